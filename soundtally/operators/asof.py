"""As-of, nearest and interval joins without range cross joins. Times are epoch milliseconds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundtally.functions.levels import day, finite


def last_at(points: DataFrame, rows: DataFrame, by: str, values: list[str], strict: bool = False, order: str | None = None) -> DataFrame:
    """points (by, ms, ...) with the values of the last of rows (by, ms, values) at or before each point, null if there is none.

    Points and rows meet by (by, day); what a day inherits is the last row of an
    earlier day, from one row a day. So a long series isn't one window partition.
    Of rows at one time the one with the largest order counts.
    """
    packed = rows.select(by, "ms", F.lit(None).cast("long").alias("__p"), F.struct("ms", *values).alias("__v"), F.col(order or "ms").alias("__o"))
    packed = packed.withColumn("__d", day(F.col("ms")))
    ends = packed.groupBy(by, "__d").agg(F.max_by("__v", F.struct("ms", "__o")).alias("__end"))
    asked = points.withColumn("__p", F.monotonically_increasing_id()).withColumn("__d", day(F.col("ms")))
    days = asked.select(by, "__d").distinct().withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType))
    earlier = Window.partitionBy(by).orderBy("__d").rangeBetween(Window.unboundedPreceding, -1)
    inherited = ends.unionByName(days).withColumn("__old", F.last("__end", True).over(earlier)).groupBy(by, "__d").agg(F.first("__old", True).alias("__old"))
    both = packed.select(by, "__d", "ms", F.lit(0 if not strict else 1).alias("__k"), "__o", "__v", F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in points.schema) + ">").alias("__q")).unionByName(
        asked.select(by, "__d", "ms", F.lit(1 if not strict else 0).alias("__k"), F.lit(None).cast(packed.schema["__o"].dataType).alias("__o"), F.lit(None).cast(packed.schema["__v"].dataType).alias("__v"), F.struct(*points.columns).alias("__q"))
    )
    here = Window.partitionBy(by, "__d").orderBy("ms", "__k", "__o").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__got", F.last("__v", True).over(here)).where("__q is not null").join(inherited, [by, "__d"], "left")
    got = met.select("__q", F.coalesce("__got", "__old").alias("__r"))
    return got.select("__q.*", F.col("__r.ms").alias("at_ms"), *[F.col(f"__r.{v}").alias(v) for v in values])


#: Least width of a bucket in which rows and spans meet, and how much wider the next class of buckets is.
LEAST_MS, WIDER = 60_000, 8


def in_intervals(rows: DataFrame, spans: DataFrame, by: str, start: str = "start_ms", end: str = "end_ms", half_open: bool = False) -> DataFrame:
    """Rows (by, ms, ...) joined with spans (by, start, end, ...) that contain them, ends included.

    Spans are told apart by length: those of a class are no longer than its buckets
    are wide, so that a span touches at most two, and a row is looked up in one bucket
    of each class that occurs. There are at most a dozen. Reversed spans hold nothing.
    """
    length = F.greatest(F.col(end) - F.col(start), F.lit(1))
    number = F.greatest(F.lit(0), F.ceil(F.log(length / LEAST_MS) / math.log(WIDER))).cast("int")
    known = spans.where(F.col(start) <= F.col(end)).withColumn("__c", number)
    classes = [r["__c"] for r in known.select("__c").distinct().collect()]
    width = F.lit(LEAST_MS) * F.pow(F.lit(float(WIDER)), F.col("__c"))
    at = lambda ms: F.floor(ms / width).cast("long")
    placed = known.withColumn("__d", F.explode(F.sequence(at(F.col(start)), at(F.col(end)))))
    asked = rows.withColumn("__c", F.explode(F.array(*map(F.lit, classes)).cast("array<int>"))).withColumn("__d", at(F.col("ms")))
    inside: Column = (F.col("ms") >= F.col(start)) & ((F.col("ms") < F.col(end)) if half_open else (F.col("ms") <= F.col(end)))
    return asked.join(placed, [by, "__c", "__d"]).where(inside).drop("__d", "__c")


def first_at(points: DataFrame, rows: DataFrame, by: str, values: list[str], strict: bool = False, order: str = "ms") -> DataFrame:
    """points with the values of the first of rows at or after each point: ``last_at`` with time reversed. Of rows at one time the one with the smallest order counts."""
    back = rows.withColumn("__w", -F.col(order)).withColumn("ms", -F.col("ms"))
    got = last_at(points.withColumn("ms", -F.col("ms")), back, by, values, strict, "__w")
    return got.withColumn("ms", -F.col("ms")).withColumn("at_ms", -F.col("at_ms"))


def nearest_at(points: DataFrame, rows: DataFrame, by: str, value: str) -> DataFrame:
    """points with the value and time (at_ms) of the nearest of rows; of two at one distance the earlier counts, at one time the smaller value."""
    before = last_at(points, rows.withColumn("__s", -F.col(value)), by, [value], order="__s")
    before = before.withColumnsRenamed({value: "__v0", "at_ms": "__t0"})
    both = first_at(before, rows, by, [value], order=value)
    early = F.col("at_ms").isNull() | (F.col("ms") - F.col("__t0") <= F.col("at_ms") - F.col("ms"))
    pick = lambda a, b: F.when(F.col("__t0").isNotNull() & early, F.col(a)).otherwise(F.col(b))
    return both.select(*points.columns, pick("__t0", "at_ms").alias("at_ms"), pick("__v0", value).alias(value))


def nearest_span(points: DataFrame, spans: DataFrame, by: str, value: str) -> DataFrame:
    """points (by, start_ms, end_ms, ...) with the value of the nearest of spans (by, start_ms, end_ms, value) and the distance to it, 0 where they meet.

    The spans of one ``by`` are disjoint. So only two come into question: the last
    that ends before the point starts, and the first that ends later. Of two at one
    distance the earlier counts. Without spans both columns are null.
    """
    ends = spans.select(by, F.col("end_ms").alias("ms"), F.struct("start_ms", F.col(value).alias("v")).alias("__s"))
    asked = points.withColumn("ms", F.col("start_ms"))
    prior = last_at(asked, ends, by, ["__s"], strict=True).withColumnsRenamed({"__s": "__s0", "at_ms": "__t0"})
    both = first_at(prior, ends, by, ["__s"])
    d0, d1 = F.col("start_ms") - F.col("__t0"), F.greatest(F.lit(0), F.col("__s.start_ms") - F.col("end_ms"))
    d1 = F.when(F.col("__s").isNotNull(), d1)
    early = F.col("__t0").isNotNull() & (d1.isNull() | (d0 <= d1))
    return both.select(*points.columns, F.when(early, F.col("__s0.v")).otherwise(F.col("__s.v")).alias(value), F.when(early, d0).otherwise(d1).alias("distance_ms"))


def recording_at(points: DataFrame, recordings: DataFrame, by: str) -> DataFrame:
    """points (by, ms, ...) with recording and offset_ms, the recording of recordings (by, recording, start_ms, end_ms) that sounds at each.

    A recording sounds from its start until before its end; those without length are
    left out. A point before the first recording gets that one at offset 0, one in a
    gap or after the last none.
    """
    rec = recordings.where("end_ms > start_ms").select(by, "recording", F.col("start_ms").alias("ms"), "end_ms")
    got = last_at(points, rec, by, ["recording", "end_ms"], order="recording")
    first = rec.groupBy(by).agg(F.min("ms").alias("__t0"), F.min_by("recording", F.struct("ms", "recording")).alias("__r0"))
    inside, early = F.col("end_ms") > F.col("ms"), F.col("ms") < F.col("__t0")
    met = got.join(first, by, "left")
    return met.select(*points.columns, F.when(inside, F.col("recording")).when(early, F.col("__r0")).alias("recording"), F.when(inside, F.col("ms") - F.col("at_ms")).when(early, F.lit(0)).alias("offset_ms"))


def match_recordings(recordings: DataFrame, segments: DataFrame, by: str = "position", near_ms: int = 7_200_000, far_ms: int = 43_200_000) -> DataFrame:
    """recordings (by, start_ms, end_ms, ...) with the nearest of segments (by, segment, start_ms, end_ms), and confidence: high up to near_ms away, medium up to far_ms, else unmatched and without start and segment."""
    got = nearest_span(recordings, segments, by, "segment")
    near = F.col("distance_ms") <= far_ms
    confidence = F.when(F.col("distance_ms") <= near_ms, "high").when(near, "medium").otherwise("unmatched")
    rest = [c for c in recordings.columns if c != "start_ms"]
    return got.select(*rest, F.when(near, F.col("start_ms")).alias("start_ms"), F.when(near, F.col("segment")).alias("segment"), confidence.alias("confidence"))


def event_windows(times: DataFrame, half_ms: int = 1_800_000) -> DataFrame:
    """times (ms, ...) with start_ms and end_ms, half a width before and after."""
    return times.withColumn("start_ms", F.col("ms") - half_ms).withColumn("end_ms", F.col("ms") + half_ms)


def window_levels(times: DataFrame, rows: DataFrame, key: str, by: str = "position", value: str = "laeq", half_ms: int = 1_800_000) -> DataFrame:
    """(key, by, n, value): number and energy mean of the rows (by, ms, value) in the windows of ``event_windows`` around times (key, ms), ends included; times that share a key count together.

    Windows are all as wide as a bucket, so that each is the end of one bucket and the
    beginning of the next. Running sums from both sides of a bucket give it without a
    pair of time and row, and without a difference of large sums. Rows and windows of
    one millisecond are one row before they are ordered.
    """
    width = 2 * half_ms
    bucket = F.floor(F.col("ms") / width).cast("long")
    level = finite(F.col(value))
    sums = ["__n", "__c", "__e"]
    add = [F.sum(c).alias(c) for c in sums]
    here = rows.where("ms is not null").select(F.col(by), F.col("ms").cast("long").alias("ms"), F.lit(1).cast("long").alias("__n"), level.isNotNull().cast("long").alias("__c"), F.pow(F.lit(10.0), level / 10).alias("__e"))
    here = here.groupBy(by, "ms").agg(*add).withColumn("__b", bucket)
    asked = event_windows(times.where("ms is not null").select(F.col("ms").cast("long").alias("ms")).distinct(), half_ms)
    ends = asked.select(F.explode(F.array(F.struct(F.col("start_ms").alias("ms"), F.lit(1).alias("__from"), F.lit(0).alias("__to")), F.struct(F.col("end_ms").alias("ms"), F.lit(0).alias("__from"), F.lit(1).alias("__to")))).alias("x")).select("x.*")
    ends = ends.withColumn("__b", bucket).join(here.select("__b", by).distinct(), "__b")
    none = [F.lit(0).cast("long").alias("__n"), F.lit(0).cast("long").alias("__c"), F.lit(None).cast("double").alias("__e")]
    both = here.withColumn("__from", F.lit(0)).withColumn("__to", F.lit(0)).unionByName(ends.select(by, "__b", "ms", *none, "__from", "__to"))
    one = both.groupBy(by, "__b", "ms").agg(*add, F.max("__from").alias("__from"), F.max("__to").alias("__to"))
    upto = lambda order: Window.partitionBy(by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = one.select("*", *[F.sum(c).over(upto(F.asc("ms"))).alias(f"{c}_to") for c in sums]).select("*", *[F.sum(c).over(upto(F.desc("ms"))).alias(f"{c}_from") for c in sums])
    part = lambda side, shift: F.when(F.col(f"__{side}") == 1, F.struct((F.col("ms") + shift).alias("ms"), *[F.col(f"{c}_{side}").alias(c) for c in sums]))
    parts = run.select(by, F.explode(F.array(part("from", half_ms), part("to", -half_ms))).alias("p")).where("p.__n > 0").select(by, "p.*")
    met = times.select(key, F.col("ms").cast("long").alias("ms")).join(parts, "ms").groupBy(key, by).agg(*add)
    mean = F.when(F.col("__e") > 1e-12, 10 * F.log10(F.col("__e") / F.col("__c")))
    return met.select(key, by, F.col("__n").alias("n"), mean.alias(value))


def marker_metrics(markers: DataFrame, levels: DataFrame, by: str = "position") -> DataFrame:
    """markers (by, ms, ...) with at_ms, parameter and value of the last row of levels (by, ms, event_id, laeq, lzeq) at or before each: LAeq where the position has it, else LZeq."""
    has = levels.groupBy(by).agg((F.count("laeq") > 0).alias("__a"), (F.count("lzeq") > 0).alias("__z"))
    got = last_at(markers, levels, by, ["laeq", "lzeq"], order="event_id").join(has, by, "left")
    name = F.when(F.col("at_ms").isNotNull(), F.when(F.col("__a"), "LAeq").when(F.col("__z"), "LZeq"))
    value = F.when(name == "LAeq", F.col("laeq")).when(name == "LZeq", F.col("lzeq"))
    return got.select(*markers.columns, "at_ms", name.alias("parameter"), value.alias("value"))
