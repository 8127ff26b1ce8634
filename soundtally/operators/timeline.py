"""Gaps, segments, cadence and downsampling of time series (position, ms, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundtally.functions.levels import DAY_MS, day


def deltas(rows: DataFrame, by: str = "position") -> DataFrame:
    """rows with delta, the milliseconds since the row before.

    Windows span one day of one ``by``; a day's first row takes the last time of
    the day before it that has rows, from one row a day. So a long series isn't
    one window partition. Rows without ``by`` meet within their day only.
    """
    d = rows.withColumn("__d", day(F.col("ms")))
    last = d.groupBy(by, "__d").agg(F.max("ms").alias("__last"))
    carry = last.select(by, "__d", F.lag("__last").over(Window.partitionBy(by).orderBy("__d")).alias("__before"))
    here = Window.partitionBy(by, "__d").orderBy("ms", "event_id")
    met = d.join(carry, [by, "__d"], "left").withColumn("delta", F.col("ms") - F.coalesce(F.lag("ms").over(here), F.col("__before")))
    return met.select(*rows.columns, "delta")


def interval_end(rows: DataFrame, step_ms: int, by: str = "position") -> DataFrame:
    """rows with end_ms, the time of the next row; of the last one its own plus step_ms. Days as in ``deltas``."""
    d = rows.withColumn("__d", day(F.col("ms")))
    first = d.groupBy(by, "__d").agg(F.min("ms").alias("__first"))
    carry = first.select(by, "__d", F.lead("__first").over(Window.partitionBy(by).orderBy("__d")).alias("__after"))
    here = Window.partitionBy(by, "__d").orderBy("ms", "event_id")
    met = d.join(carry, [by, "__d"], "left").withColumn("end_ms", F.coalesce(F.lead("ms").over(here), F.col("__after"), F.col("ms") + step_ms))
    return met.select(*rows.columns, "end_ms")


def segments(rows: DataFrame, by: str = "position", least_gap_ms: int = 300_000, times_median: float = 5.0) -> DataFrame:
    """Runs without a gap of over max(least_gap_ms, times_median * median delta): by, segment, start_ms, end_ms, n.

    A day's segments go on from the number of gaps in the days before it.
    """
    d = deltas(rows, by)
    typical = d.groupBy(by).agg(F.greatest(F.lit(float(least_gap_ms)), times_median * F.percentile("delta", 0.5)).alias("limit"))
    gap = F.coalesce((F.col("delta") > F.col("limit")).cast("long"), F.lit(0))
    cut = d.join(typical, by).select(by, "ms", "event_id", day(F.col("ms")).alias("__d"), gap.alias("__gap"))
    earlier = Window.partitionBy(by).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    upto = cut.groupBy(by, "__d").agg(F.sum("__gap").alias("__g")).select(by, "__d", F.coalesce(F.sum("__g").over(earlier), F.lit(0)).alias("__upto"))
    here = Window.partitionBy(by, "__d").orderBy("ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = cut.join(upto, [by, "__d"]).withColumn("segment", F.col("__upto") + F.sum("__gap").over(here))
    return numbered.groupBy(by, "segment").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count(F.lit(1)).alias("n"))


def ranked(rows: DataFrame, order: str, width: int = 4096, tie: str | None = None) -> DataFrame:
    """rows with rank, from 1, by a whole-number order and, where that is equal, tie.

    Counts of ranges of ``width`` orders are summed up inside blocks of 4,096 ranges,
    and those blocks in turn, so that the last window has one row for 16 million
    orders at the usual width; rows are ranked within their range.
    """
    b = rows.withColumn("__b", F.floor(F.col(order) / width))
    n = b.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__bb", F.floor(F.col("__b") / 4096))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = n.groupBy("__bb").agg(F.sum("__n").alias("__m")).select("__bb", F.coalesce(F.sum("__m").over(earlier(Window.orderBy("__bb"))), F.lit(0)).alias("__base"))
    inside = F.coalesce(F.sum("__n").over(earlier(Window.partitionBy("__bb").orderBy("__b"))), F.lit(0))
    upto = n.withColumn("__in", inside).join(blocks, "__bb").select("__b", (F.col("__base") + F.col("__in")).alias("__upto"))
    here = Window.partitionBy("__b").orderBy(order, *([tie] if tie else []))
    return b.join(upto, "__b").withColumn("rank", F.col("__upto") + F.row_number().over(here)).drop("__b", "__upto")


def sample_period(rows: DataFrame, by: str = "position") -> DataFrame:
    """Smallest most frequent step in seconds of rows with distinct times: of two rows their delta; else of the deltas but the last, five at each end left out where over 20 remain.

    The ends are found by their times, so that no series is numbered as a whole.
    """
    end = lambda order, pick, name: rows.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("__k <= 6").groupBy(by).agg(pick("ms").alias(name))
    size = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n"), F.max("ms").alias("__last"))
    ends = size.join(end(F.asc("ms"), F.max, "__lo"), by).join(end(F.desc("ms"), F.min, "__hi"), by)
    d = deltas(rows.withColumn("event_id", F.lit(0)), by).join(ends, by)
    inside = F.when(F.col("__n") == 2, True).when(F.col("__n") - 2 > 20, (F.col("ms") > F.col("__lo")) & (F.col("ms") < F.col("__hi"))).otherwise(F.col("ms") < F.col("__last"))
    return d.withColumn("step", F.when(inside, F.col("delta"))).groupBy(by).agg(F.round(F.mode("step", True) / 1000, 3).alias("period_s"))


def time_step(rows: DataFrame, by: str = "position", first: int = 32) -> DataFrame:
    """Median of the positive steps among the first stamps."""
    w = Window.partitionBy(by).orderBy("ms")
    early = rows.withColumn("i", F.row_number().over(w)).where(F.col("i") <= first)
    d = early.withColumn("delta", F.col("ms") - F.lag("ms").over(w))
    return d.where("delta > 0").groupBy(by).agg(F.percentile("delta", 0.5).alias("step_ms"))


def upper_median_step(rows: DataFrame, by: str = "position", pairs: int = 4000) -> DataFrame:
    """The upper median of the positive steps among the first pairs of stamps: of an even number the larger middle one."""
    w = Window.partitionBy(by).orderBy("ms")
    early = rows.withColumn("i", F.row_number().over(w)).where(F.col("i") <= pairs + 1)
    d = early.withColumn("delta", F.col("ms") - F.lag("ms").over(w)).where("delta > 0")
    steps = d.groupBy(by).agg(F.array_sort(F.collect_list("delta")).alias("s"))  # at most ``pairs`` of each
    return steps.select(by, F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("step_ms"))


def downsample_max(rows: DataFrame, values: list[str], target: int, by: str = "position", tie: str = "event_id") -> DataFrame:
    """Series (by, ms, values) of at most about target rows: by, ms, values.

    A series of up to target rows stays as it is. A longer one is cut into buckets of
    ceil(span / target) ms, from midnight of its first day on, that keep each value's
    largest; one without span keeps its first target rows in order of ``tie``.
    """
    span = rows.groupBy(by).agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"), F.count(F.lit(1)).alias("n"))
    step = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / target))
    kind = F.when(F.col("n") <= target, "whole").when(F.col("hi") <= F.col("lo"), "first").otherwise("buckets")
    grid = span.select(by, (F.floor(F.col("lo") / DAY_MS) * DAY_MS).alias("day0"), step.alias("step"), kind.alias("__kind"))
    met = rows.join(grid, by)
    w = Window.partitionBy(by).orderBy(tie)
    first = met.where("__kind = 'first'").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= target)
    b = met.where("__kind = 'buckets'").withColumn("bucket", F.floor((F.col("ms") - F.col("day0")) / F.col("step")).cast("long"))
    out = b.groupBy(by, "bucket").agg(*[F.max(v).alias(v) for v in values], F.first("day0").alias("day0"), F.first("step").alias("step"))
    cut = out.select(by, (F.col("day0") + F.col("bucket") * F.col("step")).cast("long").alias("ms"), *values)
    return met.where("__kind = 'whole'").select(by, "ms", *values).unionByName(first.select(by, "ms", *values)).unionByName(cut)


def between(rows: DataFrame, start: Column | int, end: Column | int) -> DataFrame:
    """Rows (ms, ...) from start to end, both included; reversed bounds are swapped."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return rows.where((F.col("ms") >= F.least(a, b)) & (F.col("ms") <= F.greatest(a, b)))


def is_spot(start: Column, end: Column) -> Column:
    """Whether a measurement lasts less than an hour; an unknown length isn't spot."""
    return F.coalesce(end - start < 3_600_000, F.lit(False))


def presence(rows: DataFrame, by: str = "position") -> DataFrame:
    """by, has_overview, has_log, has_overview_spectra, has_log_spectra of rows (by, profile, spectral)."""
    has = lambda p, s: F.coalesce(F.bool_or((F.col("profile") == p) & (F.col("spectral") == s)), F.lit(False))
    return rows.groupBy(by).agg(has("overview", False).alias("has_overview"), has("log", False).alias("has_log"), has("overview", True).alias("has_overview_spectra"), has("log", True).alias("has_log_spectra"))


def in_position_order(rows: DataFrame, order: list[str], by: str = "position") -> DataFrame:
    """rows with place: positions that the configuration lists first, in its order, then the others by name."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(by)) if order else F.lit(0)
    names = rows.select(by).distinct().withColumn("__at", F.when(at > 0, at).otherwise(len(order) + 1))
    # one row a position
    placed = names.withColumn("place", F.row_number().over(Window.orderBy("__at", by)).cast("long")).drop("__at")
    return rows.join(placed, by)


def aligned(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two report blocks side by side on the union of their keys; a block's columns are null where it lacks one."""
    return left.join(right, keys, "full")


def merge_sources(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, found by partial aggregation, so that a key's many copies meet in no task."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return first.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in rows.columns])


def head(rows: DataFrame, n: int, by: str = "position") -> DataFrame:
    """The first n rows of each ``by``; Spark cuts each task's rows to n before the shuffle."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy("ms", "event_id"))).where(F.col("__n") <= n).drop("__n")
