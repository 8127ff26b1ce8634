"""Sets of time intervals, region calendars and region metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundtally.functions import levels as L
from soundtally.functions.levels import DAY_MS, HOUR_MS, day
from soundtally.operators.asof import in_intervals
from soundtally.sources.place import cut


def merged(areas: DataFrame, by: list[str]) -> DataFrame:
    """Disjoint areas: ends swapped where reversed, empty ones left out, overlapping and touching ones joined.

    Windows span the areas that begin on one day of one ``by``; what earlier days
    reach to, and how many islands they began, comes from one row a day.
    """
    a = areas.select(*by, F.least("start_ms", "end_ms").alias("s"), F.greatest("start_ms", "end_ms").alias("e")).where("s < e").withColumn("__d", day(F.col("s")))
    days = Window.partitionBy(*by).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    reach = a.groupBy(*by, "__d").agg(F.max("e").alias("__m")).select(*by, "__d", F.max("__m").over(days).alias("__reach"))
    w = Window.partitionBy(*by, "__d").orderBy("s", "e")
    upto = F.greatest(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__reach"))
    fresh = a.join(reach, [*by, "__d"]).withColumn("__new", F.coalesce((F.col("s") > upto).cast("int"), F.lit(1)))
    began = fresh.groupBy(*by, "__d").agg(F.sum("__new").alias("__k")).select(*by, "__d", F.coalesce(F.sum("__k").over(days), F.lit(0)).alias("__base"))
    island = fresh.withColumn("__in", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(began, [*by, "__d"]).withColumn("__i", F.col("__base") + F.col("__in"))
    return island.groupBy(*by, "__i").agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms")).drop("__i")


def valid_ranges(rows: DataFrame, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Rows whose range begins at or after 0 and ends after it begins."""
    return rows.where((F.col(start) >= 0) & (F.col(end) > F.col(start)))


def day_night(extent: DataFrame, by: str = "position", zone: str = "UTC") -> DataFrame:
    """Daytime (07-23) and nighttime (23-07) intervals of each extent (by, lo, hi), clamped to it; empty ones left out.

    The first day begins at local midnight, the next ones 24 hours later each, up to
    the local midnight before the extent's end.
    """
    local = lambda ms: F.from_utc_timestamp(F.timestamp_millis(ms), zone)
    midnight = lambda ms: F.unix_millis(F.to_utc_timestamp(F.date_trunc("day", local(ms)), zone))
    d = extent.where("lo <= hi").withColumn("d", F.explode(F.sequence(midnight(F.col("lo")), midnight(F.col("hi")), F.lit(DAY_MS))))
    modes = F.explode(F.array(F.struct(F.lit("daytime").alias("mode"), F.lit(7).alias("a"), F.lit(23).alias("b")), F.struct(F.lit("nighttime").alias("mode"), F.lit(23).alias("a"), F.lit(31).alias("b"))))
    r = d.withColumn("m", modes).select(by, "m.mode", "lo", "hi", (F.col("d") + F.col("m.a") * HOUR_MS).alias("s"), (F.col("d") + F.col("m.b") * HOUR_MS).alias("e"))
    return r.select(by, "mode", F.greatest("s", "lo").alias("start_ms"), F.least("e", "hi").alias("end_ms")).where("start_ms < end_ms")


def auto_regions(extent: DataFrame, modes: list[str], by: str = "position", zone: str = "UTC") -> DataFrame:
    """by, mode, note, areas of the day and night regions of each extent: of several modes one region each with all its intervals; of one mode a region for each interval, numbered where there are more."""
    r = day_night(extent, by, zone).where(F.col("mode").isin(modes))
    areas = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms")))
    title = F.concat(F.initcap("mode"), F.lit(" - "), F.col(by))
    whole = r.groupBy(by, "mode").agg(areas.alias("areas"))
    if len(set(modes)) > 1:
        return whole.select(by, "mode", title.alias("note"), "areas")
    one = whole.select(by, "mode", F.size("areas").alias("n"), F.posexplode("areas").alias("i", "a"))
    suffix = F.when(F.col("n") > 1, F.concat(F.lit(" ("), (F.col("i") + 1).cast("string"), F.lit(")"))).otherwise("")
    return one.select(by, "mode", F.concat(title, suffix).alias("note"), F.array("a").alias("areas"))


def source_areas(areas: DataFrame, offsets: DataFrame | None) -> DataFrame:
    """Areas in the times of the data: shown times less the position's chart_offset_ms, of at most an hour either way."""
    if offsets is None:
        return areas
    off = F.greatest(F.lit(-HOUR_MS), F.least(F.lit(HOUR_MS), F.coalesce("chart_offset_ms", F.lit(0))))
    return areas.join(offsets.select("position", "chart_offset_ms"), "position", "left").withColumns({"start_ms": F.col("start_ms") - off, "end_ms": F.col("end_ms") - off}).drop("chart_offset_ms")


def region_metrics(levels: DataFrame, areas: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """Per region of areas (region_id, position, start_ms, end_ms), which are disjoint: dataset, laeq, lafmax, la90, la90_available, duration_ms.

    levels: position, profile, ms, laeq, lafmax, laf90. The log is used where it has a
    level there, else the overview. L90 comes from the measured LAF90 where there is
    one, else from the levels, and counts as available from the log alone. Areas are
    shown times; offsets (position, chart_offset_ms) lead to the data's.
    """
    met = in_intervals(levels, source_areas(areas, offsets).where("start_ms < end_ms"), "position")
    of = lambda p, c: F.when(F.col("profile") == p, F.col(c))
    short = (("log", "log"), ("over", "overview"))
    both = met.groupBy("region_id").agg(
        *[F.count(L.finite(of(p, "laeq"))).alias(f"n_{n}") for n, p in short],
        *[L.laeq(of(p, "laeq")).alias(f"laeq_{n}") for n, p in short],
        *[L.lafmax(of(p, "lafmax")).alias(f"lafmax_{n}") for n, p in short],
        *[F.coalesce(L.l_n(of(p, "laf90"), 90), L.l_n(of(p, "laeq"), 90)).alias(f"la90_{n}") for n, p in short],
    )
    length = areas.groupBy("region_id", "position").agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("duration_ms"))
    r = length.join(both, "region_id", "left")
    use = F.when(F.col("n_log") > 0, "log").when(F.col("n_over") > 0, "overview").otherwise("none")
    pick = lambda c: F.when(F.col("n_log") > 0, F.col(f"{c}_log")).when(F.col("n_over") > 0, F.col(f"{c}_over"))
    out = r.select("region_id", "position", "duration_ms", use.alias("dataset"), pick("laeq").alias("laeq"), pick("lafmax").alias("lafmax"), pick("la90").alias("la90"))
    return out.withColumn("la90_available", (F.col("dataset") == "log") & F.col("la90").isNotNull())


def region_spectra(spectra: DataFrame, areas: DataFrame, selected: str | None = None, offsets: DataFrame | None = None) -> DataFrame:
    """region_id, param, source, freq_hz, laeq: each region's mean spectrum.

    spectra: position, profile, param, ms, freq_hz, level. The parameter is the
    selected one where the position has it, else LZeq; its log is used where there is
    one, else its overview.
    """
    wish = F.when(F.col("param") == F.lit(selected), 0).when(F.col("param") == "LZeq", 1)
    kinds = spectra.select("position", "profile", "param").distinct().withColumn("__wish", wish).where("__wish is not null and profile in ('log', 'overview')")
    best = kinds.groupBy("position").agg(F.min(F.struct("__wish", F.col("profile") == "overview", "profile", "param")).alias("b")).select("position", "b.profile", "b.param")
    used = spectra.join(best, ["position", "profile", "param"])
    met = in_intervals(used, source_areas(areas, offsets).where("start_ms < end_ms"), "position")
    return met.groupBy("region_id", "param", F.col("profile").alias("source"), "freq_hz").agg(L.laeq(F.col("level")).alias("laeq"))


def compare_positions(levels: DataFrame, slices: DataFrame, positions: DataFrame, selected: str = "LAeq") -> DataFrame:
    """A row for each of slices (slice_id, start_ms, end_ms) and positions (position): the metrics of the slice at the position.

    levels: position, profile, ms, laeq, lafmax, value, the last being the selected
    parameter's level. The log is used where it has the parameter or a level in the
    slice, else the overview. broadband is the energy mean of the parameter, or of
    the levels where it has none there, and laeq the other way about. L90 comes from
    the log's levels alone. has_data is true in all rows of a slice of which one has a
    level. The rows are as many as slices times positions by definition.
    """
    spans = slices.select("slice_id", F.least("start_ms", "end_ms").alias("start_ms"), F.greatest("start_ms", "end_ms").alias("end_ms"))
    grid = spans.crossJoin(positions.select("position").distinct())
    met = in_intervals(levels, grid, "position")
    of = lambda p, c: F.when(F.col("profile") == p, F.col(c))
    sides = (("log", "log"), ("over", "overview"))
    both = met.groupBy("slice_id", "position").agg(
        *[F.count(L.finite(of(p, c))).alias(f"n_{c}_{n}") for n, p in sides for c in ("laeq", "value")],
        *[L.laeq(of(p, c)).alias(f"{c}_{n}") for n, p in sides for c in ("laeq", "value")],
        *[L.lafmax(of(p, "lafmax")).alias(f"lafmax_{n}") for n, p in sides],
        *[L.l_n(of("log", c), 90).alias(f"la90_{c}") for c in ("laeq", "value")],
    )
    r = grid.join(both, ["slice_id", "position"], "left")
    has = lambda n: (F.col(f"n_laeq_{n}") > 0) | (F.col(f"n_value_{n}") > 0)
    use = F.when(has("log"), "log").when(has("over"), "overview").otherwise("none")
    pick = lambda c: F.when(has("log"), F.col(f"{c}_log")).when(has("over"), F.col(f"{c}_over"))
    own = F.coalesce(pick("n_value") > 0, F.lit(True))
    out = r.select(
        "slice_id", "position", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), use.alias("dataset"),
        F.when(pick("n_laeq") > 0, pick("laeq")).otherwise(pick("value")).alias("laeq"),
        F.when(own, F.lit(selected)).otherwise("LAeq").alias("parameter"), F.when(own, pick("value")).otherwise(pick("laeq")).alias("broadband"),
        pick("lafmax").alias("lafmax"), F.when(use == "log", F.when(F.col("n_laeq_log") > 0, F.col("la90_laeq")).otherwise(F.col("la90_value"))).alias("la90"),
    )
    any_ = out.groupBy("slice_id").agg(F.bool_or(F.coalesce("laeq", "broadband", "lafmax").isNotNull()).alias("has_data"))
    return out.join(any_, "slice_id").withColumn("la90_available", F.col("la90").isNotNull())


def compare_spectra(spectra: DataFrame, compared: DataFrame, slices: DataFrame, selected: str) -> DataFrame:
    """slice_id, position, source, freq_hz, laeq: the mean spectrum of the selected parameter in each slice at each position of compared (slice_id, position, dataset), see ``compare_positions``.

    Where the log was chosen the position's log spectra count, if it has any of the
    parameter; else its overview's. A position without a dataset has no spectrum.
    """
    own = spectra.where(F.col("param") == selected).select("position", "profile", "ms", "freq_hz", "level")
    has = own.groupBy("position").agg(F.bool_or(F.col("profile") == "log").alias("__log"))
    asked = compared.where("dataset <> 'none'").select("slice_id", "position", "dataset").join(has, "position")
    source = F.when((F.col("dataset") == "log") & F.col("__log"), "log").otherwise("overview")
    ends = slices.select("slice_id", F.least("start_ms", "end_ms").alias("start_ms"), F.greatest("start_ms", "end_ms").alias("end_ms"))
    spans = asked.select("slice_id", "position", source.alias("source")).join(ends, "slice_id")
    met = in_intervals(own, spans, "position").where("profile = source")
    return met.groupBy("slice_id", "position", "source", "freq_hz").agg(L.laeq(F.col("level")).alias("laeq"))


def merge_regions(areas: DataFrame, pairs: DataFrame) -> DataFrame:
    """Areas (region_id, position, start_ms, end_ms) after the merges of pairs (region_id, target_id): a region goes into a target of its own position, else stays."""
    place = areas.select(F.col("region_id").alias("target_id"), F.col("position").alias("__there")).distinct()
    moved = areas.join(pairs, "region_id", "left").join(place, "target_id", "left")
    own = F.when(F.col("__there") == F.col("position"), F.col("target_id")).otherwise(F.col("region_id"))
    return merged(moved.select(own.alias("region_id"), "position", "start_ms", "end_ms"), ["region_id", "position"])


def split_regions(areas: DataFrame) -> DataFrame:
    """Areas with part: 0 for a region's only area, else 1, 2, ... in order of time."""
    w = Window.partitionBy("region_id")
    n, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("start_ms", "end_ms"))
    return areas.withColumn("part", F.when(n > 1, k).otherwise(0).cast("long"))


def with_ids(regions: DataFrame, order: str, given: str, by: str) -> DataFrame:
    """regions with id, numbered within each ``by`` in order: a given id stays where none has it yet, else the region gets one more than the largest so far, from 1.

    Which ids are taken depends on the rows before. A pass takes the regions that
    have to be numbered for known and finds the largest id at each by a running sum
    and a running maximum; it is repeated while given ids turn out to be taken.
    """
    w = Window.partitionBy(by).orderBy(order)
    r = regions.withColumn("__g", F.col(given).cast("long"))
    again = F.row_number().over(Window.partitionBy(by, "__g").orderBy(order)) > 1
    state = r.withColumn("__new", F.col("__g").isNull() | again)
    while True:
        count = F.sum(F.col("__new").cast("long")).over(w)
        numbered = state.withColumn("__k", count)
        # the largest id is the largest of 0 and each given one, and one more for each new one since
        most = F.greatest(F.lit(0), F.max(F.when(~F.col("__new"), F.col("__g") - F.col("__k"))).over(w))
        done = numbered.withColumn("id", F.when(F.col("__new"), F.col("__k") + F.coalesce(most, F.lit(0))).otherwise(F.col("__g"))).drop("__k")
        taken = done.where("__new").select(by, F.col("id").alias("__g"), F.col(order).alias("__at")).groupBy(by, "__g").agg(F.min("__at").alias("__at"))
        met = done.join(taken, [by, "__g"], "left")
        late = ~F.col("__new") & (F.col("__at") < F.col(order))
        first = met.where(late).groupBy(by).agg(F.min(order).alias("__first"))
        state = cut(met.join(first, by, "left").withColumn("__late", F.coalesce(F.col(order) == F.col("__first"), F.lit(False))))
        if state.where("__late").isEmpty():
            return state.select(*regions.columns, "id")
        state = state.withColumn("__new", F.col("__new") | F.col("__late")).drop("__at", "__first", "__late", "id")
