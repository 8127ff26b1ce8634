"""Spectra in long form (position, ms, freq_hz, level): averages, rasters and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundtally.functions.levels import finite, laeq, quantised
from soundtally.operators.asof import last_at
from soundtally.operators.timeline import interval_end


def mean_spectrum(spectra: DataFrame, by: list[str]) -> DataFrame:
    return spectra.groupBy(*by, "freq_hz").agg(laeq(F.col("level")).alias("laeq"))


def quantise(spectra: DataFrame, by: str = "position") -> DataFrame:
    """Levels as small integers over each position's range, 0 to 100 where nothing is finite."""
    r = spectra.groupBy(by).agg(F.coalesce(F.min(finite(F.col("level"))), F.lit(0.0)).alias("lo"), F.coalesce(F.max(finite(F.col("level"))), F.lit(100.0)).alias("hi"))
    return spectra.join(r, by).withColumn("level", quantised(F.col("level"), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def rasterise(spectra: DataFrame, bins: int, step_ms: float | None = None, by: str = "position", fill: float | None = None) -> DataFrame:
    """(by, freq_hz, bin, level): each position's spectra on a fixed number of time bins over the span from its first to its last time.

    A spectrum paints the bins that it reaches into until the next one, at least one,
    with the largest level; the last one lasts for step_ms, or as long as the one before
    it where none is given, and paints the last bin. As many times as bins keep their
    places, and a single time fills all of them. With a fill each bin of each band has a
    row: the fill is the least level, and stands where nothing was painted.
    """
    times = spectra.select(by, "ms", F.lit(0).alias("event_id")).distinct()
    ends = interval_end(times, 0, by).select(by, "ms", F.col("end_ms").alias("end"))
    last = F.col("ms") == F.col("t1")
    span = ends.groupBy(by).agg(F.min("ms").alias("t0"), F.max("ms").alias("t1"), F.max(F.when(F.col("end") > F.col("ms"), F.col("ms"))).alias("prev"), F.count(F.lit(1)).alias("n"))
    place = ends.join(span, by).withColumn("w", (F.col("t1") - F.col("t0")) / bins)
    every = F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<long>")
    # as many times as bins
    order = Window.partitionBy(by).orderBy("ms")
    kept = place.where(F.col("n") == bins).select(by, "ms", (F.row_number().over(order) - 1).cast("long").alias("bin"))
    alone = place.where((F.col("n") == 1) & (F.col("n") != bins)).select(by, "ms", F.explode(every).alias("bin"))
    length = F.lit(float(step_ms)) if step_ms and step_ms > 0 else F.greatest(F.col("t1") - F.col("prev"), F.col("w"), F.lit(1.0))
    until = F.when(last, F.col("ms") + length).otherwise(F.col("end"))
    first = F.least(F.floor((F.col("ms") - F.col("t0")) / F.col("w")), F.lit(bins - 1))
    stop = F.least(F.greatest(F.ceil((until - F.col("t0")) / F.col("w")), first + 1), F.lit(bins))
    painted = place.where((F.col("n") > 1) & (F.col("n") != bins)).select(by, "ms", F.explode(F.sequence(first, stop - 1)).alias("bin"))
    cells = spectra.join(kept.unionByName(alone).unionByName(painted), [by, "ms"]).groupBy(by, "freq_hz", "bin").agg(F.max("level").alias("level"))
    if fill is None:
        return cells
    grid = spectra.select(by, "freq_hz").distinct().select(by, "freq_hz", F.explode(every).alias("bin"))
    return grid.join(cells, [by, "freq_hz", "bin"], "left").withColumn("level", F.greatest("level", F.lit(float(fill))))


def pack(cells: DataFrame, by: str = "position") -> DataFrame:
    """One row a band: its levels in order of bins."""
    a = F.array_sort(F.collect_list(F.struct("bin", "level")))
    return cells.groupBy(by, "freq_hz").agg(F.transform(a, lambda x: x["level"]).alias("levels"))


def level_range(spectra: DataFrame, by: str = "position") -> DataFrame:
    """Least and largest finite level, 0 and 100 where there is none."""
    x = finite(F.col("level"))
    return spectra.groupBy(by).agg(F.coalesce(F.min(x), F.lit(0.0)).alias("lo"), F.coalesce(F.max(x), F.lit(100.0)).alias("hi"))


def band_range(spectra: DataFrame, ranges: DataFrame, by: str = "position") -> DataFrame:
    """Bands within each position's range of ranges (by, lo, hi); all bands where none is within."""
    r = spectra.join(ranges, by)
    inside = F.col("freq_hz").between(F.col("lo"), F.col("hi"))
    hit = r.groupBy(by).agg(F.max(inside).alias("__hit"))
    return r.join(hit, by).where(inside | ~F.col("__hit")).select(*spectra.columns)


def spectrum_at(points: DataFrame, spectra: DataFrame, low: float, high: float, by: str = "position") -> DataFrame:
    """points (by, ms, ...) with each band between low and high of the last spectrum at or before them; a missing level is 0."""
    times = spectra.select(by, "ms").distinct()
    at = last_at(points, times, by, []).where("at_ms is not null")
    bands = spectra.where(F.col("freq_hz").between(low, high)).withColumnRenamed("ms", "at_ms")
    return at.join(bands, [by, "at_ms"]).withColumn("level", F.coalesce(finite(F.col("level")), F.lit(0.0)))


def align(spectra: DataFrame, by: str = "position") -> DataFrame:
    """Every position's mean levels on the bands of the position with most of them (of equals, the first by name); null where it lacks one."""
    mean = mean_spectrum(spectra, [by])
    n = mean.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    base = n.agg(F.min_by(by, F.struct(-F.col("n"), by)).alias(by))
    bands = mean.join(F.broadcast(base), by).agg(F.collect_set("freq_hz").alias("bands"))
    grid = n.join(F.broadcast(bands)).select(by, F.explode("bands").alias("freq_hz"))
    return grid.join(mean, [by, "freq_hz"], "left")


def choose_resolution(requests: DataFrame, thresholds: DataFrame, limit_s: float, default_s: float, by: str = "position") -> DataFrame:
    """requests (by, span_s, manual_s, ...) with dataset: log where the span is within the threshold, else overview.

    The threshold is the manual one; else of thresholds (by, has_log, threshold_s)
    the position's own, the smallest of all where it has none, the limit where it
    has no log. It never exceeds the limit.
    """
    shared = thresholds.agg(F.coalesce(F.min(F.when(F.col("threshold_s") > 0, F.col("threshold_s"))), F.lit(float(default_s))).alias("__shared"))
    own = F.when(~F.coalesce("has_log", F.lit(False)), F.lit(float(limit_s))).when(F.col("threshold_s") > 0, F.col("threshold_s")).otherwise(F.col("__shared"))
    t = F.least(F.when(F.col("manual_s") > 0, F.col("manual_s")).otherwise(own), F.lit(float(limit_s)))
    met = requests.join(thresholds, by, "left").join(F.broadcast(shared))
    return met.select(*requests.columns, t.alias("used_s"), F.when(F.abs("span_s") <= t, "log").otherwise("overview").alias("dataset"))
