import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from soundtally.functions import levels as L
from soundtally.operators import asof, regions, spectrogram, timeline
from soundtally.plans import registry
from soundtally.sources import readers

SF = "/root/testdata/sf0.001"


def one(spark, values, f):
    return spark.createDataFrame([(v,) for v in values], "x double").agg(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("values, want", [([50.0, 60.0], 57.4), ([80.0, 40.0, 60.0, 70.0, 30.0, 50.0], 72.7), ([float("nan"), 50.0, None, float("inf")], 50.0)])
def test_energy_mean(spark, values, want):
    assert round(one(spark, values, L.laeq), 1) == want


def test_no_levels(spark):
    assert one(spark, [], L.laeq) is None and one(spark, [float("nan")], L.lafmax) is None


def test_l90(spark):
    assert one(spark, [80.0, 40.0, 60.0, 70.0, 50.0], lambda c: L.l_n(c, 90)) == pytest.approx(44)


def test_frequencies(spark):
    df = spark.createDataFrame([("1k",), ("1 kHz",), ("31.5_Hz",), ("63",), ("x",)], "s string")
    assert [r[0] for r in df.select(L.frequency_hz(F.col("s"))).collect()] == [1000, 1000, 31.5, 63, None]


def painted(spark, seconds, bins, step_ms=None, fill=None, levels=(60.0, 70.0)):
    rows = [("p", t * 1000, f, b + i) for i, t in enumerate(seconds) for f, b in zip((100, 200), levels, strict=True)]
    out = spectrogram.pack(spectrogram.rasterise(spark.createDataFrame(rows, "position string, ms long, freq_hz int, level double"), bins, step_ms, fill=fill))
    return {r["freq_hz"]: r["levels"] for r in out.collect()}


@pytest.mark.parametrize("step_ms", [None, 0, 1000, 10_000])
def test_rasterise(spark, step_ms):
    assert painted(spark, (0, 10, 20), 6, step_ms) == {100: [60, 60, 60, 61, 61, 62], 200: [70, 70, 70, 71, 71, 72]}


def test_rasterise_as_many_times_as_bins(spark):
    assert painted(spark, (0, 1, 20), 3, 1000)[100] == [60, 61, 62] and painted(spark, (7,), 1)[100] == [60]


def test_rasterise_one_time(spark):
    assert painted(spark, (7,), 4, 0) == {100: [60] * 4, 200: [70] * 4}


def test_rasterise_takes_the_largest_and_fills(spark):
    assert painted(spark, (0, 1, 2, 3, 4), 2)[100] == [61, 64]
    rows = [("p", 0, 100, 60.0), ("p", 10_000, 200, 50.0), ("p", 20_000, 100, 10.0)]
    out = spectrogram.pack(spectrogram.rasterise(spark.createDataFrame(rows, "position string, ms long, freq_hz int, level double"), 4, fill=20))
    assert {r["freq_hz"]: r["levels"] for r in out.collect()} == {100: [60, 60, 20, 20], 200: [20, 20, 50, 50]}


def test_segments(spark):
    rows = [("p", m * 60_000, i) for i, m in enumerate((0, 1, 2, 20, 21))]
    got = timeline.segments(spark.createDataFrame(rows, "position string, ms long, event_id long")).orderBy("start_ms").collect()
    assert [(r["start_ms"] // 60_000, r["end_ms"] // 60_000) for r in got] == [(0, 2), (20, 21)]


def test_merge_touching_and_reversed(spark):
    df = spark.createDataFrame([("p", 10, 0), ("p", 10, 20), ("p", 30, 30), ("p", 40, 50)], "position string, start_ms long, end_ms long")
    assert sorted((r["start_ms"], r["end_ms"]) for r in regions.merged(df, ["position"]).collect()) == [(0, 20), (40, 50)]


def test_asof_over_days(spark):
    day = L.DAY_MS
    rows = spark.createDataFrame([("p", 5, 1.0), ("p", 3 * day, 2.0)], "position string, ms long, v double")
    points = spark.createDataFrame([("p", 4, 1), ("p", 5, 2), ("p", 2 * day, 3), ("p", 9 * day, 4)], "position string, ms long, k int")
    got = {r["k"]: r["v"] for r in asof.last_at(points, rows, "position", ["v"]).collect()}
    assert got == {1: None, 2: 1.0, 3: 1.0, 4: 2.0}


def test_short_delimited_logs(spark):
    fixture = "Time (Date hh:mm:ss.ms),LEQ dB-A,Lmax dB-A,L10 dB-A,L90 dB-A\n2026-03-02 16:22:30,44.9,46.6,46.7,42.5\n2026-03-02 16:22:31,44.8,46.4,46.5,42.4"
    odd = "\n\nWhen;What\nTime\tLevel one\tLMax\n2026-03-02 16:22:30\t1\t2\n\t\t\nno\t3\t4"
    lines = spark.createDataFrame([(p, i, x) for p, t in (("a.csv", fixture), ("b.csv", odd), ("c.csv", ""), ("d.csv", "Datetime\tx\n1\t2")) for i, x in enumerate(t.split("\n"))], "path string, line_no long, line string")
    got = sorted((r["path"], r["ms"] % 100_000, r["name"], r["level"]) for r in readers.short_delimited(lines).collect())
    assert got == [("a.csv", 50_000, "LAF10", 46.7), ("a.csv", 50_000, "LAF90", 42.5), ("a.csv", 50_000, "LAFmax", 46.6), ("a.csv", 50_000, "LAeq", 44.9), ("a.csv", 51_000, "LAF10", 46.5), ("a.csv", 51_000, "LAF90", 42.4), ("a.csv", 51_000, "LAFmax", 46.4), ("a.csv", 51_000, "LAeq", 44.8)]


LEVELS = "position string, profile string, ms long, laeq double, lafmax double, laf90 double"


def test_region_metrics_prefer_measured_l90(spark):
    rows = [("P1", "log", t * 1000, 50.0 + 10 * t, 80.0 + t, 40.0 + t) for t in range(3)] + [("P2", "overview", 0, 45.0, None, None), ("P2", "log", 0, float("nan"), 90.0, 30.0)]
    areas = spark.createDataFrame([(1, "P1", 0, 2000), (2, "P2", 0, 10), (3, "P3", 0, 7), (4, "P1", 5, 5)], "region_id long, position string, start_ms long, end_ms long")
    got = {r["region_id"]: r for r in regions.region_metrics(spark.createDataFrame(rows, LEVELS), areas).collect()}
    assert (got[1]["dataset"], got[1]["lafmax"], got[1]["la90_available"], got[1]["duration_ms"]) == ("log", 82.0, True, 2000) and got[1]["la90"] == pytest.approx(40.2)
    assert (got[2]["dataset"], got[2]["laeq"], got[2]["lafmax"], got[2]["la90"], got[2]["la90_available"]) == ("overview", pytest.approx(45.0), None, 45.0, False)
    assert (got[3]["dataset"], got[3]["laeq"], got[3]["duration_ms"], got[4]["dataset"]) == ("none", None, 7, "none")
    # shown an hour late at most
    late = spark.createDataFrame([("P1", 9_000_000)], "position string, chart_offset_ms long")
    shown = spark.createDataFrame([(1, "P1", 3_600_000, 3_601_000)], "region_id long, position string, start_ms long, end_ms long")
    assert regions.region_metrics(spark.createDataFrame(rows, LEVELS), shown, late).first()["lafmax"] == 81.0


def test_compared_positions(spark):
    rows = [("P1", "log", t * 1000, x, m, None, None) for t, (x, m) in enumerate([(40.0, 55.0), (50.0, 65.0), (60.0, 70.0), (50.0, 68.0)])]
    rows += [("P2", "log", t * 1000, float("nan"), None, None, None) for t in range(3)] + [("P2", "overview", 0, 45.0, None, None, None), ("P2", "overview", 6000, 47.0, None, None, None), ("P4", "log", 0, None, None, None, 33.0)]
    slices = spark.createDataFrame([(1, 3000, 1000), (2, 0, 6000), (3, 50_000, 60_000)], "slice_id long, start_ms long, end_ms long")
    places = spark.createDataFrame([("P1",), ("P2",), ("P3",), ("P4",)], "position string")
    out = regions.compare_positions(spark.createDataFrame(rows, LEVELS + ", value double"), slices, places, "LZeq").collect()
    got = {(r["slice_id"], r["position"]): r for r in out}
    mean = lambda *x: pytest.approx(10 * math.log10(sum(10 ** (v / 10) for v in x) / len(x)))
    a, b, c, d = got[1, "P1"], got[2, "P2"], got[2, "P3"], got[2, "P4"]
    assert (a["dataset"], a["laeq"], a["lafmax"], a["la90"], a["la90_available"], a["duration_ms"], a["parameter"]) == ("log", mean(50, 60, 50), 70.0, 50.0, True, 2000, "LAeq")
    assert (b["dataset"], b["laeq"], b["la90"], b["la90_available"]) == ("overview", mean(45, 47), None, False)
    assert (c["dataset"], c["laeq"], c["parameter"], c["has_data"]) == ("none", None, "LZeq", True)
    assert (d["parameter"], d["broadband"], d["laeq"], d["la90"]) == ("LZeq", pytest.approx(33.0), pytest.approx(33.0), 33.0)
    assert len(out) == 12 and not any(r["has_data"] for r in out if r["slice_id"] == 3)


def test_downsampling(spark):
    rows = [("short", t, i, float(i)) for i, t in enumerate((500, 1700, 3100))] + [("flat", 7, i, float(-i)) for i in range(9)] + [("long", 10 * i, i, float(i)) for i in range(100)]
    got = {}
    for r in timeline.downsample_max(spark.createDataFrame(rows, "position string, ms long, event_id long, x double"), ["x"], 5).collect():
        got.setdefault(r["position"], []).append((r["ms"], r["x"]))
    assert sorted(got["short"]) == [(500, 0.0), (1700, 1.0), (3100, 2.0)] and sorted(got["flat"]) == [(7, -4.0), (7, -3.0), (7, -2.0), (7, -1.0), (7, 0.0)]
    assert sorted(got["long"]) == [(0, 19.0), (198, 39.0), (396, 59.0), (594, 79.0), (792, 98.0), (990, 99.0)]


def test_spans_of_all_lengths(spark):
    rng = random.Random(5)
    spans = [("p", k, s, s + rng.choice([-5, 0, 1, 59_999, 60_000, 10**6, 10**8, 10**10])) for k in range(60) for s in [rng.randrange(10**9)]]
    rows = [("p", rng.randrange(10**9), i) for i in range(300)] + [("p", s, 1000 + k) for _, k, s, _ in spans] + [("p", e, 2000 + k) for _, k, _, e in spans]
    want = sorted((i, k) for _, t, i in rows for _, k, s, e in spans if s <= t <= e)
    df = asof.in_intervals(spark.createDataFrame(rows, "position string, ms long, i long"), spark.createDataFrame(spans, "position string, k long, start_ms long, end_ms long"), "position")
    assert sorted((r["i"], r["k"]) for r in df.collect()) == want


def test_windows_without_pairs(spark):
    """Counts and means of windows against a plain loop, with equal times, rows at both ends, repeated keys, null positions and levels that are missing; no join meets times with rows."""
    rng = random.Random(9)
    at = [rng.choice([rng.randrange(-4000, 9000), 1000 * rng.randrange(9)]) for _ in range(400)]
    rows = [(rng.choice(["a", "b", None]), t, rng.choice([30.0, 90.0, None, float("nan"), float("inf"), rng.uniform(30, 90)])) for t in at] + [("a", None, 1.0)]
    times = [(rng.choice([k, 7]), rng.choice(at)) for k in range(60)] + [(99, None), (98, 10**9), (97, 2000), (97, 2000)]
    want = {}
    for k, t in times:
        for p, ms, x in rows:
            if t is not None and ms is not None and t - 500 <= ms <= t + 500:
                want.setdefault((k, p), []).append(x)
    want = {g: (len(xs), [10 ** (x / 10) for x in xs if x is not None and math.isfinite(x)]) for g, xs in want.items()}
    df = asof.window_levels(spark.createDataFrame(times, "k long, ms long"), spark.createDataFrame(rows, "position string, ms long, laeq double"), "k", half_ms=500)
    got = {(r["k"], r["position"]): (r["n"], r["laeq"]) for r in df.collect()}
    assert {g: n for g, (n, _) in got.items()} == {g: n for g, (n, _) in want.items()}
    for g, (_, energy) in want.items():
        assert got[g][1] == (pytest.approx(10 * math.log10(sum(energy) / len(energy)), abs=1e-9) if energy else None)


def test_event_windows_at_one_time(spark, tmp_path):
    """40,000 events within a second are 320 million pairs of marker and row."""
    n = 40_000
    e = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id") % 1000).cast("timestamp_ntz").alias("ts"), F.when(F.col("id") % 5 == 0, "error").otherwise("view").alias("event_type"), F.lit(100.0).alias("value"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    q = registry.queries()["r4_event_windows"](spark, str(tmp_path))
    assert [tuple(r) for r in q.groupBy("position", "n", "laeq").count().orderBy("position").collect()] == [("error", n // 5, 40.0, n // 5), ("view", n - n // 5, 40.0, n // 5)]


def test_merging_over_days(spark):
    rng = random.Random(6)
    areas = [(s, s + rng.randrange(-10**8, 3 * 10**8)) for s in (rng.randrange(10**10) for _ in range(120))]
    want = []
    for s, e in sorted((min(a), max(a)) for a in areas if a[0] != a[1]):
        if want and s <= want[-1][1]:
            want[-1] = (want[-1][0], max(want[-1][1], e))
        else:
            want.append((s, e))
    df = spark.createDataFrame([("p", *a) for a in areas], "position string, start_ms long, end_ms long")
    assert sorted((r["start_ms"], r["end_ms"]) for r in regions.merged(df, ["position"]).collect()) == want


def test_ranks_over_blocks(spark):
    values = [v * 5_000_011 for v in range(-40, 60)] + [3, 3, 4]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long")
    got = {r["i"]: r["rank"] for r in timeline.ranked(df, "v", tie="i").collect()}
    assert got == {i: k + 1 for k, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}


def test_regions_of_days_in_a_zone(spark):
    hour = 3_600_000
    extent = spark.createDataFrame([("P", 0, 30 * hour)], "position string, lo long, hi long")
    both = {r["mode"]: r for r in regions.auto_regions(extent, ["daytime", "nighttime"], zone="Asia/Tokyo").collect()}
    assert [tuple(a) for a in both["daytime"]["areas"]] == [(0, 14 * hour), (22 * hour, 30 * hour)] and both["daytime"]["note"] == "Daytime - P"
    assert [tuple(a) for a in both["nighttime"]["areas"]] == [(14 * hour, 22 * hour)]
    one = sorted((r["note"], len(r["areas"])) for r in regions.auto_regions(extent, ["daytime"], zone="Asia/Tokyo").collect())
    assert one == [("Daytime - P (1)", 1), ("Daytime - P (2)", 1)]


def test_coverage_of_windows_without_width(spark):
    rows = spark.createDataFrame([(0, 10, 5, 20), (5, 5, 5, 20), (4, 4, 5, 20), (0, 3, 5, 20)], "s long, e long, lo long, hi long")
    assert [r[0] for r in rows.select(L.coverage(*[F.col(c) for c in ("s", "e", "lo", "hi")])).collect()] == [0.5, 1.0, 0.0, 0.0]


def rows_of(df):
    df = df[sorted(df.columns)]
    # pandas turns whole numbers with nulls into floats, so those are told from doubles by the schema check below
    cell = lambda v: "" if pd.isna(v) else f"{float(v):.6f}" if not isinstance(v, (str, bool, np.bool_)) and hasattr(v, "__float__") else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, sql = registry.queries()[name](spark, SF), registry.oracle_sql()[name]
    got, want = df.toPandas(), con.execute(sql).df()
    real = {"double": True, "float": True, "bigint": False, "int": False, "smallint": False}
    kinds = {r[0]: r[1] in ("DOUBLE", "FLOAT") for r in con.execute("describe " + sql).fetchall()}
    assert {c: real[t] for c, t in df.dtypes if t in real} == {c: kinds[c] for c, t in df.dtypes if t in real}
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)
