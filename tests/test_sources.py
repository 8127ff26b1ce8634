import datetime as dt

import pytest
from pyspark.sql import functions as F

from soundtally.functions import texts
from soundtally.operators import asof, regions, spectrogram, timeline
from soundtally.plans import registry
from soundtally.sources import annotations as A
from soundtally.sources import clock, lines, place, readers
from soundtally.sources import inventory as I


def text(spark, **files):
    return spark.createDataFrame([(p, i, x) for p, t in files.items() for i, x in enumerate(t.split("\n"))], "path string, line_no long, line string")


def utc(spark, *stamps):
    rows = [("f", i, dt.datetime.fromisoformat(s)) for i, s in enumerate(stamps)]
    out = clock.to_utc(spark.createDataFrame(rows, "path string, line_no int, local timestamp_ntz"), "Europe/London")
    return [f"{r['utc']:%d %H:%M}" for r in out.orderBy("line_no").collect()]


def test_clock_shows_an_hour_twice(spark):
    assert utc(spark, *(f"2024-10-27 {t}" for t in ("00:30", "01:30", "01:30", "02:30"))) == ["26 23:30", "27 00:30", "27 01:30", "27 02:30"]


def test_clock_skips_an_hour(spark):
    assert utc(spark, *(f"2024-03-31 {t}" for t in ("00:30", "01:30", "02:30"))) == ["31 00:30", "31 01:00", "31 01:30"]


def test_untold_hour_goes(spark):
    assert utc(spark, "2024-10-27 00:30", "2024-10-27 01:10", "2024-10-27 01:40", "2024-10-27 02:30") == ["26 23:30", "27 02:30"]


def test_three_row_header(spark):
    t = text(spark, a="Site\n,P1 (TH),1/3 Oct (TH),\n,LAeq [dB],LZeq,\nDate & time,,100 Hz,\n2024-01-01 00:00:01,50.5,40,\n\nbad,1,2,", b="nothing here")
    assert sorted(r["name"] + f" {r['freq_hz']} {r['level']}" for r in readers.three_row_header(t).collect()) == ["LAeq None 50.5", "LZeq 100.0 40.0"]


@pytest.mark.parametrize("raw, want", [("P2 (A, Fast) (SR)_LAeq L90", ("LAF90", None)), ("1/3 Oct LZFmax_1k Hz", ("LZFmax", 1000.0)), ("1/3 Oct LZeq_99 Hz", (None, None)), ("Comment", (None, None))])
def test_three_row_names(spark, raw, want):
    assert tuple(spark.range(1).select(readers.three_row_name(F.lit(raw)).alias("k")).first()["k"]) == want


def test_numbered(spark):
    a = F.array(*map(F.lit, ["x", "y", "x", "x"]))
    assert list(spark.range(1).select(lines.numbered(a, 2).alias("n")).first()["n"]) == ["x", "y", "x_2", "x_3"]


def test_sections_end_at_the_checksum(spark):
    got = lines.sections(text(spark, a="x\n# One\n1\n\n# Two\n2\n#CheckSum\n3")).orderBy("line_no")
    assert [(r["section"], r["line"]) for r in got.collect()] == [("One", "1"), ("One", ""), ("Two", "2")]


def test_generic_needs_a_time(spark):
    t = text(spark, a="Date;Time;v\n2024-01-01;00:00:01;7", b="v;w\n1;2")
    assert [(r["path"], r["ms"], r["name"], r["level"]) for r in readers.generic(t).collect()] == [("a", 1704067201000, "v", 7.0)]


def test_cutoff_keeps_lines_without_a_time(spark):
    t = text(spark, a="head\n2024-01-01 00:00:00,1\n2024-01-02 00:00:00,2")
    assert readers.before(t, "2024-01-02 00:00:00").count() == 2


@pytest.mark.parametrize("name, want", [("march_2031", True), ("Round Two", True), ("2031 works", True), ("Harbour Mews", False), ("summary", False), ("44-2", False), (None, False)])
def test_visit_folders(spark, name, want):
    assert spark.range(1).select(I.is_visit(F.lit(name).cast("string")).alias("v")).first()["v"] is want


def test_nearest_span(spark):
    minute = 60_000
    spans = spark.createDataFrame([("p", 0, 10 * minute, 0), ("p", 120 * minute, 130 * minute, 1)], "position string, start_ms long, end_ms long, segment int")
    points = spark.createDataFrame([("p", 4 * minute, 5 * minute, 1), ("p", 299 * minute, 300 * minute, 2), ("p", 64 * minute, 66 * minute, 3), ("q", 1, 2, 4)], "position string, start_ms long, end_ms long, k int")
    got = {r["k"]: (r["segment"], r["distance_ms"]) for r in asof.nearest_span(points, spans, "position", "segment").collect()}
    assert got == {1: (0, 0), 2: (1, 169 * minute), 3: (0, 54 * minute), 4: (None, None)}


def test_segments_over_days(spark):
    day = 86_400_000
    rows = [("p", t, i) for i, t in enumerate((day - 60_000, day, day + 60_000, 5 * day, 5 * day + 60_000))]
    got = timeline.segments(spark.createDataFrame(rows, "position string, ms long, event_id long")).orderBy("segment").collect()
    assert [(r["segment"], r["n"]) for r in got] == [(0, 3), (1, 2)]


@pytest.mark.parametrize("given", [[5, 5, None, 7], [None, 1, 2, None, 2], [None, None, 2, 3, 9, None, 10, 1], [], [3, None, 4, 4, 5, 6, None]])
def test_ids(spark, given):
    taken, top, want = set(), 0, []
    for g in given:
        i = g if g is not None and g not in taken else top + 1
        taken.add(i)
        top = max(top, i)
        want.append(i)
    r = spark.createDataFrame([("s", n, g) for n, g in enumerate(given)], "scope string, n long, given long")
    assert [x["id"] for x in sorted(regions.with_ids(r, "n", "given", "scope").collect(), key=lambda x: x["n"])] == want


def test_mixed_files(spark):
    t = text(
        spark,
        **{
            "a_2024_05_13__09h00m00s.csv": "Time (Date hh:mm:ss.ms),LEQ dB-A\n2024-01-01 00:00:00,50\n2024-01-01 00:02:00,51",
            "b_log.csv": "Site\n,P1 (TH),\n,LAeq [dB],\nDate & time,,\n2024-01-01 00:00:01,40,",
            "c.csv": "Start time,LAeq\n2024-01-01 00:00:01,41",
            "d.dat": "Timestamp;v\n2024-01-01 00:00:01;42",
            "e.csv": "nothing",
            "f.bin": "x",
            "g_123_Log.txt": "# Broadband LOG Results\nDate\tTime\tLAeq_dt\n2024-01-01\t00:00:01\t43",
        },
    )
    forced = spark.createDataFrame([("d.dat", "generic")], "path string, forced string")
    rows, rejects = readers.read_files(t, forced)
    assert sorted((r["path"][0], r["reader"], r["profile"], r["level"]) for r in rows.collect()) == [("a", "sentry", "overview", 50.0), ("a", "sentry", "overview", 51.0), ("b", "svan", "log", 40.0), ("c", "svan", "unknown", 41.0), ("d", "generic", "log", 42.0), ("g", "nti", "log", 43.0)]
    assert {(r["path"], r["reason"]) for r in rejects.collect()} == {("e.csv", "no rows found"), ("f.bin", "no reader for this name")}


def test_a_file_of_comments(spark, monkeypatch):
    monkeypatch.setattr(lines, "MARKS", 5)
    many = "\n".join(f"# c{i}\n{i}" for i in range(9))
    got = {(r["path"], r["section"], r["line"]) for r in lines.sections(text(spark, a=many + "\n#CheckSum\nx", b="# One\n1")).collect()}
    assert got == {*(("a", f"c{i}", str(i)) for i in range(9)), ("b", "One", "1")}


def test_many_files_are_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lines, "FEW", 0)
    t = text(spark, a="# One\n1\n2", b="x\n# Two\n3")
    assert {(r["path"], r["section"], r["line"]) for r in lines.sections(t).collect()} == {("a", "One", "1"), ("a", "One", "2"), ("b", "Two", "3")}


def test_band_report(spark):
    t = text(spark, a="# Time\nStart:\t2024-01-01, 00:00:01\nEnd:\t2024-01-01, 00:10:01\n# RTA Results\n\tBand [Hz]\t63\t125\n\t\t[dB]\t[dB]\n\tLZeq\t50\t-.-\n\t\t1\t2\n#CheckSum\nx", b="# RTA Results\n\tBand\n")
    r = readers.single_band_reports(t).collect()
    assert [(x["path"], x["end_ms"] - x["start_ms"], x["header"], [tuple(m) for m in x["metrics"]]) for x in r] == [("a", 600_000, ["63", "125"], [("LZeq", [50.0, 0.0])])]


def test_shared_folder_of_a_cluster_is_asked_for():
    class Conf:
        get = staticmethod(lambda key, default: default)

    class Context:
        master, getCheckpointDir, getConf = "spark://host:7077", staticmethod(lambda: None), staticmethod(Conf)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        place.shared_root(Session)


def test_all_bands_where_none_is_in_range(spark):
    s = spark.createDataFrame([("p", 0, 10, 1.0), ("p", 0, 20, 2.0)], "position string, ms long, freq_hz int, level double")
    ranges = spark.createDataFrame([("p", 100, 200)], "position string, lo int, hi int")
    assert spectrogram.band_range(s, ranges).count() == 2


def test_empty_annotations(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('type,id,positionId,start_utc,end_utc,note,color,areas\nregion,3,P1,2024-01-01 00:00:10,1704067200000,"a ""b""",,"[{""start"": ""bad""}]"\nregion,4,,1,2,,,\nmarker,-1,,2024-01-01T00:00:00Z,,,,\nother,1,,1,,,,\n')
    got = {r["type"]: r for r in A.read_annotations(spark, str(path)).collect()}
    assert sorted(got) == ["marker", "region"] and got["region"]["note"] == 'a "b"' and got["marker"]["id"] is None
    assert [tuple(a) for a in got["region"]["areas"]] == [(1704067200000, 1704067210000)] and got["marker"]["ms"] == 1704067200000


@pytest.mark.parametrize("n, want", [(1, None), (2, 1.0), (3, 1.0), (40, 3.0)])
def test_sample_period(spark, n, want):
    times = [0, 1000, 9000] if n < 40 else [0, 1, 2, 3, 4, 5, *(6 + 3000 * i for i in range(28)), *(90_000 + i for i in range(6))]
    rows = spark.createDataFrame([("p", t) for t in times[:n]], "position string, ms long")
    assert timeline.sample_period(rows).first()["period_s"] == want


def test_repeat_reports(spark):
    head = "# RTA Results\nStart\t\tStop\t\t\tLZeq\tLZFmax\nDate\tTime\tDate\tTime\tBand [Hz]\t31.5\t1k\n[d]\t[t]\t[d]\t[t]\t\t[dB]\t[dB]\n"
    row = "\t2024-01-01\t00:00:0{}\t2024-01-01\t00:00:0{}\t\t{}\t{}\n"
    t = text(spark, a=head + row.format(1, 2, 50, "-.-") + "\n" + row.format(3, 4, "bad", 61) + "#CheckSum\n" + row.format(5, 6, 1, 1), b="# RTA Results\nonly\n", c="no section")
    got = sorted((r["start_ms"] % 60_000, r["end_ms"] % 60_000, r["name"], r["freq_hz"], r["level"]) for r in readers.repeat_reports(t, bands=True).collect())
    assert got == [(1000, 2000, "LZFmax", 1000.0, 0.0), (1000, 2000, "LZeq", 31.5, 50.0), (3000, 4000, "LZFmax", 1000.0, 61.0)]


def test_region_rows(spark):
    areas = spark.createDataFrame([(1, "P1", 50, 60), (1, "P1", 10, 20), (2, "P2", 5, 9)], "region_id long, position string, start_ms long, end_ms long")
    offsets = spark.createDataFrame([("P1", 10)], "position string, chart_offset_ms long")
    got = {r["id"]: r for r in A.region_rows(areas, offsets).collect()}
    assert [tuple(a) for a in got[1]["areas"]] == [(10, 20), (50, 60)] and [tuple(a) for a in got[1]["sourceAreas"]] == [(0, 10), (40, 50)]
    assert (got[1]["start"], got[1]["end"], got[2]["chartOffsetMs"], got[2]["note"]) == (10, 60, 0, "")


def test_names_are_read_once_a_file(spark):
    """No pattern for names of columns runs over cells."""
    t = text(spark, a="x\nBuffer,P1 (A) (TH),1/3 Oct,\n,LAeq,LZeq,\nDate & time,,31.5 Hz,\n2024-01-01 00:00:00,50,40,7")
    long = readers.three_row_header(t)
    assert sorted((r["name"], r["freq_hz"], r["level"]) for r in long.collect()) == [("LAeq", None, 50.0), ("LZeq", 31.5, 40.0)]
    assert "Oct" not in long._jdf.queryExecution().optimizedPlan().toString()
    p2 = registry.queries()["p2_map_columns"](spark, "/root/testdata/sf0.001")
    assert "regexp" not in p2._jdf.queryExecution().optimizedPlan().toString().lower()


def test_ends_of_areas_are_parsed_once(spark):
    forms = ['[{"start":"2024-01-01 00:00:01","endUtc":"2024-01-01T00:00:02Z"},["1000","2000.5"],"5 | 6",{"startUtc":null,"start":7,"end":"x"}]', '{"start_utc":"1e3","end_utc":" 2024-1-1 00:00:00 "}', "[{bad", None]
    df = spark.createDataFrame([(x,) for x in forms], "x string").select(A.area_ends(F.col("x")).alias("a"))
    got = [None if r["a"] is None else [tuple(x) for x in r["a"]] for r in df.collect()]
    assert got[0] == [(1_704_067_201_000, 1_704_067_202_000), (1000, 2000), (5, 6), (7, None)] and got[1] == [(1000, 1_704_067_200_000)] and not got[2] and got[3] is None
    assert df._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 8
    numbers = spark.createDataFrame([(x,) for x in ("1", " -2.5 ", "1e3", "2024-01-01", "2024", "NaN", "x", "", None)], "x string").select(texts.number(F.col("x")).alias("n"), F.col("x").try_cast("double").alias("m")).collect()
    assert [str(r["n"]) for r in numbers] == [str(r["m"]) for r in numbers]
