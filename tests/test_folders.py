"""Listings of plain folders, and what the ends of their files tell."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from soundtally.sources import folders


def put(root, path, text):
    place = root / path
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_bytes(text if isinstance(text, bytes) else text.encode())


def ms(text):
    return int(dt.datetime.fromisoformat(text + "+00:00").timestamp() * 1000)


def log(start, n, step=1, head="Date & time,LAeq\n"):
    at = dt.datetime.fromisoformat(start)
    return head + "".join(f"{at + dt.timedelta(seconds=i * step)},{40 + i % 9}\n" for i in range(n))


@pytest.fixture
def root(tmp_path):
    put(tmp_path, "visit one/P 1+2/2031-05-13_SLM_007_RTA_3rd_Log.txt", log("2031-05-13 09:00:00", 20_000))
    put(tmp_path, "visit one/P 1+2/short_log.csv", log("2031-05-13 09:00:00", 5, 60))
    put(tmp_path, "visit one/loud/R10.wav", b"RIFF" + bytes(96))
    put(tmp_path, "visit one/loud/R9.WAV", bytes(20))
    put(tmp_path, "top_log.csv", "no time here")
    put(tmp_path, "jobs/a.json", '{"sources": [1, 2]}')
    put(tmp_path, "jobs/b.json", '{"sources": "none"}')
    put(tmp_path, "jobs/c.json", "not json")
    put(tmp_path, "notes.docx", "x")
    put(tmp_path, ".hidden_log.csv", "x")
    put(tmp_path, "empty_log.csv", "")
    return tmp_path


def test_listing_reads_metadata_only(spark, root):
    got = {r["path"]: r["bytes"] for r in folders.listing(spark, str(root)).collect()}
    want = {str(p.relative_to(root)): p.stat().st_size for p in root.rglob("*") if p.is_file() and p.stat().st_size and not p.name.startswith(".")}
    assert got == want
    plan = folders.listing(spark, f"file:{root}")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1] and {r["path"] for r in folders.listing(spark, f"file:{root}", "*.csv").collect()} == {p for p in want if p.endswith(".csv")}


def test_survey(spark, root):
    got = {r["path"]: r.asDict() for r in folders.survey(spark, str(root)).collect()}
    assert set(got) == {"visit one/P 1+2/2031-05-13_SLM_007_RTA_3rd_Log.txt", "visit one/P 1+2/short_log.csv", "visit one/loud", "top_log.csv", "jobs/a.json"}
    long, short = got["visit one/P 1+2/2031-05-13_SLM_007_RTA_3rd_Log.txt"], got["visit one/P 1+2/short_log.csv"]
    assert (long["visit"], long["position"], long["session"], long["role"], long["spectral"], long["reader"]) == ("visit one", "P 1+2", "2031-05-13_SLM_007", "log", True, "nti")
    assert (long["start_ms"], long["end_ms"], long["duration_s"], long["spot"]) == (ms("2031-05-13 09:00:00"), ms("2031-05-13 14:33:19"), 19_999.0, False)
    assert short["spot"] and not short["recommended"] and short["duration_s"] == 240
    assert (got["visit one/loud"]["kind"], got["visit one/loud"]["files"], got["visit one/loud"]["bytes"], got["visit one/loud"]["visit"], got["visit one/loud"]["position"]) == ("audio", 2, 120, "visit one", "loud")
    assert got["top_log.csv"]["start_ms"] is None and got["top_log.csv"]["recommended"] and got["jobs/a.json"]["kind"] == "config"


def test_ends_read_so_many_bytes(spark, root):
    put(root, "long_log.csv", log("2031-01-01 00:00:00", 200_000))
    files = folders.listing(spark, str(root), "*_log.csv").unionByName(spark.createDataFrame([(f"{n}_log.csv", 1, 0, f"{root}/{n}_log.csv", f"{root}/{n}_log.csv") for n in ("gone", "empty")], "path string, bytes long, modified_ms long, first_file string, last_file string"))
    got = {r["path"]: r for r in folders.probed(folders.ends(files)).collect()}
    assert got["long_log.csv"]["bytes_read"] == 2 * folders.END_BYTES and got["long_log.csv"]["bytes"] > 4_000_000
    assert got["long_log.csv"]["end_ms"] - got["long_log.csv"]["start_ms"] == 199_999_000
    assert got["empty_log.csv"]["bytes_read"] == 0 and got["empty_log.csv"]["error"] is None and got["empty_log.csv"]["start_ms"] is None
    assert "FileNotFoundError" in got["gone_log.csv"]["error"] and got["gone_log.csv"]["start_ms"] is None


def test_file_in_parts(spark, tmp_path):
    spark.createDataFrame([("a b/x=1.csv", f"2031-01-01 00:00:0{i},1") for i in range(10)], "path string, value string").repartitionByRange(3, "value").write.partitionBy("path").text(str(tmp_path / "w"))
    got = folders.probed(folders.ends(folders.listing(spark, str(tmp_path / "w")))).collect()
    assert [(r["path"], r["bytes"], r["start_ms"], r["end_ms"]) for r in got] == [("a b/x=1.csv", 220, ms("2031-01-01 00:00:00"), ms("2031-01-01 00:00:09"))]


@pytest.mark.parametrize("head, tail, want", [
    ("x 2031-02-30 10:00 2031-03-01\t10:00:05", "", ("2031-03-01 10:00:05", "2031-03-01 10:00:05")),
    ("a 2031/01/02T03:04 b", "2031-01-01 00:00:00", ("2031-01-01 00:00:00", "2031-01-02 03:04:00")),
    ("13/02/2031 10:00 and 02/13/2031 11:00", "02-03-2031 12:00:00", ("2031-02-03 12:00:00", "2031-02-13 10:00:00")),
    ("2031-01-01\n10:00:00", "", (None, None)),
])
def test_times_in_ends(spark, head, tail, want):
    df = spark.createDataFrame([(head, tail or head)], "head string, tail string")
    r = folders.probed(df).first()
    assert (r["start_ms"], r["end_ms"]) == tuple(w and ms(w) for w in want)


def peek(spark, head):
    r = folders.peeked(spark.createDataFrame([(head,)], "head string")).first()
    return r["columns"], r["spectral"], r["step_ms"]


def test_headers(spark):
    assert peek(spark, log("2031-01-01 00:00:00", 100)) == (["Date & time", "LAeq"], False, 1000.0)
    assert peek(spark, "junk\nDate\tTime\tLZeq_31.5\n2031-01-01\t00:00:00\t1\n2031-01-01\t00:00:02\t1\n\n2031-01-01\t00:00:05\t1\n") == (["Date", "Time", "LZeq_31.5"], True, 2500.0)
    assert peek(spark, 'a,b\n"Start Date","Start Time","31.5 Hz"\n') == (["Start Date", "Start Time", "31.5 Hz"], True, 0.0)
    assert peek(spark, "a,b\n1,2") == (None, False, 0.0) and peek(spark, "") == (None, False, 0.0) and peek(spark, None) == (None, False, 0.0)


def test_nothing_there(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert folders.survey(spark, str(tmp_path / "e")).count() == 0
    assert folders.listing(spark, str(tmp_path / "e")).where(F.col("bytes") > 0).count() == 0
