"""Overview sheets of small folders, and options of sources."""

import pytest

from soundtally.sources import options, overview

UNITS = "[YYYY-MM-DD]\t[hh:mm:ss]\t[YYYY-MM-DD]\t[hh:mm:ss]"


def lines(spark, files):
    return spark.createDataFrame([(p, n, x) for p, text in files.items() for n, x in enumerate(text.split("\n"))], "path string, line_no long, line string")


def table(spark, files, kind):
    heads, records = overview.block(lines(spark, files), kind)
    rows = sorted(records.collect(), key=lambda r: (r["path"], r["line_no"]))
    titles = {r["folder"]: [tuple(c) for c in r["columns"]] for r in heads.collect()}
    return titles, [(r["folder"], r["file"], r["date"], r["time"], r["times"], r["cells"]) for r in rows]


def report(*rows, names="LAeq_dt\tLAF10.0%"):
    return f"# Setup\nx: y\n# Broadband Results\n\tStart\t\tStop\n\tDate\tTime\tDate\tTime\t{names}\n\t{UNITS}\t[dB]\t[dB]\n" + "\n".join(rows) + "\n\n#CheckSum\n\tabc"


def test_broadband_reports(spark):
    row = "\t2031-05-13\t09:00:00\t2031-05-13\t09:05:00\t 51.0\t-.-"
    more = "\t2031-05-13\t09:10:00\t2031-05-13\t09:15:00\t52"
    # names begin a cell before the values
    files = {"v/a_123_Report.txt": report(row, more), "v/b_123_Report.txt": report(more, names="LCeq"), "w/c_123_Report.txt": "# Broadband Results\nx\ny"}
    titles = {"v": [("", "Time", "[hh:mm:ss]"), ("", "LAeq_dt", "[dB]"), ("", "LAF10.0%", "[dB]")]}
    first = ("v", "a_123_Report.txt", "2031-05-13", "09:00:00", ["2031-05-13", "09:05:00"], ["51.0", "0"])
    got = table(spark, files, "123 report")
    assert got[1] == [first, ("v", "b_123_Report.txt", "2031-05-13", "09:10:00", ["2031-05-13", "09:15:00"], ["52"])]
    assert got[0] == titles
    # all rows of a repeat report, of which the first alone has the name; rows without a time go
    _, rows = table(spark, {"v/a_123_Rpt_Report.txt": report(row, more, "\t\t\tx", "note")}, "123 rpt")
    assert rows == [("v", "a_123_Rpt_Report.txt", *first[2:]), ("v", None, "2031-05-13", "09:10:00", ["2031-05-13", "09:15:00"], ["52"])]


def test_band_reports(spark):
    text = "# Time\nStart:\t2031-05-13, 09:00:00\nEnd:\t2031-05-13, 09:05:00\n# RTA Results\n\tBand [Hz]\t63.0\t125.0\n\t\t[dB]\t[dB]\n\tLZeq_dt\t40.0\t-.-\n\tLZFmax\t 50\t60.10\n\n#CheckSum\nx"
    titles, rows = table(spark, {"a_RTA_3rd_Report.txt": text}, "rta report")
    assert titles == {"": [("LZeq_dt", "63.0", "[dB]"), ("LZeq_dt", "125.0", "[dB]"), ("LZFmax", "63.0", "[dB]"), ("LZFmax", "125.0", "[dB]")]}
    assert rows == [("", "a_RTA_3rd_Report.txt", "2031-05-13", "09:00:00", ["2031-05-13", "09:05:00"], ["40.0", "0", "50", "60.10"])]
    repeat = f"# RTA Results\n\tStart\t\tStop\t\tLZeq\tLZFmax\n\tDate\tTime\tDate\tTime\t63.0\t125.0\n\t{UNITS}\t[dB]\t[dB]\n\t2031-05-13\t09:00:00\t2031-05-13\t09:05:00\t\t1\t2"
    titles, rows = table(spark, {"a_RTA_3rd_Rpt_Report.txt": repeat}, "rta rpt")
    assert titles == {"": [("LZeq", "63.0", "[dB]"), ("LZFmax", "125.0", "[dB]")]} and rows[0][5] == ["1", "2"]


def test_sheet(spark):
    keys = "folder string, date string, time string, file string, times array<string>, cells array<string>, path string, line_no int"
    left = [("v", "d", "1", "f", ["t"], ["1"], "f", 1), ("v", "d", "2", None, ["t"], ["2"], "f", 2), ("v", "d", "2", "g", ["t"], ["3"], "g", 1)]
    right = [("v", "d", "2", "h", ["t"], ["4", "5"], "h", 1), ("w", "d", "1", "h", ["t"], [], "h", 1)]
    s = overview.sheet(spark.createDataFrame(left, keys), spark.createDataFrame(right, keys))
    heads = spark.createDataFrame([("w", [("", "z", "")]), ("v", [("Lz", "63.0", "[dB]"), ("Lz", "63.0", "[dB]")])], "folder string, columns array<struct<upper:string,name:string,unit:string>>")
    w = overview.wide(s, heads, "right")
    assert w.columns[-2:] == ["right_Lz_63_0", "right_Lz_63_0_1"]
    got = sorted((r["folder"], r["time"], r["left_file"], r["left_cells"], r["right_Lz_63_0"], r["right_Lz_63_0_1"]) for r in w.collect())
    assert got == [("v", "1", "f", ["1"], None, None), ("v", "2", "g", ["3"], "4", "5"), ("w", "1", None, None, None, None)]
    # neither block has anything
    none = spark.createDataFrame([], keys)
    empty = overview.wide(overview.sheet(none, none), heads.where("false"), "left")
    assert empty.count() == 0 and "left_file" in empty.columns


@pytest.mark.parametrize("few", [20_000, 0])
def test_options(spark, monkeypatch, few):
    monkeypatch.setattr(options.T, "FEW", few)
    rows = [(p, "file", t, n, hz, 1.0) for p in "abcde" for t in (1, 2) for n, hz in (("LAeq", None), ("LAFmax", None), ("LZeq", 63.0))]
    df = spark.createDataFrame(rows, "path string, profile string, ms long, name string, freq_hz double, level double")
    asked = [("a", ["LAeq", "LAF90"], "log"), ("b", ["Datetime"], None), ("c", [], "log"), ("d", ["", None, "x"], None), ("z", ["x"], "log")]
    opts = spark.createDataFrame(asked, "path string, columns array<string>, forced_profile string")
    got = {}
    for r in options.with_options(df, opts).collect():
        got.setdefault((r["path"], r["profile"]), []).append((r["ms"], r["name"], r["level"]))
    every = [(t, n, 1.0) for t in (1, 2) for n in ("LAFmax", "LAeq", "LZeq")]
    times = [(t, n, v) for t in (1, 2) for n, v in ((None, None), ("LZeq", 1.0))]
    key = lambda r: (r[0], r[1] or "")
    assert {k: sorted(v, key=key) for k, v in got.items()} == {("a", "log"): [(t, n, 1.0) for t in (1, 2) for n in ("LAeq", "LZeq")], ("b", "file"): times, ("c", "log"): every, ("d", "file"): times, ("e", "file"): every}
    assert {r["path"]: r["missing"] for r in options.missing(df, opts).collect()} == {"a": ["LAF90"], "d": ["x"]}
