"""Readers that a user adds, of lines and of blocks of files."""

import pytest
from pyspark.sql import functions as F

from soundtally.sources import added, names, readers


def beeps(lines):
    """Lines such as 'beep 1000 47.5'."""
    parts = F.split("line", " ")
    good = lines.where(F.col("line").rlike(r"^beep \d+ [\d.]+$"))
    return good.select("path", parts[1].cast("long").alias("ms"), F.lit("LAeq").alias("name"), F.lit(None).cast("double").alias("freq_hz"), parts[2].cast("double").alias("level"))


@pytest.fixture
def beep():
    added.add(added.Reader("beep", r"_beep\.dat$", beeps))
    yield
    added.remove("beep")


def text(spark, **files):
    return spark.createDataFrame([(p, i, x) for p, t in files.items() for i, x in enumerate(t.split("\n"))], "path string, line_no long, line string")


def test_added_reader_is_dispatched(spark, beep):
    log = "Date & time,LAeq\n2031-01-01 00:00:00,50\n2031-01-01 00:00:01,51"
    lines = text(spark, **{"A_Beep.dat": "beep 1000 47.5\nnoise\nbeep 2000 48", "x.dat": "beep 3000 40", "plain.txt": log, "b_beep.dat": "nothing"})
    forced = spark.createDataFrame([("x.dat", "BEEP"), ("plain.txt", "generic"), ("b_beep.dat", None)], "path string, forced string")
    rows, rejects = readers.read_files(lines, forced)
    assert {(r["path"], r["reader"], r["ms"], r["level"]) for r in rows.collect() if r["reader"] == "beep"} == {("A_Beep.dat", "beep", 1000, 47.5), ("A_Beep.dat", "beep", 2000, 48.0), ("x.dat", "beep", 3000, 40.0)}
    assert rows.where("reader = 'generic'").count() == 2
    assert {(r["path"], r["reader"], r["reason"]) for r in rejects.collect()} == {("b_beep.dat", "beep", "no rows found")}


def test_added_reader_goes_away(spark, beep):
    files = spark.createDataFrame([("a_beep.dat", None), ("b.wav", None)], "path string, forced string")
    assert {r["path"]: r["reader"] for r in names.routed(files).collect()} == {"a_beep.dat": "beep", "b.wav": "audio"}
    added.remove("beep")
    assert {r["path"]: r["reader"] for r in names.routed(files).collect()} == {"a_beep.dat": None, "b.wav": "audio"}


@pytest.mark.parametrize("name", ["svan", "Two", "a-b", ""])
def test_names_that_are_no_readers(name):
    with pytest.raises(ValueError):
        added.add(added.Reader(name, "x", beeps))


def parser():
    """Times count from the file's second line; rows are '<seconds>;<level>'. Within a function, so that it is sent to the workers whole."""

    def parsed(head, lines):
        start = int(head[1])
        for line in lines:
            seconds, _, level = line.partition(";")
            if level:
                yield start + 1000 * int(seconds), "LAeq", None, float(level)

    return parsed


@pytest.mark.parametrize("block", [1, 7, 64, 1000, 1 << 26])
def test_blocks_hold_each_line_once(spark, tmp_path, block):
    for f, end in (("a.beep", "\n"), ("deep/b.beep", "\r\n")):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_bytes(end.join(["head", "5000", *[f"{i};{i / 2}" for i in range(40)], "é" * 20]).encode())
    (tmp_path / "c.txt").write_text("other")
    (tmp_path / "empty.beep").write_text("")
    added.register(spark, added.block_source("beeps", parser(), ".beep"))
    df = spark.read.format("beeps").option("block", block).load(str(tmp_path))
    rows = [(r["path"].rsplit("/", 1)[1], r["ms"], r["level"]) for r in df.collect()]
    assert sorted(rows) == sorted((f, 5000 + 1000 * i, i / 2) for f in ("a.beep", "b.beep") for i in range(40))
    assert block > 100 or df.rdd.getNumPartitions() > 2


def test_no_files(spark, tmp_path):
    added.register(spark, added.block_source("beeps", parser()))
    assert spark.read.format("beeps").load(f"file:{tmp_path}").count() == 0
