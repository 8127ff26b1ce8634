"""Sessions of a stream in append mode against segments of the whole."""

import os
import random

from pyspark.sql import functions as F

from soundtally.streaming import streams


def put(spark, folder, batches):
    """One file a batch of (position, seconds), in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "position string, s long").coalesce(1).write.mode("append").parquet(str(folder / f"b={i}"))
        for f in (folder / f"b={i}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema("position string, s long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder)).select("position", F.timestamp_seconds("s").alias("ts"))


def segments(rows, gap=300):
    out = []
    for p in sorted({p for p, _ in rows}):
        at = sorted(s for q, s in rows if q == p)
        runs = [[at[0]]]
        for a, b in zip(at, at[1:], strict=False):
            if b - a > gap:
                runs.append([])
            runs[-1].append(b)
        out += [(p, 1000 * r[0], 1000 * r[-1], len(r)) for r in runs]
    return out


def test_sessions_close_and_their_state_goes(spark, tmp_path):
    rng = random.Random(2)
    rows = [(p, t) for p in "ab" for t in rng.sample(range(0, 400_000, 7), 3000)]
    batches = [[r for r in rows if r[1] // 20_000 == k] for k in range(20)]
    reports = []
    got = streams.drained(streams.sessions(put(spark, tmp_path, batches)), "append", reports)
    end = max(t for _, t in rows) * 1000 - 3_600_000
    closed = [s for s in segments(rows) if s[2] + 300_000 <= end]
    assert sorted(tuple(r) for r in got.collect()) == sorted(closed)
    # what is held are the sessions of an hour or so, however long the stream is
    assert max(r["state_rows"] for r in reports) < len(closed) / 4 and sum(r["rows"] for r in reports) == len(rows)
    assert sum(r["late_rows"] for r in reports) == 0 and len(reports) >= 20


def test_late_rows_are_counted(spark, tmp_path):
    # rows are late by the watermark that the batch before began with
    batches = [[("a", 10_000)], [("a", 100_000)], [("a", 100_005)], [("a", 10_010), ("a", 100_010)], [("a", 200_000)]]
    reports = []
    got = streams.drained(streams.sessions(put(spark, tmp_path, batches)), "append", reports)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 10_000_000, 10_000_000, 1), ("a", 100_000_000, 100_010_000, 3)]
    assert sum(r["late_rows"] for r in reports) == 1 and reports[-1]["state_rows"] == 1
