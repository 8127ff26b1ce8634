"""Folders whose files are read as they come, with failed ones tried again.

A round lists the folder, reads the files that are due, and writes their rows and what
became of each file: loaded, failed, or rejected after so many attempts. A loaded file
is never read again, so its rows are there once, even if it changes later. All state is
in two tables in a folder that all executors see, one folder a round in each.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from soundtally.sources import added, folders, readers
from soundtally.sources.place import cut

ATTEMPTS = "path string, bytes long, modified_ms long, attempted_ms long, reader string, attempts int, state string, reason string"
ROWS = "path string, reader string, profile string, ms long, name string, freq_hz double, level double"
#: Lines of a batch that a task hands over.
LINES = 10_000


def lines_of(parts: DataFrame, block: int = added.BLOCK) -> DataFrame:
    """(path, line_no, line, error) of files (path, file, bytes), read by tasks that share their blocks; a block that can't be read gives one row with its error."""
    blocks = parts.select("path", "file", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(block))).alias("start"))
    shared = blocks.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ["path", "file", "start", "i", "line", "error"]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for path, file, start in zip(pdf["path"], pdf["file"], pdf["start"], strict=True):
                some = []
                try:
                    for i, line in enumerate(added.block_lines(file, start, start + block)):
                        some.append((path, file, start, i, line, None))
                        if len(some) == LINES:
                            yield pd.DataFrame(some, columns=names)
                            some = []
                except Exception as e:  # noqa: BLE001 - whatever a store raises is a fact about the file
                    some.append((path, file, start, -1, None, f"{type(e).__name__}: {e}"))
                if some:
                    yield pd.DataFrame(some, columns=names)

    out = shared.mapInPandas(run, "path string, file string, start long, i long, line string, error string")
    return out.select("path", F.struct("file", "start", "i").alias("line_no"), "line", "error")


def _table(spark: SparkSession, place: str, schema: str) -> DataFrame:
    """A table of rounds; empty before the first."""
    full = schema + ", round long"
    try:
        return spark.read.schema(full).parquet(place)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def ledger(spark: SparkSession, place: str) -> DataFrame:
    """ATTEMPTS and round: the latest state of each file that was tried."""
    rounds = _table(spark, f"{place}/attempts", ATTEMPTS)
    rest = [c for c in rounds.columns if c != "path"]
    last = rounds.groupBy("path").agg(F.max_by(F.struct(*rest), "round").alias("__r"))
    return last.select("path", *[f"__r.{c}" for c in rest])


def loaded(spark: SparkSession, place: str) -> DataFrame:
    """ROWS of the loaded files; those of a round that broke off before its end aren't there."""
    done = _table(spark, f"{place}/attempts", ATTEMPTS).select("round").distinct()
    return _table(spark, f"{place}/rows", ROWS).join(F.broadcast(done), "round", "left_semi").drop("round")


def rejects(spark: SparkSession, place: str) -> DataFrame:
    """(path, reader, attempts, reason) of the files that were given up."""
    return ledger(spark, place).where("state = 'rejected'").select("path", "reader", "attempts", "reason")


def attempt(spark: SparkSession, source: str, place: str, tries: int = 3, wait_ms: int = 0, forced: DataFrame | None = None, clock: Callable[[], float] = time.time) -> bool:
    """One round; whether any file was due.

    Due are files that were never tried, failed ones that have waited, and rejected ones
    that have changed since, which get one attempt a change. What a round costs depends
    on the listing and the files due, not on what was loaded before. A round that broke
    off is done again under its number. One writer a place.
    """
    before = cut(ledger(spark, place))
    now = int(clock() * 1000)
    parts = folders.parts(spark, source)
    files = parts.groupBy("path").agg(F.sum("bytes").alias("bytes"), F.max("modified_ms").alias("modified_ms"))
    was = before.select("path", F.col("bytes").alias("__b"), F.col("modified_ms").alias("__m"), "attempted_ms", "state", F.col("attempts").alias("__n"))
    changed = (F.col("bytes") != F.col("__b")) | (F.col("modified_ms") != F.col("__m"))
    waits = (F.col("state") == "failed") & (F.col("attempted_ms") + wait_ms <= now)
    asked = F.col("state").isNull() | waits | ((F.col("state") == "rejected") & changed)
    due = cut(files.join(was, "path", "left").where(asked).select("path", "bytes", "modified_ms", F.coalesce("__n", F.lit(0)).alias("before")))
    if due.isEmpty():
        return False
    number = (before.agg(F.max("round")).head()[0] or 0) + 1
    # what was read is kept, so that all of the round sees the same even if a file changes
    read = cut(lines_of(parts.join(due.select("path"), "path", "left_semi")))
    errors = read.where("error is not null").groupBy("path").agg(F.min("error").alias("error"))
    whole = read.where("error is null").join(errors, "path", "left_anti").select("path", "line_no", "line")
    rows, none = readers.read_files(whole, forced)
    rows.write.mode("overwrite").parquet(f"{place}/rows/round={number}")
    got = spark.read.schema(ROWS).parquet(f"{place}/rows/round={number}").groupBy("path").agg(F.min("reader").alias("__reader"))
    met = due.join(got, "path", "left").join(none.select("path", "reader", "reason"), "path", "left").join(errors, "path", "left")
    tried = F.col("before") + 1
    state = F.when(F.col("__reader").isNotNull(), "loaded").when(tried >= tries, "rejected").otherwise("failed")
    reason = F.when(F.col("__reader").isNull(), F.coalesce("error", "reason", F.lit("no lines")))
    out = met.select("path", "bytes", "modified_ms", F.lit(now).alias("attempted_ms"), F.coalesce("__reader", "reader").alias("reader"), tried.cast("int").alias("attempts"), state.alias("state"), reason.alias("reason"))
    out.write.mode("overwrite").parquet(f"{place}/attempts/round={number}")
    return True


def follow(spark: SparkSession, source: str, place: str, every: str = "1 minute", tries: int = 3, wait_ms: int = 0) -> StreamingQuery:
    """A query that makes a round at each tick of a timer until it is stopped; started again it goes on where it was."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(_: DataFrame, epoch: int) -> None:
        attempt(spark, source, place, tries, wait_ms)

    return ticks.writeStream.trigger(processingTime=every).option("checkpointLocation", f"{place}/ticks").foreachBatch(tick).start()
