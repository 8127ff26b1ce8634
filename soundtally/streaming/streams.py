"""Structured Streaming: energy-mean levels of event-time windows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from soundtally.functions.levels import laeq, lafmax
from soundtally.sources.place import shared_dir


def windowed_leq(levels: DataFrame, late: str = "1 hour", width: str = "5 minutes") -> DataFrame:
    """position, window_start, laeq, lafmax, n of a stream (position, ts, laeq, lafmax); later rows than ``late`` are left out."""
    w = levels.withWatermark("ts", late).groupBy("position", F.window("ts", width).alias("w"))
    out = w.agg(laeq(F.col("laeq")).alias("laeq"), lafmax(F.col("lafmax")).alias("lafmax"), F.count(F.lit(1)).alias("n"))
    return out.select("position", F.unix_millis(F.col("w.start")).alias("window_start"), "laeq", "lafmax", "n")


def stream_leq(spark: SparkSession, d: str) -> DataFrame:
    """The events table read as a stream to its end, in append mode: the windows that the watermark has closed by then. Their state is dropped as they are given out."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    level = 30 + F.least(F.col("value"), F.lit(600)) / 10.0
    # a glob, so that a table of one file and one of a folder are both read
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    levels = source.select(F.col("event_type").alias("position"), F.col("ts").cast("timestamp").alias("ts"), level.alias("laeq"), (level + 5).alias("lafmax"))
    return drained(windowed_leq(levels), "append")


def sessions(levels: DataFrame, late: str = "1 hour", gap: str = "5 minutes") -> DataFrame:
    """position, start_ms, end_ms, n of a stream (position, ts): runs without a gap of this length.

    In append mode a session is given out once, when the watermark has passed its end by
    the gap, and its state is dropped then; rows that come later than ``late`` are left
    out, and ``report`` says how many. Rows without a time have no session.
    """
    w = levels.withWatermark("ts", late).groupBy("position", F.session_window("ts", gap).alias("w"))
    return w.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n")).select("position", F.unix_millis("lo").alias("start_ms"), F.unix_millis("hi").alias("end_ms"), "n")


def first_per_time(levels: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream (position, ts) without later copies of a position's time, as long as they come within ``late``."""
    return levels.withWatermark("ts", late).dropDuplicatesWithinWatermark(["position", "ts"])


def events_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream (position, ts, event_id)."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return source.select(F.col("event_type").alias("position"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def report(run: StreamingQuery) -> list[dict]:
    """Of each batch of a query its number, rows read, rows held as state after it, rows left out as too late, and the watermark in milliseconds."""
    out = []
    for p in run.recentProgress:
        watermark = p.eventTime.get("watermark") if p.eventTime else None
        at = int(datetime.fromisoformat(watermark.replace("Z", "+00:00")).timestamp() * 1000) if watermark else 0
        out.append({"batch": p.batchId, "rows": p.numInputRows, "state_rows": sum(o.numRowsTotal for o in p.stateOperators), "late_rows": sum(o.numRowsDroppedByWatermark for o in p.stateOperators), "watermark_ms": at})
    return out


def drained(stream: DataFrame, mode: str, reports: list[dict] | None = None) -> DataFrame:
    """What a stream gives until its source is read to the end; in complete mode the last state. reports gets a ``report`` of each batch."""
    spark = stream.sparkSession
    place = shared_dir(spark)

    def keep(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{place}/out/epoch={epoch}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    if reports is not None:
        reports += report(run)
    out = spark.read.schema(stream.schema.add("epoch", "long")).parquet(f"{place}/out")
    if mode == "complete":
        out = out.join(F.broadcast(out.agg(F.max("epoch").alias("epoch"))), "epoch")
    return out.drop("epoch")


def ingest(spark: SparkSession, source: str) -> tuple[DataFrame, DataFrame]:
    """Lines 'position,ms,level' of the files in a folder, read as a stream to its end: rows, and lines that are none with their file.

    Each batch is written once under its number, so a batch run again after a failure replaces its own output.
    """
    place = shared_dir(spark)
    cells = F.split("value", ",")
    typed = spark.readStream.text(source).select("value", F.col("_metadata.file_name").alias("file"), F.get(cells, F.lit(0)).alias("position"), F.get(cells, F.lit(1)).try_cast("bigint").alias("ms"), F.get(cells, F.lit(2)).try_cast("double").alias("level"))
    good = F.col("ms").isNotNull() & F.col("level").isNotNull()

    def keep(df: DataFrame, epoch: int) -> None:
        marked = df.withColumn("good", good)
        marked.write.mode("overwrite").partitionBy("good").parquet(f"{place}/out/epoch={epoch}")

    run = typed.writeStream.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    out = spark.read.schema(typed.schema.add("good", "boolean").add("epoch", "long")).parquet(f"{place}/out")
    return out.where("good").select("position", "ms", "level"), out.where("not good").select("file", "value")
