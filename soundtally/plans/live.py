"""Queries that read the supplied tables as streams to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundtally.plans.base import log, query
from soundtally.plans.ingest import DAY, comma, files
from soundtally.sources.place import shared_dir
from soundtally.sources.lines import write_lines
from soundtally.streaming import retries, streams


@query("select position, ms, round(laeq, 6) as level, false as rejected from log where event_id % 9 > 0 union all select null, null, null, true from log where event_id % 9 = 0", "log")
def t1_stream_levels(spark, d):
    """The log as text lines, of which every ninth has no number; rows read, and lines rejected."""
    place = shared_dir(spark) + "/lines"
    level = F.when(F.col("event_id") % 9 > 0, F.col("laeq").cast("string")).otherwise("n/a")
    log(spark, d).select(F.concat_ws(",", "position", F.col("ms").cast("string"), level).alias("value")).write.text(place)
    rows, rejects = streams.ingest(spark, place)
    return rows.withColumn("rejected", F.lit(False)).unionByName(rejects.select(F.lit(True).alias("rejected")), allowMissingColumns=True)


@query(
    f"""select position, day, case when kind = 2 then 'rejected' else 'loaded' end as state, (case kind when 0 then 1 when 1 then 2 else 3 end)::int as attempts, 'sentry' as reader,
 case when kind = 2 then 'no rows found' end as reason, case when kind = 2 then 0 else 2 * n end as n, round(case when kind < 2 then high end, 6) as highest
 from (select position, (ms // {DAY})::bigint as day, case when position = 'view' and ms // {DAY} % 3 > 0 then 2 when ms // {DAY} % 3 = 1 then 1 else 0 end as kind, count(*) as n, max(lafmax) as high from log group by 1, 2, 3)""",
    "log",
)
def t1_retried_files(spark, d):
    """Files of the log, of which some can't be read at first and some never, over three rounds; those that can be mended are mended after the first."""
    rows = files(spark, d).withColumn("stamp", F.concat_ws(" ", "date", "time")).withColumn("day", F.floor(F.col("ms") / DAY))
    third = F.col("day") % 3
    kind = F.when((F.col("position") == "view") & (third > 0), 2).when(third == 1, 1).otherwise(0)
    named = rows.select(F.concat("path", F.lit("_2024_01_01__00h00m00s.csv")).alias("path"), F.col("event_id").alias("line_no"), kind.alias("kind"), comma("stamp", "laeq", "lafmax").alias("line"))
    head = named.select("path", F.lit(-1).cast("long").alias("line_no"), "kind", F.lit("Time (Date hh:mm:ss.ms),LEQ dB-A,Lmax dB-A").alias("line")).distinct()
    good = head.unionByName(named)
    bad = head.withColumn("line", F.lit("not yet"))
    source, place = shared_dir(spark), shared_dir(spark)
    write_lines(good.where("kind = 0").unionByName(bad.where("kind > 0")), source)
    retries.attempt(spark, source, place)
    write_lines(good.where("kind = 1"), source, renew=True)
    while retries.attempt(spark, source, place):
        pass
    levels = retries.loaded(spark, place).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("highest"))
    told = retries.ledger(spark, place).join(levels, "path", "left")
    part = F.split("path", "_")
    return told.select(part[0].alias("position"), part[1].cast("long").alias("day"), "state", "attempts", "reader", "reason", F.coalesce("n", F.lit(0)).alias("n"), "highest")


@query(
    """, s as (select position, ms, sum(coalesce((ms - prev > 300000)::int, 0)) over (partition by position order by ms rows unbounded preceding) as seg from (select *, lag(ms) over (partition by position order by ms) as prev from log))
 select position, min(ms) as start_ms, max(ms) as end_ms, count(*) as n from s group by position, seg""",
    "log",
)
def t3_stream_segments(spark, d):
    return streams.drained(streams.sessions(streams.events_stream(spark, d)), "complete")


SEGMENTS = """, s as (select position, ms, sum(coalesce((ms - prev > 300000)::int, 0)) over (partition by position order by ms rows unbounded preceding) as seg from (select *, lag(ms) over (partition by position order by ms) as prev from log)),
 closed as (select position, min(ms) as start_ms, max(ms) as end_ms, count(*) as n from s group by position, seg having max(ms) + 300000 <= (select max(ms) from log) - 3600000)"""


@query(SEGMENTS + " select * from closed", "log")
def t3_closed_segments(spark, d):
    """Segments in append mode: each is given out once, when the watermark has passed it."""
    return streams.drained(streams.sessions(streams.events_stream(spark, d)), "append")


@query(SEGMENTS + " select (select count(*) from log) as rows, 0::bigint as late_rows, (select count(distinct (position, seg)) from s) - (select count(*) from closed) as state_rows", "log")
def t3_state_report(spark, d):
    """Rows read, rows left out as too late, and sessions still held when the stream's end is reached: those that the watermark hasn't passed."""
    reports = []
    streams.drained(streams.sessions(streams.events_stream(spark, d)), "append", reports)
    total = lambda k: sum(r[k] for r in reports)
    return spark.createDataFrame([(total("rows"), total("late_rows"), reports[-1]["state_rows"])], "rows long, late_rows long, state_rows long")


@query("select distinct position, ms // 60000 * 60000 as ms from log", "log")
def t4_stream_dedupe(spark, d):
    minutes = streams.events_stream(spark, d).select("position", F.date_trunc("minute", "ts").alias("ts"))
    return streams.drained(streams.first_per_time(minutes), "append").select("position", F.unix_millis("ts").alias("ms"))
