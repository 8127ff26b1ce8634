"""What the registered queries share: views of the supplied tables, in Spark and in SQL, and the register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundtally.functions import levels as L
from soundtally.operators import timeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
H = L.HOUR_MS

#: Views that every SQL text may use; the same tables as the functions below.
VIEWS = {
    "log": "select event_type as position, epoch_us(ts) // 1000 as ms, event_id, 30 + least(value, 600) / 10.0 as laeq, 30 + least(value, 600) / 10.0 + 5 as lafmax from events",
    "spectra": "select 'P' || label as position, vec_id * 1000 as ms, u.i as freq_hz, 50 + 10 * embedding[u.i]::double as level from embeddings, unnest(range(1, 65)) as u(i)",
    "overview": f"select position, ms // {H} * {H} as ms, 10 * log10(avg(pow(10.0, laeq / 10))) as laeq, max(lafmax) as lafmax from log group by 1, 2",
    "areas": f"select event_id as region_id, position, ms as start_ms, ms + (coalesce(lead(ms) over (partition by position order by ms, event_id), ms + {H}) - ms) * (1 + event_id % 3) // 2 as end_ms from log",
    "markers": "select event_id as marker_id, ms from log where position = 'error'",
    "extent": "select position, min(ms) as lo, max(ms) as hi from log group by 1",
}


def log(spark: SparkSession, d: str) -> DataFrame:
    """events as a level log: position, ms, event_id, laeq, lafmax."""
    e = spark.read.parquet(f"{d}/events.parquet")
    level = 30 + F.least(F.col("value"), F.lit(600)) / 10.0
    return e.select(F.col("event_type").alias("position"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id", level.alias("laeq"), (level + 5).alias("lafmax"))


def spectra(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("P"), F.col("label")).alias("position"), (F.col("vec_id") * 1000).alias("ms"), F.posexplode("embedding").alias("i", "x"))
    return e.select("position", "ms", (F.col("i") + 1).cast("long").alias("freq_hz"), (50 + 10 * F.col("x").cast("double")).alias("level"))


def overview(rows: DataFrame) -> DataFrame:
    return rows.groupBy("position", (F.floor(F.col("ms") / H) * H).alias("ms")).agg(L.laeq(F.col("laeq")).alias("laeq"), L.lafmax(F.col("lafmax")).alias("lafmax"))


def areas(rows: DataFrame) -> DataFrame:
    """A region for every row: it ends halfway to the next row of its position, at it, or half as far again beyond."""
    ends = timeline.interval_end(rows, H)
    length = F.floor((F.col("end_ms") - F.col("ms")) * (1 + F.col("event_id") % 3) / 2).cast("long")
    return ends.select(F.col("event_id").alias("region_id"), "position", F.col("ms").alias("start_ms"), (F.col("ms") + length).alias("end_ms"))


def extent(rows: DataFrame) -> DataFrame:
    return rows.groupBy("position").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, *views: str):
    """Registers a function; its doubles are rounded to six places, as the SQL's are by hand."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, d: rounded(f(spark, d))
        if sql:
            need = [v for v in VIEWS if v in views or v == "log" and views]
            SQL[f.__name__] = ("with " + ", ".join(f"{v} as ({VIEWS[v]})" for v in need) + " " if need else "") + sql
        return f

    return add


#: Energy mean of a column in SQL, rounded.
ENERGY = "round(10 * log10(avg(pow(10.0, {0} / 10))), 6)"
