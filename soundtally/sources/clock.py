"""Local clock times to UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_utc(rows: DataFrame, zone: str, by: str = "path", line: str = "line_no") -> DataFrame:
    """rows (by, line, local TIMESTAMP_NTZ) with utc TIMESTAMP_NTZ, whatever the session's zone.

    A time that the clock skips moves to the end of the gap, for gaps of an hour.
    In an hour that the clock shows twice the rows of a file up to the first step
    that doesn't go forward are summer time, the later ones winter time; without
    such a step, or with several, the rows of that hour go. Only these hours' rows
    are ordered, so a file isn't one window partition.
    """
    hour = F.expr("interval 1 hour")
    local_of = lambda t: F.convert_timezone(F.lit("UTC"), F.lit(zone), t)
    first = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col("local"))
    r = rows.withColumn("__u", first)
    skipped = local_of(F.col("__u")) != F.col("local")
    start = F.expr("make_timestamp_ntz(year(local), month(local), day(local), hour(local), 0, 0)")
    r = r.withColumn("__u", F.when(skipped, F.convert_timezone(F.lit(zone), F.lit("UTC"), start)).otherwise(F.col("__u")))
    late, early = local_of(F.col("__u") + hour) == F.col("local"), local_of(F.col("__u") - hour) == F.col("local")
    r = r.withColumn("__base", F.when(late, F.col("__u")).when(early, F.col("__u") - hour)).withColumn("__run", F.to_date("__base"))
    run = Window.partitionBy(by, "__run").orderBy(line)
    twice = r.where("__base is not null")
    twice = twice.withColumn("__back", F.coalesce((F.col("local") <= F.lag("local").over(run)).cast("int"), F.lit(0)))
    twice = twice.withColumn("__n", F.sum("__back").over(Window.partitionBy(by, "__run"))).withColumn("__after", F.sum("__back").over(run))
    told = twice.where("__n = 1").withColumn("utc", F.when(F.col("__after") > 0, F.col("__base") + hour).otherwise(F.col("__base")))
    plain = r.where("__base is null").withColumn("utc", F.col("__u"))
    return plain.select(*rows.columns, "utc").unionByName(told.select(*rows.columns, "utc"))
