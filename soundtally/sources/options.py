"""What a configuration asks of each source: a profile, and which of its broadband levels are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundtally.sources import lines as T
from soundtally.sources.place import cut


def _wanted(columns: Column) -> Column:
    """The names asked for but the time's; null where none are, so that all are kept."""
    asked = F.filter(columns, lambda c: F.coalesce(c, F.lit("")).isin("", "Datetime") == F.lit(False))
    return F.when(F.size(columns) > 0, asked)


def _met(rows: DataFrame, options: DataFrame) -> DataFrame:
    one = options.groupBy("path").agg(F.min_by(F.struct("columns", "forced_profile"), F.struct("columns", "forced_profile")).alias("__o"))
    asked = one.select("path", _wanted(F.col("__o.columns")).alias("__wanted"), F.nullif(F.col("__o.forced_profile"), F.lit("")).alias("__profile"))
    return T.with_heads(rows, asked, "left", "ms")


def with_options(rows: DataFrame, options: DataFrame) -> DataFrame:
    """rows (path, profile, ms, name, freq_hz, level, ...) as options (path, columns, forced_profile) want them.

    A forced profile replaces the file's. Of broadband levels, which have no freq_hz, the
    columns asked for stay, in any number; bands stay. A file that has none of them keeps
    its times, in a row each whose name and further columns are null. No columns, and
    columns that are an empty list, ask for nothing; the time needn't be asked for. Of
    several options of a path the smallest counts.
    """
    met = _met(rows, options)
    total = F.col("freq_hz").isNull()
    held = F.array_contains("__wanted", F.col("name"))
    selects = total & F.col("__wanted").isNotNull()
    profiled = met.withColumn("profile", F.coalesce("__profile", "profile"))
    kept = profiled.where(~selects | held).select(*rows.columns)
    bare = cut(profiled.where(selects).groupBy("path").agg(F.bool_or(F.coalesce(held, F.lit(False))).alias("__any")).where("not __any")).select("path")
    times = T.with_heads(profiled.where(selects), bare, order="ms").select("path", "profile", "ms").distinct()
    return kept.unionByName(times, allowMissingColumns=True).select(*rows.columns)


def missing(rows: DataFrame, options: DataFrame) -> DataFrame:
    """(path, missing): the columns asked for that a file's broadband levels don't have, of files with some."""
    have = _met(rows.where("freq_hz is null"), options).where("__wanted is not null").groupBy("path", "__wanted").agg(F.collect_set("name").alias("__have"))
    return have.select("path", F.array_except("__wanted", "__have").alias("missing")).where(F.size("missing") > 0)
