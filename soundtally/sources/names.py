"""Routing by file name, and what names tell of profiles and recordings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundtally.functions.texts import file_name
from soundtally.sources import added

# File name patterns of the loggers, and other names of the readers.
SECTIONED = r"_(rta|123)_"
SECTIONED_END = r"_report\.txt|_log\.txt"
STAMPED = r"_\d{4}_\d{2}_\d{2}__\d{2}h\d{2}m\d{2}s.*\.csv$"
TABULAR = r"\.(csv|svl)$|overview\.xlsx"
ALIASES = {"sentry": "sentry", "noisesentry": "sentry", "svan": "svan", "svantek": "svan", "nti": "nti", "audio": "audio", "wav": "audio", "generic": "generic", "plotlinesonly": "generic", "lineonly": "generic"}


def routed(files: DataFrame) -> DataFrame:
    """files (path, forced) with reader: nti, sentry, svan, audio, generic, one that a user added, or null. A forced reader that has a known name wins, underscores, dashes and case aside; else the file's name decides, by the added readers first."""
    low = F.lower(file_name(F.col("path")))
    names = ALIASES | {re.sub("[_-]", "", name): name for name in added.READERS}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    asked = F.element_at(known, F.regexp_replace(F.lower(F.trim(F.coalesce("forced", F.lit("")))), "[_-]", ""))
    named = F.when(low.rlike(r"\.wav$"), "audio").when(low.rlike(SECTIONED_END) & low.rlike(SECTIONED), "nti").when(low.rlike(STAMPED), "sentry").when(low.rlike(TABULAR), "svan")
    extra = [F.when(low.rlike(r.pattern), r.name) for r in added.READERS.values()]
    return files.withColumn("reader", F.coalesce(asked, *extra, named))


def profile(path: Column, reader: Column, top: Column, period_s: Column) -> Column:
    """log, overview or unknown, by the reader's rule.

    Names decide for svan, then marks in its first five lines, given in capitals as
    top; the period alone for sentry; words in the name and then the period for
    generic; the file's ending for nti.
    """
    name = file_name(path)
    up, low = F.upper(name), F.lower(name)
    mark = lambda m: F.exists(top, lambda x: x.contains(m))
    first = F.get(F.filter(top, lambda x: x.contains("(TH)") | x.contains("(SR)")), F.lit(0))
    by_period = F.when(period_s > 60, "overview").otherwise("log")
    svan = F.when(up.contains("_LOG.CSV") | up.contains("_LOG_"), "log").when(up.contains("_SUMMARY.CSV"), "overview").when(first.contains("(TH)"), "log").when(mark("(SR)"), "overview").otherwise("unknown")
    words = F.when(low.rlike("summary|overview"), "overview").when(low.contains("log"), "log").otherwise(by_period)
    return F.when(reader == "svan", svan).when(reader == "sentry", by_period).when(reader == "nti", F.when(low.rlike(r"_log\.txt"), "log").otherwise("overview")).otherwise(words)


def recording_index(path: Column) -> Column:
    """The number in a recording's name: R<n>.wav, or _<n>.wav at its end."""
    name = file_name(path)
    number = lambda form: F.nullif(F.regexp_extract(name, form, 1), F.lit(""))
    return F.coalesce(number(r"(?i)^R(\d+)\.wav$"), number(r"(?i)_(\d+)\.wav$")).try_cast("bigint")


def recordings(files: DataFrame) -> DataFrame:
    """(path, folder, recording_no, size_mb, end_ms, duration_s, rank) of files (path, bytes, modified_ms, duration_s) that are recordings of some length.

    They are named r*.wav or *_audio_*.wav, in any case. The time of their last change
    is rounded to seconds. rank orders a folder's: numbers by value, before names.
    """
    low = F.lower(file_name(F.col("path")))
    r = files.where(low.rlike(r"^r.*\.wav$|_audio_.*\.wav$") & (F.col("duration_s") > 0))
    out = r.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), recording_index(F.col("path")).alias("recording_no"), F.round(F.col("bytes") / 1048576, 2).alias("size_mb"), (F.round(F.col("modified_ms") / 1000) * 1000).cast("long").alias("end_ms"), "duration_s")
    order = Window.partitionBy("folder").orderBy(F.col("recording_no").isNull(), "recording_no", "path")
    return out.withColumn("rank", F.row_number().over(order).cast("long"))
