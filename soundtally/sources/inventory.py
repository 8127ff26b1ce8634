"""What files a survey has: facts from names and paths, groups of one recorder and place, visits, job configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundtally.functions.texts import contents

# Words that mark a folder as a visit rather than a position.
VISIT_WORDS = ["verification", "monitoring", "testing", "test", "glazing", "manuals", "manual", "survey", "visit", "phase", "round"]
MONTHS = ["jan", "january", "feb", "february", "mar", "march", "apr", "april", "may", "jun", "june", "jul", "july", "aug", "august", "sep", "sept", "september", "oct", "october", "nov", "november", "dec", "december"]
# Name grammars of two kinds of recorders.
SESSION = r"(?i)^(\d{4}-\d{2}-\d{2}_SLM_\d{3})(?:_(123|RTA_3rd))?(?:_(Rpt_Report|Report|Log|VoiceNote))?\.(txt|xl2)$"
ROLE = r"(?i)^(.+?)[_\s-]*(log|summary)(_\d+[a-z]*)?\.csv$"


def is_visit(name: Column) -> Column:
    """Whether a folder's name has a visit's word, a month or a year, as whole words."""
    low = F.regexp_replace(F.lower(F.trim(name)), r"[_\-.]+", " ")
    words = rf"\b(?:{'|'.join(VISIT_WORDS)})s?\b|\b(?:{'|'.join(MONTHS)})\b|(?:^|\D)(?:19|20)\d\d(?:\D|$)"
    return F.coalesce(low.rlike(words), F.lit(False))


def facts(files: DataFrame) -> DataFrame:
    """files (path, bytes, ...) with visit, position, session, instrument, role and spectral, from the path alone.

    The last folder is the position and the first visit-like one above it the
    visit, else the first. A folder on its own is a visit if it is like one. With
    no position, the label comes from the file's name.
    """
    parts = F.filter(F.split(F.regexp_replace("path", r"\\", "/"), "/"), lambda p: p != "")
    f = files.withColumn("__p", parts).withColumn("name", F.element_at("__p", -1)).withColumn("__f", F.slice("__p", 1, F.greatest(F.size("__p") - 1, F.lit(0))))
    n, one, last = F.size("__f"), F.get("__f", F.lit(0)), F.try_element_at("__f", F.lit(-1))
    above = F.filter(F.slice("__f", F.lit(1), F.greatest(n - 1, F.lit(0))), is_visit)
    visit = F.when(n == 0, "").when(n == 1, F.when(is_visit(one), one).otherwise("")).otherwise(F.coalesce(F.get(above, F.lit(0)), one))
    place = F.when(n == 0, "").when((n == 1) & is_visit(one), "").otherwise(last)
    part = lambda i: F.lower(F.regexp_extract("name", SESSION, i))
    session, role = F.regexp_extract("name", SESSION, 1), F.lower(F.regexp_extract("name", ROLE, 2))
    kind = F.when(part(4) == "xl2", "raw").when(part(3) == "log", "log").when(part(3).isin("report", "rpt_report"), "summary").when(part(3) == "voicenote", "voice_note")
    bare = F.when(role != "", F.regexp_extract("name", ROLE, 1)).otherwise(F.regexp_replace("name", r"\.[^.]*$", ""))
    label = F.trim(F.regexp_replace(bare, r"(?i)[_\s-]*(log|summary|rpt_report|report)(_\d+[a-z]*)?$", ""), F.lit(" _-"))
    stem = F.when(session != "", session).otherwise(F.coalesce(F.nullif(label, F.lit("")), bare))
    return f.select(
        *files.columns,
        visit.alias("visit"),
        F.coalesce(F.nullif(place, F.lit("")), stem).alias("position"),
        session.alias("session"),
        F.when(session != "", "session").when((role != "") | F.lower("name").endswith(".svl"), "stem").alias("instrument"),
        F.when(session != "", kind).when(role != "", role).when(F.lower("name").endswith(".svl"), "raw").alias("role"),
        F.when(part(2) != "", part(2) == "rta_3rd").alias("spectral"),
    )


def groups(sources: DataFrame) -> DataFrame:
    """One row a (visit, position, session) of sources (.., role, instrument, spectral, lo, hi, bytes): a group is a spot reading if all its measured sources are shorter than an hour, recommended otherwise."""
    length = (F.col("hi") - F.col("lo")) / 1000
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    g = sources.groupBy("visit", "position", "session").agg(
        names("role").alias("roles"), names("instrument").alias("instruments"), F.coalesce(F.max("spectral"), F.lit(False)).alias("spectral"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(length).alias("duration_s"), F.sum("bytes").alias("bytes"),
        F.coalesce(F.min(length >= 3600), F.lit(True)).alias("__long"), F.coalesce(F.max(length) < 3600, F.lit(False)).alias("spot"),
    )
    return g.withColumn("recommended", ~F.col("spot")).drop("__long")


def visits(groups: DataFrame) -> DataFrame:
    """One row a visit, with place: the newest by its end first, those without times last."""
    v = groups.groupBy("visit").agg(F.count(F.lit(1)).alias("positions"), F.count_if("recommended").alias("recommended"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # one row a visit
    return v.withColumn("place", F.row_number().over(Window.orderBy(F.col("hi").desc_nulls_last(), "visit")).cast("long"))


def described(groups: DataFrame) -> DataFrame:
    """groups with contents, what each offers in words."""
    return groups.withColumn("contents", contents(F.split("roles", ", ")))


# Endings of files that a survey may have.
SUPPORTED = r"\.(csv|svl|txt|xlsx|xls|json|wav)$"


def scanned(files: DataFrame) -> DataFrame:
    """files (path, bytes, content) as they are listed: one row a file of a supported kind, but one a folder for recordings, with their number and bytes.

    A JSON file counts where its content is a configuration with a list of sources.
    """
    low = F.lower("path")
    config = F.get_json_object("content", "$.sources").startswith("[") | F.get_json_object("content", "$.sourceConfigs").startswith("[")
    some = files.where(low.rlike(SUPPORTED) & (~low.endswith(".json") | F.coalesce(config, F.lit(False))))
    audio = low.endswith(".wav")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    loud = some.where(audio).groupBy(folder.alias("path")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").cast("long").alias("bytes"))
    kind = F.when(low.endswith(".json"), "config").otherwise("file")
    return some.where(~audio).select("path", F.lit(1).cast("long").alias("files"), F.col("bytes").cast("long").alias("bytes"), kind.alias("kind")).unionByName(loud.withColumn("kind", F.lit("audio")))


def enabled_sources(sources: DataFrame) -> DataFrame:
    """Sources (position, path, enabled) that are used: enabled unless they say otherwise, with a position and a path."""
    return sources.where(F.coalesce("enabled", F.lit(True)) & F.col("position").isNotNull() & (F.col("position") != "") & F.col("path").isNotNull() & (F.col("path") != ""))


def job_sources(configs: DataFrame, listing: DataFrame) -> DataFrame:
    """(position, reader, columns, profile, axis, low, high, paths, missing) of configs (base, sources): the sources' paths against the base, grouped by what is to be read and how it is shown; missing counts paths that the listing lacks, paths has the others."""
    s = configs.select("base", F.explode("sources").alias("s")).select("base", "s.*")
    s = enabled_sources(s)
    full = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat_ws("/", "base", "path"))
    keys = ["position", "reader", "columns", "profile", "axis", "low", "high"]
    flat = s.withColumn("path", full).withColumn("reader", F.coalesce("reader", F.lit("auto"))).withColumn("columns", F.array_join(F.coalesce("columns", F.array().cast("array<string>")), ","))
    met = flat.join(listing.select("path", F.lit(True).alias("__there")).distinct(), "path", "left")
    there = F.col("__there").isNotNull()
    return met.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(there, F.col("path")))).alias("paths"), F.count_distinct(F.when(~there, F.col("path"))).alias("missing"))
