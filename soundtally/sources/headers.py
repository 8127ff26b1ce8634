"""What the first lines of a file tell of its layout, by a rule a reader."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundtally.sources import lines as T
from soundtally.sources.readers import SHORT_WORDS


@dataclass(frozen=True)
class Rule:
    """How a reader's files are looked at.

    The words are sought, in any case, in a header line, or in all of the first lines
    if ``anywhere``. The header is the first line with ``header`` of the words, else the
    first that isn't blank. ``likely`` and ``some`` are the numbers of words for the two
    better results; ``also`` are words in the first five lines that stand for some. The
    excerpt is the header, or so many of the first lines that aren't blank. reasons are
    the texts for blank lines, likely, some and none; without the first, blank lines
    are none.
    """

    first: int
    words: tuple[str, ...]
    likely: int
    some: int
    reasons: tuple[str, str, str, str]
    header: int = 1
    anywhere: bool = False
    also: tuple[str, ...] = ()
    excerpt: int = 0


EXCERPT = 200
# The words of each layout, how many are enough, and the texts of the results: blank, likely, some, none.
EMPTY = "File appears to be empty."
UNREADABLE = "No readable lines found in file header."
RULES = {
    "sentry": Rule(20, tuple(SHORT_WORDS), 4, 2, ("No header row detected in file head.", "Detected %d standard Noise Sentry header columns.", "Only a subset of expected Noise Sentry columns were detected.", "Header does not match typical Noise Sentry structure."), header=2),
    "svan": Rule(25, ("date", "time", "laeq", "lafmax", "lafmin", "laf10", "laf90", "lzeq", "band [hz]"), 4, 2, (UNREADABLE, "Detected %d typical SVAN column markers.", "Only a subset of SVAN markers detected in header.", "Header did not resemble typical SVAN exports."), also=("svan", "svantek"), excerpt=2),
    "nti": Rule(40, ("# hardware configuration", "# measurement setup", "# broadband results", "# rta results", "# rta log results", "# broadband log results", "serial number", "nti"), 3, 1, (UNREADABLE, "Found %d NTi section markers in header.", "Detected limited NTi markers; double-check file contents.", "Header did not include recognizable NTi markers."), anywhere=True, excerpt=4),
    "generic": Rule(20, ("date", "time", "timestamp"), 1, 1, ("", "Header contains datetime-related tokens.", "", "Header does not clearly indicate datetime columns."), header=0),
}


def _judged(rule: Rule, top: Column) -> Column:
    """(status, reason, excerpt, matches) of a file's first lines."""
    lines = F.filter(F.slice(top, 1, rule.first), lambda x: x.rlike(r"\S"))
    count = lambda x: sum((F.lower(x).contains(w).cast("int") for w in rule.words), F.lit(0))
    chosen = F.get(F.filter(lines, lambda x: count(x) >= rule.header), F.lit(0)) if rule.header else F.lit(None).cast("string")
    header = F.coalesce(chosen, F.get(lines, F.lit(0)), F.lit(""))
    if rule.anywhere:
        held = lambda w: F.exists(lines, lambda x: F.lower(x).contains(w)).cast("int")
        n = sum((held(w) for w in rule.words), F.lit(0))
    else:
        n = count(header)
    also = F.exists(F.slice(lines, 1, 5), lambda x: F.lower(x).rlike("|".join(rule.also))) if rule.also else F.lit(False)
    blank, likely, some, none = rule.reasons
    empty, bare = F.size(top) == 0, (F.size(lines) == 0) & F.lit(blank != "")
    unlikely = empty | bare
    status = F.when(unlikely, "unlikely_valid").when(n >= rule.likely, "likely_valid").otherwise("needs_review")
    found = F.format_string(likely, n) if "%d" in likely else F.lit(likely)
    reason = F.when(empty, EMPTY).when(bare, blank).when(n >= rule.likely, found).when((n >= rule.some) | also, some).otherwise(none)
    whole = F.array_join(F.slice(lines, 1, rule.excerpt), "\n") if rule.excerpt else F.regexp_replace(header, r"^\s+|\s+$", "") if rule.header > 1 else header
    return F.struct(status.alias("status"), reason.alias("reason"), F.substring(whole, 1, EXCERPT).alias("excerpt"), n.alias("matches"))


def hints(files: DataFrame, lines: DataFrame) -> DataFrame:
    """files (path, reader, ...) with status, reason, excerpt and matches: whether what begins a file is of its reader's layout.

    status is likely_valid, needs_review, unlikely_valid for files without lines, or
    unknown for readers without a rule. Only each file's first lines are shuffled, at
    most as many as the longest rule reads.
    """
    most = max(r.first for r in RULES.values())
    top = T.top(lines, most).select("path", F.transform("top", lambda x: x["line"]).alias("__top"))
    met = files.join(top, "path", "left").withColumn("__top", F.coalesce("__top", F.array().cast("array<string>")))
    none = F.struct(F.lit("unknown").alias("status"), F.lit("").alias("reason"), F.lit("").alias("excerpt"), F.lit(0).alias("matches"))
    judged = none
    for reader, rule in RULES.items():
        judged = F.when(F.col("reader") == reader, _judged(rule, F.col("__top"))).otherwise(judged)
    out = met.withColumn("__h", judged)
    return out.select(*files.columns, "__h.status", "__h.reason", "__h.excerpt", "__h.matches")
