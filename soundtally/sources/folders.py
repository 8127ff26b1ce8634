"""Folders of files as tables: what is there, and what a few bytes of each file's ends tell.

A file that Spark wrote is a folder of parts below folders named key=value; it counts
as one file whose path are the values. Nothing reads a file's content but ``ends``, which
reads so many bytes from its beginning and its end, and ``configs``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundtally.functions.texts import file_name
from soundtally.sources import inventory as I
from soundtally.sources import names as N
from soundtally.sources.place import opened

#: Bytes that are read from each end of a file.
END_BYTES = 8192
#: Lines below the header whose times tell the cadence, and lines that may be the header of the columns.
STAMPS, HEADER_LINES = 33, 40
# Fixed value: a date and a time on one line, year first or last, with tabs between them or blanks.
STAMP = r"\d{4}[-/]\d{2}[-/]\d{2}[ \tT]+\d{2}:\d{2}(?::\d{2})?|\d{2}[-/]\d{2}[-/]\d{4}[ \tT]+\d{2}:\d{2}(?::\d{2})?"
# Columns of bands in a log's header.
BAND_COLUMNS = r"(?i)^l[a-z0-9]+_[0-9]+(\.[0-9]+)?$"
HERTZ = r"(?i)^[0-9]+(\.[0-9]+)?\s*hz$"


def _logical(file: Column, root: str) -> Column:
    """A file's path below root, without the parts of what Spark wrote."""
    # the root may be written with a scheme or without
    below = F.regexp_replace(F.element_at(F.split(file, root.rstrip("/").split(":", 1)[-1].replace(".", "[.]"), 2), 2), "^/+", "")
    steps = F.split(below, "/")
    written = F.exists(steps, lambda s: s.contains("="))
    value = lambda s: F.url_decode(F.replace(F.regexp_extract(s, "^[^=]*=(.*)$", 1), F.lit("+"), F.lit("%2B")))
    return F.when(written, F.array_join(F.transform(F.filter(steps, lambda s: s.contains("=")), value), "/")).otherwise(below)


def parts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, file, bytes, modified_ms) of what ``listing`` sums up: a row a file, or a row a part of one that Spark wrote."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    seen = raw.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.unix_millis("modificationTime").alias("modified_ms"))
    return seen.withColumn("path", _logical(F.col("file"), root)).where(~file_name(F.col("file")).rlike("^[._]")).select("path", "file", "bytes", "modified_ms")


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, modified_ms, first_file, last_file) of all files below a folder, at any depth; only their metadata are read.

    path is relative to root, first_file and last_file are where its first and its last
    byte are. Hidden files, empty ones and empty folders aren't there.
    """
    held = F.when(F.col("bytes") > 0, F.col("file"))
    return parts(spark, root, pattern).groupBy("path").agg(F.sum("bytes").alias("bytes"), F.max("modified_ms").alias("modified_ms"), F.coalesce(F.min(held), F.min("file")).alias("first_file"), F.coalesce(F.max(held), F.max("file")).alias("last_file"))


def configs(spark: SparkSession, root: str, largest: int = 1 << 20) -> DataFrame:
    """(path, content) of the JSON files below a folder that have up to so many bytes, as text; of one in parts the first one's."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length").between(1, largest))
    named = raw.select(_logical(F.col("path"), root).alias("path"), F.col("path").alias("file"), "content").where(F.lower("path").endswith(".json"))
    return named.groupBy("path").agg(F.min_by(F.col("content").cast("string"), "file").alias("content"))


def ends(files: DataFrame, size: int = END_BYTES, opener: Callable[[str], AbstractContextManager[BinaryIO]] = opened) -> DataFrame:
    """files (path, first_file, last_file, ...) with head, tail, bytes_read and error.

    Each task reads at most 2 * size bytes of each of its files, however long they are;
    the tail is the head where a file has no more. A file that can't be read has an
    error instead, and none of them fails the job.
    """
    new = "head string, tail string, bytes_read long, error string"
    schema = files.schema
    for f in files.sparkSession.createDataFrame([], new).schema:
        schema = schema.add(f)

    def both(first: str, last: str) -> tuple[str, str, int, None]:
        with opener(first) as held:
            head, length = held.read(size), held.seek(0, 2)
            tail = b""
            if last == first and length > size:
                held.seek(max(0, length - size))
                tail = held.read(size)
        if last != first:
            with opener(last) as held:
                held.seek(max(0, held.seek(0, 2) - size))
                tail = held.read(size)
        text = head.decode("utf-8", "replace")
        return text, tail.decode("utf-8", "replace") if tail else text, len(head) + len(tail), None

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for first, last in zip(pdf["first_file"], pdf["last_file"], strict=True):
                try:
                    out.append(both(first, last))
                except Exception as e:  # noqa: BLE001 - whatever a store raises is a fact about the file
                    out.append((None, None, 0, f"{type(e).__name__}: {e}"))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=["head", "tail", "bytes_read", "error"])], axis=1)

    # a task reads a share of the files, whatever their lengths
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, schema)


def stamp_ms(text: Column) -> Column:
    """Milliseconds of a date with a time: year first; else month first, or day first where the first number is no month."""
    part = lambda form, i: F.regexp_extract(text, form, i)
    first = r"^(\d{4})[-/](\d{2})[-/](\d{2})[ \tT]+(.*)$"
    last = r"^(\d{2})[-/](\d{2})[-/](\d{4})[ \tT]+(.*)$"
    swap = part(last, 1) > "12"
    month, day = F.when(swap, part(last, 2)).otherwise(part(last, 1)), F.when(swap, part(last, 1)).otherwise(part(last, 2))
    iso = F.when(text.rlike(first), F.concat_ws(" ", F.concat_ws("-", part(first, 1), part(first, 2), part(first, 3)), part(first, 4)))
    return F.unix_millis(F.try_to_timestamp(F.coalesce(iso, F.concat_ws(" ", F.concat_ws("-", part(last, 3), month, day), part(last, 4)))))


def probed(ends: DataFrame) -> DataFrame:
    """ends (head, tail, ...) with start_ms and end_ms: the first time in the head and the last in the tail, in order; null where there is none. What looks like a time but is none is passed over."""
    times = lambda c: F.filter(F.transform(F.regexp_extract_all(c, F.lit(f"({STAMP})"), F.lit(1)), stamp_ms), lambda t: t.isNotNull())
    first, last = F.get(times("head"), F.lit(0)), F.try_element_at(times("tail"), F.lit(-1))
    both = ends.withColumn("__a", first).withColumn("__b", last)
    turned = F.col("__b") < F.col("__a")
    return both.withColumn("start_ms", F.when(turned, F.col("__b")).otherwise(F.col("__a"))).withColumn("end_ms", F.when(turned, F.col("__a")).otherwise(F.col("__b"))).drop("__a", "__b")


def peeked(ends: DataFrame) -> DataFrame:
    """ends (head, ...) with columns, spectral and step_ms, from the head alone.

    A tab in the first 20 lines separates cells, else a comma. The header is the first
    line with a cell that names date and time, or a cell for each; columns are its
    cells if it is among the first HEADER_LINES. step_ms is the median positive
    gap of the first 32 times below it, 0 where there are not two.
    """
    lines = F.split(F.regexp_replace("head", r"\r\n?", "\n"), "\n")
    tabbed = F.exists(F.slice("__l", 1, 20), lambda x: x.contains("\t"))
    bare = lambda c: F.trim(F.trim(c), F.lit('"'))
    cells = F.transform("__l", lambda x: F.transform(F.split(x, F.col("__s")), bare))
    one = lambda c: F.lower(c).contains("date") & F.lower(c).contains("time")
    date = lambda c: F.lower(c).isin("date", "start date")
    time = lambda c: F.lower(c).isin("time", "start time")
    header = lambda r: F.exists(r, one) | (F.exists(r, date) & F.exists(r, time))
    place = lambda test: F.array_position(F.transform("__h", test), F.lit(True)).cast("int")
    cut = ends.withColumn("__l", lines).withColumn("__s", F.when(tabbed, "\t").otherwise(",")).withColumn("__c", cells)
    cut = cut.withColumn("__at", F.array_position(F.transform("__c", header), F.lit(True)).cast("int")).withColumn("__h", F.try_element_at("__c", F.nullif(F.col("__at"), F.lit(0))))
    cut = cut.withColumn("__one", place(one)).withColumn("__date", place(date)).withColumn("__time", place(time))
    cell = lambda r, at: F.coalesce(F.get(r, at - 1), F.lit(""))
    text = lambda r: F.when(F.col("__one") > 0, cell(r, F.col("__one"))).otherwise(F.trim(F.concat_ws(" ", cell(r, F.col("__date")), cell(r, F.col("__time")))))
    # 32 gaps need 33 lines; unreadable ones don't count
    rows = F.slice("__c", F.col("__at") + 1, F.lit(STAMPS))
    times = F.slice(F.filter(F.transform(rows, lambda r: F.coalesce(stamp_ms(text(r)), F.unix_millis(F.try_to_timestamp(text(r))))), lambda t: t.isNotNull()), 1, 32)
    gaps = F.array_sort(F.filter(F.zip_with(F.slice("__t", F.lit(2), F.greatest(F.size("__t") - 1, F.lit(0))), F.slice("__t", F.lit(1), F.greatest(F.size("__t") - 1, F.lit(0))), lambda b, a: b - a), lambda g: g > 0))
    n = F.size("__g")
    middle = (F.get("__g", F.floor((n - 1) / 2).cast("int")) + F.get("__g", F.floor(n / 2).cast("int"))) / 2
    found = F.col("__at") > 0
    columns = F.when(found & (F.col("__at") <= HEADER_LINES), F.col("__h"))
    cut = cut.withColumn("__t", F.when(found, times).otherwise(F.array().cast("array<bigint>"))).withColumn("__g", gaps)
    cut = cut.withColumn("columns", columns)
    spectral = F.exists("columns", lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike(BAND_COLUMNS) | c.rlike(HERTZ))
    out = cut.withColumn("spectral", F.coalesce(spectral, F.lit(False))).withColumn("step_ms", F.when(n > 0, middle).otherwise(0.0))
    return out.drop("__l", "__s", "__c", "__at", "__h", "__one", "__date", "__time", "__t", "__g")


def survey(spark: SparkSession, root: str, opener: Callable[[str], AbstractContextManager[BinaryIO]] = opened) -> DataFrame:
    """What a survey's folder has: one row a file that a reader takes, a folder of recordings, and a configuration.

    path, kind (file, audio, config), files, bytes, reader, visit, position, session,
    instrument, role, spectral, start_ms, end_ms, duration_s, spot, recommended. Times
    come from the ends of each file. A reading of less than an hour is a spot reading and
    isn't recommended; without times a file is. Configurations need a list of sources.
    """
    found = listing(spark, root)
    low = F.lower("path")
    kept = found.where(low.rlike(I.SUPPORTED)).join(configs(spark, root), "path", "left")
    summed = I.scanned(kept)
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    loud = found.where(low.endswith(".wav")).select(folder.alias("__dir"), "path", F.lit(0).alias("bytes"))
    first = I.facts(loud.groupBy("__dir").agg(F.min("path").alias("path"), F.max("bytes").alias("bytes"))).select(F.col("__dir").alias("path"), "visit", file_name(F.col("__dir")).alias("position"))
    audio = summed.where("kind = 'audio'").join(first, "path").select("path", "kind", "files", "bytes", F.lit("audio").alias("reader"), "visit", "position", F.lit("").alias("session"), F.lit("").alias("instrument"), F.lit("audio").alias("role"))
    job = summed.where("kind = 'config'").select("path", "kind", "files", "bytes", F.lit("config").alias("reader"))
    read = N.routed(found.where(~low.endswith(".wav") & ~low.endswith(".json") & low.rlike(I.SUPPORTED)).withColumn("forced", F.lit(None).cast("string"))).where("reader is not null")
    timed = probed(ends(read, opener=opener)).drop("head", "tail")
    facts = I.facts(timed).withColumn("duration_s", (F.col("end_ms") - F.col("start_ms")) / 1000)
    spot = F.coalesce(F.col("duration_s") < 3600, F.lit(False))
    one = facts.select("path", F.lit("file").alias("kind"), F.lit(1).cast("long").alias("files"), "bytes", "reader", "visit", "position", "session", "instrument", "role", "spectral", "start_ms", "end_ms", "duration_s", spot.alias("spot"))
    every = one.unionByName(audio, allowMissingColumns=True).unionByName(job, allowMissingColumns=True)
    return every.withColumn("spot", F.coalesce("spot", F.lit(False))).withColumn("recommended", ~F.col("spot"))
