"""Overview sheets: the tables of a folder's broadband and third-octave files side by side, by date and time.

A block is what all files of one kind in a folder hold: a record a row of their tables,
under the header of the folder's first file by name. Cells stay text, and '-.-' is 0.
A sheet has a row for each date and time that one of two blocks has. All folders are
done in one job; a header is a row a folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundtally.functions.texts import file_name
from soundtally.sources import lines as T
from soundtally.sources import readers
from soundtally.sources.place import cut


@dataclass(frozen=True)
class Kind:
    """title of the section with the table; how many rows head it, in which of them groups (or None), names and units stand, and from which cell on; cells of a row that tell its times, and the first value."""

    title: str
    head: int
    rows: tuple[int | None, int, int]
    named: int
    times: int
    values: int
    one: bool = False


# How the tables of one kind of recorder are laid out.
KINDS = {
    "123 log": Kind("Broadband LOG Results", 2, (None, 0, 1), 3, 3, 4),
    "rta log": Kind("RTA LOG Results", 3, (0, 1, 2), 4, 3, 5),
    "123 report": Kind("Broadband Results", 3, (None, 1, 2), 4, 4, 5, one=True),
    "123 rpt": Kind("Broadband Results", 3, (None, 1, 2), 4, 4, 5),
    "rta rpt": Kind("RTA Results", 3, (0, 1, 2), 5, 4, 6),
}
#: The section that counts where a third-octave log has several; else the first one.
PREFERRED = "RTA LOG Results L*eq_dt"
WIDEST = 9999


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _text(cell: Column) -> Column:
    t = F.trim(F.coalesce(cell, F.lit("")))
    return F.when(t == "-.-", "0").otherwise(t)


def _heads(tables: DataFrame, columns: Column) -> DataFrame:
    """(folder, columns) by the first file of each folder that has a header."""
    return tables.groupBy(folder(F.col("path")).alias("folder")).agg(F.min_by(columns, "path").alias("columns"))


def _titles(upper: Column, names: Column, units: Column) -> Column:
    return F.transform(F.arrays_zip(upper.alias("a"), names.alias("b"), units.alias("c")), lambda x: F.struct(_text(x["a"]).alias("upper"), _text(x["b"]).alias("name"), _text(x["c"]).alias("unit")))


def block(lines: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Headers (folder, columns) and records (folder, date, time, file, times, cells, path, line_no) of the files of a kind.

    columns are structs of upper, name and unit; times are the timer, or the date and
    time of the end. Only a file's first record has its name. Files without a whole
    header, and rows without a date and a time, aren't there.
    """
    if kind == "rta report":
        return _band_reports(lines)
    k = KINDS[kind]
    body = T.sections(lines).where(F.col("section").startswith(k.title) & F.col("line").rlike(r"\S"))
    later = ~F.col("section").startswith(PREFERRED)
    chosen = body.groupBy("path").agg(F.min_by("section", F.struct(later, "line_no")).alias("__section"))
    table = cut(T.with_heads(body, chosen).where("section = __section").select("path", "line_no", "line"))
    top = T.top(table, k.head).where(F.size("top") == k.head)
    row = lambda i: F.array().cast("array<string>") if i is None else F.slice(F.split(F.get("top", F.lit(i))["line"], "\t"), k.named + 1, WIDEST)
    heads = top.select("path", F.get("top", F.lit(k.head - 1))["line_no"].alias("header_no"), _titles(*map(row, k.rows)).alias("columns"))
    below = T.with_heads(table, heads.select("path", "header_no")).where(F.col("line_no") > F.col("header_no"))
    first = below.groupBy("path").agg(F.min("line_no").alias("__first"))
    rows = T.with_heads(below, first).withColumn("c", F.transform(F.split("line", "\t"), _text))
    if k.one:
        rows = rows.where(F.col("line_no") == F.col("__first"))
    known = rows.where((F.coalesce(F.get("c", F.lit(1)), F.lit("")) != "") & (F.coalesce(F.get("c", F.lit(2)), F.lit("")) != ""))
    file = F.when(F.col("line_no") == F.col("__first"), file_name(F.col("path")))
    records = known.select(folder(F.col("path")).alias("folder"), F.col("c")[1].alias("date"), F.col("c")[2].alias("time"), file.alias("file"), F.slice("c", 4, k.times - 2).alias("times"), F.slice("c", k.values + 1, WIDEST).alias("cells"), "path", "line_no")
    return _heads(heads, F.col("columns")), records


def _band_reports(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The block of third-octave reports with one measurement each: its metrics one after the other, each with all bands."""
    r = cut(readers.single_band_reports(lines))
    per = lambda of: F.flatten(F.transform("metrics", of))
    columns = _titles(per(lambda m: F.transform("header", lambda _: m["name"])), per(lambda m: F.col("header")), per(lambda m: F.col("units")))
    day = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd")
    clock = lambda c: F.date_format(F.timestamp_millis(c), "HH:mm:ss")
    records = r.select(folder(F.col("path")).alias("folder"), day("start_ms").alias("date"), clock("start_ms").alias("time"), file_name(F.col("path")).alias("file"), F.array(day("end_ms"), clock("end_ms")).alias("times"), per(lambda m: F.transform(m["texts"], _text)).alias("cells"), "path", F.lit(0).alias("line_no"))
    return _heads(r, columns), records


def sheet(left: DataFrame, right: DataFrame) -> DataFrame:
    """(folder, date, time) of either block's records, and file, times and cells of each, as left_... and right_...; null where a block has none.

    Of records of one date and time in a block the last counts, by path and line.
    """
    keys = ["folder", "date", "time"]

    def last(records: DataFrame, side: str) -> DataFrame:
        r = records.groupBy(*keys).agg(F.max_by(F.struct("file", "times", "cells"), F.struct("path", "line_no")).alias("r"))
        return r.select(*keys, F.col("r.file").alias(f"{side}_file"), F.col("r.times").alias(f"{side}_times"), F.col("r.cells").alias(f"{side}_cells"))

    return last(left, "left").join(last(right, "right"), keys, "full")


def wide(rows: DataFrame, headers: DataFrame, side: str) -> DataFrame:
    """Sheet rows with a text column for each cell of a side, named by the header of the first folder: side, group and name, joined by _; equal names are numbered from 2."""
    first = headers.agg(F.min_by("columns", "folder").alias("columns"))
    bare = F.transform("columns", lambda c: F.regexp_replace(F.concat_ws("_", F.lit(side), F.nullif(c["upper"], F.lit("")), F.nullif(c["name"], F.lit(""))), r"\W", "_"))
    names = first.select(T.numbered(bare, 1).alias("names")).head()["names"] or []  # one row
    return rows.select(*[c for c in rows.columns if c != f"{side}_cells"], *[F.get(f"{side}_cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
