"""Text files as (path, line_no, line): written, read back, cut into sections and columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soundtally.sources.place import cut


def write_lines(lines: DataFrame, place: str, renew: bool = False) -> None:
    """Writes (path, line_no, line) as text, one folder path=... a file, in order of line_no; with renew over files that are there, and no others."""
    laid = lines.repartition("path").sortWithinPartitions("path", "line_no").select("path", F.col("line").alias("value")).write.partitionBy("path")
    (laid.mode("overwrite").option("partitionOverwriteMode", "dynamic") if renew else laid).text(place)


def read_lines(spark: SparkSession, place: str) -> DataFrame:
    """The lines of a folder that ``write_lines`` made. line_no orders them within a file, also where a file is read in several splits."""
    raw = spark.read.text(place).select("path", "value", F.col("_metadata.file_block_start").alias("block"))
    return raw.select(F.col("path").cast("string").alias("path"), F.struct("block", F.monotonically_increasing_id().alias("i")).alias("line_no"), F.col("value").alias("line"))


#: Rows of a table with one row a file that are broadcast at most; more are met in MANY parts a file.
FEW, MANY = 20_000, 16
#: Section lines of a file up to which each of its lines looks them up.
MARKS = 200


def with_heads(lines: DataFrame, heads: DataFrame, how: str = "inner", order: str = "line_no") -> DataFrame:
    """lines with the columns of heads, which has a row a file at most: broadcast if their number, which is counted, allows it, else met in parts by order, so that a long file isn't one task. A left join keeps lines of files without a head."""
    small = cut(heads)
    if small.count() <= FEW:
        return lines.join(F.broadcast(small), "path", how)
    dealt = lines.withColumn("__part", F.pmod(F.xxhash64(order), F.lit(MANY)).cast("int"))
    return dealt.join(small.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(MANY - 1)))), ["path", "__part"], how).drop("__part")


def sections(lines: DataFrame, marker: str = r"^#", end: str = "#CheckSum") -> DataFrame:
    """Lines below a section line, with its text as section; what follows a line with ``end`` goes.

    A file has few section lines. They are gathered by file and each line looks up
    the last one above it, so that no file is ordered in one task. A file with more
    than MARKS of them is ordered after all.
    """
    title = F.trim(F.regexp_replace("line", "^#+", ""))
    marked = lines.where(F.col("line").rlike(marker))
    many = marked.groupBy("path").agg(F.count(F.lit(1)).alias("__n"))
    heads = cut(many)
    few = heads.where(F.col("__n") <= MARKS).select("path")
    marks = marked.join(F.broadcast(few) if heads.count() <= FEW else few, "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", title.alias("title"), F.col("line").contains(end).alias("end")))).alias("marks"))
    met = with_heads(lines.where(~F.col("line").rlike(marker)), marks)
    above = F.filter("marks", lambda m: m["line_no"] < F.col("line_no"))
    here = met.withColumn("__above", above).where((F.size("__above") > 0) & ~F.exists("__above", lambda m: m["end"]))
    out = here.select("path", "line_no", "line", F.element_at("__above", -1)["title"].alias("section"))
    if heads.where(F.col("__n") > MARKS).isEmpty():
        return out
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    long = lines.join(heads.where(F.col("__n") > MARKS).select("path"), "path", "left_semi")
    is_mark = F.col("line").rlike(marker)
    filled = long.withColumn("section", F.last(F.when(is_mark, title), True).over(w)).withColumn("__over", F.max(is_mark & F.col("line").contains(end)).over(w))
    return out.unionByName(filled.where(~is_mark & F.col("section").isNotNull() & ~F.col("__over")).select("path", "line_no", "line", "section"))


def top(lines: DataFrame, first: int) -> DataFrame:
    """(path, top): each file's first lines in order, as structs of line_no and line. Tasks cut to that number before the shuffle."""
    w = Window.partitionBy("path").orderBy("line_no")
    early = lines.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= first)
    return early.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("top"))


def found(lines: DataFrame, first: int, test: Callable[[Column], Column]) -> DataFrame:
    """(path, top, at, header, header_no) of files with a line among the first that passes the test; ``at`` is its place from 1."""
    at = F.array_position(F.transform("top", lambda x: test(x["line"])), F.lit(True)).cast("int")
    h = top(lines, first).withColumn("at", at).where(F.col("at") > 0).withColumn("__h", F.element_at("top", F.col("at")))
    return h.select("path", "top", "at", F.col("__h.line").alias("header"), F.col("__h.line_no").alias("header_no"))


def numbered(names: Column, first: int) -> Column:
    """An array of names in which the second holder of one gets _first, the next _(first + 1), ..."""
    before = lambda x, i: F.size(F.filter(F.slice(names, 1, i), lambda y: y == x))
    return F.transform(names, lambda x, i: F.when(before(x, i) == 0, x).otherwise(F.concat(x, F.lit("_"), (before(x, i) + (first - 1)).cast("string"))))


def cells(lines: DataFrame, heads: DataFrame, separator: str | Column, is_time: Callable[[Column], Column], known: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, line_no, ts_text, name, text) for every non-empty cell below a file's header of heads (path, names, header_no). ts_text is the line's time cells in order of name.

    What depends on names alone is found once a file: which columns are times, and what
    ``known`` makes of the others, which stands in place of the name; columns for which
    that is null go.
    """
    column = lambda n, i: F.struct(i.alias("i"), n.alias("name"), F.coalesce(is_time(n), F.lit(False)).alias("time"), (known(n) if known else n).alias("known"))
    named = F.filter(F.transform("names", column), lambda c: c["name"].isNotNull())
    at = heads.withColumn("__n", named).withColumns({"__times": F.filter("__n", lambda c: c["time"]), "__rest": F.filter("__n", lambda c: ~c["time"] & c["known"].isNotNull())}).drop("names", "__n")
    body = with_heads(lines, at).where((F.col("line_no") > F.col("header_no")) & (F.trim("line") != ""))
    parts = body.withColumn("__c", F.split("line", separator))
    text = lambda c: F.trim(F.get("__c", c["i"])).alias("text")
    ts = F.array_join(F.transform(F.array_sort(F.transform("__times", lambda c: F.struct(c["name"].alias("name"), text(c)))), lambda c: c["text"]), " ")
    rest = F.filter(F.transform("__rest", lambda c: F.struct(c["known"].alias("name"), text(c))), lambda c: c["text"] != "")
    return parts.select("path", "line_no", ts.alias("ts_text"), F.explode(rest).alias("c")).select("path", "line_no", "ts_text", "c.name", "c.text")


def metadata(lines: DataFrame, titles: list[str]) -> DataFrame:
    """(path, section, key, value) of 'key: value' lines in sections of these titles; of a repeated key the last counts."""
    s = sections(lines).where(F.col("section").isin(titles) & F.col("line").contains(":") & ~F.trim("line").startswith("---"))
    key, value = (F.regexp_extract("line", r"^\s*([^:]*?)\s*:\s*(.*?)\s*$", i) for i in (1, 2))
    return s.withColumn("key", key).where("key <> ''").groupBy("path", "section", "key").agg(F.max_by(value, "line_no").alias("value"))


def span(rows: DataFrame) -> DataFrame:
    """(path, lo, hi) of rows (path, ms)."""
    return rows.groupBy("path").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
