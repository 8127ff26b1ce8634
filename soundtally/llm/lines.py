"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line's words are what stands between single spaces of the trimmed line. Equal
lines are one class. Two classes of at least ``min_words`` words are near where
one word replaced, added or left out turns one into the other. Such lines share
their first or their last half, so a join on hashed halves first finds the lines
that can have a near one at all; only these emit their deletion variants. Groups
of equal variants are reduced to their earliest members, never to pairs; each
proposed (line, earlier line) is then verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

MIN_WORDS = 8


def _words(line: str = "line") -> Column:
    return F.split(F.trim(line), " ")


def _half_keys(w: Column, m: Column) -> Column:
    """Hashes of the halves that a line of m words shares with a line of as many words, or one more or less, one edit away."""
    out = []
    for n in (m, m - 1):
        h = F.floor(n / 2).cast("int")
        out += [F.xxhash64(F.lit("first"), n, F.slice(w, F.lit(1), h)), F.xxhash64(F.lit("last"), n, F.slice(w, m - (n - h) + 1, n - h))]
    return F.array(*out)


def _exploded(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line_no, first_doc_id, first_line_no, edits): each line that an earlier one makes superfluous, by (doc_id, line number).

    edits is 0 for a line equal to an earlier one, and 1 for the first line of its
    kind that is one word away from an earlier line; the earliest such line is
    named. Blank lines, null texts and rows without doc_id have no part; rows that
    share a doc_id count as one document and are told apart by text alone. An empty
    table gives an empty result.
    """
    lines = _exploded(docs).where("trim(line) <> ''")
    w, m = F.col("w"), F.col("m")
    keyed = (
        lines.withColumn("w", _words())
        .withColumn("m", F.size("w"))
        .select("doc_id", "line_no", F.xxhash64(F.trim("line")).alias("h"), F.xxhash64(F.lit(7), F.trim("line")).alias("g"), F.when(m >= min_words, _half_keys(w, m)).alias("halves"))
    )
    pos = F.struct("doc_id", "line_no")
    classes = stored(keyed.groupBy("h", "g").agg(F.min(pos).alias("pos"), F.count(F.lit(1)).alias("n"), F.first("halves").alias("halves")))

    # copies
    many = classes.where("n > 1").select("h", "g", "pos")
    copies = keyed.select("doc_id", "line_no", "h", "g").join(many, ["h", "g"]).where((F.col("doc_id") != F.col("pos.doc_id")) | (F.col("line_no") != F.col("pos.line_no")))
    exact = copies.select("doc_id", "line_no", F.col("pos.doc_id").alias("first_doc_id"), F.col("pos.line_no").alias("first_line_no"), F.lit(0).alias("edits"))

    # lines that share a half with another line
    halves = classes.where("halves is not null").select("h", F.posexplode("halves").alias("k", "half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("half")
    flagged = halves.join(shared, "half").groupBy("h").agg(F.max((F.col("k") % 2 == 0).cast("int")).alias("same_first"), F.max((F.col("k") % 2).cast("int")).alias("same_last"))
    firsts = classes.join(flagged, "h").select(F.col("pos.doc_id").alias("doc_id"), F.col("pos.line_no").alias("line_no"), "same_first", "same_last")
    asked = firsts.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "same_first", "same_last")).alias("asked"))
    text_of = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.split(F.col("text").cast("string"), "\n").alias("all_lines"))
    rows = text_of.join(asked, "doc_id").select("doc_id", F.explode(F.filter("asked", lambda a: a["line_no"] < F.size("all_lines"))).alias("a"), "all_lines")
    held = stored(rows.select("doc_id", F.col("a.line_no").alias("line_no"), "a.same_first", "a.same_last", F.split(F.trim(F.col("all_lines")[F.col("a.line_no")]), " ").alias("w")).withColumn("m", F.size("w")))

    # variants: a position where any word may stand (r), or a word left out (d); a whole line is its longer neighbours' variant
    spot = F.xxhash64("doc_id", "line_no")
    hashes = F.transform("w", lambda x, i: F.xxhash64(i, x))
    every = F.aggregate("hashes", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    low = F.when(F.col("same_last") == 1, F.lit(1)).otherwise(F.floor((m - 1) / 2).cast("int") + 1)
    high = F.when(F.col("same_first") == 1, m).otherwise(F.ceil(m / 2).cast("int") + 1)
    places = F.sequence(low, F.least(high, m))
    variants = F.concat(
        F.transform("places", lambda i: F.struct(F.xxhash64(F.lit("r"), m, i, F.col("every").bitwiseXOR(F.element_at("hashes", i))).alias("key"), F.lit("r").alias("role"))),
        F.transform("places", lambda i: F.struct(F.xxhash64(F.lit("d"), m - 1, F.slice("w", F.lit(1), i - 1), F.slice("w", i + 1, m)).alias("key"), F.lit("d").alias("role"))),
        F.array(F.struct(F.xxhash64(F.lit("d"), m, w).alias("key"), F.lit("w").alias("role"))),
    )
    emitted = held.withColumn("hashes", hashes).withColumn("every", every).withColumn("places", places).select("doc_id", "line_no", F.explode(variants).alias("v")).select("doc_id", "line_no", "v.key", "v.role", spot.alias("spot"))
    groups = emitted.groupBy("key").agg(F.min("spot").alias("s0"), F.max("spot").alias("s1"), *[F.min(F.when(F.col("role") == r, F.struct("doc_id", "line_no"))).alias(r) for r in "rdw"]).where("s0 <> s1")
    met = emitted.select("doc_id", "line_no", "key", "role").join(groups.select("key", "r", "d", "w"), "key")
    other = F.when(F.col("role") == "r", F.col("r")).when(F.col("role") == "d", F.col("w")).otherwise(F.col("d"))
    earlier = (F.col("o.doc_id") < F.col("doc_id")) | ((F.col("o.doc_id") == F.col("doc_id")) & (F.col("o.line_no") < F.col("line_no")))
    proposed = cut(met.withColumn("o", other).where(earlier).select("doc_id", "line_no", F.col("o.doc_id").alias("first_doc_id"), F.col("o.line_no").alias("first_line_no")).distinct())
    x = held.select("doc_id", "line_no", F.col("w").alias("x"))
    y = held.select(F.col("doc_id").alias("first_doc_id"), F.col("line_no").alias("first_line_no"), F.col("w").alias("y"))
    verified = proposed.join(x, ["doc_id", "line_no"]).join(y, ["first_doc_id", "first_line_no"]).where(one_edit(F.col("x"), F.col("y")))
    near = verified.groupBy("doc_id", "line_no").agg(F.min(F.struct("first_doc_id", "first_line_no")).alias("f")).select("doc_id", "line_no", "f.*", F.lit(1).alias("edits"))
    return exact.unionByName(near).distinct()


def one_edit(x: Column, y: Column) -> Column:
    """Whether arrays of words are at edit distance 1 or less: beyond their common start, what is left over agrees but for one word."""
    n = F.least(F.size(x), F.size(y))
    differ = F.array_position(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda a, b: a != b), F.lit(True)).cast("int")
    at = F.when(differ == 0, n + 1).otherwise(differ)
    rest = lambda v, skip: F.slice(v, at + skip, F.greatest(F.size(v) - at - skip + 1, F.lit(0)))
    same = F.when(F.size(x) == F.size(y), rest(x, 1) == rest(y, 1)).when(F.size(x) == F.size(y) + 1, rest(x, 1) == rest(y, 0)).when(F.size(y) == F.size(x) + 1, rest(x, 0) == rest(y, 1))
    return F.coalesce(same, F.lit(False))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without their superfluous lines; a document all of whose lines but blank ones went goes as a whole.

    Columns stay as they are, but for n_chars, which follows the text where there
    is one. A null or blank text stays as it was.
    """
    marks = dropped_lines(docs, min_words).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("line_no").alias("__gone"))
    joined = docs.join(marks, docs["doc_id"].cast("long") == F.col("__id"), "left")
    parts = F.split(F.col("text").cast("string"), "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains("__gone", i))
    out = joined.withColumn("__kept", F.when(F.col("__gone").isNotNull(), kept))
    out = out.where(F.col("__kept").isNull() | F.exists("__kept", lambda x: F.trim(x) != ""))
    out = out.withColumn("text", F.when(F.col("__kept").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__kept").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


ORACLE = """
with l as (select doc_id, u.i - 1 as line_no, trim(string_split(text, chr(10))[u.i], ' ') as line
           from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) as u(i)
           where doc_id is not null and text is not null),
f as (select doc_id, line_no, line, first_value(doc_id) over w as fd, first_value(line_no) over w as fl from l where line <> ''
      window w as (partition by line order by doc_id, line_no)),
c as (select doc_id, line_no, string_split(line, ' ') as w, len(string_split(line, ' ')) as m from f where fd = doc_id and fl = line_no),
h as (select *, n, w[1:n // 2] as a, w[m - (n - n // 2) + 1:m] as b from c, unnest([m, m - 1]) as t(n) where m >= 8),
p as (select distinct x.doc_id, x.line_no, y.doc_id as fd, y.line_no as fl, x.w as x, y.w as y
      from h x join h y on x.n = y.n and x.a = y.a where (y.doc_id, y.line_no) < (x.doc_id, x.line_no)
      union
      select distinct x.doc_id, x.line_no, y.doc_id, y.line_no, x.w, y.w
      from h x join h y on x.n = y.n and x.b = y.b where (y.doc_id, y.line_no) < (x.doc_id, x.line_no)),
d as (select doc_id, line_no, fd, fl, x, y,
             coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i]), true), least(len(x), len(y)) + 1) as k from p),
e as (select doc_id, line_no, fd, fl from d
      where (len(x) = len(y) and x[k + 1:] = y[k + 1:]) or (len(x) = len(y) + 1 and x[k + 1:] = y[k:]) or (len(y) = len(x) + 1 and x[k:] = y[k + 1:])),
r as (select doc_id, line_no, fd, fl, row_number() over (partition by doc_id, line_no order by fd, fl) as n from e)
select doc_id, line_no::int as line_no, fd as first_doc_id, fl::int as first_line_no, 0 as edits from f where not (fd = doc_id and fl = line_no)
union all
select doc_id, line_no::int, fd, fl::int, 1 from r where n = 1
"""
