"""Merkle manifest of a table: a digest tree for each language and one over their roots, with a witness for every row.

Rows are ordered and numbered by a range partitioning. Blocks of ``SPAN`` leaves, a
power of ``RUN``, are appended one leaf at a time: a node that joins an open run has a
partial witness, the nodes before it there, and each later sibling that is completed
extends the witnesses of those before it. A block's root is one further append to a
tree over the blocks, and so on until a language has one node; the languages'
nodes are leaves of the last tree. The way back gives each block the witness of its
root, which its leaves' own witnesses go on with. Only digests are shuffled, no texts.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

RUN, SPAN = 8, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<place: int, others: array<string>>>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(text: str | Column = "text", fields: tuple[str, ...] = FIELDS) -> Column:
    """Digest of a row: each field ``-`` if null, else its length in UTF-8 bytes, a colon and its text."""
    out = []
    for name in fields:
        value = (F.col(text) if isinstance(text, str) else text) if name == "text" else F.col(name)
        value = value.cast("string")
        out.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*out), 256)


class Appender:
    """Aligned appends to a tree of runs, with the witness of every leaf so far.

    A witness is a list of steps from the leaf upwards; a step is [place in the run,
    digests of the run's other nodes]. Steps belong to nodes, so that all leaves below a
    node share them, and a sibling that is completed later extends them once for all.
    """

    def __init__(self, height: int):
        self.height, self.witnesses = height, []
        self.open = [[] for _ in range(height + 1)]

    def append(self, node: str) -> None:
        at = len(self.witnesses)
        self.witnesses.append([])
        self._join(0, node, at, at + 1)

    def _join(self, level: int, node: str, first: int, last: int) -> None:
        run = self.open[level]
        if level < self.height:
            step = [len(run), [n for n, *_ in run]]
            for i in range(first, last):
                self.witnesses[i].append(step)
            for _, _, _, (_, others) in run:
                others.append(node)
        else:
            step = None
        run.append((node, first, last, step))
        if len(run) == RUN and level < self.height:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._join(level + 1, digest(*[n for n, *_ in run]), run[0][1], run[-1][2])

    def root(self) -> str:
        """Ends the open runs, from the leaves upwards."""
        for level in range(self.height):
            if self.open[level]:
                self._complete(level)
        return self.open[self.height][0][0]


def height(nodes: int, span: int = SPAN) -> int:
    """Levels above so many leaves until one node is left, within a block: all of its levels where the leaves fill more than one."""
    n, levels = min(nodes, span), 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


def _appended(pdf: pd.DataFrame, span: int) -> tuple[pd.DataFrame, Appender, str]:
    """A block's rows in order, their witnesses within it, and its root."""
    pdf = pdf.sort_values("at", ignore_index=True)
    held = Appender(height(int(pdf["n"].iloc[0]), span))
    for node in pdf["node"]:
        held.append(node)
    return pdf, held, held.root()


def witnessed(nodes: DataFrame, base: Callable[[DataFrame], DataFrame], span: int = SPAN) -> DataFrame:
    """nodes (key, at, n, node, more) with subroot, root and witness.

    at numbers the n nodes of a key from 0. base gives (key, node) of the keys' last
    nodes the columns root and witness, with which all witnesses below go on.
    """
    if nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] <= 1:
        last = base(nodes.select("key", "node")).select("key", "root", "witness")
        return nodes.join(last, "key").select("key", "at", "node", "more", F.col("node").alias("subroot"), "root", "witness")

    def block_root(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, _, root = _appended(pdf, span)
        return pd.DataFrame({"key": rows["key"][:1], "at": rows["at"][:1] // span, "n": -(-rows["n"][:1] // span), "node": [root]})

    def with_witness(block: pa.Table, above: pa.Table) -> pa.Table:
        rows, held, _ = _appended(block.to_pandas(), span)
        top = above.to_pylist()[0]
        rest = [(s["place"], s["others"]) for s in top["witness"]]
        both = pa.array([[{"place": p, "others": o} for p, o in [*own, *rest]] for own in held.witnesses], pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))])))
        columns = {c: pa.array(rows[c], t) for c, t in (("key", pa.string()), ("at", pa.int64()), ("node", pa.string()), ("more", pa.string()))}
        return pa.table(columns | {c: pa.array([top[c]] * len(rows), pa.string()) for c in ("subroot", "root")} | {"witness": both})

    block = F.floor(F.col("at") / span).cast("long").alias("block")
    roots = cut(nodes.select("key", "at", "n", "node").groupBy("key", block).applyInPandas(block_root, "key string, at long, n long, node string")).withColumn("more", F.lit(""))
    above = witnessed(roots, base, span).select("key", F.col("at").alias("block"), "subroot", "root", "witness")
    pairs = nodes.groupBy("key", block).cogroup(above.groupBy("key", "block"))
    return pairs.applyInArrow(with_witness, f"key string, at long, node string, more string, subroot string, root string, witness {_STEPS}")


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with at, their place from 0 within the key by order, and n, the key's rows; a key is dealt over as many ranges as it needs."""
    dealt = cut(rows.repartitionByRange(partitions(rows), key, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__c"))
    every = Window.partitionBy(key)
    # one row a range and key
    sums = cut(counts.select(key, "__part", (F.sum("__c").over(every.orderBy("__part")) - F.col("__c")).alias("__from"), F.sum("__c").over(every).alias("n")))
    inner = Window.partitionBy(key, "__part").orderBy(*order)
    placed = dealt.withColumn("__at", F.row_number().over(inner) - 1).join(sums, [key, "__part"])
    return placed.withColumn("at", (F.col("__from") + F.col("__at")).cast("long")).drop("__part", "__at", "__from")


def _languages(last: DataFrame, span: int) -> DataFrame:
    """root and witness of the languages' nodes: one more tree, in the order of their keys."""
    rows = numbered(last.select(F.lit("").alias("key"), F.col("key").alias("more"), "node"), "key", ["more"])
    alone = lambda top: top.select("key", F.col("node").alias("root"), F.array().cast(_STEPS).alias("witness"))
    return witnessed(cut(rows), alone, span).select(F.col("more").alias("key"), "root", "witness")


def manifest(docs: DataFrame, more: Column | None = None, span: int = SPAN) -> DataFrame:
    """doc_id, leaf, subroot, root, witness and more of every row of docs (doc_id, source, lang, n_chars, text).

    A language's leaves ascend by doc_id; rows without doc_id come first, and those that
    share one are ordered by their leaves, so that only equal rows may change places.
    Null is a language of its own, the first one. Each run of RUN nodes, the last one
    maybe shorter, becomes the digest of its nodes until one is left. The witness has
    a step a level, from the leaf to the root: the place in the run and its other
    nodes. Null and empty texts have leaves as others do, and a text counts whole
    however long. span, a power of RUN, is how many leaves a task appends to one block;
    it doesn't change the result. more is a string column that comes along, "" for null. Other columns
    are ignored. An empty table gives an empty result.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    rows = docs.select("doc_id", key.alias("key"), leaf().alias("node"), F.coalesce(more.cast("string") if more is not None else F.lit(""), F.lit("")).alias("more"))
    ids = F.to_json(F.struct("doc_id", "more"))
    placed = numbered(rows, "key", ["doc_id", "node", "more"]).select("key", "at", "n", "node", ids.alias("more"))
    out = witnessed(cut(placed), lambda last: _languages(last, span), span)
    kept = F.from_json("more", f"struct<doc_id: {docs.schema['doc_id'].dataType.simpleString()}, more: string>")
    return out.withColumn("more", kept).select("more.doc_id", F.col("node").alias("leaf"), "subroot", "root", "witness", "more.more")


def folded(start: Column, witness: str = "witness") -> Column:
    """The root that a leaf and its witness give."""

    def up(node: Column, step: Column) -> Column:
        others, place = step["others"], step["place"]
        left, right = F.slice(others, F.lit(1), place), F.slice(others, place + 1, F.size(others))
        return F.sha2(F.concat(F.array_join(left, ""), node, F.array_join(right, "")), 256)

    return F.aggregate(witness, start, up)


def siblings(witness: str = "witness") -> Column:
    """Digest of a witness: all its nodes from the leaf's run to the last one, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(witness, lambda s: s["others"])), ""), 256)


def lower_ascii(text: str = "text") -> Column:
    """A-Z in lower case, other letters as they are."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    one_byte = F.octet_length(text) == F.length(text)
    return F.when(one_byte, F.lower(text)).otherwise(F.translate(text, capitals, capitals.lower()))


def audited(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The manifest of docs, and whether each row still proves to be in it when every third id's text has been lower-cased.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; a row without
    doc_id is never tampered with. Nulls, copies and empty tables as in ``manifest``.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    now = F.when(tampered & F.col("text").isNotNull(), leaf(lower_ascii()))
    proved = manifest(docs, now, span).withColumn("folded_root", folded(F.coalesce(F.nullif("more", F.lit("")), F.col("leaf"))))
    return proved.select("doc_id", "leaf", "subroot", "root", siblings().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle(table: str = "documents") -> str:
    """SQL for the rows of ``audited``: the trees level by level, and every leaf folded up again."""
    field = lambda v: f"coalesce(strlen(({v})::varchar) || ':' || ({v})::varchar, '-')"
    hashed = lambda text: "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 by the reversed polynomial, bit by bit
    bit = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    byte = f"list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, y: {bit})"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint)), lambda c, x: {byte}), 4294967295::bigint)"
    up = f"""select level + 1, key, pos // {RUN}, sha256(string_agg(node, '' order by pos)) from (select *, count(*) over (partition by key) as n from {{0}}) where n > 1 group by level, key, pos // {RUN}"""
    sides = f"""select level, key, pos, coalesce(string_agg(node, '') over (r rows between unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(node, '') over (r rows between 1 following and unbounded following), '') as r
 from {{0}} semi join (select level, key from {{0}} group by all having count(*) > 1) using (level, key) window r as (partition by level, key, pos // {RUN} order by pos)"""
    return f"""with recursive d as (select doc_id, coalesce('=' || lang, '') as key, {hashed("text")} as leaf, case when ({crc}) % 3 = 0 and text is not null then {hashed(low)} end as now from {table}),
 k as (select *, row_number() over (partition by key order by doc_id nulls first, leaf, now) - 1 as pos from d),
 t(level, key, pos, node) as (select 0, key, pos, leaf from k union all {up.format("t")}),
 s as ({sides.format("t")}),
 subs as (select key, max_by(node, level) as subroot, row_number() over (order by key) - 1 as place from t group by 1),
 u(level, key, pos, node) as (select 0, '', place, subroot from subs union all {up.format("u")}),
 v as ({sides.format("u")}),
 f(level, key, pos, place, node, proof) as (select 0, key, pos, pos, coalesce(now, leaf), '' from k union all select f.level + 1, f.key, f.pos, f.place // {RUN}, sha256(l || node || r), proof || l || r from f join s on s.level = f.level and s.key = f.key and s.pos = f.place),
 g as (select key, pos, max_by(node, level) as node, max_by(proof, level) as proof from f group by 1, 2),
 h(level, key, pos, place, node, proof) as (select 0, key, pos, place, node, proof from g join subs using (key) union all select h.level + 1, h.key, h.pos, h.place // {RUN}, sha256(l || node || r), proof || l || r from h join v on v.level = h.level and v.pos = h.place),
 e as (select key, pos, max_by(node, level) as folded_root, sha256(max_by(proof, level)) as proof_sha256 from h group by 1, 2)
 select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from k join subs using (key) join e using (key, pos), (select max_by(node, level) as root from u)"""
