"""MinHash near-dedup with HyperMinHash sketches.

A document's shingle hashes are split over ``REGISTERS`` buckets. A bucket keeps
the leading-zero count and ten mantissa bits of its smallest hash, 16 bits in
all. Empty buckets borrow from a filled one along a fixed random order, so short
documents have full sketches. Bands of registers propose pairs, the
collision-corrected estimate drops hopeless ones, and every remaining pair is
confirmed on the full shingle sets.

Equal sets are collapsed first. Keys that many rows share are met in salted parts.
Inside a band group every member is compared with
the group's smallest id. Members that are in different components afterwards are
compared with each other inside tasks, in blocks of bounded size, and only edges
that join components come out; no list of a group's pairs is ever made, and no link
between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, partitions, runs, salted_join, stored

REGISTERS = 256
#: Share of the pairs at the threshold that may share no band.
MISSED = 1e-4
#: Bits of a hash below its bucket number, and mantissa bits kept of it.
TAIL, MANTISSA = 56, 10
#: A pair whose estimate is this much below the threshold isn't confirmed: seven standard deviations of 256 registers at 0.85.
SLACK = 0.16
#: Members of a band group that are compared at once; a larger group is compared block by block.
BLOCK = 512
_ORDER = np.argsort(np.random.default_rng(20).random((REGISTERS, REGISTERS)), axis=1)
_BOUNDS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(TAIL)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class _Words(dict):
    """Hashes of words; cleared when large, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``width`` words; fewer words make one shingle, none an empty set."""
    parts = text.encode("utf-8", "replace").lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter((words[w] for w in parts), np.uint64, len(parts))
    w = min(width, len(h))
    acc = np.full(len(h) - w + 1, w, np.uint64)
    for i in range(w):
        acc = _mixed(acc ^ (h[i : i + len(acc)] * _ODD[i % 8] + np.uint64(i)))
    return np.unique(acc)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """16-bit registers of a non-empty sorted set."""
    at = np.searchsorted(hashes, _BOUNDS)
    low = hashes[np.minimum(at, len(hashes) - 1)]
    filled = (at < len(hashes)) & (low >> np.uint64(TAIL) == np.arange(REGISTERS, dtype=np.uint64))
    part, exponent = np.frexp((low & np.uint64((1 << TAIL) - 1)).astype(np.float64) + 1)
    zeros = np.clip(TAIL - exponent, 0, 62)
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | ((part * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    if not filled.all():
        source = _ORDER[np.arange(REGISTERS), filled[_ORDER].argmax(axis=1)]
        out = np.where(filled, out, out[source])
    return out


def band_rows(percent: int) -> int:
    """Registers of a band: the most with which a pair at the threshold shares a band but in MISSED of cases."""
    p = percent / 100
    return max([1] + [r for r in range(1, 9) if (1 - p**r) ** (REGISTERS // r) <= MISSED])


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) signed 64-bit keys of sketches (sets, registers)."""
    bands = registers.shape[1] // rows
    parts = registers[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    return _mixed((parts * _ODD[:rows]).sum(axis=2) + np.arange(77, 77 + bands, dtype=np.uint64) * _ODD[7]).view(np.int64)


def collision_share(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Chance that two registers of unrelated sets agree: the minimum's exponent varies over about two binary orders, each with 2**MANTISSA values."""
    skew = np.abs(np.log2(np.maximum(n_a, 1) / np.maximum(n_b, 1)))
    return 0.33 * 2.0**-MANTISSA / (1 + skew)


def _sketches(width: int, smallest: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for pdf in batches:
            n, digest, registers, keys = [], [], [], []
            for text in pdf["text"]:
                s = shingle_hashes(text, width, words)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                r = sketch(s) if len(s) >= smallest else None
                registers.append(None if r is None else r.tobytes())
                keys.append(None if r is None else band_keys(r[None], rows)[0])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": n, "digest": digest, "registers": registers, "bands": keys})

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["doc_id"], "shingles": [shingle_hashes(t, width, words).view(np.int64) for t in pdf["text"]]})

    return run


def _blocks(percent: int):
    """Compares the members of band groups, block by block, that are in different components; gives edges that join what is linked."""

    rows = band_rows(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, spans in runs(batches, ["key", "x", "y"]):
            ids, c, n, left, right, side, key = (pdf[k].to_numpy() for k in ("id", "c", "n_shingles", "x", "y", "side", "key"))
            sets = pdf["shingles"].to_numpy()
            for start, stop in spans:
                own = np.arange(start, stop)
                same = left[start] == right[start]
                other = own if same else own[side[own] != left[start]]
                own = own if same else own[side[own] == left[start]]
                if not len(own) or not len(other):
                    continue
                ra, rb = (np.frombuffer(b"".join(pdf["registers"].iloc[i]), np.uint16).reshape(len(i), -1) for i in (own, other))
                ba, bb = band_keys(ra, rows), band_keys(rb, rows)
                band = int((ba[0] == key[start]).argmax())
                low = {v: v for v in np.unique(c[start:stop]).tolist()}
                found: list[tuple[int, int]] = []

                def head(v: int, low: dict[int, int] = low) -> int:
                    while low[v] != v:
                        v = low[v]
                    return v

                for i, at in enumerate(own):
                    sized = 100 * np.minimum(n[at], n[other]) >= percent * np.maximum(n[at], n[other])
                    try_ = np.flatnonzero(sized & (c[other] != c[at]) & (ids[other] > ids[at] if same else True))
                    if not len(try_):
                        continue
                    # a pair that shares an earlier band is met there
                    try_ = try_[~(bb[try_, :band] == ba[i, :band]).any(axis=1)]
                    chance = collision_share(n[at], n[other[try_]])
                    likely = ((rb[try_] == ra[i]).mean(axis=1) - chance) / (1 - chance) >= percent / 100 - SLACK
                    for j in other[try_[likely]]:
                        p, q = head(int(c[at])), head(int(c[j]))
                        if p != q:
                            both = len(np.intersect1d(sets[at], sets[j], assume_unique=True))
                            if 100 * both >= percent * (n[at] + n[j] - both):
                                low[max(p, q)] = min(p, q)
                                found.append((int(ids[at]), int(ids[j])))
                if found:
                    yield pd.DataFrame(found, columns=["a", "b"])

    return run


def _estimate(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint16).reshape(len(b), -1)
    chance = collision_share(n_a.to_numpy(), n_b.to_numpy())
    return pd.Series(((x == y).mean(axis=1) - chance) / (1 - chance))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored).

    Two documents are linked where 100 * |A & B| >= percent * |A | B| of their
    shingle sets; component_id is the smallest doc_id reachable. A null or blank
    text has an empty set and is linked with nothing. Rows that share a doc_id are
    one node; of their differing texts each is met by its copies, and the one with the
    smallest digest by what is near and not equal. A row without a doc_id has a null component and is
    kept. Very long texts are compared as a whole. An empty table gives an empty
    result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    smallest = -(-percent // max(1, 100 - percent))  # a smaller set is linked with equal sets alone
    pack = F.pandas_udf(_estimate, "double")
    made = docs.mapInPandas(_sketches(width, smallest, band_rows(percent)), "doc_id long, n_shingles long, digest binary, registers binary, bands array<long>")
    all_rows = stored(made)
    n = all_rows.count()
    slim = all_rows.where("doc_id is not null and digest is not null")
    heads = cut(slim.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    head_of = cut(salted_join(slim.select("doc_id", "digest"), heads, ["digest"], "doc_id", n).select("doc_id", "id").distinct())
    reps = slim.where("bands is not null").join(heads.select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi")
    reps = reps.groupBy("doc_id").agg(F.min_by(F.struct("n_shingles", "registers", "bands"), "digest").alias("r")).select("doc_id", "r.*")
    sketches = reps.select(F.col("doc_id").alias("id"), "n_shingles", "registers")
    bands = reps.select(F.posexplode("bands").alias("b", "key"), F.col("doc_id").alias("id"))
    groups = cut(bands.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("copies")).where("first <> last"))
    hits = cut(salted_join(bands, groups.select("key", "first", "copies"), ["key"], "id", n * (REGISTERS // band_rows(percent))))

    need = hits.select(F.col("id").alias("doc_id")).distinct()
    sets = stored(docs.join(need, "doc_id", "left_semi").mapInPandas(_sets(width), "id long, shingles array<long>"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that are linked, by estimate and then by full sets; a row of a that many pairs name is met in parts."""
        m = pairs.count()
        often = cut(pairs.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("copies")))
        named = lambda df, s, *more: df.select(F.col("id").alias(s), *more)
        sketch = lambda s: (F.col("n_shingles").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}"))
        met = salted_join(pairs, named(sketches.join(often, "id"), "a", *sketch("a"), "copies"), ["a"], "b", m)
        # no set can be linked with one that is too large for it
        sized = met.join(named(sketches, "b", *sketch("b")), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        likely = sized.where(pack("r_a", "r_b", "n_a", "n_b") >= percent / 100 - SLACK).select("a", "b")
        left = salted_join(likely, named(sets.join(often, "id"), "a", F.col("shingles").alias("x"), "copies"), ["a"], "b", m)
        both = left.join(named(sets, "b", F.col("shingles").alias("y")), "b")
        common = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("t"))
        return cut(common.where(f"100 * i >= {percent} * (t - i)").select("a", "b").distinct())

    links = confirmed(cut(hits.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()))
    label = components(links)
    named = hits.select("key", "b", "id").join(label.select(F.col("v").alias("id"), "c"), "id", "left").select("key", "b", "id", F.coalesce("c", "id").alias("c"))
    mix = [F.bit_xor(F.xxhash64(F.lit(s), "id")).alias(f"m{s}") for s in (0, 1)]
    open_keys = named.groupBy("key").agg(F.min("b").alias("b"), F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("i0"), F.max("id").alias("i1"), *mix).where("low <> high")
    # bands with the same members are searched once, in the first, where a pair of them would be met anyway
    open_keys = open_keys.groupBy("copies", "i0", "i1", "m0", "m1").agg(F.min_by("key", "b").alias("key")).select("key", F.ceil(F.col("copies") / BLOCK).cast("int").alias("blocks"), "copies")
    open_rows = cut(salted_join(named, cut(open_keys), ["key"], "id", hits.count()).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("side")).alias("x"), F.greatest(i, F.col("side")).alias("y")))
    full = open_rows.join(sketches, "id").join(sets, "id").select("key", F.explode(meet).alias("m"), "side", "id", "c", "n_shingles", "registers", "shingles").select("key", "m.x", "m.y", "side", "id", "c", "n_shingles", "registers", "shingles")
    more = cut(full.repartition(partitions(full), "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInPandas(_blocks(percent), "a long, b long"))
    if not more.isEmpty():
        label = components(links.unionByName(more))
    final = head_of.join(label.select(F.col("v").alias("id"), "c"), "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("c", "id")).alias("c"))
    out = all_rows.select("doc_id", "n_shingles").join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each group of near duplicates, with its columns: that of the smallest doc_id.

    Rows that share a doc_id are copies of one document, of which the one with the
    smallest text stays, whatever their order. Rows without doc_id all stay, as do
    those with a null or blank text, which are near to nothing. An empty table gives
    an empty result.
    """
    found = near_duplicates(docs, width, percent).where("doc_id is not null")
    marks = cut(found.groupBy(F.col("doc_id").alias("__id")).agg(F.bool_or(~F.col("kept")).alias("__gone"), F.count(F.lit(1)).alias("__n")).where("__gone or __n > 1"))
    met = docs.join(marks, docs["doc_id"].cast("long") == F.col("__id"), "left").where(~F.coalesce("__gone", F.lit(False)))
    if marks.where("not __gone").isEmpty():
        return met.select(*docs.columns)
    own = [f"`{c}`" for c in docs.columns]
    first = F.min_by(F.struct(*own), F.struct(F.col("text").isNull().alias("null"), "text", F.xxhash64(*own).alias("tie")))
    again = met.where("__n > 1").groupBy("__id").agg(first.alias("__r")).select("__r.*")
    return met.where("__n is null").select(*docs.columns).unionByName(again)
