"""Embedding near-dedup by counting collisions of one-dimensional projections.

Unit vectors are projected on ``LINES`` random lines and each line is sorted. Two
vectors collide on a line where one lies in the window centred on the other, and a
pair with at least ``needed()`` collisions is verified by its exact cosine. The
window is fixed by the threshold, so a pair at the threshold misses that count once
in a million times whatever the data are.

Such a window holds a fixed share of all vectors, so whole lines would give a work
that grows with the square of the input. The ends of lines hold few. So the vectors
are parted first: a pick takes ``ends`` further lines, centred and scaled on a sample,
and puts a vector to the end of the line on which it lies furthest out; a table joins
several picks, and lines are sorted and windows searched inside the cells of each
table. How often a pair at the threshold falls into one cell is measured on pairs
made of the sample's vectors and on such pairs that the sample has; from that follow
the tables, so that one pair in 100,000 is missed at the threshold and fewer above
it. Picks, ends and tables are those that cost least; where vectors lie so close
together that no cells pay, there is one, searched block by block.

A pair is counted in the first table in which it shares a cell, so links are summed
without spelling pairs out. Equal vectors are collapsed first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import usable
from .common import components, cut, hashed_sample, partitions, runs, salted_join, tree

LINES, WINDOW, MISSED = 40, 1.6, 1e-6
#: Vectors of a cell that are searched at once; larger cells are searched block by block.
BLOCK = 2_048
#: Costs, in microseconds: to place a vector, to count a pair's collisions, to open a cell.
PLACED, COUNTED, OPENED = 6.0, 0.012, 2000.0
#: Vectors that the lines are fitted on at most, chosen by hash; pairs and picks that collisions are measured on.
SAMPLE, PAIRS, TRIALS = 8_192, 256, 128
#: Lines of a pick that are tried, and picks of a table at most.
ENDS, PICKS = (8, 16, 32, 64), 4
#: Numbers that all lines of all tables have at most.
NUMBERS = 4_194_304
#: Share of the pairs at the threshold that may share no cell.
LOST = 1e-5


def needed(lines: int = LINES, window: float = WINDOW, missed: float = MISSED) -> int:
    """The largest count that a pair at the threshold misses with probability below ``missed``: its difference is normal along a random line, so collisions are independent draws."""
    p, below = math.erf(window / math.sqrt(2)), 0.0
    for c in range(lines + 1):
        below += math.comb(lines, c) * p**c * (1 - p) ** (lines - c)
        if below > missed:
            return c
    return lines


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def furthest(x: np.ndarray, lines: np.ndarray, at: np.ndarray, ends: int) -> np.ndarray:
    """(vectors, picks): the end of a line on which a vector lies furthest out, from 0 to 2 * ends - 1; lines are (width, picks * ends) and at their centres."""
    p = (x.astype(np.float32) @ lines - at).reshape(len(x), -1, ends)
    best = np.abs(p).argmax(axis=2)
    return 2 * best + (np.take_along_axis(p, best[:, :, None], axis=2)[:, :, 0] > 0)


def drawn(width: int, n: int, sample: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n random lines, scaled so that the sample spreads alike on each, and their medians."""
    lines, at = np.random.default_rng(seed).standard_normal((width, n)).astype(np.float32), np.zeros(n, np.float32)
    for i in range(0, n if len(sample) else 0, 1024):
        p = sample.astype(np.float32) @ lines[:, i : i + 1024]
        scale = p.std(axis=0)
        scale[scale < 1e-6] = 1
        lines[:, i : i + 1024] /= scale
        at[i : i + 1024] = np.median(p, axis=0) / scale
    return lines, at


def made_pairs(sample: np.ndarray, cosine: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at the threshold: a vector of the sample, and one that lies about the sample's mean as much as it does, turned from it towards another."""
    rng = np.random.default_rng(81)
    a, c = (sample[rng.integers(0, len(sample), n)] for _ in range(2))
    keep = (a * c).sum(axis=1) < cosine
    a, c = a[keep], c[keep]
    mean, low, high = sample.mean(axis=0), np.zeros((len(a), 1)), np.ones((len(a), 1))
    for _ in range(40):
        mid = (low + high) / 2
        b = unit(mean + mid * (a - mean) + np.sqrt(1 - mid**2) * (c - mean) + 1e-12 * a)
        far = (a * b).sum(axis=1, keepdims=True) < cosine
        low, high = np.where(far, mid, low), np.where(far, high, mid)
    return a, b if len(a) else a


def found_pairs(sample: np.ndarray, cosine: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the sample a little above the threshold, at most n of those that 4,096 of its vectors form."""
    some, found = sample[:4096].astype(np.float32), []
    for i in range(0, len(some), 512):
        sims = some[i : i + 512] @ some.T
        a, b = np.nonzero((sims >= cosine) & (sims < cosine + (1 - cosine) / 4))
        keep = a + i < b
        found.append(np.stack([a[keep] + i, b[keep]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
    if pairs.shape[1] > n:
        pairs = pairs[:, np.random.default_rng(82).choice(pairs.shape[1], n, replace=False)]
    return sample[pairs[0]], sample[pairs[1]]


@dataclass
class Layout:
    """Lines of a pick, picks of a table, and tables; no picks put all vectors into one cell."""

    ends: int
    picks: int
    tables: int


def layout(sample: np.ndarray, n: int, cosine: float) -> Layout:
    """The cheapest layout for n vectors that loses at most LOST of the pairs at the threshold."""
    cost = lambda tables, inside: tables * (PLACED * (1 + inside / BLOCK) + COUNTED * inside + OPENED / (inside + 1))
    best, least = Layout(1, 0, 1), cost(1, n)
    if len(sample) < 64:
        return best
    kinds = [p for p in (made_pairs(sample, cosine, PAIRS), found_pairs(sample, cosine, PAIRS)) if len(p[0]) >= 32]
    for ends in ENDS:
        if not kinds:
            break
        lines, at = drawn(sample.shape[1], TRIALS * ends, sample[:1024], 83)
        shared, step = [np.empty((0, len(a))) for a, _ in kinds], 16 * ends
        for i in range(0, len(at), step):
            part = lines[:, i : i + step], at[i : i + step], ends
            shared = [np.concatenate([s, (furthest(a, *part) == furthest(b, *part)).T]) for s, (a, b) in zip(shared, kinds, strict=True)]
        few = furthest(sample, lines[:, : 8 * ends * PICKS], at[: 8 * ends * PICKS], ends).reshape(len(sample), 8, PICKS)
        alone = None
        for picks in range(1, PICKS + 1):
            keys = few[:, :, :picks] @ (2 * ends) ** np.arange(picks)
            sizes = [np.unique(keys[:, t], return_counts=True)[1].astype(float) for t in range(8)]
            share = float(np.mean([(s * (s - 1)).sum() for s in sizes])) / (len(sample) * (len(sample) - 1.0))
            alone = alone if alone is not None else share
            share = max(share, alone**picks)
            miss = [np.log1p(-np.minimum(s.mean(axis=0) ** picks, 1 - 1e-12)) for s in shared]
            lost = lambda tables, miss=miss: max(float(np.exp(tables * m).mean()) for m in miss)
            few_, many = 0, 1
            while lost(many) > LOST and many < 1 << 16:
                few_, many = many, 2 * many
            while many - few_ > 1:
                mid = (few_ + many) // 2
                few_, many = (mid, many) if lost(mid) > LOST else (few_, mid)
            if lost(many) <= LOST and many * picks * ends * sample.shape[1] <= NUMBERS and cost(many, share * n) < least:
                best, least = Layout(ends, picks, many), cost(many, share * n)
    return best


class Lines:
    """Random lines, their windows, and the tables of cells."""

    def __init__(self, width: int, n: int, cosine: float, sample: np.ndarray):
        self.cosine = cosine
        self.layout = layout(sample, n, cosine)
        self.axes = np.random.default_rng(8).standard_normal((width, LINES)).astype(np.float32)
        self.half = np.float32(WINDOW * math.sqrt(2 - 2 * cosine))
        self.ends, self.at = drawn(width, self.layout.tables * self.layout.picks * self.layout.ends, sample, 84)

    def cells(self, x: np.ndarray, tables: int | None = None) -> np.ndarray:
        """(vectors, tables): a vector's cell in each of the first tables."""
        how = self.layout
        tables = how.tables if tables is None else tables
        if not how.picks or not tables:
            return np.zeros((len(x), tables), np.int64)
        each = how.picks * how.ends
        step = max(1, 16_384 // each)
        base, out = (2 * how.ends) ** np.arange(how.picks, dtype=np.int64), []
        for t in range(0, tables, step):
            part = slice(t * each, min(t + step, tables) * each)
            out.append(furthest(x, self.ends[:, part], self.at[part], how.ends).reshape(len(x), -1, how.picks) @ base)
        return np.concatenate(out, axis=1)


def colliding(px: np.ndarray, py: np.ndarray, half: np.float32, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of px, rows of py) with at least ``least`` collisions; both are (vectors, lines).

    A line's members are sorted, and the window centred on each of px is a range of
    that order: the difference of two running sets of members, held as bits. Sets are
    added up bit by bit over the lines.
    """
    n, words = len(py), -(-len(py) // 64)
    one, turned, upto = np.zeros((n, words), np.uint64), np.empty((n, words), np.uint64), np.zeros((n + 1, words), np.uint64)
    one[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
    asked, members = np.ascontiguousarray(px.T), np.ascontiguousarray(py.T)
    order = members.argsort(axis=1)
    turn = order if px is py else asked.argsort(axis=1)
    low, high = np.empty(len(px), np.int64), np.empty(len(px), np.int64)
    free: list[np.ndarray] = []
    level: list[list[np.ndarray]] = [[]]
    for j in range(px.shape[1]):
        line, centre = members[j, order[j]], asked[j, turn[j]]
        np.take(one, order[j], axis=0, out=turned, mode="clip")
        np.bitwise_xor.accumulate(turned, axis=0, out=upto[1:])
        low[turn[j]], high[turn[j]] = np.searchsorted(line, centre - half, "left"), np.searchsorted(line, centre + half, "right")
        held, below = (free.pop() if free else np.empty((len(px), words), np.uint64) for _ in range(2))
        np.take(upto, high, axis=0, out=held, mode="clip")
        np.take(upto, low, axis=0, out=below, mode="clip")
        held ^= below
        free.append(below)
        k = 0
        while True:
            level[k].append(held)
            if len(level[k]) < 3:
                break
            # three digits of one worth leave their odd one here and carry over two of the next
            a, b, c = level[k]
            odd = np.bitwise_xor(a, b, out=free.pop() if free else None)
            a &= b
            np.bitwise_and(c, odd, out=b)
            a |= b
            odd ^= c
            free += [b, c]
            level[k], held, k = [odd], a, k + 1
            if k == len(level):
                level.append([])
    digits: list[np.ndarray] = []
    k = 0
    while k < len(level):
        while len(level[k]) > 1:
            a, b = level[k].pop(), level[k].pop()
            level[k].append(a ^ b)
            if k + 1 == len(level):
                level.append([])
            level[k + 1].append(a & b)
        digits.append(level[k][0] if level[k] else np.zeros((len(px), words), np.uint64))
        k += 1
    more, equal = np.zeros((len(px), words), np.uint64), np.full((len(px), words), ~np.uint64(0))
    for k in range(len(digits) - 1, -1, -1):
        if least >> k & 1:
            equal &= digits[k]
        else:
            more |= equal & digits[k]
            equal &= ~digits[k]
    hit = more | equal if least < 1 << len(digits) else np.zeros_like(more)
    at = np.flatnonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little").view(bool))
    return at // (64 * words), at % (64 * words)


def linked(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the pairs (rows of x, rows of y) have at least this cosine, in double precision; many are sifted first by a product in single precision."""
    keep = np.arange(len(a))
    if 8 * len(a) > len(x) * len(y):
        keep = np.flatnonzero((x.astype(np.float32) @ y.astype(np.float32).T)[a, b] >= cosine - 1e-5)
    fine = [np.einsum("ij,ij->i", x[a[i]], y[b[i]]) >= cosine for i in np.split(keep, range(32_768, len(keep), 32_768))]
    return keep[np.concatenate(fine)]


def near_vectors(embeddings: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings (vec_id, embedding).

    Vectors with a cosine of at least ``cosine``, in double precision, are linked.
    Vectors that are null or zero or hold null or non-finite components, or of
    another length than most, are linked with nothing. Repeated rows of a vec_id
    count once, with the smallest vector. A row without vec_id has no links and is
    kept. Other columns are ignored. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = cut(rows.where(F.col("vec_id").isNotNull() & usable(rows)).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    width = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not width:
        return alone
    good = good.where(F.size("embedding") == width[0]["n"])
    heads = cut(good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    n = heads.count()
    sample = hashed_sample(heads, "id", SAMPLE, n).select("embedding").toPandas()["embedding"]
    sample = unit(np.array(sample.tolist(), np.float64))[np.random.default_rng(85).permutation(len(sample))]
    lines = spark.sparkContext.broadcast(Lines(width[0]["n"], n, cosine, sample))
    kind = "f8" if embeddings.schema["embedding"].dataType.elementType.typeName() == "double" else "f4"

    def dealt(whole: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tables = lines.value.layout.tables
            for pdf in batches:
                step = max(1, min(2048, 65_536 // tables))
                for i in range(0, len(pdf), step):
                    part = pdf.iloc[i : i + step]
                    raw = np.array(part["embedding"].tolist(), kind)
                    out = pd.DataFrame({"t": np.tile(np.arange(tables, dtype=np.int32), len(part)), "cell": lines.value.cells(unit(raw)).ravel()})
                    if whole:
                        out["id"], out["copies"] = (np.repeat(part[c].to_numpy(), tables) for c in ("id", "copies"))
                        out["vector"] = np.repeat(np.array([v.tobytes() for v in raw], object), tables)
                    yield out

        return run

    limit = needed()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells come whole and in order, with their blocks' pairs; what is found are link counts and a few joining edges."""
        held = lines.value
        for pdf, spans in runs(batches, ["t", "cell", "x", "y"]):
            ids, copies, t, left, right, side, vectors = (pdf[c].to_numpy() for c in ("id", "copies", "t", "x", "y", "side", "vector"))
            for start, stop in spans:
                same, mine = left[start] == right[start], side[start:stop] == left[start]
                own = start + np.flatnonzero(mine)
                other = own if same else start + np.flatnonzero(~mine)
                if not len(own) or not len(other) or stop - start < 2:
                    continue
                x = unit(np.frombuffer(b"".join(vectors[own]), kind).reshape(len(own), -1))
                y = x if same else unit(np.frombuffer(b"".join(vectors[other]), kind).reshape(len(other), -1))
                px = x.astype(np.float32) @ held.axes
                a, b = colliding(px, px if same else y.astype(np.float32) @ held.axes, held.half, limit)
                if same:
                    a, b = a[a < b], b[a < b]
                keep = linked(x, y, a, b, held.cosine)
                a, b = a[keep], b[keep]
                if len(a) and t[start]:
                    ua, at_a = np.unique(a, return_inverse=True)
                    ub, at_b = np.unique(b, return_inverse=True)
                    ca, cb = held.cells(x[ua], int(t[start])), held.cells(y[ub], int(t[start]))
                    new = np.concatenate([~(ca[at_a[i : i + 32_768]] == cb[at_b[i : i + 32_768]]).any(axis=1) for i in range(0, len(a), 32_768)])
                    a, b = a[new], b[new]
                if not len(a):
                    continue
                a, b = own[a], other[b]
                links = pd.DataFrame({"id": np.concatenate([ids[a], ids[b]]), "n": np.concatenate([copies[b], copies[a]])}).groupby("id", as_index=False)["n"].sum()
                yield links.assign(to=links["id"])
                yield tree(ids[a], ids[b])

    # blocks of large cells; a cell of one block meets itself alone
    spread = heads.repartition(partitions(heads))
    large = spread.mapInPandas(dealt(False), "t int, cell long").groupBy("t", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    placed = spread.mapInPandas(dealt(True), "t int, cell long, id long, copies long, vector binary").join(cut(large), ["t", "cell"], "left")
    placed = placed.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("side")).alias("x"), F.greatest(i, F.col("side")).alias("y")))
    full = placed.select("t", "cell", F.explode(meet).alias("m"), "side", "id", "copies", "vector").select("t", "cell", "m.x", "m.y", "side", "id", "copies", "vector")
    out = cut(full.repartition(partitions(full), "t", "cell", "x", "y").sortWithinPartitions("t", "cell", "x", "y").mapInPandas(search, "id long, n long, to long"))
    links = out.where("id = to").groupBy("id").agg(F.sum("n").alias("n"))
    label = components(out.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    totals = heads.join(links, "id", "left").join(label.withColumnRenamed("v", "id"), "id", "left")
    totals = totals.select("embedding", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    named = salted_join(good, cut(totals), ["embedding"], "vec_id", n).select("vec_id", "n_links", "component_id")
    result = rows.select("vec_id").join(named, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
