"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids and residual code books are fitted on a bounded sample; every vector
is indexed. The number of lists grows with the square root of the table, and how many
a query visits is measured on the sample, so that few are visited where vectors form
groups and as many as needed where they don't. Lists that lie together form a part
of the index; a list too large for one, of equal vectors say, is dealt over several by
hash. A query goes to the parts that hold a list it visits. Asymmetric distance tables
rank the codes there, and the best are reranked with exact distances on the original
vectors. A code's distance is off by at most the vector's quantisation error, which is
stored: every other code that this bound lets come as near as the last exact distance
kept is reranked too, so a part hands on its k truly nearest of the visited lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hashed_sample, partitions

#: Vectors that centroids and code books are fitted on, chosen by hash: so many, or so many a list in large tables, at most MOST.
SAMPLE, A_LIST, MOST = 16_384, 16, 131_072
#: Lists are about the square root of the table, but no more than MOST / A_LIST, and no fewer than LISTS.
LISTS = 256
#: Share of the sample's nearest neighbours that lie in the lists visited, and queries that this is measured on.
FOUND, TRIALS = 0.97, 512
#: Sub-vectors of a code and values of each; candidates that are reranked first in a part.
PIECES, CODES, KEPT = 32, 256, 100
#: Vectors of a part and queries of a block on average, which bound a task's memory; smaller tables are dealt into parts of SMALL while the session has partitions for them.
PART, QUERIES, SMALL = 524_288, 524_288, 8_192
#: Distances that a task holds at once, and vectors that it reranks at once.
HELD, RERANKED = 4_194_304, 65_536
#: Rounding of a code's squared distance in single precision, as a share of the squared norms.
ROUNDING = 2e-5


def usable(df: DataFrame, vector: str = "embedding") -> Column:
    """Whether a vector isn't null or zero and has no null or non-finite component."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def clusters(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of k-means; an empty cluster takes a random vector."""
    at = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest(x, at)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        at = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)]).astype(np.float32)
    return at


def nearest(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((at * at).sum(axis=1) - 2 * (x @ at.T)).argmin(axis=1)


def lists_for(n: int) -> int:
    return int(min(max(LISTS, 2 ** round(math.log2(max(1, n)) / 2)), MOST // A_LIST))


def near_order(x: np.ndarray) -> np.ndarray:
    """An order in which points that lie together follow each other: halves along the widest direction, again and again."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= 2:
            out.append(at)
            continue
        wide = x[at].var(axis=0).argmax()
        at = at[x[at, wide].argsort(kind="stable")]
        todo += [at[len(at) // 2 :], at[: len(at) // 2]]
    return np.concatenate(out)


class Index:
    """Centroids, code books and the parts of the lists; bounded by the constants above.

    n is the number of vectors to be indexed, in about ``parts`` parts; k the neighbours that queries ask for.
    """

    def __init__(self, sample: np.ndarray, n: int, parts: int, k: int):
        rng = np.random.default_rng(6)
        sample = sample.astype(np.float32)
        x = np.unique(sample, axis=0)
        self.centroids = clusters(x, min(lists_for(n), len(x)), 8 if lists_for(n) <= 1024 else 3, rng)
        self.centroids = self.centroids[near_order(self.centroids)]
        rest = x - self.centroids[nearest(x, self.centroids)]
        width = -(-x.shape[1] // PIECES)
        self.cuts = [slice(i, min(i + width, x.shape[1])) for i in range(0, x.shape[1], width)]
        self.books = [clusters(rest[:, c], min(CODES, len(x)), 6, rng) for c in self.cuts]
        self.visited = self.measured(x, k, rng)
        # a list's first part, and the parts that it is dealt over
        share = np.bincount(nearest(sample, self.centroids), minlength=len(self.centroids)) / len(sample)
        each = 1 / parts
        self.dealt = np.maximum(1, np.ceil(share / each - 0.5)).astype(int)
        self.first, at, held = np.zeros(len(share), int), 0, 0.0
        for i, s in enumerate(share):
            if held and held + s > each or self.dealt[i] > 1 and held:
                at, held = at + 1, 0.0
            self.first[i] = at
            if self.dealt[i] > 1:
                at, held = at + self.dealt[i], 0.0
            else:
                held += s
        self.parts = int((self.first + self.dealt).max())

    def measured(self, x: np.ndarray, k: int, rng: np.random.Generator) -> int:
        """Lists to visit, so that FOUND of the k nearest in the sample of some of its vectors lie in them. A larger table's neighbours lie nearer, so this is on the safe side."""
        q = x[rng.permutation(len(x))[:TRIALS]]
        far = (q * q).sum(axis=1)[:, None] - 2 * (q @ x.T) + (x * x).sum(axis=1)
        k = min(k + 1, len(x))
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        place = np.empty(self.gaps(q).shape, int)
        np.put_along_axis(place, self.gaps(q).argsort(axis=1), np.arange(len(self.centroids))[None], axis=1)
        own = nearest(x, self.centroids)[near]
        return 1 + int(np.quantile(np.take_along_axis(place, own, axis=1), FOUND, method="higher"))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, what a vector's code adds to its distance from any query, and how far the code is from the vector."""
        lists = nearest(x, self.centroids)
        at = self.centroids[lists]
        rest = x - at
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        known = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        return lists, codes, (known * (known + 2 * at)).sum(axis=1), np.sqrt(((rest - known) ** 2).sum(axis=1))

    def gaps(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of queries from centroids."""
        return (q * q).sum(axis=1)[:, None] - 2 * (q @ self.centroids.T) + (self.centroids**2).sum(axis=1)

    def visits(self, gaps: np.ndarray, share: float | None = None) -> np.ndarray:
        """Whether a query visits a list: (queries, lists)."""
        k = self.visited if share is None else max(1, int(np.ceil(len(self.centroids) * share)))
        out = np.zeros(gaps.shape, bool)
        if k < gaps.shape[1]:
            np.put_along_axis(out, np.argpartition(gaps, k - 1, axis=1)[:, :k], True, axis=1)
        else:
            out[:] = True
        return out

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """A piece's share of the squared distance by query and code, but for what hangs on the list: (queries, codes) each."""
        return [-2 * (q[:, c] @ b.T) for c, b in zip(self.cuts, self.books, strict=True)]


def smallest(far: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest finite values; among equals the first."""
    if len(far) > k:
        bar = np.partition(far, k - 1)[k - 1]
        less = np.flatnonzero(far < bar)
        out = np.concatenate([less, np.flatnonzero(far == bar)[: k - len(less)]])
    else:
        out = np.arange(len(far))
    return out[np.isfinite(far[out])]


def squares(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors from a query."""
    return np.concatenate([((x[i : i + RERANKED].astype(np.float64) - q) ** 2).sum(axis=1) for i in range(0, len(x), RERANKED)])


def nearest_of(far: np.ndarray, error: np.ndarray, slack: float, x: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact squared distances of the k nearest vectors x of q with finite code distance far, ties by ids.

    error is each vector's distance from its code, slack the rounding of far.
    """
    top = smallest(far, max(KEPT, k))
    if not len(top):
        return top, np.empty(0)
    exact = squares(x[top], q)
    if len(top) >= k:
        last = np.sqrt(np.partition(exact, k - 1)[k - 1])
        left = far <= (np.float32(last) + error) ** 2 + np.float32(slack)
        left[top] = False
        for i in np.split(rest := np.flatnonzero(left), range(RERANKED, len(rest), RERANKED)):
            if len(i):
                top, exact = np.concatenate([top, i]), np.concatenate([exact, squares(x[i], q)])
                best = np.lexsort((ids[top], exact))[:k]
                top, exact = top[best], exact[best]
    best = np.lexsort((ids[top], exact))[:k]
    return top[best], exact[best]


def fit(vectors: DataFrame, n: int, parts: int = 1, k: int = 10) -> Index | None:
    """From a bounded sample by hash of the n usable vectors; None if there are none."""
    size = min(max(SAMPLE, A_LIST * lists_for(n)), MOST)
    rows = hashed_sample(vectors, "vec_id", size, n).select("embedding").toPandas()["embedding"]
    return Index(np.array(rows.tolist(), dtype=np.float32), n, parts, k) if len(rows) else None


def search(embeddings: DataFrame, queries: DataFrame, k: int = 10, visited: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, embedding) among embeddings (vec_id, embedding), but itself.

    visited is the share of lists to visit, by default as measured on the sample.
    score is the Euclidean distance in double precision; ties go to the smaller
    vec_id. Vectors that are null or zero, or hold null or non-finite components,
    rows without vec_id, and vectors of another length than most of the sample take
    no part. Repeated rows of a vec_id are one, with the smallest vector. Other columns
    are ignored. The result is exact but for lists that are not visited. Fewer than k
    candidates give fewer rows, an empty table none.
    """
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(df)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    spark = embeddings.sparkSession
    base = cut(clean(embeddings))
    width = base.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not width:
        return empty
    base = base.where(F.size("embedding") == width[0]["n"])
    asked = cut(clean(queries).where(F.size("embedding") == width[0]["n"]))
    n = base.count()
    fitted = fit(base, n, max(-(-n // PART), min(partitions(base), -(-n // SMALL))), k)
    parts, index = fitted.parts, spark.sparkContext.broadcast(fitted)
    blocks = max(1, -(-asked.count() // QUERIES))
    kind = "f8" if base.schema["embedding"].dataType.elementType.typeName() == "double" else "f4"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["embedding"].tolist(), dtype=kind)
                lists, codes, added, error = index.value.place(x.astype(np.float32))
                part = index.value.first[lists] + pdf["turn"].to_numpy() % index.value.dealt[lists]
                yield pd.DataFrame({"part": part, "list": lists, "vec_id": pdf["vec_id"], "added": added, "error": error, "codes": [c.tobytes() for c in codes], "vector": [v.tobytes() for v in x]})

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query once for each part that holds a list it visits."""
        held = index.value
        for pdf in batches:
            for i in range(0, len(pdf), 1024):
                part = pdf.iloc[i : i + 1024]
                x = np.array(part["embedding"].tolist(), dtype=kind)
                who, lists = np.nonzero(held.visits(held.gaps(x.astype(np.float32)), visited))
                times = held.dealt[lists]
                step = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
                pairs = np.unique(np.repeat(who, times) * parts + np.repeat(held.first[lists], times) + step)
                at = pairs // parts
                raw = np.array([v.tobytes() for v in x], object)
                yield pd.DataFrame({"part": pairs % parts, "query_id": part["vec_id"].to_numpy()[at], "query": raw[at]})

    def scan(_, codes: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(codes) and len(asking):
            codes = codes.sort_values(["list", "vec_id"], ignore_index=True)
            ids, added, error = (codes[c].to_numpy() for c in ("vec_id", "added", "error"))
            x = np.frombuffer(b"".join(codes["vector"]), kind).reshape(len(ids), -1)
            size = max(float((x[i : i + RERANKED].astype(np.float64) ** 2).sum(axis=1).max()) for i in range(0, len(ids), RERANKED))
            code = np.ascontiguousarray(np.frombuffer(b"".join(codes["codes"]), np.uint8).reshape(len(ids), -1).T)
            lists, start = np.unique(codes["list"].to_numpy(), return_index=True)
            stop, q_ids = [*start[1:], len(ids)], asking["query_id"].to_numpy()
            step = max(1, min(128, HELD // len(ids)))
            for i in range(0, len(asking), step):
                true = np.frombuffer(b"".join(asking["query"].iloc[i : i + step]), kind).reshape(-1, x.shape[1]).astype(np.float64)
                q = true.astype(np.float32)
                gaps, tables = index.value.gaps(q), index.value.tables(q)
                goes = index.value.visits(gaps, visited)
                far = np.full((len(q), len(ids)), np.inf, np.float32)
                for at, a, b in zip(lists, start, stop, strict=True):
                    who = np.flatnonzero(goes[:, at])
                    if len(who):
                        sums = gaps[who, at][:, None] + added[None, a:b]
                        for table, c in zip(tables, code, strict=True):
                            sums += table[who][:, c[a:b]]
                        far[who, a:b] = sums
                far[q_ids[i : i + step, None] == ids] = np.inf
                for j, row in enumerate(far):
                    top, exact = nearest_of(row, error, ROUNDING * (size + float(true[j] @ true[j])), x, true[j], ids, k)
                    found.append((np.full(len(top), q_ids[i + j]), ids[top], np.sqrt(exact)))
        flat = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), flat, strict=True)))

    turned = base.withColumn("turn", F.pmod(F.xxhash64(F.lit(16), "vec_id"), F.lit(1 << 30)))
    placed = turned.repartition(partitions(base)).mapInPandas(place, "part int, list int, vec_id long, added float, error float, codes binary, vector binary")
    dealt = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    going = asked.repartition(partitions(base)).mapInPandas(go, "part int, query_id long, query binary").withColumn("block", F.pmod(F.xxhash64(F.lit(6), "query_id"), F.lit(blocks)).cast("int"))
    # a task's work follows from vectors times queries, not from bytes, so small partitions aren't to be joined
    tasks = max(partitions(base), parts * blocks)
    dealt, going = (df.repartition(tasks, "part", "block") for df in (dealt, going))
    found = dealt.groupBy("part", "block").cogroup(going.groupBy("part", "block")).applyInPandas(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
