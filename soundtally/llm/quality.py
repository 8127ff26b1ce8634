"""Quality classifier: similarity-weighted voting of labelled neighbours in a latent space.

A text becomes counts of hashed runs of character classes (how letters, capitals,
digits, marks and spaces follow each other) and of hashed words; the counts are
weighted by inverse document frequency and projected on the leading singular
vectors. The labelled sample's vectors are broadcast, at most ``SAMPLE`` of
``DIMENSIONS`` floats, and every document's cosine with each of them is computed
exactly, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the classifier is fitted on at most, half of each label; chosen by hash of the id.
SAMPLE = 4_000
#: Hashed features: SHAPES for character classes, WORDS for words.
SHAPES, WORDS = 768, 512
DIMENSIONS, NEIGHBOURS, SHARPNESS = 64, 25, 6
#: Decimals of a similarity that count.
PLACES = 9
_CLASS = np.arange(256, dtype=np.uint8)
for _first, _last, _to in ((0x61, 0x7A, 0x61), (0x41, 0x5A, 0x41), (0x30, 0x39, 0x30), (0x80, 0xFF, 0x61), (0x09, 0x0D, 0x0A), (0x20, 0x20, 0x20)):
    _CLASS[_first : _last + 1] = _to


def features(text: str | None) -> np.ndarray:
    """Counts of hashed features of the whole text."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    out = np.zeros(SHAPES + WORDS, np.float32)
    if not len(raw):
        return out
    kind = _CLASS[raw]
    kind = kind[np.r_[True, kind[1:] != kind[:-1]]].astype(np.uint32)
    for n in (1, 2, 3, 5):
        if len(kind) >= n:
            h = np.full(len(kind) - n + 1, n * 2654435761 & 0xFFFFFFFF, np.uint32)
            for i in range(n):
                h = (h ^ kind[i : i + len(h)]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            out[:SHAPES] += np.bincount(h % np.uint32(SHAPES), minlength=SHAPES)
    # words: sums of scrambled bytes between spaces, each weighted by its place in the word
    space = raw <= 0x20
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if len(start):
        body = raw[start[0] :].astype(np.uint32)
        place = np.arange(len(body), dtype=np.uint32) - np.repeat((start - start[0]).astype(np.uint32), np.diff(np.r_[start, len(raw)]))
        value = (body * np.uint32(0x85EBCA6B) ^ body << np.uint32(9)) * (place * np.uint32(0x9E3779B2) + np.uint32(1))
        value[space[start[0] :]] = 0
        word = np.add.reduceat(value, start - start[0])
        word ^= word >> np.uint32(13)
        out[SHAPES:] += np.bincount((word * np.uint32(0xC2B2AE35) >> np.uint32(8)) % np.uint32(WORDS), minlength=WORDS)
    return out


def labelled_sample(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, quality): at most size rows, half of each label, that may be learnt from: crc32 of the id's decimal text modulo 5 isn't 0. A document with contradicting labels is left out."""
    one = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    free = one.where(~held_out())
    half = lambda q: free.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size // 2)
    return half(0).unionByName(half(1))


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


class Model:
    """Fitted weights; bounded by SAMPLE and the feature counts whatever the input."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 1.0
        n = max(1, len(counts))
        self.idf = np.log((1 + n) / (1 + np.count_nonzero(counts, axis=0))) + 1
        x = self.weighted(counts)
        values, vectors = np.linalg.eigh(x.T @ x) if len(counts) else (np.ones(1), np.eye(x.shape[1]))
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS], dtype=np.float64)
        self.labels = labels.astype(np.float64)
        self.known = self.latent(x)
        # places by label, 1 first, and then by id, as rows come in order of ids
        self.turn = np.empty(len(labels), np.int64)
        self.turn[np.argsort(-self.labels, kind="stable")] = np.arange(len(labels))

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts.astype(np.float64))
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return x

    def latent(self, x: np.ndarray) -> np.ndarray:
        v = x @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors by weight; a text without features gets the sample's share.

        Of equal similarities at the last place, to nine decimals, rows of label 1 are
        nearer, and of these the smaller ids.
        """
        if not len(self.known):
            return np.full(len(counts), self.prior)
        sims = np.round(self.latent(self.weighted(counts)) @ self.known.T, PLACES)
        k, n = min(NEIGHBOURS, sims.shape[1]), sims.shape[1]
        near = np.rint(sims * 10**PLACES).astype(np.int64) * n - self.turn
        top = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
        weight = np.maximum(np.take_along_axis(sims, top, axis=1), 0) ** SHARPNESS
        vote = (weight * self.labels[top]).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-12)
        return np.where((weight.sum(axis=1) > 1e-12) & (counts.sum(axis=1) > 0), np.clip(vote, 0, 1), self.prior)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "counts": [features(t).tobytes() for t in pdf["text"]]})


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Fits on the bounded sample; only hashed counts of its texts come to the driver, at most size vectors.

    Of rows that share a doc_id the smallest text counts, whatever their order. A null
    text has no features, a label without a document teaches nothing, and without
    labels every score is 1. Ids of documents that are null have no label.
    """
    sample = F.broadcast(labelled_sample(labels, size))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    one = known.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = one.mapInPandas(_features, "doc_id long, quality int, counts binary").toPandas().sort_values("doc_id")
    counts = np.stack([np.frombuffer(c, np.float32) for c in rows["counts"]]) if len(rows) else np.zeros((0, SHAPES + WORDS), np.float32)
    return Model(counts, rows["quality"].to_numpy())


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of every whole text, as column ``name``; null and empty texts get the sample's share of label 1. Other columns stay, but for one of that name. An empty table stays empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = [held.value.score(np.stack([features(t) for t in texts.iloc[i : i + 256]])) for i in range(0, len(texts), 256)]
            yield pd.Series(np.concatenate(out) if out else [], dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(run, "double")(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text; other columns are ignored).

    Rows that share a doc_id are scored singly. Null and empty texts get the sample's
    share of label 1; a row without doc_id isn't held out. A very long text is scored
    as a whole. An empty table gives an empty result.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score at least threshold, with their columns as they are, also one named like a score.

    Rows without doc_id, repeated rows, very long and empty texts are scored like
    others, see ``classify``; an empty table stays empty.
    """
    name = "__quality" + "_" * max(map(len, docs.columns))
    return score(docs, fit(docs, labels), name).where(F.col(name) >= threshold).select(*docs.columns)
