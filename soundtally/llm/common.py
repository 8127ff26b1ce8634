"""Helpers that the corpus operators share: table access, shared checkpoints, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. The session's own setting wins; a temporary one is made only in a local session where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends here and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder as Parquet and read back; for wide rows, which Parquet compresses."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over at least the session's shuffle partitions, for stages that do much work a row on few input splits."""
    return df.repartition(partitions(df))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], by: str, rows: int) -> DataFrame:
    """big, of so many rows, joined with small, which has one row for each of keys and says in copies how many rows of big have it.

    A key with over half a task's fair share of rows is met in several parts: its
    rows of big are dealt over them by hash of ``by``, and its row of small is repeated
    for each. There are at most two such keys a shuffle partition.
    """
    share = max(1, rows // (4 * partitions(big)))
    parts = F.ceil(F.col("copies") / share).cast("int")
    heavy = small.where(F.col("copies") > 2 * share).select(*keys, parts.alias("__parts"))
    dealt = big.join(F.broadcast(heavy), keys, "left").withColumn("__part", F.pmod(F.xxhash64(by), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    there = F.when(F.col("copies") > 2 * share, parts).otherwise(1)
    return dealt.join(small.withColumn("__part", F.explode(F.sequence(F.lit(0), there - 1))).drop("copies"), [*keys, "__part"]).drop("__part")


def hashed_sample(df: DataFrame, key: str, size: int, n: int) -> DataFrame:
    """At most size of the n rows of df, first by hash of key. A bound on the hash leaves about four times as many before they are sorted, so that large tables don't sort in one task."""
    h = F.xxhash64(F.lit(3), key)
    bound = -(-4 * size * (1 << 40) // max(1, n))
    few = df.where(F.pmod(h, F.lit(1 << 40)) < bound) if bound < 1 << 40 else df
    return few.orderBy(h, key).limit(size)


def text_bytes(col: str = "text") -> Column:
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for every endpoint of edges (a, b): c is the smallest id that v reaches.

    Rounds of neighbour minimum and pointer jumping until nothing changes; each
    round is a join and a pre-aggregated minimum, so a hub's neighbours are
    never gathered in one task. Empty edges give an empty result.
    """
    e = edges.select("a", "b").where("a <> b")
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("n"))
        low = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("up"))
        new = cut(low.join(jump, "c", "left").select("v", "old", F.least("c", F.coalesce("up", "c")).alias("c")))
        labels = new.select("v", "c")
        if new.where("c <> old").isEmpty():
            return labels


def with_arrow(df: DataFrame, fields: str, make: Callable[[pa.RecordBatch], list[pa.Array]], rows: int = 400) -> DataFrame:
    """df and the columns that make() gives for a batch; columns of those names are replaced. Batches are cut to ``rows`` rows, which bounds a worker's memory."""
    new = df.sparkSession.createDataFrame([], fields).schema
    own = [c for c in df.columns if c.lower() not in {n.lower() for n in new.names}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                kept = [part.column(i) for i, c in enumerate(part.schema.names) if c in own]
                yield pa.RecordBatch.from_arrays([*kept, *make(part)], names=[*own, *new.names])

    schema = df.select(*own).schema
    for field in new:
        schema = schema.add(field)
    return df.mapInArrow(run, schema)


def runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Sorted rows with the places of their whole runs of equal ``by``; a run may span batches."""
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        key = pdf[by].to_numpy()
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]).tolist()
        if len(start) > 1:
            yield pdf, list(zip(start[:-1], start[1:], strict=True))
        rest = pdf.iloc[start[-1] :]
    if rest is not None:
        yield rest, [(0, len(rest))]


def tree(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Edges that join the same vectors as the pairs (a, b) do, at most one a vector: each is joined with its component's smallest id."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    low = np.arange(len(names))
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            break
        low = new
    other = low != np.arange(len(names))
    return pd.DataFrame({"id": names[other], "n": 0, "to": names[low[other]]})
