"""Mixing sources to target weights by temperature, in DataFrame operations only.

Source token shares p are raised to an exponent a from 0 to 1 and normalised. a is
bisected, many exponents a step, so that the weights just meet a target entropy (given
as a share of the largest one) or a repetition limit. A source whose weight asks for q tokens of its
T gives q div T whole passes and a last part: its documents lie in hashed blocks,
the blocks follow a hashed order, whole blocks are taken while they fit, and the
block at the border is cut at the last document that fits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, salted_join

#: A block has about so many tokens, or more where a source would have over MOST_BLOCKS.
BLOCK_TOKENS, MOST_BLOCKS = 200_000, 65_536
#: Exponents that are tried at once, and rounds: each narrows the interval by as many.
TRIED, ROUNDS = 64, 6
#: Copies of a row that a task writes out at once.
RANGE = 65_536


def token_count(text: str = "text") -> Column:
    """Words between white space, 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("long")


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def solve(sizes: DataFrame, entropy: float | None, most_repeats: float | None) -> tuple[float, float, float]:
    """The exponent, to six decimal places, the sum of all shares raised to it, and all tokens, of sizes (source, tokens) with tokens > 0.

    It is the largest whose entropy reaches the target, or the smallest that repeats
    no source more often than allowed. With both, the larger of the two: where they
    contradict each other the repetition limit holds and the entropy stays below its
    target. Each round tries TRIED exponents in one aggregation over the sources,
    however many there are, and keeps the interval in which the answer lies; only two
    numbers an exponent come to the driver.
    """
    total, count, least = sizes.agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens")).first()
    if not count:
        return 1.0, 1.0, 0.0
    p, rarest = F.col("tokens") / float(total), least / total

    def sums(at: list[float]) -> list[tuple[float, float]]:
        """For each exponent the sum of the powers, and of the powers times the logarithms."""
        each = sizes.select(p.alias("p"), F.explode(F.array(*map(F.lit, at))).alias("a")).groupBy("a")
        got = {r["a"]: (r["z"], r["l"]) for r in each.agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("l")).collect()}
        return [got[a] for a in at]

    def between(reached: Callable[[float, float, float], bool]) -> tuple[float, float]:
        """The interval in which reached(exponent, powers, logs) turns true."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            at = [low + (high - low) * i / (TRIED + 1) for i in range(1, TRIED + 1)]
            for a, (z, logs) in zip(at, sums(at), strict=True):
                if reached(a, z, logs):
                    high = a
                    break
                low = a
        return low, high

    found = [0.0]
    if entropy is not None:
        found.append(between(lambda a, z, logs: math.log(z) - a * logs / z < entropy * math.log(count))[0])
    if most_repeats is not None:
        found.append(between(lambda a, z, logs: rarest ** (a - 1) / z <= most_repeats)[1])
    a = round(max(found), 6)
    return a, sums([a])[0][0], float(total)


def weights(sizes: DataFrame, entropy: float | None = 0.95, most_repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """sizes (source, tokens, ...) with weight and quota; the quotas sum to at most the budget, all tokens if none is given. A source without tokens has neither."""
    a, z, total = solve(sizes.where("tokens > 0"), entropy, most_repeats)
    share = F.when(F.col("tokens") > 0, F.col("tokens") / F.lit(total or 1.0))
    known = sizes.withColumn("weight", F.round(F.pow(share, F.lit(a)) / z, 9))
    return known.withColumn("quota", F.floor(F.col("weight") * F.lit(float(budget if budget is not None else total))))


def passes(docs: DataFrame, entropy: float | None = 0.95, most_repeats: float | None = None, budget: int | None = None, seed: int = 0) -> DataFrame:
    """docs (doc_id, source, text) with n_tokens, block and passes: how often the mixture has each row, 0 included.

    A null source is a source of its own. A row without tokens goes with its block
    and costs nothing. A row without doc_id hashes like the empty id. Rows that
    share a doc_id are taken or left together where they lie on a border. A text
    longer than a block is a block's only one, or counts whole. Where no row has a
    token every row passes once; an empty table gives an empty result. Other columns
    are ignored.
    """
    ident = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    base = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source"), token_count().alias("n_tokens"))
    base = base.withColumn("place", F.md5(ident)).withColumn("spread", F.xxhash64("doc_id", "n_tokens"))
    sizes = cut(base.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("copies")))
    rows = sizes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    block_count = F.ceil(F.col("tokens") / F.greatest(F.lit(BLOCK_TOKENS), F.ceil(F.col("tokens") / MOST_BLOCKS)))
    some = F.nullif(F.col("tokens"), F.lit(0))
    plan = weights(sizes, entropy, most_repeats, budget).select("source", "copies", F.when(F.col("tokens") > 0, block_count).alias("blocks"), (F.col("quota") % some).alias("part"), F.floor(F.col("quota") / some).alias("whole")) if rows else sizes.selectExpr("source", "copies", "1L blocks", "0L part", "1L whole")
    plan = cut(plan.select("source", "copies", "blocks", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("whole", F.lit(1)).alias("whole")))
    placed = salted_join(base, plan, ["source"], "spread", rows).withColumn("block", F.coalesce(_number(ident) % F.col("blocks"), F.lit(0)).cast("long"))
    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("here"), F.count(F.lit(1)).alias("copies"))
    turn = Window.partitionBy("source").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("source"), F.col("block").cast("string"))), "block")
    blocks = cut(sums.withColumn("until", F.sum("here").over(turn)).select("source", "block", "copies", (F.col("until") - F.col("here")).alias("before"), "until"))
    known = salted_join(placed, blocks, ["source", "block"], "spread", rows)
    inside = known.where("until <= part or before >= part").select("doc_id", "source", "n_tokens", "block", (F.col("whole") + (F.col("until") <= F.col("part")).cast("long")).alias("passes"))
    # ids on a border, of which copies come together
    border = known.where("until > part and before < part")
    order = Window.partitionBy("source", "block").orderBy("place")
    ids = border.groupBy("source", "block", "place").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("before").alias("from"))
    ends = cut(ids.select("source", "block", "place", "copies", (F.col("from") + F.sum("n").over(order)).alias("end")))
    cut_there = salted_join(border, ends, ["source", "block", "place"], "spread", rows).select("doc_id", "source", "n_tokens", "block", (F.col("whole") + (F.col("end") <= F.col("part")).cast("long")).alias("passes"))
    return inside.unionByName(cut_there).withColumn("source", F.when(F.col("source") != "\0", F.col("source")))


def repeated(rows: DataFrame, often: str, name: str) -> DataFrame:
    """rows as often as the column says, numbered from 0; nothing for 0.

    A row that comes more than RANGE times is cut into ranges, which are dealt over the
    tasks before they are written out, so that no task holds all its copies.
    """
    n = F.col(often)
    numbers = lambda first, last: F.explode(F.sequence(first, last)).alias(name)
    few = rows.where((n > 0) & (n <= RANGE)).select("*", numbers(F.lit(0).cast("long"), n - 1))
    ranges = rows.where(n > RANGE).select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(RANGE).cast("long"))).alias("__first")).repartition(partitions(rows))
    many = ranges.select("*", numbers(F.col("__first"), F.least(F.col("__first") + RANGE, n) - 1)).drop("__first")
    return few.unionByName(many)


def mixture(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, n_tokens, block and epoch, from 0: one row for each time that the mixture has a row of docs; nulls, copies and empty tables as in ``passes``."""
    often = repeated(passes(docs, **how).withColumn("passes", F.col("passes").cast("long")), "passes", "epoch")
    return often.select("doc_id", "source", "n_tokens", "block", "epoch")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as the mixture has them, with their columns.

    Rows without doc_id or source are repeated like others. Rows that share a doc_id
    and a source come equally often. Empty texts go with their block, and a very long one
    is repeated whole; where no row has a token each row comes once, and an empty table
    gives an empty result.
    """
    often = passes(docs, **how).where("passes > 0").groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__s")).agg(F.max("passes").cast("long").alias("__n"))
    same = docs["source"].cast("string").eqNullSafe(F.col("__s"))
    known = docs.join(often.where("__id is not null"), (docs["doc_id"] == F.col("__id")) & same)
    # rows without doc_id hash alike, so that all of a source have the same passes: at most one row a source
    blank = docs.where(docs["doc_id"].isNull()).join(often.where("__id is null"), same)
    return repeated(known.unionByName(blank), "__n", "__e").select(*docs.columns)
