"""Sharding by balanced label propagation, in DataFrame operations only.

Links are given as membership of hubs: the rows of a hub are linked with each other, and
no pair is ever spelt out. Labels spread in three steps. Rows first take the label of
their largest hub, and labels that meet in hubs join, the one with most votes over all
hubs first, as long as they fit a shard together. Then labels go to shards: each votes
for the shard with most of its rows that has room for all, a shard takes those that
vote for it, large ones first, up to its quota, and those that found no room vote again
for what is left; a label for which no shard has room takes all of one and goes on with
the rest, and rows without links fill the quotas. Last, rows move to the shard that
most of their neighbours over all hubs are on, in exchange for as many that want to go
the other way, until no more links are mended. Row counts are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, salted_join, text_bytes

#: Labels that ask to join one label in a task; where more do, they and the room are divided.
ASKING = 10_000
#: Share of members that a pass has to bring together for further ones to be made.
MENDED = 0.02


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with a gapless rank from 0 within the groups ``by``, a large group being numbered in many hashed parts.

    The parts' counts are at most 4 a shuffle partition and group; by must have few groups.
    """
    parts = 4 * partitions(df)
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(F.lit(31), *order), F.lit(parts)))
    before = Window.partitionBy(*by).orderBy("__part")
    sums = dealt.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__from", F.sum("__n").over(before) - F.col("__n")).drop("__n")
    inner = Window.partitionBy(*by, "__part").orderBy(*order)
    # at most 4 rows a shuffle partition and group
    return dealt.withColumn("__at", F.row_number().over(inner) - 1).join(F.broadcast(sums), [*by, "__part"]).withColumn(name, (F.col("__from") + F.col("__at")).cast("long")).drop("__part", "__at", "__from")


def before(df: DataFrame, by: list[str], size: str, name: str = "start") -> DataFrame:
    """df (hub, size, ...) with what the sizes before a row sum up to within the groups ``by``: larger sizes first, equal classes of them in hashed parts.

    The parts are at most 4 a shuffle partition, group and power of two; by must have few groups.
    """
    parts, h = 4 * partitions(df), F.xxhash64(F.lit(37), "hub")
    dealt = df.withColumn("__part", (63 - F.floor(F.log2(F.col(size)))) * parts + F.pmod(h, F.lit(parts)))
    earlier = Window.partitionBy(*by).orderBy("__part")
    sums = dealt.groupBy(*by, "__part").agg(F.sum(size).alias("__n")).withColumn("__from", F.sum("__n").over(earlier) - F.col("__n")).drop("__n")
    inner = Window.partitionBy(*by, "__part").orderBy(h, "hub").rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.withColumn("__at", F.sum(size).over(inner) - F.col(size)).join(F.broadcast(sums), [*by, "__part"])
    return met.withColumn(name, (F.col("__from") + F.col("__at")).cast("long")).drop("__part", "__at", "__from")


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, hub) of the rows whose text another document has too."""
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(5), "text").alias("g")).distinct()
    many = keyed.groupBy("h", "g").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return salted_join(keyed, cut(many), ["h", "g"], "doc_id", docs.count()).select("doc_id", F.xxhash64("h", "g").alias("hub"))


def granted(hubs: DataFrame, votes: DataFrame, rooms: list[int]) -> DataFrame:
    """(hub, shard, first, take): which of a hub's rows, from the first, a shard takes. Each round gives at least the largest hub that asks a place, and ends when all have one or nothing is left.

    hubs: hub, size; votes: hub, shard, n; rooms: rows that each shard may take.
    """
    shards, spark = len(rooms), hubs.sparkSession
    known = votes.groupBy("hub").agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("votes"))  # at most a pair a shard
    left = cut(hubs.join(known, "hub", "left").withColumn("left", F.col("size")))
    out = spark.createDataFrame([], "hub long, shard int, first long, take long")
    while any(rooms) and not left.isEmpty():
        room = F.array(*[F.lit(r).cast("long") for r in rooms])
        fit = lambda s: F.element_at(room, s + 1)
        open_to = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: fit(s) > 0)
        wish = F.transform(open_to, lambda s: F.struct((fit(s) >= F.col("left")).alias("fits"), F.coalesce(F.element_at("votes", s), F.lit(0)).alias("n"), F.xxhash64("hub", s).alias("tie"), s.alias("shard")))
        asked = before(left.withColumn("shard", F.array_max(wish)["shard"]), ["shard"], "left")
        free = fit(F.col("shard")) - F.col("start")
        take = F.when(F.col("left") <= free, F.col("left")).when(F.col("left") > max(rooms), F.greatest(free, F.lit(0))).otherwise(0)
        told = cut(asked.withColumn("take", take.cast("long")).withColumn("first", F.col("size") - F.col("left")))
        for r in told.groupBy("shard").agg(F.sum("take").alias("take")).collect():  # a row a shard
            rooms[r["shard"]] -= r["take"]
        out = out.unionByName(told.where("take > 0").select("hub", "shard", "first", "take"))
        left = told.where("left > take").select("hub", "size", "votes", (F.col("left") - F.col("take")).alias("left"))
    return cut(out)


def labelled(links: DataFrame, cap: int) -> DataFrame:
    """(doc_id, hub): the label of each linked row, after labels have joined as long as cap rows aren't exceeded.

    In each round every hub names a label that its smallest one could join, the one with
    most of its rows; every smaller label that fits it as well votes for it with its rows
    there. A label joins the one with most votes over all hubs, unless that one joins
    another in the same round. It ends when no hub has two labels that fit together.
    """
    m = links.count()
    sizes = cut(links.groupBy("hub").agg(F.count(F.lit(1)).alias("copies")))
    # a row goes with the largest of its hubs
    lead = cut(salted_join(links, sizes.withColumn("members", F.col("copies")), ["hub"], "doc_id", m).groupBy("doc_id").agg(F.max(F.struct("members", "hub"))["hub"].alias("label")))
    size = lead.groupBy("label").agg(F.count(F.lit(1)).alias("copies"))
    rows = links.join(lead, "doc_id").groupBy("label", "hub").agg(F.count(F.lit(1)).alias("n"))
    total = cut(size)
    held = cut(rows.join(total.withColumnRenamed("copies", "size"), "label"))
    now = total.select("label", F.col("label").alias("to"), "copies")
    while True:
        tie = F.xxhash64("label").alias("tie")
        low = held.groupBy("hub").agg(F.min(F.struct("size", tie, "label")).alias("low"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
        met = salted_join(held, cut(low), ["hub"], "label", m)
        fits = (F.col("size") + F.col("low.size") <= cap) & (F.col("label") != F.col("low.label"))
        named = met.where(fits).groupBy("hub").agg(F.max(F.struct("n", "size", tie, "label")).alias("f")).join(low.select("hub", "copies"), "hub")
        named = cut(named)
        if named.isEmpty():
            break
        asked = salted_join(held, named, ["hub"], "label", m)
        smaller = F.struct("size", tie, "label") < F.struct("f.size", "f.tie", "f.label")
        votes = asked.where(smaller & (F.col("size") + F.col("f.size") <= cap)).groupBy("label", "size", F.col("f.label").alias("to"), F.col("f.size").alias("to_size")).agg(F.sum("n").alias("votes"))
        best = cut(votes.groupBy("label", "size").agg(F.max(F.struct("votes", F.xxhash64("label", "to").alias("tie"), "to", "to_size")).alias("b")).select("label", "size", "b.*"))
        # a label that others ask to join stays where it is, if it asks itself
        still = best.join(best.select(F.col("label").alias("to")), "to", "left_anti")
        many = still.groupBy("to").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > ASKING)
        # at most a row for each ASKING labels
        dealt = still.join(F.broadcast(many), "to", "left").withColumn("__parts", F.coalesce(F.ceil(F.col("__n") / ASKING), F.lit(1))).withColumn("__part", F.pmod(F.xxhash64("label"), F.col("__parts")))
        order = Window.partitionBy("to", "__part").orderBy(F.desc("votes"), "tie", "label").rowsBetween(Window.unboundedPreceding, 0)
        taken = dealt.withColumn("__sum", F.sum("size").over(order)).where(F.col("__sum") <= F.greatest(F.col("size"), (cap - F.col("to_size")) / F.col("__parts")))
        # where the room's share is smaller than the first label, that one still fits alone
        taken = cut(taken.select("label", F.col("to").alias("__new")))
        new = F.coalesce("__new", "label").alias("label")
        moved = held.join(taken, "label", "left").groupBy(new, "hub").agg(F.sum("n").alias("n"))
        grown = cut(now.join(taken, now["to"] == taken["label"], "left").select(now["label"], F.coalesce("__new", "to").alias("to"), "copies"))
        now, whole = grown, grown.groupBy(F.col("to").alias("label")).agg(F.sum("copies").alias("size"))
        held = cut(moved.join(whole, "label"))
    # a label has at most as many rows as its largest hub
    return salted_join(lead, now, ["label"], "doc_id", m).select("doc_id", F.col("to").alias("hub"))


def propagated(state: DataFrame, lead: DataFrame, shards: int, n: int) -> DataFrame:
    """state (doc_id, size, text_crc32, shard) after the labels lead (doc_id, hub) have gone to shards."""
    tie = F.xxhash64(F.lit(17), "doc_id", "text_crc32")
    led = cut(state.join(lead, "doc_id", "left"))
    where = state.where("doc_id is not null").groupBy("doc_id", "shard").agg(F.count(F.lit(1)).alias("n"))
    votes = lead.join(where, "doc_id").groupBy("hub", "shard").agg(F.sum("n").alias("n"))
    hubs = cut(led.where("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("size")))
    rooms = [n // shards + (s < n % shards) for s in range(shards)]
    grants = granted(hubs, votes, rooms)
    met = cut(grants.join(hubs, "hub"))
    whole = met.where("take = size").select("hub", F.col("shard").alias("to"), F.col("size").alias("copies"))
    linked = led.where("hub is not null")
    going = salted_join(linked, whole, ["hub"], "doc_id", n).select("doc_id", "size", "text_crc32", F.col("to").alias("shard"))
    # a hub is split only where it fills a shard, so at most a row a shard is broadcast here
    part = met.where("take < size").select("hub", F.col("shard").alias("to"), "first", (F.col("first") + F.col("take")).alias("last"))
    split = ranked(linked.join(F.broadcast(part.select("hub").distinct()), "hub"), ["hub"], [tie, F.col("size")])
    met_part = split.join(F.broadcast(part), (split["hub"] == part["hub"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")), "left")
    some = cut(met_part.select("doc_id", "size", "text_crc32", "to"))
    lost = linked.join(met.select("hub").distinct(), "hub", "left_anti")
    rest = led.where("hub is null").select("doc_id", "size", "text_crc32")
    rest = rest.unionByName(lost.select("doc_id", "size", "text_crc32")).unionByName(some.where("to is null").select("doc_id", "size", "text_crc32"))
    upto, last = F.array(*[F.lit(sum(rooms[: s + 1])) for s in range(shards)]), F.lit(shards - 1)
    to = F.least(F.size(F.filter(upto, lambda u: u <= F.col("rank"))), last).cast("int")
    filled = ranked(rest.withColumn("one", F.lit(1)), ["one"], [tie, F.col("doc_id"), F.col("size")]).select("doc_id", "size", "text_crc32", to.alias("shard"))
    return going.unionByName(some.where("to is not null").withColumnRenamed("to", "shard")).unionByName(filled)


def exchanged(state: DataFrame, links: DataFrame, n: int, turn: int) -> DataFrame:
    """state after rows have changed places: half of them, by hash and turn, may go where they have more neighbours, and as many go from one shard to another as come back, those who gain most first. Rows that share a doc_id stay."""
    where = cut(state.where("doc_id is not null").groupBy("doc_id").agg(F.min("shard").alias("shard"), F.count(F.lit(1)).alias("rows")).where("rows = 1").drop("rows"))
    each = cut(links.join(where, "doc_id").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n")))
    # at most a pair a shard
    hubs = cut(each.groupBy("hub").agg(F.sum("n").alias("copies"), F.collect_list(F.struct("shard", "n")).alias("there")).where(F.size("there") > 1))
    seen = salted_join(links.join(where.withColumnRenamed("shard", "own"), "doc_id"), hubs, ["hub"], "doc_id", n)
    score = seen.select("doc_id", "own", F.explode("there").alias("t")).groupBy("doc_id", "own", "t.shard").agg(F.sum(F.col("t.n") - (F.col("t.shard") == F.col("own")).cast("int")).alias("n"))
    other = F.when(F.col("shard") != F.col("own"), F.struct("n", F.xxhash64("doc_id", "shard").alias("tie"), F.col("shard").alias("to")))
    best = score.groupBy("doc_id", "own").agg(F.max(other).alias("b"), F.max(F.when(F.col("shard") == F.col("own"), F.col("n"))).alias("n"))
    gain = F.col("b.n") - F.coalesce("n", F.lit(0))
    going = cut(best.where((gain > 0) & (F.pmod(F.xxhash64(F.lit(turn // 2), "doc_id"), F.lit(2)) == turn % 2)).select("doc_id", "own", F.col("b.to").alias("to"), F.floor(F.log2(gain.cast("double"))).cast("int").alias("class")))
    # a row a pair of shards and power of two
    sums = cut(going.groupBy("own", "to", "class").agg(F.count(F.lit(1)).alias("n")))
    pairs = sums.groupBy("own", "to").agg(F.sum("n").alias("n"))
    both = pairs.join(pairs.select(F.col("own").alias("to"), F.col("to").alias("own"), F.col("n").alias("back")), ["own", "to"]).select("own", "to", F.least("n", "back").alias("quota"))
    earlier = Window.partitionBy("own", "to").orderBy(F.desc("class"))
    allowed = sums.withColumn("first", F.sum("n").over(earlier) - F.col("n")).join(both, ["own", "to"]).drop("n")
    numbers = ranked(going, ["own", "to", "class"], [F.xxhash64(F.lit(41), "doc_id"), F.col("doc_id")])
    swapped = numbers.join(F.broadcast(allowed), ["own", "to", "class"]).where("first + rank < quota").select("doc_id", F.col("to").alias("__to"))
    return cut(state.join(swapped, "doc_id", "left").withColumn("shard", F.coalesce("__to", "shard")).drop("__to"))


def balanced_shards(docs: DataFrame, shards: int = 8, links: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text).

    Law ``rows``: shards hold counts at most one apart, and slots number a shard's
    rows without gaps. links (doc_id, hub long) defaults to equal texts. A null text has
    size 1 and no links; a row without doc_id has none either; rows that share a
    doc_id move alike but are counted singly. A group larger than a shard fills whole
    shards. Where rows are in several hubs, they change places until nothing linked is
    apart, or two passes in a row have mended less than MENDED. A very long text counts
    whole. Other columns are
    ignored. An empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    base = docs.select("doc_id", (text_bytes() + 1).alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"))
    tie = F.xxhash64(F.lit(17), "doc_id", "text_crc32")
    state = cut(ranked(base.withColumn("one", F.lit(1)), ["one"], [tie, F.col("doc_id"), F.col("size")]).select("doc_id", "size", "text_crc32", (F.col("rank") % shards).cast("int").alias("shard")))
    links = cut((links if links is not None else copies(docs.select("doc_id", text.alias("text")))).where("doc_id is not null and hub is not null").select("doc_id", "hub").distinct())
    n, m = state.count(), links.count()
    if m:
        several = m > links.select("doc_id").distinct().count()
        lead = labelled(links, n // shards) if several else links
        state = cut(propagated(state, lead, shards, n))
        members, kept = cut_links(state, links).first()
        turn = idle = 0
        while several and kept < members and idle < 2:
            new = exchanged(state, links, m, turn)
            now = cut_links(new, links).first()["kept_together"]
            idle = 0 if now - kept > members * MENDED else idle + 1
            if now > kept:
                state, kept = new, now
            turn += 1
    out = ranked(state, ["shard"], [tie, F.col("doc_id"), F.col("size")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_links(assigned: DataFrame, links: DataFrame) -> DataFrame:
    """One row: members (of hubs), kept_together (the members that are on their hub's fullest shard)."""
    n = links.join(assigned.select("doc_id", "shard").distinct(), "doc_id").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("hub").agg(F.sum("n").alias("n"), F.max("n").alias("most")).agg(F.sum("n").alias("members"), F.sum("most").alias("kept_together"))
