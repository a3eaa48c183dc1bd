"""Sharding by balanced label propagation (native: DataFrame functions only).

Documents of equal text are linked. Labels (shards) start as an exactly even deal by a hash of doc_id; then, in each
round, a join with the label counts of its group tells every linked document the shard where most of its neighbours
are, and it moves there if the quota of that pair of shards allows: what the two shards exchange, plus the
target's free room. Rounds go on until nothing moves or the groups are in no fewer pieces than before; then the groups
that are still cut are lifted out and go whole into the rooms that this leaves, largest first (the largest ``LIFTED`` of them; any
more fill free places side by side, where a group may lie across two shards). Documents without links have
no edge to cut and fill the places that are left, so that the law ``rows`` (counts at most one apart) holds exactly.

Groups of more than an eighth of a shard (at most 8 * shards of them, or all groups where a shard has under 8 rows) start whole,
largest first in the fullest shard with room, since later no shard would have room for them. Only a group larger than a shard is split,
into blocks of exactly a shard's rows and one of the rest: no two of these could share a shard, so every link that can be
kept is kept. A group that fits nowhere takes part in the rounds, and if it is cut after them, fills free places side by side.

A group never becomes pairs: its links are kept as counts per (group, shard), summed map-side first. ``kept_whole``
reports how many groups are in one shard.

Defined cases: a null text is linked with the empty texts; rows that repeat a doc_id or have none are rows like any other; a very long
text is hashed and measured whole and not moved; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, drop, global_rank, high_bits, table

PARTS = 8  # bits of the hash that number the rows of a group larger than a shard
LIFTED = 100_000  # groups that the driver places at once after the rounds


def _propagate(state: DataFrame, quota_base: list[int], shards: int) -> tuple[DataFrame, int]:
    """One round over the linked rows: (doc_id, ..., _group, shard) with new shards, and how many moved."""
    counts = state.groupBy("_group", "shard").agg(F.count(F.lit(1)).alias("_n"))
    held = {r[0]: r[1] for r in counts.groupBy("shard").agg(F.sum("_n")).collect()}  # one number for each shard
    rooms = F.array(*(F.lit(max(0, quota_base[s] - held.get(s, 0))).cast("long") for s in range(shards)))
    # a shard that can take the whole group goes before one that can't, then the one where most of it is
    total = F.sum("_n").over(W.partitionBy("_group"))  # at most one row for each shard
    fits = F.element_at(rooms, F.col("shard") + 1) >= total - F.col("_n")
    ranked = counts.withColumn("_fits", fits)
    best = ranked.groupBy("_group").agg(F.max(F.struct("_fits", "_n", F.xxhash64("_group", "shard").alias("_tie"), F.col("shard").alias("_to"))).alias("_best"))
    moves = counts.join(best, "_group").select("_group", "shard", F.col("_best._to").alias("_to"), (F.col("_best._n") - F.col("_n")).alias("_gain"), "_n")
    wanted = moves.where("shard <> _to").groupBy("shard", "_to").agg(F.sum("_n").alias("_want"))
    back = wanted.select(F.col("_to").alias("shard"), F.col("shard").alias("_to"), F.col("_want").alias("_back"))
    # at most shards * (shards - 1) rows from here on
    free = F.element_at(F.array(*(F.lit(x).cast("long") for x in quota_base)), F.col("_to") + 1)
    loads = state.groupBy(F.col("shard").alias("_to")).agg(F.count(F.lit(1)).alias("_load"))
    quotas = wanted.join(back, ["shard", "_to"], "left").withColumn("_swap", F.least("_want", F.coalesce("_back", F.lit(0)))).withColumn("_more", F.col("_want") - F.col("_swap"))
    quotas = quotas.join(loads, "_to", "left").withColumn("_room", F.greatest(F.lit(0), free - F.coalesce("_load", F.lit(0))))
    share = F.floor(F.col("_room") * F.col("_more") / F.greatest(F.lit(1), F.sum("_more").over(W.partitionBy("_to"))))
    quotas = cut(quotas.select("shard", "_to", (F.col("_swap") + F.least("_more", share)).alias("_quota")), "quotas")
    moved = quotas.agg(F.sum("_quota")).first()[0] or 0
    if not moved:
        drop(quotas)
        return state, 0
    # the quota is dealt to (group, shard) counts by a prefix sum; of its rows only those of a count that is met in part are numbered, one count for each pair of shards
    before = F.sum("_n").over(W.partitionBy("shard", "_to").orderBy(F.col("_gain").desc(), "_group")) - F.col("_n")
    dealt = moves.where("shard <> _to").join(F.broadcast(quotas), ["shard", "_to"]).withColumn("_may", F.least("_n", F.col("_quota") - before)).where("_may > 0")
    asked = state.join(dealt.select("_group", "shard", "_to", "_may", "_n"), ["_group", "shard"], "left")
    some = asked.where("_may < _n").withColumn("_row", F.row_number().over(W.partitionBy("_group", "shard").orderBy("_h", "doc_id")))
    some = some.withColumn("shard", F.when(F.col("_row") <= F.col("_may"), F.col("_to")).otherwise(F.col("shard")))
    rest = asked.where("_may is null or _may = _n").withColumn("shard", F.coalesce("_to", "shard"))
    new = cut(rest.select(*state.columns).unionByName(some.select(*state.columns)), "labels")
    drop(quotas)
    return new, moved


def _fill(sizes: list[tuple], rooms: list[int]) -> dict:
    """name -> shard for the (name, size) that fit whole, largest first, each in the fullest shard with room; rooms shrink."""
    out = {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        room, s = min(((r, s) for s, r in enumerate(rooms) if r >= n), default=(0, -1))
        if s >= 0:
            out[name] = s
            rooms[s] = room - n
    return out


def _deal(places: list[int], rank) -> Column:
    """The shard of a rank when shard 0 takes the first places[0] ranks, shard 1 the next places[1], and so on."""
    ends = F.array(*(F.lit(sum(places[: s + 1])).cast("long") for s in range(len(places))))
    return F.size(F.filter(ends, lambda e: e <= F.col(rank))).cast("int")


def _loads(df: DataFrame, shards: int) -> list[int]:
    held = {r[0]: r[1] for r in df.groupBy("shard").count().collect()}  # one number for each shard
    return [held.get(s, 0) for s in range(shards)]


def _blocks(linked: DataFrame, limit: int, size: int) -> DataFrame:
    """Adds _block: 0, or for groups of more than limit rows the row's number within its group over size. Rows are numbered in
    two levels, so that no task sees a whole group; there are fewer groups of that size than shards."""
    part = F.when(F.col("_members") > limit, high_bits(F.col("_h"), PARTS))
    rows = linked.withColumn("_part", part)
    large = rows.where("_part is not null")
    before = large.groupBy("_key", "_part").count()
    before = before.select("_key", "_part", (F.sum("count").over(W.partitionBy("_key").orderBy("_part")) - F.col("count")).alias("_before"))
    number = F.row_number().over(W.partitionBy("_key", "_part").orderBy("_h", "doc_id")) - 1
    numbered = large.withColumn("_row", number).join(F.broadcast(before), ["_key", "_part"])
    numbered = numbered.withColumn("_block", F.floor((F.col("_before") + F.col("_row")) / size).cast("long"))
    return rows.where("_part is null").withColumn("_block", F.lit(0).cast("long")).unionByName(numbered.drop("_row", "_before")).drop("_part")


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    base = docs.select("doc_id", text.alias("_text"))
    base = base.select("doc_id", (F.octet_length("_text") + 16).cast("long").alias("size"), F.crc32("_text").alias("text_crc32"), F.sha2("_text", 256).alias("_key"))
    base = cut(base.withColumn("_h", F.xxhash64(F.lit("deal"), "doc_id", "_key")), "sizes")
    groups = base.groupBy("_key").agg(F.count(F.lit(1)).alias("_members")).where("_members > 1")
    total = base.count()
    caps = [total // shards + (s < total % shards) for s in range(shards)]
    groups = cut(groups, "linked")  # a table of its own: the join below can split a hot group over tasks
    dealt = cut(base.join(groups, "_key", "left"), "dealt")
    narrow = ["doc_id", "size", "text_crc32", "_h"]
    quota = max(1, total // shards)
    # groups of more than an eighth of a shard, in blocks that a shard can hold
    large = [(r[0], r[1]) for r in groups.where(F.col("_members") > quota // 8).collect()]
    sizes = []
    for key, n in large:
        step = n if n <= caps[0] else quota
        sizes += [((key, k), min(step, n - k * step)) for k in range(-(-n // step))]
    rooms = list(caps)
    whole = [(key, k, s) for (key, k), s in _fill(sizes, rooms).items()]
    whole = spark.createDataFrame(whole, "_key string, _block long, shard int")
    linked = _blocks(dealt.where("_members is not null"), caps[0], quota)
    linked = cut(linked.join(F.broadcast(whole), ["_key", "_block"], "left").select(*narrow, F.xxhash64("_key", "_block").alias("_group"), "shard"), "blocks")
    settled = linked.where("shard is not null")
    # the other linked rows start as an even deal over the rooms
    rest = global_rank(linked.where("shard is null").drop("shard"), "_h", ["doc_id", "_group"], "_rank")
    n, free = linked.where("shard is null").count(), sum(rooms)
    starts = [r * n // max(1, free) for r in rooms]
    for s in sorted(range(shards), key=lambda s: starts[s] - rooms[s])[: n - sum(starts)]:
        starts[s] += 1
    state = cut(rest.select(*narrow, "_group", _deal(starts, "_rank").alias("shard")), "labels")
    pieces = None
    while n:
        new, moved = _propagate(state, rooms, shards)
        if not moved:
            break
        drop(state)
        state, was = new, pieces
        pieces = state.select("_group", "shard").distinct().count()
        if was is not None and pieces >= was:
            break
    # groups that are still cut leave their places and go whole where they fit
    spread = state.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), F.min("shard").alias("_low"), F.max("shard").alias("_high")).where("_low < _high")
    lifted = [(r[0], r[1]) for r in spread.orderBy(F.desc("_n"), "_group").limit(LIFTED).collect()]
    loads = _loads(state.join(spread.select("_group"), "_group", "left_anti"), shards)
    rooms = [r - x for r, x in zip(rooms, loads, strict=True)]
    placed = spark.createDataFrame(list(_fill(lifted, rooms).items()), "_group long, _to int")
    still = spread.select("_group", F.lit(True).alias("_cut")).join(placed, "_group", "left")
    state2 = cut(state.join(still, "_group", "left").select(*narrow, "_group", F.when(F.col("_cut").isNull(), F.col("shard")).otherwise(F.col("_to")).alias("shard")), "lifted")
    # what fits nowhere, side by side, and the rows without links fill the places that are left
    loose = state2.where("shard is null").select(*narrow, F.xxhash64("_group").alias("_fill"))
    alone = dealt.where("_members is null").select(*narrow, F.col("_h").alias("_fill")).unionByName(loose)
    alone = global_rank(alone, "_fill", ["_h", "doc_id", "text_crc32"], "_free").select(*narrow, _deal(rooms, "_free").alias("shard"))
    placed = cut(settled.select(*narrow, "shard").unionByName(state2.where("shard is not null").select(*narrow, "shard")).unionByName(alone), "placed")
    drop(state, state2, linked, dealt, base, groups)
    part = F.pmod(F.col("_h"), F.lit(64)).cast("int")
    rows = placed.withColumn("_part", part)
    before = rows.groupBy("shard", "_part").count()  # at most shards * 64 rows
    before = before.select("shard", "_part", (F.sum("count").over(W.partitionBy("shard").orderBy("_part")) - F.col("count")).alias("_before"))
    slot = F.row_number().over(W.partitionBy("shard", "_part").orderBy("_h", "doc_id")) - 1
    out = rows.withColumn("_row", slot).join(F.broadcast(before), ["shard", "_part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_before") + F.col("_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def kept_whole(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """One row: groups of equal texts, those of them that a shard could hold, and those that lie in one shard."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    keys = docs.select("doc_id", F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("_key")).groupBy("doc_id", "text_crc32", "_key").agg(F.count(F.lit(1)).alias("_n"))
    seen = placed.groupBy("doc_id", "text_crc32").agg(F.min("shard").alias("_low"), F.max("shard").alias("_high"))
    rows = keys.join(seen, keys.doc_id.eqNullSafe(seen.doc_id) & (keys.text_crc32 == seen.text_crc32))
    groups = rows.groupBy("_key").agg(F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high")).where("_n > 1")
    largest = placed.groupBy("shard").count().agg(F.max("count").alias("_cap"))
    return groups.join(F.broadcast(largest)).agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("_n") <= F.col("_cap")).alias("n_fitting"), F.count_if(F.col("_low") == F.col("_high")).alias("n_whole"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
