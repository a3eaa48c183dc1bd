"""T-occurrence search over inverted lists of shingles, shared by the operators that link documents of similar shingle sets.

Two sets of n and m shingles are linked when 100 * shared >= share * united, that is when they share at least
``T = ceil(share * (n + m) / (100 + share))``. Each set is cut at one place of a global order of shingles; the part before the cut stands in the
lists, the ``tail`` is the number of shingles behind it. Two linked sets share at least T - max(tail, tail') shingles before
their cuts, since at most that many of the shared ones can stand behind the earlier of both cuts. So counting in the lists loses no link.

* ``atoms``: lists of the same members are one list with a weight, as a changed word changes several neighbouring shingles at once.
* ``star_rounds``: before any two members of a list meet, all meet its most central one, which stands in the most and longest lists: of copies with
  changes it is the one with the fewest, that most others are linked with. Then members outside a list's largest component meet one member of it; rounds
  go on as long as they link anything. A group of near copies so becomes one component at a cost that grows with its rows.
* ``t_occurrence`` (DivideSkip): what still stands in a list with another component asks its lists for partners in components of higher rank. Its
  longest lists are set aside as far as the required count allows; the short ones are merged on a heap which skips forward to the next
  id that can still reach the count; for what is left over the long lists are probed by binary search.
* ``settle``: candidates are confirmed on full sets, the best of each node first, so that a pair within a component is never compared.

Nothing here is capped: every list, partner and candidate is followed to the end.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WordHashes, broadcast_if_small, cut, drop

MIX = np.uint64(0x9E3779B97F4A7C15)
TURNS = ((False, 2), (False, 2), (True, 4), (True, 6))  # star rounds: whether each list has a centre of its own, and pairs tried for each node
CHUNK, LONG = 4096, 256  # members of a list that one merge holds; lists shorter than LONG are always merged


def shingles(text: str, hashes: WordHashes, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    width = min(width, n)
    with np.errstate(over="ignore"):
        h = ids[: n - width + 1] + np.uint64(width)
        for j in range(1, width):
            h = h * MIX + ids[j : n - width + 1 + j]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def needed(n: Column, m: Column, share: int) -> Column:
    """What two linked sets of n and m shingles share at least."""
    return F.ceil(share * (n + m) / (100 + share))


def least_partner(n: Column, share: int) -> Column:
    """The size of the smallest set that a set of n shingles can be linked with."""
    return F.ceil(share * n / 100)


def similar(pairs: DataFrame, width: int, share: int) -> DataFrame:
    """a, b of the rows (a, b, text_a, text_b) whose full sets have 100 * intersection >= share * union."""

    def run(batches):
        hashes = WordHashes()
        last, held = None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            keep = []
            for i in range(len(a)):
                if last != a[i]:
                    last, held = a[i], shingles(ta[i] or "", hashes, width)
                other = shingles(tb[i] or "", hashes, width)
                both = np.sort(np.concatenate([held, other]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= share * (len(both) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], type=pa.int64()), pa.array([b[i] for i in keep], type=pa.int64())], names=["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, share: int) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text) are linked."""
    ta, tb = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    return cut(similar(pairs.select("a", "b").join(tb, "b").join(ta, "a"), width, share), "links")


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of the links (a, b)."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("_near"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("_was"), F.least("comp", "_near").alias("_least"))
        # pointer jumping: a label is a node, whose own label is at most as large
        jump = labels.select(F.col("node").alias("_to"), F.col("comp").alias("_then"))
        new = cut(least.join(jump, least["_least"] == jump["_to"]).select("node", "_was", F.least("_least", "_then").alias("comp")), "labels")
        changed = new.where("comp <> _was").limit(1).count()
        drop(labels)
        labels = new
        if not changed:
            drop(both)
            return labels.select("node", "comp")


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, comp) with new links (a, b): only the components that these join are walked again."""
    ends = [comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")) for c in "ab"]
    met = cut(links.join(ends[0], "a", "left").join(ends[1], "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "met")
    top = components(met.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()).select(F.col("node").alias("_c"), F.col("comp").alias("_top"))
    own = met.select(F.col("a").alias("node"), F.col("ca").alias("comp")).union(met.select("b", "cb")).union(comps.select("node", "comp")).distinct()
    out = cut(own.join(top, own["comp"] == top["_c"], "left").select("node", F.coalesce("_top", "comp").alias("comp")), "components")
    drop(met)
    return out


def split_lists(prefix: DataFrame, comps: DataFrame, turn: int) -> DataFrame:
    """The postings of lists that still hold more than one component, with the list's largest component (of equal ones the one
    that a hash favours in this turn, the same in all lists)."""
    placed = cut(prefix.join(comps, "node", "left").select(*prefix.columns, F.coalesce("comp", "node").alias("comp")), "placed")
    per_comp = placed.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("_m"))
    main = per_comp.groupBy("value").agg(F.max(F.struct("_m", F.xxhash64(F.lit(turn), "comp").alias("_h"), "comp")).alias("_main"), F.count(F.lit(1)).alias("_comps"))
    main = cut(main.where("_comps > 1").select("value", F.col("_main.comp").alias("_main")), "main")
    out = cut(placed.join(main, "value"), "split")
    drop(placed, main)
    return out


def _star(split: DataFrame, turn: int, by_value: bool, most: int) -> DataFrame:
    """Pairs (a, b) of nodes outside their list's largest component with one member of it, at most ``most`` for each node, those of
    most collisions first. The member is the one that a hash favours, in this turn or (by_value) in this turn and list."""
    favour = F.xxhash64(F.lit(turn), "node", "value") if by_value else F.xxhash64(F.lit(turn), "node")
    centres = split.where("comp = _main").groupBy("value").agg(F.min_by("node", F.struct(favour, F.col("node"))).alias("centre"))
    asks = split.where("comp <> _main").select("value", "node", "weight").join(cut(centres, "centres"), "value")
    met = asks.groupBy("node", "centre").agg(F.sum("weight").alias("_c"))
    best = met.withColumn("_row", F.row_number().over(W.partitionBy("node").orderBy(F.desc("_c"), F.xxhash64(F.lit(turn), "node", "centre")))).where(F.col("_row") <= most)
    return best.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def central_pairs(prefix: DataFrame, most: int = 2) -> DataFrame:
    """Pairs (a, b) of nodes with the most central member of their lists, at most ``most`` for each node, those of most collisions first."""
    lengths = prefix.groupBy("value").agg(F.count(F.lit(1)).alias("_length")).where("_length > 1")
    held = cut(prefix.join(lengths, "value").select("value", "node", "weight", "_length"), "held")
    central = held.groupBy("node").agg(F.sum(F.col("weight") * F.col("_length")).alias("_central"))
    placed = held.join(central, "node")
    centres = placed.groupBy("value").agg(F.max(F.struct("_central", "node")).alias("_top")).select("value", F.col("_top.node").alias("centre"))
    met = held.join(cut(centres, "centres"), "value").where("node <> centre").groupBy("node", "centre").agg(F.sum("weight").alias("_c"))
    best = met.withColumn("_row", F.row_number().over(W.partitionBy("node").orderBy(F.desc("_c"), "centre"))).where(F.col("_row") <= most)
    out = cut(best.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "central-pairs")
    drop(held)
    return out


def star_rounds(prefix: DataFrame, confirm) -> DataFrame:
    """Components (node, comp) after the star rounds over prefix (value, node, weight); confirm gives the linked ones of pairs. A round of which
    fewer than a quarter of the pairs are linked is the last: the search for all pairs does the rest at less cost."""
    comps = prefix.sparkSession.createDataFrame([], "node long, comp long")
    pairs = central_pairs(prefix)
    new = confirm(pairs)
    asked, found = pairs.count(), new.count()
    drop(pairs)
    if found:
        comps = joined(comps, new)
    if 4 * found < asked or not asked:
        return comps
    for turn, (by_value, most) in enumerate(TURNS):
        split = split_lists(prefix, comps, turn)
        pairs = cut(_star(split, turn, by_value, most), "star-pairs")
        new = confirm(pairs)
        asked, found = pairs.count(), new.count()
        drop(split, pairs)
        if found:
            comps = joined(comps, new)
        if 4 * found < asked or not asked:
            break
    return comps


def rare_shingles(texts: DataFrame, width: int, share: int, whole: bool = False) -> DataFrame:
    """value, node, n, tail: each set's shingles before its cut, rarest first, that stand in another of these sets too. The cut lies at least
    behind the n - T + 1 rarest, T being what the smallest partner that the lists offer must share; it moves on over shingles up to twice as
    frequent as the last of these, so that one shared change out of many makes no candidate; with ``whole`` it lies behind the last shingle, so that only pairs that share
    enough of their full sets become candidates. Sets whose first n - T + 1 are theirs alone have no partner."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = shingles(text or "", hashes, width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), node)), pa.array(np.full(len(got), len(got))), pa.array(got.view(np.int64))], names=["node", "n", "value"])

    each = cut(texts.select("node", "text").mapInArrow(run, "node long, n long, value long"), "open-shingles")
    often = cut(each.groupBy("value").agg(F.count(F.lit(1)).alias("freq"), F.min("n").alias("least")).where("freq > 1"), "shared-shingles")
    by_node = W.partitionBy("node")
    n = F.col("n")
    placed = each.join(often, "value").withColumn("_place", F.row_number().over(by_node.orderBy("freq", "value")) + n - F.count(F.lit(1)).over(by_node))
    shared = needed(n, F.greatest(least_partner(n, share), F.min("least").over(by_node)), share)
    placed = placed.withColumn("_share", shared).withColumn("_must", n - F.col("_share") + 1)
    placed = placed.withColumn("_last", F.max(F.when(F.col("_place") == F.col("_must"), F.col("freq"))).over(by_node))
    kept = placed.where("_last is not null" if whole else "_last is not null and (_place <= _must or (freq <= 2 * _last and _place <= _must + _share / 4))")
    out = cut(kept.select("value", "node", "n", (n - F.max("_place").over(by_node)).alias("tail")), "rare-shingles")
    drop(each, often)
    return out


def atoms(postings: DataFrame) -> DataFrame:
    """postings (value, node, ...) of one value for each set of values whose lists have the same members, with weight, the number of these
    values, and length, the number of members; values of one member are left out."""
    each = F.xxhash64("node"), F.xxhash64(F.lit(1), "node")
    lists = postings.groupBy("value").agg(F.count(F.lit(1)).alias("length"), *(F.bit_xor(h).alias(f"_x{k}") for k, h in enumerate(each))).where("length > 1")
    first = lists.groupBy("length", "_x0", "_x1").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("weight")).select("value", "weight", "length")
    return cut(postings.join(broadcast_if_small(cut(first, "lists"), 500_000), "value"), "postings")


def merge_skip(lists: list[tuple[list[int], int]], want: int) -> list[tuple[int, int]]:
    """(id, count) of the ids whose lists weigh at least ``want`` together, from (ascending ids, weight) lists."""
    if want <= min(w for _, w in lists):  # every id counts: no list can be skipped
        return [(x, c) for x, c in _totals(lists) if c >= want]
    heap = [(ids[0], k) for k, (ids, _) in enumerate(lists) if ids]
    heapq.heapify(heap)
    at, out = [0] * len(lists), []
    while heap:
        x, popped, count = heap[0][0], [], 0
        while heap and heap[0][0] == x:
            k = heapq.heappop(heap)[1]
            popped.append(k)
            count += lists[k][1]
        if count >= want:
            out.append((x, count))
        else:  # lists too light together to make a result of any id before the heap's next head
            while heap and count + lists[heap[0][1]][1] < want:
                k = heapq.heappop(heap)[1]
                popped.append(k)
                count += lists[k][1]
        if not heap and count < want:
            break
        ahead = x + 1 if count >= want else max(x + 1, heap[0][0])
        for k in popped:
            at[k] = bisect_left(lists[k][0], ahead, at[k])
            if at[k] < len(lists[k][0]):
                heapq.heappush(heap, (lists[k][0][at[k]], k))
    return out


def _totals(lists: list[tuple[list[int], int]]):
    ids = np.concatenate([np.asarray(i, dtype=np.int64) for i, _ in lists])
    seen, where = np.unique(ids, return_inverse=True)
    return zip(seen.tolist(), np.bincount(where, np.repeat([w for _, w in lists], [len(i) for i, _ in lists])).astype(int).tolist(), strict=True)


def t_occurrence(postings: DataFrame, comps: DataFrame, share: int) -> DataFrame:
    """a, b, over: all pairs of nodes of different components that share enough in the lists to be linked; over is by how much. postings
    (value, node, n, tail, weight, length) as made by ``atoms``."""
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("_size"))
    known = postings.join(comps.join(sizes, "comp"), "node", "left")
    placed = known.select(*postings.columns, F.coalesce("comp", "node").alias("comp"), F.coalesce("_size", F.lit(1)).alias("size"))
    rank = F.struct("size", "comp")
    ends = placed.groupBy("value").agg(F.max(rank).alias("_main"), F.min(rank).alias("_least"), F.max("tail").alias("_tail"), F.min("n").alias("_small")).where("_main <> _least").select("value", "_main", "_tail", "_small")
    placed = cut(placed.join(ends, "value"), "placed")
    most = placed.agg(F.max("length")).first()[0] or 0
    chunk = F.pmod(F.xxhash64("node"), F.lit(-(-most // CHUNK) or 1))
    member = F.struct("node", "n", "tail", "size", "comp")
    # sizes fall into classes so wide that the partners of a set lie in its own class and the two beside it
    size_class = F.floor(F.log(F.col("n").cast("double")) / (1.001 * math.log(100 / share))).cast("int")
    lists = placed.groupBy("value", size_class.alias("class"), chunk.alias("chunk")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    by_node = W.partitionBy("node")
    small = F.greatest(least_partner(F.col("n"), share), F.min("_small").over(by_node))  # no partner is smaller
    least = needed(F.col("n"), small, share) - F.greatest("tail", F.max("_tail").over(by_node))
    asks = placed.where(rank != F.col("_main")).withColumn("_least", least)
    aside = F.sum(F.when(F.col("length") >= LONG, F.col("weight")).otherwise(0)).over(by_node.orderBy(F.desc("length"), "value"))
    asks = asks.withColumn("_aside", aside).withColumn("long", (F.col("length") >= LONG) & (F.col("_aside") < F.col("_least")))
    asks = cut(asks.withColumn("put_by", F.max(F.when(F.col("long"), F.col("_aside")).otherwise(0)).over(by_node)), "asks")
    short = asks.where("not long").select("value", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("tail").alias("tx"), F.col("size").alias("sx"), F.col("comp").alias("cx"), "put_by", "weight", F.explode(F.sequence(size_class - 1, size_class + 1)).alias("class"))

    # members that cannot answer stay behind before anything is shuffled: of lower rank, or of a size that rules a link out
    fits = f"(m.size > sx or m.size = sx and m.comp > cx) and 100 * m.n >= {share} * nx and {share} * m.n <= 100 * nx"
    able = F.expr(f"filter(members, m -> {fits})")
    want = f"cast(ceil({share} * (nx + m.n) / {100 + share}) - greatest(tx, m.tail) - put_by as int)"  # of the short lists, if all long ones had it
    met = short.join(lists, ["value", "class"]).withColumn("_able", able)  # used in one projection only, so that it is computed once
    met = met.select("x", "chunk", "weight", F.expr("transform(_able, m -> m.node)").alias("ids"), F.expr(f"transform(_able, m -> {want})").alias("wants"))

    def run(batches):
        now, lists_, wants, out = None, [], {}, []

        def merge():
            least = max(1, min(wants.values()))
            return [(now[0], y, c) for y, c in merge_skip(lists_, least) if c >= wants[y]]

        for batch in batches:
            for x, chunk_, weight, ids, wants_ in zip(*(batch.column(c).to_pylist() for c in ("x", "chunk", "weight", "ids", "wants")), strict=True):
                if now != (x, chunk_):
                    if lists_:
                        out += merge()
                    now, lists_, wants = (x, chunk_), [], {}
                if not ids:
                    continue
                lists_.append((ids, weight))
                wants.update(zip(ids, wants_, strict=True))
            if len(out) > 10_000:
                yield found_batch(out)
                out = []
        if lists_:
            out += merge()
        if out:
            yield found_batch(out)

    def found_batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], schema=found_schema)

    found_schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("c", pa.int64())])
    met = met.repartition("x", "chunk").sortWithinPartitions("x", "chunk")
    found = cut(met.mapInArrow(run, "x long, y long, c long"), "found")
    own = placed.groupBy("node").agg(F.first("n").alias("n"), F.first("tail").alias("tail"), F.sort_array(F.collect_list("value")).alias("lists"))
    long = asks.where("long").groupBy(F.col("node").alias("x")).agg(F.collect_list(F.struct("value", "weight")).alias("long"))
    own = cut(own.join(long, own["node"] == long["x"], "left").drop("x"), "own-lists")
    left = own.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("tail").alias("tx"), "long")
    right = own.select(F.col("node").alias("y"), "n", "tail", "lists")
    rest = needed(F.col("nx"), F.col("n"), share) - F.greatest("tx", "tail") - F.col("c")

    def probe(batches):
        for batch in batches:
            a, b, rest_ = (batch.column(c).to_pylist() for c in ("x", "y", "rest"))
            out = []
            for i, (long_, lists__) in enumerate(zip(batch.column("long").to_pylist(), batch.column("lists").to_pylist(), strict=True)):
                hit = 0
                for w in long_ or ():
                    k = bisect_left(lists__, w["value"])
                    hit += w["weight"] if k < len(lists__) and lists__[k] == w["value"] else 0
                if hit >= rest_[i]:
                    out.append({"a": min(a[i], b[i]), "b": max(a[i], b[i]), "over": hit - rest_[i]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("over", pa.int64())]))

    reach = F.coalesce(F.aggregate("long", F.lit(0).cast("long"), lambda s, w: s + w["weight"]), F.lit(0))
    pairs = found.join(left, "x").join(right, "y").withColumn("rest", rest.cast("long")).where(F.col("rest") <= reach)
    out = cut(pairs.select("x", "y", "rest", "long", "lists").mapInArrow(probe, "a long, b long, over long"), "candidates")
    drop(placed, asks, found, own)
    return out


def settle(pairs: DataFrame, confirm, comps: DataFrame) -> DataFrame:
    """Components after the candidates (a, b, over): first each node's best one, then its best four, then all that still lie
    between two components."""
    for most in (1, 4, None):
        if not pairs.limit(1).count():
            break
        each = pairs
        if most:
            place = lambda c: F.row_number().over(W.partitionBy(c).orderBy(F.desc("over"), "a", "b"))
            each = cut(pairs.withColumn("_a", place("a")).withColumn("_b", place("b")).where((F.col("_a") <= most) | (F.col("_b") <= most)).select("a", "b"), "tried")
        comps = joined(comps, confirm(each.select("a", "b")))
        if most:
            ca, cb = (comps.select(F.col("node").alias(c), F.col("comp").alias(f"_c{c}")) for c in ("a", "b"))
            apart = pairs.join(each, ["a", "b"], "left_anti").join(ca, "a", "left").join(cb, "b", "left")
            pairs = cut(apart.where(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b", "over"), "candidates")
    return comps
