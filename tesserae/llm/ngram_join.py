"""N-gram Jaccard join by T-occurrence search with DivideSkip.

1. Each text's set of 4-word shingles is hashed. The hashes' range is cut into K equal parts, and what a set holds in a part is one
   signature. Two linked sets differ in at most d shingles (see ``levels``), so of the parts at least K - d hold the same in both. K belongs to a
   level, that is a range of sizes; a set has signatures for each level that the larger set of a linked pair can be in. A signature covers
   about five shingles, so sets that share a few shingles by chance have none in common, however many sets there are. Texts of equal
   sets are one node, so copies are never expanded into pairs.
2. Inverted lists are made of the signatures. A node that doesn't hold K - d signatures that others hold, too, can have no partner. Parts that are
   empty in both sets count as equal but have no signature; a set with K - d of them (rare, small) is searched for in step 4 anyway.
3. Star rounds turn groups of near copies into components, at a cost that grows with their rows.
4. What still shares enough signatures with other components is searched for by DivideSkip, over lists of the shingles of the full sets: long lists
   set aside, short lists merged on a heap with skips, long lists probed by binary search for the ids left over. As the lists hold whole sets, copies of
   one text that differ in too much are no candidates, however many there are.
5. All pairs of different components that come out of this are confirmed on the full sets of both texts.

Only hashes of 64 bits stand for shingles; no link is lost, and links are exact but for two shingles of one hash.

Defined cases: texts without words (null, empty, white space) have an empty set, are linked with nothing and have their own doc_id as
component; fewer than four words are one shingle. Rows that share a doc_id with different texts are judged text by text: each
has the component of its own text, whose id is the smallest doc_id in it. Rows without doc_id are linked with nothing and have no component. Very
long texts are hashed whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import WordHashes, broadcast_if_small, cut, drop, table
from .near_dedup import text_hash
from .overlap import MIX, TURNS, atoms, confirmed, rare_shingles, settle, shingles, split_lists, star_rounds, t_occurrence

WIDTH, SHARE = 4, 85
SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("th", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("need", T.LongType()), T.StructField("signs", T.ArrayType(T.LongType()))])


@lru_cache(1 << 16)
def levels(n: int, share: int) -> tuple[tuple[int, int, int], ...]:
    """(level, K, K - d) of the levels in which a set of n shingles can meet a linked one that differs from it. Linked sets of n and m shingles differ in
    at most (100 - share) * (n + m) / (100 + share), which is greatest for two of the level's largest size; where that is below 1 none differ."""
    out, low, level = [], 1, 0
    while low <= 100 * n // share:
        high = max(low + 1, low * 8 // 5)
        d = (100 - share) * 2 * (high - 1) // (100 + share)
        if n < high and d:
            out.append((level, d + 2 + d // 8, 2 + d // 8))
        low, level = high, level + 1
    return tuple(out)


@lru_cache(64)
def edges(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(parts)], dtype=np.uint64)


def signatures(got: np.ndarray, share: int) -> tuple[np.ndarray, int]:
    """The signatures of a set's sorted hashes in all its levels, and how many of them a linked set has at least."""
    out, need = [np.zeros(0, dtype=np.uint64)], None
    for level, parts, equal in levels(len(got), share):
        begin = np.append(np.searchsorted(got, edges(parts)), len(got))
        full = np.flatnonzero(begin[1:] > begin[:-1])
        with np.errstate(over="ignore"):
            h = np.add.reduceat(got, begin[full]) + (full + 1).astype(np.uint64) * MIX + np.uint64(level << 32)
            h ^= h >> np.uint64(31)
            out.append(h * MIX)
        least = equal - (parts - len(full))
        need = least if need is None else min(need, least)
    return np.unique(np.concatenate(out)), 1 if need is None else need


def sets(docs: DataFrame, width: int, share: int) -> DataFrame:
    """doc_id, th, n, key (a hash of the whole set), need and signs of every row; key and signs are null for a text without words."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            n, key, need, signs = [], [], [], []
            for text in batch.column("text").to_pylist():
                got = shingles(text or "", hashes, width)
                n.append(len(got))
                key.append(xxhash.xxh3_128_digest(got.tobytes()) if len(got) else None)
                of, least = signatures(got, share)
                need.append(least)
                signs.append(of.view("int64") if len(got) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, type=pa.int64()), pa.array(key, type=pa.binary()), pa.array(need, type=pa.int64()), pa.array(signs, type=pa.list_(pa.int64()))], names=SETS.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash(F.col("text")).alias("th")).mapInArrow(run, SETS)


def join_groups(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs."""
    rows = cut(sets(docs, width, share).withColumn("node", F.monotonically_increasing_id()), "sets")
    known = rows.where("key is not null and doc_id is not null")
    classes = cut(known.groupBy("key").agg(F.min(F.struct("doc_id", "th", "node")).alias("_first"), F.count(F.lit(1)).alias("rows")).select("key", "_first.*", "rows"), "classes")
    copies = known.select("key", "node").join(classes.where("rows > 1").select("key", F.col("node").alias("_kept")), "key").where("node <> _kept").select("node")
    copies = cut(copies, "copies")
    firsts = known.join(broadcast_if_small(copies, 1_000_000), "node", "left_anti")
    postings = firsts.select("node", F.explode("signs").alias("value"))
    shared = cut(postings.withColumn("_times", F.count(F.lit(1)).over(W.partitionBy("value"))).where("_times > 1").select("value", "node"), "shared")
    enough = shared.groupBy("node").agg(F.count(F.lit(1)).alias("_shared")).join(firsts.select("node", "need"), "node").where("_shared >= need").select("node")
    able = cut(enough.union(firsts.where("need <= 0").select("node")).distinct(), "able")
    prefix = cut(shared.join(able, "node", "left_semi").withColumn("weight", F.lit(1)), "prefixes")
    signs = cut(firsts.join(able, "node", "left_semi").select("node", "need", "signs"), "signs")
    wanted = classes.join(able, "node", "left_semi").select("doc_id", "th", "node")
    wanted = broadcast_if_small(cut(wanted, "wanted"), 200_000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash(F.col("text")).alias("th"))
    texts = cut(texts.join(wanted, ["doc_id", "th"]).select("node", "text").dropDuplicates(["node"]), "texts")
    drop(shared, able, copies)

    def confirm(pairs: DataFrame) -> DataFrame:
        """Pairs that share too few signatures don't need their texts."""
        a, b = (signs.select(*(F.col(c).alias(f"{c}_{k}") for c in ("node", "need", "signs"))) for k in "ab")
        both = pairs.join(a, F.col("a") == F.col("node_a")).join(b, F.col("b") == F.col("node_b"))
        near = cut(both.where(F.size(F.array_intersect("signs_a", "signs_b")) >= F.greatest("need_a", "need_b")).select("a", "b"), "near-pairs")
        out = confirmed(near, texts, width, share)
        drop(near)
        return out

    comps = star_rounds(prefix, confirm)
    split = split_lists(prefix, comps, len(TURNS))
    left = split.groupBy("node").agg(F.count(F.lit(1)).alias("_left"))
    left = signs.select("node", "need").join(left, "node", "left").where("need <= 0 or _left >= need").select("node")
    lists = atoms(rare_shingles(texts.join(left, "node", "left_semi"), width, share, whole=True))
    drop(split, prefix)
    pairs = t_occurrence(lists, comps, share)
    comps = settle(pairs, lambda p: confirmed(p, texts, width, share), comps)
    drop(lists, signs, texts, pairs)
    tree = classes.join(comps, "node", "left").select("key", "doc_id", F.coalesce("comp", "node").alias("group"))
    least = cut(tree.groupBy("group").agg(F.min("doc_id").alias("component_id")), "least")
    tree = cut(tree.join(least, "group").select("key", "component_id"), "class-components")
    drop(least)
    out = known.select("doc_id", "n", "key").join(tree, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("key is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_groups(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), '|')) AS k FROM s),
c AS (SELECT k, min(doc_id) AS node, any_value(n) AS n FROM n WHERE n > 0 GROUP BY k),
p AS (SELECT c.node, c.n, unnest(s.sh) AS g FROM c JOIN s ON s.doc_id = c.node),
r AS (SELECT node, n, g FROM p WHERE g IN (SELECT g FROM p GROUP BY g HAVING count(*) > 1)),
l AS (
  SELECT a.node AS a, b.node AS b FROM r a JOIN r b ON a.g = b.g AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
t AS (SELECT node, node AS top FROM c UNION SELECT l.b, t.top FROM t JOIN l ON l.a = t.node WHERE t.top < l.b),
m AS (SELECT node, min(top) AS comp FROM t GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.comp, n.doc_id) AS component_id
FROM n LEFT JOIN c ON n.k = c.k AND n.n > 0 LEFT JOIN m ON m.node = c.node
"""
