"""Near-duplicate detection by a signature-coordinate inverted join.

1. Each text's set of 5-word shingles gives a MinHash signature of ``K`` coordinates. Texts of equal sets form a class; from
   here on a class is one node, named by its smallest doc_id, so copies are never expanded into pairs.
2. Each coordinate-value of a node is a posting. Two sets of Jaccard similarity 0.75 agree on K * 0.75 coordinates on average
   and on fewer than ``MATCH`` of them once in about 50,000 such pairs. So only a prefix of each node's postings is merged: its
   K - MATCH + 1 rarest by the global order (frequency, value); two nodes with MATCH postings in common share one of these. Values
   that occur once meet nobody and are skipped before any list is merged.
3. Lists are merged in rounds over components. A star round joins the nodes outside a list's largest component with one member
   of that component and counts the collisions of each pair; those with most collisions are confirmed. The member changes from
   round to round, so that nearly all of a group of near copies soon is one component. Rounds end when few of their pairs are linked.
4. What still stands in a list with another component is searched for by ``overlap.t_occurrence`` over the rarest shingles of the full sets. A pair
   becomes a candidate only if it shares as many of these as linked sets must, so that copies of a template that share one change out of many
   don't; candidates are compared best first, and never within a component. Among these nodes no link is lost. On pages of one template (ten slots of
   eight phrases) the full comparisons grow with the rows.
5. Links of the star rounds agree on at least MATCH coordinates; all links are confirmed on the full shingle sets of both texts, and make
   connected components by min-label propagation with pointer jumping.

Defined cases: texts without words (null, empty, white space) have an empty set and are linked with nothing; fewer than five
words are one shingle. Rows that share a doc_id with different texts are judged text by text: each text has the component of its own
class, whose id is the smallest doc_id in it. Rows without doc_id get no component and are kept; an empty table gives no rows; extra
columns are not read by ``near_groups`` and passed through by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import WordHashes, broadcast_if_small, cut, drop, global_rank, table
from .overlap import MIX, TURNS, atoms, confirmed, rare_shingles, settle, shingles, split_lists, star_rounds, t_occurrence

K, MATCH, SHINGLE, SHARE = 96, 55, 5, 75
FACTORS = (np.random.default_rng(5).integers(0, 1 << 63, K, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
STEP = np.arange(K, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("th", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("sig", T.ArrayType(T.LongType()))])


def signature(hashes: np.ndarray, rows: int = 2048) -> np.ndarray:
    least = np.full(K, np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for a in range(0, len(hashes), rows):
            np.minimum(least, (hashes[a : a + rows, None] * FACTORS).min(axis=0), out=least)
        return (least * MIX + STEP).view(np.int64)  # differs between coordinates, so a value names its coordinate


def text_hash(text: Column) -> Column:
    """Tells the texts of rows that share a doc_id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            n, key, sig = [], [], []
            for text in batch.column("text").to_pylist():
                got = shingles(text or "", hashes, SHINGLE)
                n.append(len(got))
                key.append(xxhash.xxh3_128_digest(got.tobytes()) if len(got) else None)
                sig.append(signature(got) if len(got) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, type=pa.int64()), pa.array(key, type=pa.binary()), pa.array(sig, type=pa.list_(pa.int64()))], names=SIGNED.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash(F.col("text")).alias("th")).mapInArrow(run, SIGNED)


def _confirm(pairs: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree on MATCH coordinates and then on their full sets."""
    left, right = (sigs.select(F.col("node").alias(c), F.col("short").alias(f"sig_{c}")) for c in ("a", "b"))
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = cut(pairs.join(left, "a").join(right, "b").where(agree >= MATCH).select("a", "b"), "near-pairs")
    out = confirmed(near, texts, SHINGLE, SHARE)
    drop(near)
    return out


def _classes(rows: DataFrame) -> DataFrame:
    """key, doc_id, th, node: each class of equal sets with its smallest (doc_id, th). The node is that doc_id; where rows that repeat
    a doc_id with other texts make several classes of it, the others get names beyond the largest doc_id."""
    named = rows.where("doc_id is not null and n > 0").groupBy("key").agg(F.min(F.struct("doc_id", "th")).alias("_first")).select("key", "_first.*")
    named = cut(named, "classes")
    firsts = named.groupBy("doc_id").agg(F.min(F.struct("th", "key")).alias("_own"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id", F.col("_own.key").alias("_own"))
    firsts = cut(firsts, "shared-ids")
    if not firsts.limit(1).count():
        drop(firsts)
        return named.withColumn("node", F.col("doc_id"))
    others = named.join(firsts, "doc_id").where("key <> _own").select("key", F.xxhash64("key").alias("_h"))
    top = named.agg(F.max("doc_id").alias("_top"))
    other = global_rank(others, "_h", ["key"], "_rank").select("key", "_rank")
    other = other.join(F.broadcast(top)).select("key", (F.col("_top") + 1 + F.col("_rank")).alias("_node"))
    return cut(named.join(other, "key", "left").select("key", "doc_id", "th", F.coalesce("_node", "doc_id").alias("node")), "classes")


def row_groups(docs: DataFrame) -> DataFrame:
    """doc_id, th, n, group, component_id for every row of docs: group names the component of the row's text, component_id is the
    smallest doc_id in it; both are null for rows without doc_id or without words."""
    rows = cut(signatures(docs), "signatures")
    classes = _classes(rows)
    reps = classes.select("doc_id", "th", "node")
    sigs = rows.where("n > 0").select("doc_id", "th", "sig").dropDuplicates(["doc_id", "th"]).join(reps, ["doc_id", "th"]).select("node", "sig")
    sigs = cut(sigs, "class-signatures")
    postings = sigs.select("node", F.explode("sig").alias("value"))
    often = cut(postings.groupBy("value").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1"), "frequencies")
    by_node = W.partitionBy("node")
    rarest = F.row_number().over(by_node.orderBy("freq", "value")) + K - F.count(F.lit(1)).over(by_node)
    prefix = cut(postings.join(often, "value").withColumn("_place", rarest).where(F.col("_place") <= K - MATCH + 1).select("node", "value"), "prefixes")
    drop(often)
    ids = cut(prefix.select("node").distinct(), "candidates")
    short = cut(sigs.join(ids, "node", "left_semi").select("node", F.transform("sig", lambda x: F.shiftright(x, 32).cast("int")).alias("short")), "short-signatures")
    drop(sigs)
    wanted = broadcast_if_small(cut(reps.join(ids, "node", "left_semi"), "wanted"), 200_000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash(F.col("text")).alias("th"))
    texts = cut(texts.join(wanted, ["doc_id", "th"]).select("node", "text").dropDuplicates(["node"]), "texts")
    comps = star_rounds(prefix.withColumn("weight", F.lit(1)), lambda p: _confirm(p, short, texts))
    split = split_lists(prefix, comps, len(TURNS))
    lists = atoms(rare_shingles(texts.join(split.select("node").distinct(), "node", "left_semi"), SHINGLE, SHARE))
    drop(split, prefix)
    pairs = t_occurrence(lists, comps, SHARE)
    comps = settle(pairs, lambda p: confirmed(p, texts, SHINGLE, SHARE), comps)
    drop(lists, short, texts, pairs)
    tree = cut(classes.join(comps, "node", "left").select("key", "doc_id", F.coalesce("comp", "node").alias("group")), "class-components")
    least = tree.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    tree = tree.select("key", "group").join(least, "group")
    known = F.col("doc_id").isNotNull() & F.col("key").isNotNull()
    out = rows.where(known).select("doc_id", "th", "n", "key").join(tree, "key").select("doc_id", "th", "n", "group", "component_id")
    return out.unionByName(rows.where(~known).select("doc_id", "th", "n", F.lit(None).cast("long").alias("group"), F.lit(None).cast("long").alias("component_id")))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    component = F.coalesce("component_id", "doc_id")
    return row_groups(docs).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of near duplicates one row, that of the smallest (doc_id, text
    hash), and of rows equal in both the one whose other columns have the smallest hash; rows without words or without doc_id all stay."""
    texts = cut(row_groups(docs).where("group is not null").groupBy("group", "doc_id", "th").agg(F.count(F.lit(1)).alias("_times")), "grouped-texts")
    first = texts.groupBy("group").agg(F.min(F.struct("doc_id", "th")).alias("_first"))
    marked = texts.join(first, "group").withColumn("_stays", F.struct("doc_id", "th") == F.col("_first"))
    gone = cut(marked.where("not _stays").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")), "dropped")
    again = cut(marked.where("_stays and _times > 1").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")), "repeated")
    rows = docs.select(F.struct(*docs.columns).alias("_doc")).select("_doc", F.col("_doc.doc_id").cast("long").alias("_id"), text_hash(F.col("_doc.text")).alias("_th"))
    same = (F.col("_id") == F.col("_d")) & (F.col("_th") == F.col("_t"))
    out = rows.join(gone, same, "left_anti")
    if again.limit(1).count():
        each = out.join(again, same, "left_semi")
        one = each.withColumn("_row", F.row_number().over(W.partitionBy("_id", "_th").orderBy(F.xxhash64("_doc")))).where("_row = 1").drop("_row")
        out = out.join(again, same, "left_anti").unionByName(one)
    return out.select("_doc.*")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), '|')) AS k FROM s),
c AS (SELECT k, min(doc_id) AS node, any_value(n) AS n FROM n WHERE n > 0 GROUP BY k),
p AS (SELECT c.node, c.n, unnest(s.sh) AS g FROM c JOIN s ON s.doc_id = c.node),
r AS (SELECT node, n, g FROM p WHERE g IN (SELECT g FROM p GROUP BY g HAVING count(*) > 1)),
l AS (
  SELECT a.node AS a, b.node AS b FROM r a JOIN r b ON a.g = b.g AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
t AS (SELECT node, node AS top FROM c UNION SELECT l.b, t.top FROM t JOIN l ON l.a = t.node WHERE t.top < l.b),
m AS (SELECT node, min(top) AS comp FROM t GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.comp, n.doc_id) AS component_id, n.doc_id = coalesce(m.comp, n.doc_id) AS kept
FROM n LEFT JOIN c ON n.k = c.k AND n.n > 0 LEFT JOIN m ON m.node = c.node
"""
