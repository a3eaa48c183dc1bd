"""Merkle dataset manifest: distributed reduction of large blocks, a small top tree on the driver, suffix paths broadcast.

1. Each row's digest is computed where its text is read; from then on a row is its tree (lang), its doc_id and digests of 32 bytes.
2. Rows are range-partitioned by (lang, doc_id, digest) and written sorted. The counts of the runs of a lang in each partition give every
   row its place in its lang, so no task sees a whole lang.
3. ``1 << BITS`` consecutive places of a tree are a block, one row of a table. Each block is reduced to one node; a block of a tree that goes
   on above it is reduced by exactly BITS levels, with the last node of a level hashed alone.
4. As long as more than ``TOP`` nodes are left, they are dealt into blocks and reduced again in the same way; trees of one node each become the
   leaves of the tree over the langs. The last at most TOP nodes go to the driver, which builds what is above them, and the path of each of
   them to the root is broadcast: TOP rows of at most some 60 digests. Below that, paths are joined to blocks on the way down.
5. Executors finish each leaf's proof (its siblings in the block, then the block's path) and fold the leaf, or the tampered one,
   through it.

A path is an array of strings, one a level: L or R and the sibling's digest in hex, or empty where the node is hashed alone.

Defined cases: a null column counts as ``-`` in the leaf; a null doc_id comes first in its lang and is never tampered with, as null has no
decimal; a null lang is a tree of its own, the first one; rows of equal doc_id and lang are ordered by their leaf, and equal rows take
consecutive places; empty and very long texts are hashed whole in the JVM; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, drop, table
from .conversation_repair import CRC_SQL, crc_sql

BITS, TOP = 12, 8192
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PLACED = "tree string, place long, size long, node binary"
OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof array<string>"


def leaf_of(changed: dict[str, Column]) -> Column:
    """The digest of a row as bytes, with some columns replaced."""

    def part(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, COLUMNS)).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree, node and forged: the digest after tampering where doc_id is chosen for it, else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    forged = F.when(chosen & F.col("n_chars").isNotNull(), leaf_of({"n_chars": F.col("n_chars") + 1}))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("tree"), leaf_of({}).alias("node"), forged.alias("forged"))


def places(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (a scratch table) with place (from 0 in each tree, by order) and size (of the tree). Read sorted from a range partitioning, so a
    row's place is its partition's place in the tree, from counts, and its own number in the partition."""
    laid = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    laid = cut(laid.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "laid")
    runs = cut(laid.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), "runs")
    by_tree = W.partitionBy("tree")
    runs = runs.select(F.col("tree").alias("_t"), F.col("_part").alias("_p"), "_first", (F.sum("_n").over(by_tree.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(by_tree).alias("size"))
    same = F.col("tree").eqNullSafe(F.col("_t")) & (F.col("_part") == F.col("_p"))
    return laid.join(runs, same).withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_t", "_p", "_part", "_at", "_first", "_before")


def pair(nodes: list[bytes]) -> list[bytes]:
    """The level above: every two neighbours, the last one alone if their number is odd. Digests go in as hex text."""
    return [sha256("".join(x.hex() for x in nodes[k : k + 2]).encode()).digest() for k in range(0, len(nodes), 2)]


def grow(nodes: list[bytes], levels: int | None) -> list[list[bytes]]:
    """All levels from the nodes up: ``levels`` of them, or up to one node."""
    out = [nodes]
    while (len(out[-1]) > 1) if levels is None else (len(out) <= levels):
        out.append(pair(out[-1]))
    return out


def path(tree: list[list[bytes]], k: int) -> list[str]:
    """From leaf k of a grown tree to its top."""
    out = []
    for level in tree[:-1]:
        beside = k ^ 1
        out.append(("R" if beside > k else "L") + level[beside].hex() if beside < len(level) else "")
        k >>= 1
    return out


def fold(node: str, way: list[str]) -> str:
    for step in way:
        side = step[1:]
        node = sha256((node + side if step[:1] != "L" else side + node).encode()).hexdigest()
    return node


def _levels(size: int, bits: int) -> int | None:
    return None if size <= 1 << bits else bits


def _blocks(nodes: DataFrame, bits: int, *carried: str) -> DataFrame:
    """tree, block, size and the block's rows in order, at most 1 << bits of them."""
    rows = nodes.groupBy("tree", F.shiftright("place", bits).alias("block"), "size").agg(F.sort_array(F.collect_list(F.struct("place", "node", *carried))).alias("rows"))
    return cut(rows, "blocks")


def _reduced(blocks: DataFrame, bits: int) -> DataFrame:
    """The node above each block, placed in its tree."""

    def run(batches):
        for batch in batches:
            sizes = batch.column("size").to_pylist()
            tops = [grow(nodes, _levels(size, bits))[-1][0] for nodes, size in zip(batch.column("nodes").to_pylist(), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), pa.array([-(-s >> bits) for s in sizes], type=pa.int64()), pa.array(tops, type=pa.binary())], names=["tree", "place", "size", "node"])

    return cut(blocks.select("tree", "block", "size", F.col("rows.node").alias("nodes")).mapInArrow(run, PLACED), "nodes")


def _top(nodes: DataFrame, bound: int, over_trees: bool) -> DataFrame:
    """tree, place, way, subroot and root for at most ``bound`` nodes, by the driver. over_trees: the nodes are the trees themselves."""
    got = nodes.select("tree", "place", "node").limit(bound + 1).collect()
    if len(got) > bound:
        raise ValueError("more nodes than the driver takes")
    trees: dict = {}
    for r in sorted(got, key=lambda r: (r["tree"] is not None, (r["tree"] or "").encode(), r["place"])):
        trees.setdefault(r["tree"], []).append(bytes(r["node"]))
    grown = {t: grow(n, None) for t, n in trees.items()}
    over = grow([g[-1][0] for g in grown.values()], None) if grown else [[]]
    rows = []
    for k, (tree, g) in enumerate(grown.items()):
        upper = [] if over_trees else path(over, k)
        rows += [(tree, j, path(g, j) + upper, None if over_trees else g[-1][0].hex(), over[-1][0].hex()) for j in range(len(g[0]))]
    return nodes.sparkSession.createDataFrame(rows, "tree string, place long, way array<string>, subroot string, root string")


def _above(nodes: DataFrame, bits: int, top: int, over_trees: bool = False) -> tuple[DataFrame, bool]:
    """tree, place, way, subroot and root of nodes (tree, place, size, node), and whether that is at most ``top`` rows. Over trees, there is one
    tree and its root is the root of all."""
    total, widest = nodes.agg(F.count(F.lit(1)), F.max("size")).first()
    if total <= top:
        return _top(nodes, top, over_trees), True
    if widest > 1:
        blocks = _blocks(nodes, bits)
        up, small = _above(_reduced(blocks, bits), bits, top, over_trees)

        def run(batches):
            for batch in batches:
                for tree, size, places_, nodes_, way, subroot, root in zip(*(batch.column(c).to_pylist() for c in ("tree", "size", "places", "nodes", "way", "subroot", "root")), strict=True):
                    g, n = grow(nodes_, _levels(size, bits)), len(nodes_)
                    ways = [path(g, k) + way for k in range(n)]
                    yield pa.RecordBatch.from_arrays([pa.array([tree] * n, type=pa.string()), pa.array(places_, type=pa.int64()), pa.array(ways, type=pa.list_(pa.string())), pa.array([subroot] * n, type=pa.string()), pa.array([root] * n, type=pa.string())], names=["tree", "place", "way", "subroot", "root"])

        ways = _with_ways(blocks, up, small).select("tree", "size", F.col("rows.place").alias("places"), F.col("rows.node").alias("nodes"), "way", "subroot", "root")
        return ways.mapInArrow(run, "tree string, place long, way array<string>, subroot string, root string"), False
    # more trees than the driver takes, each of one node: they become the leaves of the tree over them
    flat = cut(nodes.select(F.lit("").alias("tree"), F.col("tree").isNotNull().alias("some"), F.col("tree").alias("name"), "node"), "subroots")
    ranked = cut(places(flat, ["some", "name"]), "ranked")
    up, small = _above(ranked.select("tree", "place", "size", "node"), bits, top, over_trees=True)
    up = up.select(F.col("place").alias("_place"), "way", "root")
    joined = ranked.join(F.broadcast(up) if small else up, F.col("place") == F.col("_place"))
    return joined.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "way", F.lower(F.hex("node")).alias("subroot"), "root"), False


def _with_ways(blocks: DataFrame, up: DataFrame, small: bool) -> DataFrame:
    up = up.select(F.col("tree").alias("_t"), F.col("place").alias("_b"), "way", "subroot", "root")
    return blocks.join(F.broadcast(up) if small else up, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b"))).drop("_t", "_b")


def manifest(docs: DataFrame, bits: int = BITS, top: int = TOP, with_proof: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row of docs; proof, an array of steps, if asked for."""
    rows = cut(leaves(docs), "leaves")
    placed = places(rows, ["doc_id", "node"])
    blocks = _blocks(placed, bits, "doc_id", "forged")
    drop(rows)
    up, small = _above(_reduced(blocks, bits), bits, top)

    def run(batches):
        for batch in batches:
            for size, ids, nodes, forged, way, subroot, root in zip(*(batch.column(c).to_pylist() for c in ("size", "ids", "nodes", "forged", "way", "subroot", "root")), strict=True):
                g, n = grow(nodes, _levels(size, bits)), len(nodes)
                ways = [path(g, k) + way for k in range(n)]
                proofs = [sha256("".join(s[1:] for s in w).encode()).hexdigest() for w in ways]
                folded = [fold((f or x).hex(), w) for f, x, w in zip(forged, nodes, ways, strict=True)]
                cols = [ids, [x.hex() for x in nodes], [subroot] * n, [root] * n, proofs, folded, [f == root for f in folded], ways if with_proof else [None] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)

    types = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.string())]
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
    ways = _with_ways(blocks, up, small).select("size", *(F.col(f"rows.{c}").alias(a) for c, a in (("doc_id", "ids"), ("node", "nodes"), ("forged", "forged"))), "way", "subroot", "root")
    out = ways.mapInArrow(run, OUT)
    return out if with_proof else out.drop("proof")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _leaf_sql(n_chars: str) -> str:
    part = lambda v: f"coalesce(octet_length(encode({v}::VARCHAR))::VARCHAR || ':' || {v}::VARCHAR, '-')"
    return f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL},
leaves AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN coalesce({crc_sql("doc_id::VARCHAR")} % 7, 1) = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS shown
  FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM leaves),
t(lang, lvl, k, h, n) AS (
  SELECT lang, 0, k, leaf, count(*) OVER (PARTITION BY lang) FROM l
  UNION ALL
  SELECT lang, lvl + 1, k // 2, sha256(string_agg(h, '' ORDER BY k)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lvl, k // 2, n),
s AS (SELECT lang, lvl AS depth, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, k, h, n) AS (
  SELECT 0, k, h, n FROM s
  UNION ALL
  SELECT lvl + 1, k // 2, sha256(string_agg(h, '' ORDER BY k)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, k // 2, n),
ways AS (
  SELECT l.lang, l.k, x.lvl, t.h, l.k // (1 << x.lvl) % 2 AS odd
  FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN range(64) AS x(lvl) ON x.lvl < s.depth
    LEFT JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.lvl = x.lvl AND t.k = xor(l.k // (1 << x.lvl), 1)
  UNION ALL
  SELECT l.lang, l.k, s.depth + x.lvl, u.h, s.k // (1 << x.lvl) % 2
  FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN range(64) AS x(lvl) ON x.lvl < (SELECT max(lvl) FROM u)
    LEFT JOIN u ON u.lvl = x.lvl AND u.k = xor(s.k // (1 << x.lvl), 1)),
proofs AS (
  SELECT l.lang, l.k, l.shown, sha256(coalesce(string_agg(w.h, '' ORDER BY w.lvl), '')) AS proof_sha256,
    coalesce(list([coalesce(w.h, ''), w.odd::VARCHAR] ORDER BY w.lvl) FILTER (w.lvl IS NOT NULL), []) AS way
  FROM l LEFT JOIN ways w ON w.lang IS NOT DISTINCT FROM l.lang AND w.k = l.k GROUP BY l.lang, l.k, l.shown),
f(lang, k, i, h, way) AS (
  SELECT lang, k, 1, shown, way FROM proofs
  UNION ALL
  SELECT lang, k, i + 1, sha256(CASE way[i][2] WHEN '1' THEN way[i][1] || h ELSE h || way[i][1] END), way FROM f WHERE i <= len(way))
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, p.proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM l JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.k = l.k JOIN f ON f.lang IS NOT DISTINCT FROM l.lang AND f.k = l.k AND f.i = len(f.way) + 1
  JOIN s ON s.lang IS NOT DISTINCT FROM l.lang, (SELECT h FROM u WHERE n = 1) r
"""
