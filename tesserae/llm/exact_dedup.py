"""Exact deduplication by deterministic block naming (native: DataFrame functions only).

A text is cut into fixed-size byte blocks. The distinct blocks are sorted into integer names; then adjacent names are
paired, the distinct pairs are sorted into names of the next level, and so on until each document has one name. Equal
(level, name) means equal text: a name stands for one byte sequence and no other, by induction over the levels.

Block contents are shuffled once, for the distinct blocks. What carries a name back to the documents is the SHA-256 of the
block, and the job stops with an error if two distinct blocks should ever share one, so no name is given to two contents.

Defined cases: a null text counts as empty; very long texts are more blocks, not larger ones; an empty table gives no rows; a row without doc_id stays only
where all rows of its text lack one (then one of them); an empty text is one empty block; rows that repeat a doc_id and text are
copies of each other, of which one stays; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ascii_lower, cut, drop, global_rank, table

KEY = ["doc_id", "_len", "_h"]


def _rows(docs: DataFrame) -> DataFrame:
    text = ascii_lower(F.col("text"))
    return docs.select(F.col("doc_id"), text.alias("_text")).select("doc_id", F.octet_length("_text").alias("_len"), F.xxhash64("_text").alias("_h"), "_text")


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """One row for each block of each document: key, n_blocks, idx, block."""
    rows = _rows(docs).withColumn("_bin", F.encode("_text", "UTF-8"))
    n = F.greatest(F.lit(1), F.ceil(F.col("_len") / size)).cast("int")
    rows = rows.select(*KEY, n.alias("_n"), "_bin", F.explode(F.sequence(F.lit(0), n - 1)).alias("_idx"))
    return rows.select(*KEY, "_n", "_idx", F.substring("_bin", F.col("_idx") * size + 1, F.lit(size)).alias("_block"))


def _named(keys: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct keys -> gapless integer names in sorted order within hash buckets."""
    return global_rank(keys.withColumn("_hash", F.xxhash64(*cols)), "_hash", cols, "_name").drop("_hash")


def identities(docs: DataFrame, block_bytes: int = 2048) -> DataFrame:
    """doc_id, _len, _h -> _level, _name: one collision-free identity for each document's normalised text."""
    blocks = _blocks(docs, block_bytes).withColumn("_digest", F.unhex(F.sha2("_block", 256)))
    per_digest = blocks.select("_digest", "_block").distinct().groupBy("_digest").agg(F.count(F.lit(1)).alias("_contents"))
    checked = per_digest.select(F.when(F.col("_contents") == 1, F.col("_digest")).otherwise(F.raise_error(F.lit("two blocks share a digest")).cast("binary")).alias("_digest"))
    names = cut(_named(checked, ["_digest"]), "names0")
    state = cut(blocks.drop("_block").join(names, "_digest").drop("_digest"), "state0")
    drop(names)
    done, level, scratch = [], 0, [state]
    most = state.agg(F.max("_n")).first()[0] or 0
    while True:
        # a document with n blocks has ceil(n / 2**level) names at a level
        ended = F.col("_n") <= (1 << level)
        if level:
            ended = ended & (F.col("_n") > (1 << (level - 1)))
        done.append(state.where(ended).select(*KEY, F.lit(level).alias("_level"), "_name"))
        if most <= (1 << level):
            break
        left, right = (F.max(F.when(F.col("_idx") % 2 == k, F.col("_name"))).alias(f"_{k}") for k in (0, 1))
        pairs = state.where(F.col("_n") > (1 << level)).groupBy(*KEY, "_n", F.floor(F.col("_idx") / 2).cast("int").alias("_idx")).agg(left, right)
        pairs = cut(pairs.withColumn("_1", F.coalesce("_1", F.lit(-1))), "pairs")
        names = _named(pairs.select("_0", "_1").distinct(), ["_0", "_1"])
        state = cut(pairs.join(names, ["_0", "_1"]).drop("_0", "_1"), "state")
        drop(pairs)
        scratch.append(state)
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = cut(out.distinct(), "identities")
    drop(*scratch)
    return out


def exact_dedup(docs: DataFrame, block_bytes: int = 2048) -> DataFrame:
    """doc_id, _len, _h (which with the copy number tell a row), keep_id, group_size, kept, text_sha256, for every row."""
    names = identities(docs, block_bytes)
    rows = _rows(docs).select(*KEY, F.sha2("_text", 256).alias("text_sha256"))
    rows = rows.withColumn("_copy", F.row_number().over(W.partitionBy(*KEY).orderBy("text_sha256")))
    same = F.lit(True)
    for k in KEY:
        same = same & rows[k].eqNullSafe(names[k])
    rows = cut(rows.join(names, same).drop(*(names[k] for k in KEY)), "named-rows")
    drop(names)
    # as a table of its own, so that the join's two exchanges stand alone and a hot group's rows can be split over tasks
    groups = cut(rows.groupBy("_level", "_name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return rows.join(groups, ["_level", "_name"]).select(*KEY, "_copy", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_unique(docs: DataFrame, block_bytes: int = 2048) -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows equal in doc_id and text, the one whose whole row has the smallest
    hash stays."""
    kept = exact_dedup(docs, block_bytes).where("kept").select(*KEY)
    rows = docs.select(F.struct(*docs.columns).alias("_doc"))  # whatever the columns are called, they don't clash
    text = ascii_lower(F.col("_doc.text"))
    rows = rows.select("_doc", F.col("_doc.doc_id").alias("doc_id"), F.octet_length(text).alias("_len"), F.xxhash64(text).alias("_h"))
    rows = rows.withColumn("_copy", F.row_number().over(W.partitionBy(*KEY).orderBy(F.xxhash64("_doc")))).where("_copy = 1")
    same = F.lit(True)
    for k in KEY:
        same = same & rows[k].eqNullSafe(kept[k])
    return rows.join(kept, same, "left_semi").select("_doc.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
