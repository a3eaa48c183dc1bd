"""Precedence merge: what a location says about a subject hides what the organisation says about it.

A lower level's hit is hidden when its topic set equals a claimed set of a higher level, or one strictly contains the other;
sets that only overlap, and empty sets, hide nothing. Claims of one level never act on that level. Pairs for the containment
test come from an equi-join on single tokens (equal or contained non-empty sets share one) of each level's best 2 * top_k hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tesserae.settings import PRECEDENCE, Retrieval


def best_of_levels(hits: DataFrame, s: Retrieval = Retrieval()) -> DataFrame:
    """What the merge looks at: the best 2 * top_k hits of each query and level."""
    levels = by_precedence(hits)
    place = F.row_number().over(W.partitionBy("query_id", "precedence").orderBy(F.desc("score"), "chunk_id"))
    return levels.withColumn("_place", place).where(F.col("_place") <= 2 * s.top_k).drop("_place")


def by_precedence(hits: DataFrame) -> DataFrame:
    """Hits with their level's precedence; a chunk seen on two levels counts for the higher one."""
    level = F.when(F.col("location_id").isNull(), PRECEDENCE["ORGANIZATION"]).otherwise(PRECEDENCE["LOCATION"])
    first = F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy(F.desc("precedence")))
    return hits.withColumn("precedence", level.cast("long")).withColumn("_n", first).where("_n = 1").drop("_n")


def suppressions(hits: DataFrame) -> DataFrame:
    """query_id, chunk_id, claimed_by of the hits that a higher level hides. A hidden hit claims nothing; with two levels no hit of
    the higher one can be hidden, so its hits are the claims."""
    low = hits.where(F.col("precedence") == PRECEDENCE["ORGANIZATION"]).select("query_id", "chunk_id", F.col("topic").alias("_low"), F.explode("topic").alias("_t"))
    high = hits.where(F.col("precedence") > PRECEDENCE["ORGANIZATION"]).select("query_id", F.col("chunk_id").alias("_claimant"), F.col("score").alias("_score"), F.col("topic").alias("_high"), F.explode("topic").alias("_t"))
    related = (F.size(F.array_except("_low", "_high")) == 0) | (F.size(F.array_except("_high", "_low")) == 0)
    pairs = low.join(high, ["query_id", "_t"]).where(related)
    return pairs.groupBy("query_id", "chunk_id").agg(F.min_by("_claimant", F.struct(-F.col("_score"), F.col("_claimant"))).alias("claimed_by"))


def merge(hits: DataFrame, s: Retrieval = Retrieval()) -> DataFrame:
    """The top_k of each query after hiding, location hits boosted: query_id, chunk_id, score, precedence, place."""
    levels = best_of_levels(hits, s)
    gone = suppressions(levels)
    boosted = F.when(F.col("precedence") > 0, F.col("score") * s.location_boost).otherwise(F.col("score"))
    kept = levels.join(gone.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("score", boosted)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("precedence"), "chunk_id")).cast("long")
    return kept.withColumn("place", place).where(F.col("place") <= s.top_k).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "precedence", "place")


def override_counts(hits: DataFrame) -> DataFrame:
    """query_id, topic_key (the hidden hit's topic words joined by -), winner (the level that hid it) and how many hits it hid."""
    levels = best_of_levels(hits)
    key = F.array_join(F.array_sort("topic"), "-")
    gone = suppressions(levels).join(levels.select("query_id", "chunk_id", key.alias("topic_key")), ["query_id", "chunk_id"])
    return gone.groupBy("query_id", "topic_key").agg(F.lit("LOCATION").alias("winner"), F.count(F.lit(1)).alias("n_hidden"))
