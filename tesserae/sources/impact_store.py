"""Postings at rest in order of impact, and exact top-k search that reads only what can still matter.

``write`` lays the postings (term, chunk_id, n) down in layers: a block holds at most ``BLOCK`` chunks in which a term stands exactly n times, so the
block's largest weight is n. ``blocks/`` is partitioned by whether a block is among the first ``HEAD`` postings of its term and by a hash of the term;
``layers/`` has how many postings each (term, n) has.

``search`` answers a table of queries in four steps:

1. The heads of the asked terms give partial scores; a query's k-th best of these is a bound that its result cannot fall below.
2. The bound is a budget. A query's terms are put in the order of postings saved by unit of weight; as long as their largest weights fit into the
   budget they need not be read at all, and of the one that no longer fits, the layers within what is left. A chunk that stands only in what was left out
   weighs less than the bound. So the commonest words, which are most of the postings, are not read.
3. What is read gives each chunk a weight and an upper bound; chunks whose bound stays below the query's are dropped.
4. The rest are weighed exactly in their own rows, and the k best are the result.

Defined cases: queries without terms, or whose terms stand nowhere, have no rows; null terms count for nothing; terms that repeat in a query
count once; equal scores are ordered by chunk_id; an empty table gives an empty index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tesserae.sources.chunk_store import kept_table

BLOCK, HEAD, BUCKETS = 128, 64, 64
STORED = "term string, n long, part long, ids array<long>, head boolean, bucket int"
LAYERS = "term string, n long, size long, before long"


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Impacts:
    blocks: DataFrame
    layers: DataFrame


def write(postings: DataFrame, root: str) -> None:
    """The layers of postings (term, chunk_id, n) in a new folder."""
    rows = postings.where("term is not null and n > 0").select("term", F.col("n").cast("long").alias("n"), F.col("chunk_id").cast("long").alias("chunk_id"))
    sizes = rows.groupBy("term", "n").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(W.partitionBy("term").orderBy(F.desc("n"))) - F.col("size")
    sizes.withColumn("before", before).write.parquet(f"{root}/layers")
    layers = rows.sparkSession.read.schema(LAYERS).parquet(f"{root}/layers")
    # a layer is dealt into parts by a hash of the chunk, so that no task gathers a whole list; only layers above a block need their number of parts
    large = layers.where(F.col("size") > BLOCK).select("term", "n", F.ceil(F.col("size") * 2 / BLOCK).alias("parts"))
    dealt = rows.join(large, ["term", "n"], "left").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.coalesce("parts", F.lit(1))))
    blocks = dealt.groupBy("term", "n", "part").agg(F.sort_array(F.collect_list("chunk_id")).alias("ids"))
    blocks = blocks.join(layers.select("term", "n", "before"), ["term", "n"])
    blocks = blocks.select("term", "n", "part", "ids", (F.col("before") + F.col("part") * BLOCK / 2 < HEAD).alias("head"), _bucket("term").alias("bucket"))
    blocks.hint("rebalance", "head", "bucket").sortWithinPartitions("head", "bucket", "term", F.desc("n")).write.partitionBy("head", "bucket").parquet(f"{root}/blocks")


def read(spark: SparkSession, root: str) -> Impacts:
    return Impacts(spark.read.schema(STORED).parquet(f"{root}/blocks"), spark.read.schema(LAYERS).parquet(f"{root}/layers"))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).where("term is not null")


def plan(index: Impacts, queries: DataFrame, k: int) -> DataFrame:
    """query_id, term, cut, bound, slack: of each asked term only postings with n > cut are read; bound is the weight that a result has at least; slack
    is the sum of a query's cuts, the most that an unread chunk can weigh."""
    asked = _asked(queries)
    own = asked.join(index.layers.groupBy("term").agg(F.max("n").alias("most"), F.sum("size").alias("length")), "term")
    own = kept_table(own, "asked-terms")
    head = index.blocks.where("head").join(own.select("query_id", "term"), "term").select("query_id", "n", F.explode("ids").alias("chunk_id"))
    partial = head.groupBy("query_id", "chunk_id").agg(F.sum("n").alias("_w"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("_w"), "chunk_id"))
    bound = partial.withColumn("_row", place).where(F.col("_row") == k).select("query_id", F.col("_w").alias("bound"))
    rows = own.join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
    by = W.partitionBy("query_id")
    spent = F.sum("most").over(by.orderBy(F.desc(F.col("length") / F.col("most")), "term")) - F.col("most")
    cut = F.greatest(F.lit(0), F.least("most", F.col("bound") - 1 - spent))  # weights are whole numbers: what is left out adds up to less than the bound
    rows = rows.withColumn("cut", cut).withColumn("slack", F.sum("cut").over(by))
    return kept_table(rows.select("query_id", "term", "cut", "bound", "slack", "most"), "search-plan")


def wanted(index: Impacts, steps: DataFrame) -> DataFrame:
    """The blocks that steps (a plan) reads: query_id, term, n, ids, cut, bound, slack. Terms that are left out whole are not looked up."""
    return index.blocks.join(steps.where("cut < most"), "term").where("n > cut").select("query_id", "term", "n", "ids", "cut", "bound", "slack")


def search(index: Impacts, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, place: the k best chunks (chunk_id, terms) for each of queries (query_id, terms), exactly."""
    steps = plan(index, queries, k)
    seen = wanted(index, steps).select("query_id", "n", "cut", "bound", "slack", F.explode("ids").alias("chunk_id"))
    met = seen.groupBy("query_id", "chunk_id").agg(F.sum("n").alias("_n"), F.sum("cut").alias("_cut"), F.first("bound").alias("bound"), F.first("slack").alias("slack"))
    able = met.where(F.col("_n") + F.col("slack") - F.col("_cut") >= F.col("bound"))
    able = kept_table(able.select("query_id", "chunk_id", "_n", (F.col("slack") - F.col("_cut")).alias("_open")), "search-candidates")
    known = able.where("_open = 0").select("query_id", "chunk_id", "_n")  # all their terms were read
    open_ = able.where("_open > 0").select("query_id", "chunk_id")
    words = F.array_distinct("terms")
    own = chunks.select("chunk_id", F.col("terms").alias("_t")).join(open_, "chunk_id").join(queries.select("query_id", words.alias("_q")), "query_id")
    weighed = own.select("query_id", "chunk_id", F.size(F.filter("_t", lambda t: F.array_contains("_q", t))).cast("long").alias("_n"))
    r = F.col("_n") * F.lit(0.4)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")).cast("long")
    return known.unionByName(weighed).select("query_id", "chunk_id", (r / (r + 1)).alias("score")).withColumn("place", place).where(F.col("place") <= k)
