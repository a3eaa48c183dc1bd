"""Mixing sources to target weights by Poisson replication.

Every source has a target share of the output; its rate is the mean number of times that one of its documents is to
appear. A row's count is the inverse of the Poisson distribution with that mean at a uniform number hashed from (seed, doc_id and text, number
among the rows equal in both), so it is the same on every run and needs no state. Rates above ``piece`` are split into equal Poisson
parts with hashed numbers of their own, as a sum of Poissons is Poisson; no term underflows. Each copy then gets a hashed
place, and the output is range-partitioned and sorted by it: one global shuffle.

Defined cases: a null source is a source of its own; a null doc_id reads as the text 'null' and a null text as an empty one, but every row draws for
itself: rows equal in doc_id and text are told apart by their other columns and, if these are equal, too, by a running number, which can be dealt in any
order. A null text is kept; very long texts are only hashed and moved; weights of sources that do not occur are left out and the rest scaled up; extra
columns stay as they are, whatever their names. Empty input gives an empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, table

TERMS = 64  # P(X >= 64) at a mean of 8 is below the resolution of the hashed number


def _uniform(*parts: Column) -> Column:
    """48 bits of an MD5 as a number in [0, 1)."""
    digest = F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float, epochs: float, piece: float) -> DataFrame:
    """For each source: n, rate, parts and the Poisson distribution function of one part."""
    counts = cut(docs.groupBy("source").agg(F.count(F.lit(1)).alias("_n")), "source-counts")
    weight = F.pow(F.col("_n").cast("double"), F.lit(alpha))
    if weights:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighed = counts.withColumn("_w", weight)
    all_w, all_n = weighed.agg(F.sum("_w"), F.sum("_n")).first()
    out = weighed.withColumn("_rate", F.col("_w") / F.lit(all_w or 1.0) * F.lit(all_n or 0) * F.lit(float(epochs)) / F.col("_n"))
    out = out.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / F.lit(piece))).cast("int"))
    mean = F.col("_rate") / F.col("_parts")
    terms = F.aggregate(
        F.sequence(F.lit(0), F.lit(TERMS - 1)),
        F.struct(F.lit(0.0).alias("cdf"), F.exp(-mean).alias("term"), F.array().cast("array<double>").alias("all")),
        lambda s, k: F.struct((s["cdf"] + s["term"]).alias("cdf"), (s["term"] * mean / (k + 1)).alias("term"), F.concat(s["all"], F.array(s["cdf"] + s["term"])).alias("all")),
        lambda s: s["all"],
    )
    return out.select(F.col("source").alias("_source"), "_rate", "_parts", terms.alias("_cdf"))


def numbered(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """rows (_doc, _who) with _tag: 1 where _who occurs once; else a hash of the row and its number among equal rows. Equal rows are counted with a
    combine on the map side and dealt out again in slices of ``most``, so that no task numbers a whole group."""
    again = cut(rows.groupBy("_who").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_who"), "repeated")
    if not again.limit(1).count():
        return rows.withColumn("_tag", F.lit("1"))
    again = broadcast_if_small(again, 200_000)
    equal = rows.join(again, "_who", "left_semi").groupBy("_who", F.sha2(F.to_json("_doc"), 256).alias("_row")).agg(F.first("_doc").alias("_doc"), F.count(F.lit(1)).alias("_n"))
    slices = equal.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(most)))).repartition("_row", "_from")
    each = slices.withColumn("_k", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + most, "_n") - 1)))
    each = cut(each.select("_doc", "_who", F.concat_ws(":", "_row", (F.col("_k") + 1).cast("string")).alias("_tag")), "numbered")
    return rows.join(again, "_who", "left_anti").select("_doc", "_who", F.lit("1").alias("_tag")).unionByName(each)


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 17, piece: float = 8.0) -> DataFrame:
    """_doc (a struct of all columns of docs), n_copies, copy_no and the hashed place, in globally shuffled order.

    weights: target share of each source; without them a source of n rows gets a share in proportion to n ** alpha.
    """
    table_ = cut(rates(docs, weights, alpha, epochs, piece), "rates")
    rows = docs.select(F.struct(*docs.columns).alias("_doc"))  # whatever the columns are called, they don't clash
    said = F.concat(F.coalesce(F.col("_doc.doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("_doc.text", F.lit("")))
    rows = numbered(rows.withColumn("_who", F.md5(said.cast("binary"))))
    joined = rows.join(broadcast_if_small(table_, 10_000), rows["_doc.source"].eqNullSafe(table_["_source"]))
    who = F.concat_ws(":", "_who", "_tag")
    draws = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda j: F.size(F.filter("_cdf", lambda c: c <= _uniform(F.lit(seed), who, j))))
    joined = joined.withColumn("n_copies", F.aggregate(draws, F.lit(0), lambda a, b: a + b))
    copies = joined.where("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    place = F.md5(F.concat_ws(":", F.lit(f"place{seed}"), who, F.col("copy_no").cast("string")).cast("binary"))
    return copies.select("_doc", "n_copies", "copy_no", place.alias("place")).repartitionByRange("place").sortWithinPartitions("place")


def mix(docs: DataFrame, **how) -> DataFrame:
    """All columns of docs, with n_copies, copy_no and place (which take the place of columns so called); ``how`` as in replicate."""
    own = ("n_copies", "copy_no", "place")
    return replicate(docs, **how).select(*(F.col("_doc")[c].alias(c) for c in docs.columns if c.lower() not in own), *own)


def mix_rows(docs: DataFrame, **how) -> DataFrame:
    """The columns of docs alone, whatever they are called, each row as often as drawn; ``how`` as in replicate."""
    return replicate(docs, **how).select("_doc.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_copies", "copy_no", "place")


OP9_SQL = """
WITH c AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM c),
p AS (SELECT source, rate, greatest(1, ceil(rate / 8))::INT AS parts FROM r),
terms AS (
  SELECT source, parts, k, exp(-rate / parts) * coalesce(list_product(list_transform(range(1, k + 1), lambda j: rate / parts / j)), 1) AS term
  FROM p, range(0, 64) AS t(k)),
cdf AS (SELECT source, parts, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS cdf FROM terms),
cdfs AS (SELECT source, any_value(parts) AS parts, list(cdf ORDER BY k) AS cdf FROM cdf GROUP BY source),
u AS (
  SELECT d.doc_id, d.source, d.text, md5(coalesce(d.doc_id::VARCHAR, 'null') || ':' || coalesce(d.text, '')) || ':1' AS who, s.cdf, unnest(range(1, s.parts + 1)) AS j
  FROM documents d JOIN cdfs s ON d.source IS NOT DISTINCT FROM s.source),
draws AS (
  SELECT doc_id, source, text, who,
    len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('17:' || who || ':' || j), 1, 12))::BIGINT / 281474976710656.0)) AS k
  FROM u),
counts AS (SELECT doc_id, source, text, who, sum(k)::INT AS n_copies FROM draws GROUP BY ALL HAVING sum(k) > 0)
SELECT doc_id, source, text, n_copies, copy_no::INT AS copy_no,
  md5('place17:' || who || ':' || copy_no) AS place
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM counts)
"""
