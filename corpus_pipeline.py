"""The corpus pipeline: quality classifier, exact dedup, near dedup, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents; the last returns
the pieces of the packed sequences. Each stage works on all rows that its predecessor kept.

Defined cases, in all stages: a null text counts as empty; rows without doc_id are kept as rows of their own (exact dedup keeps one of equal texts, near
dedup keeps all, mixing draws for each, packing carries the null); rows that repeat a doc_id with other texts are judged text by text; ties are broken by
a hash of the whole row; very long texts are taken whole; an empty table gives no rows; extra columns, whatever their names, pass through all but
the last stage.

ORACLE_SQL is None: SQL cannot express the classifier or the packing. tests/llm/test_pipeline.py tests the stages by brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import exact_dedup, line_crf, mixing, near_dedup, packing
from tesserae.llm.common import crc_mod, cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF scores below 0.5 go. It learns from the labelled rows of docs outside the held-out third."""
    model = line_crf.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    return line_crf.keep_good(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of equal text (A-Z lower-cased), the one of the largest doc_id stays."""
    return exact_dedup.keep_unique(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of the smallest doc_id stays."""
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target share asks for, in shuffled order."""
    return mixing.mix_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's output written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
