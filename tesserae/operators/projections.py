"""What leaves the engine: hits, citations and events as rows of fixed columns, rounded last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as tx

#: A hit's columns and types, in order.
HIT = {
    "chunk_id": "long", "document_id": "long", "version_number": "long", "organization_id": "long", "location_id": "long", "content": "string", "heading": "string",
    "section_path": "array<string>", "section_key": "string", "topic_key": "string", "source_name": "string", "source_type": "string", "page_from": "long", "page_to": "long",
    "language": "string", "token_count": "long", "content_hash": "string", "score": "double",
}


def hits(rows: DataFrame) -> DataFrame:
    """The columns of a hit, cast; those that rows lack are null, a null path is empty, a null token count 0 and a null score 0."""
    empty = {"section_path": F.array().cast("array<string>"), "token_count": F.lit(0).cast("long"), "score": F.lit(0.0)}
    out = []
    for name, kind in HIT.items():
        col = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(col, empty[name]) if name in empty else col).alias(name))
    arms = [c for c in ("vector_score", "keyword_score", "vector_rank", "keyword_rank") if c in rows.columns]
    return rows.select(*out, *arms)


def scope(location_id: Column) -> Column:
    return F.when(location_id.isNull(), "ORGANIZATION").otherwise("LOCATION")


def described(rows: DataFrame) -> DataFrame:
    """Hits with their scope, the arms that found them, and their path as one text."""
    arms = F.array_compact(F.array(F.when(F.col("vector_score").isNotNull(), "vector"), F.when(F.col("keyword_score").isNotNull(), "keyword")))
    return rows.withColumns({"scope": scope(F.col("location_id")), "matched": arms, "breadcrumb": F.array_join("section_path", " > ")})


def api_hits(rows: DataFrame) -> DataFrame:
    """Described hits as the interface gives them: scores to six places."""
    return described(rows).withColumns({c: F.round(c, 6) for c in ("score", "vector_score", "keyword_score")})


def citations(rows: DataFrame, snippet: int = 240) -> DataFrame:
    """query_id and a citation struct for each hit with a ref: eleven fields, the score to four places."""
    text = F.trim(F.regexp_replace("content", r"\s+", " "))
    fields = {
        "ref": F.col("ref"), "chunk_id": F.col("chunk_id"), "document_id": F.col("document_id"), "version_number": F.col("version_number"), "source_name": F.col("source_name"),
        "locator": tx.locator(F.col("page_from"), F.col("page_to")), "heading": F.col("heading"), "breadcrumb": F.array_join("section_path", " > "),
        "scope": scope(F.col("location_id")), "snippet": F.substring(text, 1, snippet), "score": F.round("score", 4),
    }
    return rows.where("ref is not null").select("query_id", F.struct(*(c.alias(n) for n, c in fields.items())).alias("citation"))
