"""Which pages of a document need optical character recognition: page statistics, watermark pages, one decision a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tesserae.functions import text as tx
from tesserae.settings import Ocr


BROKEN = r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]"


def page_stats(pages: DataFrame) -> DataFrame:
    """pages (document_id, page_number, text, image_area_ratio, has_fonts) with their text measures."""
    t = F.coalesce("text", F.lit(""))

    def measures(t: Column) -> Column:
        w, bare = tx.words(t), F.regexp_replace(t, r"(?U)\s+", "")

        def of(x: Column) -> Column:
            n_words, n = F.size(x["w"]), F.length(x["bare"])
            share = lambda k, of: F.when(of > 0, k.cast("double") / of).otherwise(0.0)
            return F.struct(
                F.length(F.trim(t)).cast("long").alias("char_count"),
                n_words.cast("long").alias("word_count"),
                share(F.aggregate(x["w"], F.lit(0), lambda s, y: s + F.length(y)), n_words).alias("mean_word_len"),
                # letters, and everything beyond U+2E80
                share(F.length(F.regexp_replace(x["bare"], r"[^\p{L}\x{2E81}-\x{10FFFF}]", "")), n).alias("alpha_ratio"),
                share(F.size(F.regexp_extract_all(t, F.lit(r"\(cid:\d+\)"), F.lit(0))), n_words).alias("cid_ratio"),
                # replacement characters, and control characters that no text should hold
                share(F.length(t) - F.length(F.regexp_replace(t, BROKEN, "")), n).alias("replacement_ratio"),
            )

        # a one-element array binds the words and the bare text once
        return F.element_at(F.transform(F.array(F.struct(w.alias("w"), bare.alias("bare"))), of), 1)

    return pages.withColumn("_m", measures(t)).select("*", "_m.*").drop("_m")


def with_repeats(stats: DataFrame) -> DataFrame:
    """is_repeating: the same short text on most pages of a document is a watermark."""
    doc = W.partitionBy("document_id")
    norm = F.substring(tx.normalize(F.coalesce("text", F.lit(""))), 1, 400)
    rows = stats.withColumn("_norm", norm).withColumn("_pages", F.count(F.lit(1)).over(doc))
    same = F.count(F.lit(1)).over(W.partitionBy("document_id", "_norm"))
    often = same >= F.greatest(F.lit(2), F.floor(F.col("_pages") * F.lit(0.6)))
    flag = (F.col("_pages") >= 3) & (F.col("_norm") != "") & (F.length("_norm") <= 200) & often
    return rows.withColumn("is_repeating", flag).drop("_norm", "_pages")


def usable(s: Ocr = Ocr()) -> Column:
    return (
        (F.col("char_count") >= s.min_chars)
        & (F.col("alpha_ratio") >= s.alpha_ratio)
        & (F.col("cid_ratio") <= s.cid_ratio)
        & (F.col("replacement_ratio") <= s.replacement_ratio)
        & F.col("mean_word_len").between(s.min_word_len, s.max_word_len)
        & ~F.col("is_repeating")
    )


def decide(stats: DataFrame, s: Ocr = Ocr(), documents: DataFrame | None = None) -> DataFrame:
    """One row a document: mode (NATIVE, OCR, HYBRID), coverage, the pages to recognise (at most max_ocr_pages), and the reasons. Of the
    documents given, those without pages are NATIVE for the reason empty_document."""
    rows = stats.withColumn("_ok", usable(s))
    scanned = (F.col("image_area_ratio") >= s.scanned_image_area) & (F.col("char_count") < s.scanned_max_chars)
    per = rows.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if("_ok").alias("n_usable"),
        F.count_if(scanned).alias("_scanned"),
        F.avg("cid_ratio").alias("_cid"),
        F.avg("replacement_ratio").alias("_broken"),
        F.avg(F.when(F.col("_ok"), F.col("char_count"))).alias("_chars"),
        F.array_sort(F.collect_list("page_number")).alias("_all"),
        F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.col("page_number")))).alias("_missing"),
    )
    none = F.array().cast("array<long>")
    if documents is not None:
        per = documents.select("document_id").distinct().join(per, "document_id", "left")
        per = per.withColumns({"n_pages": F.coalesce("n_pages", F.lit(0)), "n_usable": F.coalesce("n_usable", F.lit(0)), "_all": F.coalesce("_all", none), "_missing": F.coalesce("_missing", none)})
    coverage = F.when(F.col("n_pages") > 0, F.col("n_usable").cast("double") / F.col("n_pages")).otherwise(0.0)
    rule = (
        F.when(F.col("n_pages") == 0, "empty_document")
        .when(F.col("_scanned") >= F.col("n_pages") * 0.5, "scanned_images")
        .when((F.col("_cid") > 0.05) | (F.col("_broken") > 0.05), "broken_text_encoding")
        .when((coverage >= s.native_coverage) & (F.col("_chars") >= 200), "native_text")
        .when(coverage <= s.ocr_coverage, "insufficient_text")
        .otherwise("mixed_document")
    )
    mode = F.when(F.col("_rule").isin("empty_document", "native_text"), "NATIVE").when(F.col("_rule") == "mixed_document", "HYBRID").otherwise("OCR")
    out = per.withColumns({"coverage": coverage, "_rule": rule}).withColumn("mode", mode)
    pages = F.when(F.col("mode") == "OCR", F.col("_all")).when(F.col("mode") == "HYBRID", F.col("_missing")).otherwise(none)
    out = out.withColumn("_pages", pages)
    over = F.when(F.size("_pages") > s.max_ocr_pages, F.lit("ocr_page_cap"))
    return out.select("document_id", "mode", F.round("coverage", 6).alias("coverage"), "n_pages", "n_usable", F.slice("_pages", 1, s.max_ocr_pages).alias("ocr_pages"), F.array_compact(F.array("_rule", over)).alias("reasons"))


def event_detail(decisions: DataFrame, most: int = 50) -> DataFrame:
    """What a job's event says of the decision: mode, coverage to 4 places, the reasons, and the first pages to recognise."""
    return decisions.select("document_id", "mode", F.round("coverage", 4).alias("coverage"), F.array_join("reasons", "; ").alias("reasons"), F.slice("ocr_pages", 1, most).alias("ocr_pages"), F.size("ocr_pages").alias("n_ocr_pages"))


def overlay(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Recognised text replaces a page's own where it is not empty. ocr: document_id, page_number, ocr_text."""
    return pages.join(ocr, ["document_id", "page_number"], "left").withColumn("text", F.coalesce(F.nullif(F.trim("ocr_text"), F.lit("")), F.col("text"))).drop("ocr_text")
