"""Text as column expressions: everything here stays in the JVM and in whole-stage code generation where Spark allows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.settings import HEADING_NUMBERS, INJECTION, TOPIC_STOPWORDS

SENTENCE_END = r"(?<=[.!?。！？])\s+"


def normalize(text: Column) -> Column:
    """White space to single spaces, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)[^\S ]\s*| \s+", " ")))  # a space that stands alone is not replaced by itself


def sanitize(text: Column) -> Column:
    """Without tags that could be taken for the prompt's own delimiters."""
    return F.trim(F.regexp_replace(text, r"(?i)</?\s*(?:sources?|system|instructions)\b[^>]*>", ""))


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct runs of n words of the normalised text; n words or fewer are one shingle."""

    def runs(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= n, F.array(F.array_join(w, " "))).otherwise(many)

    # a one-element array binds the words once; written out, they would be split anew for every run
    return F.array_distinct(F.flatten(F.transform(F.array(F.filter(F.split(normalize(text), " "), lambda x: x != "")), runs)))


def refs(answer: Column) -> Column:
    """S1, S2, ... as cited by [S1], [S1, S2] and [S1][S3], in order of first mention."""
    groups = F.regexp_extract_all(answer, F.lit(r"(?i)\[\s*(S\d+(?:\s*,\s*S\d+)*)\s*\]"), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda r: F.upper(F.trim(r))))


def token_estimate(text: Column) -> Column:
    """floor(characters / 3.5) + 1, nothing for an empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.floor(n / F.lit(3.5)) + 1).cast("long")


def normalize_heading(heading: Column) -> Column:
    """A heading's words: without number, chapter word and edge punctuation, white space single."""
    out = F.trim(heading)
    for pattern in HEADING_NUMBERS:
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), r"^[ :\-–—.]+|[ :\-–—.]+$", "")


def topic_tokens(heading: Column) -> Column:
    """Sorted distinct topic words: stop words go first, then the plural s of words longer than three letters."""
    kept = F.filter(terms(normalize_heading(heading)), lambda x: ~x.isin(*TOPIC_STOPWORDS))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.when(F.length(x) > 3, F.regexp_replace(x, "s+$", "")).otherwise(x))))


def topic_key(heading: Column) -> Column:
    """Topic words joined by -, cut at 64 characters; null if none."""
    t = topic_tokens(heading)
    return F.when(F.size(t) > 0, F.substring(F.array_join(t, "-"), 1, 64))


def content_hash(text: Column) -> Column:
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"[ \t]+", " "))), 256)


def clean_pages(pages: Column) -> Column:
    """Pages joined by blank lines; CRLF to LF; soft hyphens out."""
    kept = F.filter(F.transform(pages, lambda p: F.trim(p)), lambda p: p != "")
    return F.replace(F.replace(F.array_join(kept, "\n\n"), F.lit("\r\n"), F.lit("\n")), F.lit("­"), F.lit(""))


def injection_flags(query: Column) -> Column:
    """Indices of the injection patterns that a query matches."""
    return F.array_compact(F.array(*(F.when(query.rlike(p), F.lit(i)) for i, p in enumerate(INJECTION))))


def screened(query: Column) -> Column:
    out = query
    for p in INJECTION:
        out = F.regexp_replace(out, p, " ")
    return F.trim(out)


def normalize_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def locator(page_from: Column, page_to: Column) -> Column:
    """p.N, pp.A-B, or null without pages."""
    return F.when(page_from.isNull(), F.lit(None).cast("string")).when(page_to.isNull() | (page_to == page_from), F.format_string("p.%d", page_from)).otherwise(F.format_string("pp.%d-%d", page_from, page_to))
