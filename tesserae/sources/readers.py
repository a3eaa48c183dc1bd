"""Sources: raw files to pages and lines. Formats that need a parser outside this environment sit behind a registry."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "path string, page_number long, text string, image_area_ratio double, has_fonts boolean"
_PARSERS: dict[str, Callable[[bytes], list[tuple[str, float, bool]]]] = {}
_OCR: dict[str, Callable[[bytes, int], tuple[str, list[float]]]] = {"noop": lambda data, page: ("", [])}

MAGIC = {"pdf": b"%PDF-", "png": b"\x89PNG", "jpg": b"\xff\xd8\xff", "tiff": b"II*\x00"}


def register_parser(kind: str, parse: Callable[[bytes], list[tuple[str, float, bool]]]) -> None:
    """parse(bytes) -> pages of (text, image area ratio, has fonts)."""
    _PARSERS[kind] = parse


def register_ocr(name: str, recognise: Callable[[bytes, int], tuple[str, list[float]]]) -> None:
    """recognise(bytes, page) -> (text, word confidences)."""
    _OCR[name] = recognise


def kind_of(head: bytes) -> str:
    for kind, magic in MAGIC.items():
        if head.startswith(magic):
            return "image" if kind != "pdf" else "pdf"
    return "text"


def text_pages(data: bytes) -> list[tuple[str, float, bool]]:
    return [(data.decode("utf-8", "replace"), 0.0, True)]


def image_pages(data: bytes) -> list[tuple[str, float, bool]]:
    return [("", 1.0, False)]


register_parser("text", text_pages)
register_parser("image", image_pages)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def pages(raw: DataFrame, max_pages: int = 5000) -> DataFrame:
    """Files (path, content) to pages by the parser registered for their kind; files without a parser stop the job."""
    parsers = dict(_PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"], strict=True):
                kind = kind_of(bytes(data[:8]))
                if kind not in parsers:
                    raise ValueError(f"no parser is registered for {kind}: {path}")
                got = parsers[kind](bytes(data))
                if len(got) > max_pages:
                    raise ValueError(f"{path} has {len(got)} pages; at most {max_pages} are read")
                out += [(path, i + 1, *p) for i, p in enumerate(got)]
            yield pd.DataFrame(out, columns=["path", "page_number", "text", "image_area_ratio", "has_fonts"])

    return raw.select("path", "content").mapInPandas(run, PAGES)


def recognise(raw: DataFrame, wanted: DataFrame, provider: str = "noop") -> DataFrame:
    """path, page_number, ocr_text, confidence (mean of those above 0) of the wanted pages."""
    engine = _OCR[provider]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [engine(bytes(d), int(p)) for d, p in zip(b["content"], b["page_number"], strict=True)]
            mean = [(lambda c: sum(c) / len(c) if c else 0.0)([x for x in conf if x > 0]) for _, conf in got]
            yield pd.DataFrame({"path": b["path"], "page_number": b["page_number"], "ocr_text": [t for t, _ in got], "confidence": mean})

    return raw.join(wanted, "path").select("path", "content", "page_number").mapInPandas(run, "path string, page_number long, ocr_text string, confidence double")


def upload_checks(raw: DataFrame, max_bytes: int = 50 << 20) -> DataFrame:
    """verdict of each file: ok, empty, too_large, or not_text for a file of no known magic that isn't UTF-8."""
    known = F.lit(False)
    for magic in MAGIC.values():
        known |= F.substring("content", 1, len(magic)) == F.lit(bytearray(magic))
    verdict = F.when(F.col("length") == 0, "empty").when(F.col("length") > max_bytes, "too_large").when(~known & ~F.is_valid_utf8("content"), "not_text").otherwise("ok")
    return raw.select("path", "length", verdict.alias("verdict"))


def html_text(html):
    """Visible text of a page: scripts, styles, comments and tags out, entities for the common five in."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def interpolate(text: str, env: dict[str, str]) -> str:
    """${NAME} and ${NAME:-default} in a configuration text; a name without value or default is an error."""

    def value(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise KeyError(m[1])
        return m[2]

    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", value, text)
