"""Keyword search with positions: stems, weights, a tree of AND, OR, NOT and phrases, and ranking by the covers of that tree.

Postings are a table (term, chunk_id, weight, positions): one row for each term of a chunk and part, A for its heading and B for its
content. ``write`` lays them down by a hash of the term, with the columns that a search filters by, so that a search lists the buckets of its own
words. A query is parsed on the driver into a tree; candidates come from an equi-join of its terms with the postings, and
what needs positions (phrases, covers) is decided over the positions of the candidates' own terms.

A cover is a shortest stretch of a chunk's matching words that satisfies the whole tree, excluded words left aside: in a choice every match is a cover of its
own, for words that must all occur it is the stretch that holds them all. Each cover counts the harmonic mean of the weights in it, divided by
the places in it that match nothing, plus one.

English words are stemmed by the first step of Porter's algorithm (plurals, -eed, -ed, -ing, -y); other languages are taken as they are.
Null texts have no terms.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.sources.chunk_store import FILTERED

#: Words that an English index leaves out.
STOPWORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
WEIGHTS = {"A": 1.0, "B": 0.4}
WORD = re.compile(r"[^\W_]+")
ROWS = 1024
VOWELS = "aeiouy"


def stem(word: str) -> str:
    """Porter's first step."""
    if len(word) < 3 or not word.isascii():
        return word
    w = word
    if w.endswith("eed"):  # agreed, but not need: only behind a vowel that a consonant follows
        root = w[:-3]
        met = [c in VOWELS for c in root]
        return root + "ee" if any(x and not y for x, y in zip(met, met[1:], strict=False)) else w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    for ending in ("ing", "ed"):
        root = w.removesuffix(ending)
        if root != w and any(c in VOWELS for c in root):
            double = len(root) > 1 and root[-1] == root[-2] and root[-1] not in "lsz"
            w = root + "e" if root.endswith(("at", "bl", "iz")) else root[:-1] if double else root
            break
    return w[:-1] + "i" if len(w) > 2 and w[-1] == "y" and any(c in VOWELS for c in w[:-1]) else w


def tokens(text: str | None, english: bool = True) -> list[tuple[str, int]]:
    """(term, position) in order; positions count all words from 1."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return [(stem(w) if english else w, i) for i, w in enumerate(words, 1) if not (english and w in STOPWORDS)]


@dataclass(frozen=True)
class Query:
    """A tree: ("leaf", phrase), ("not", tree), ("and", trees) or ("or", trees); a phrase is a tuple of stems with their distances from its first. None
    is a query without words."""

    tree: tuple | None

    def terms(self) -> list[str]:
        return sorted({t for phrase in _phrases(self.tree) for t, _ in phrase})


def _phrases(tree: tuple | None) -> list[tuple]:
    if tree is None:
        return []
    kind, inside = tree
    return [inside] if kind == "leaf" else _phrases(inside) if kind == "not" else [p for t in inside for p in _phrases(t)]


def parse(text: str, english: bool = True, relax: bool = True) -> Query:
    """Words, "phrases", -excluded, and ``or`` in any case, which binds weaker than what stands side by side: a b or c is (a and b) or c. Words stand
    for all of them; relaxed, for any of them, unless something is excluded. An ``or`` without anything on one of its sides is left out."""
    sides, minus_seen = [[]], False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if not minus and word.lower() == "or":
            sides.append([])
            continue
        found = tokens(phrase or word, english)
        if found:
            leaf = ("leaf", tuple((t, p - found[0][1]) for t, p in found))
            sides[-1].append(("not", leaf) if minus else leaf)
            minus_seen |= bool(minus)
    sides = [side for side in sides if side]
    if relax and not minus_seen:
        sides = [[leaf] for side in sides for leaf in side]
    trees = [side[0] if len(side) == 1 else ("and", tuple(side)) for side in sides]
    return Query(None if not trees else trees[0] if len(trees) == 1 else ("or", tuple(trees)))


def holds(tree: tuple, where: dict, strict: bool = True) -> bool:
    """Whether positions by term satisfy the tree; unless strict, what is excluded doesn't count."""
    kind, inside = tree
    if kind == "leaf":
        return has_phrase(where, inside)
    if kind == "not":
        return not strict or not holds(inside, where)
    return (all if kind == "and" else any)(holds(t, where, strict) for t in inside)


def postings(chunks: DataFrame, columns: tuple = ()) -> DataFrame:
    """chunks (chunk_id, heading, content, language) to (chunk_id, term, weight, positions) and the named columns of the chunk; content follows the heading."""
    kept = ["chunk_id", *(c for c in columns if c in chunks.columns)]
    fields = [chunks.schema[c] for c in kept]
    schema = T.StructType([*fields, *T._parse_datatype_string("term string, weight string, positions array<int>").fields])

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                at, terms, weights, places = [], [], [], []
                for i, (heading, content, language) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_heading", "_content", "_language")), strict=True)):
                    english, offset = language == "en", 0
                    for weight, text in (("A", heading), ("B", content)):
                        words, found = WORD.findall((text or "").lower()), {}
                        for p, w in enumerate(words, offset + 1):
                            if not (english and w in STOPWORDS):
                                found.setdefault(stem(w) if english else w, []).append(p)
                        offset += len(words)
                        at += [i] * len(found)
                        weights += [weight] * len(found)
                        terms += found
                        places += found.values()
                own = [batch.column(c).take(pa.array(at, type=pa.int64())) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(terms, type=pa.string()), pa.array(weights, type=pa.string()), pa.array(places, type=pa.list_(pa.int32()))], names=schema.names)

    return chunks.select(*kept, F.col("heading").alias("_heading"), F.col("content").alias("_content"), F.col("language").alias("_language")).mapInArrow(run, schema)


def has_phrase(where: dict, phrase: tuple) -> bool:
    if len(phrase) == 1:
        return bool(where.get(phrase[0][0]))
    starts = None
    for t, d in phrase:
        here = {p - d for p in where.get(t, ())}
        starts = here if starts is None else starts & here
        if not starts:
            return False
    return True


def covers(tree: tuple, places: list[tuple[int, str, float]]):
    """(first, last) of the shortest stretches of places (position, term, weight; ascending) that satisfy the tree, none within another. Both ends only
    move forward, so a place is taken in and given up once."""
    where, left = {}, 0
    for right, (p, t, _) in enumerate(places):
        where.setdefault(t, deque()).append(p)
        if not holds(tree, where, strict=False):
            continue
        while holds(tree, where, strict=False):
            gone = places[left][1]
            where[gone].popleft()
            left += 1
        yield left - 1, right


def cover_density(places: list[tuple[int, str, float]], tree: tuple) -> float:
    places = sorted(places)
    total = 0.0
    for first, last in covers(tree, places):
        inside = places[first : last + 1]
        noise = (inside[-1][0] - inside[0][0]) - (len(inside) - 1)
        total += len(inside) / sum(1 / w for *_, w in inside) / (1 + max(0, noise))
    return total


def search(index: DataFrame, query: Query, k: int) -> DataFrame:
    """chunk_id, score of the k best chunks: r / (r + 1), r being the cover density of the query's tree. A query that no word has to match (excluded words
    alone, or as one side of a choice) has no hits."""
    tree, wanted = query.tree, query.terms()
    if tree is None or holds(tree, {}, strict=False):
        return index.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    met = index.where(F.col("term").isin(*wanted)).groupBy("chunk_id").agg(F.collect_list(F.struct("term", "weight", "positions")).alias("_p"))

    def score(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            where, places = {}, []
            for x in row:
                where.setdefault(x["term"], []).extend(int(p) for p in x["positions"])
                places += [(int(p), x["term"], WEIGHTS[x["weight"]]) for p in x["positions"]]
            ok = holds(tree, where)
            r = cover_density(places, tree) if ok else 0.0
            out.append(round(r / (r + 1), 12) if ok and r else None)  # sums in another order are ties
        return pd.Series(out, dtype="float64")

    return met.select("chunk_id", F.pandas_udf(score, "double")("_p").alias("score")).where("score is not null").orderBy(F.desc("score"), "chunk_id").limit(k)


def write(chunks: DataFrame, root: str, buckets: int = 64) -> None:
    """The postings of chunks, with the columns that a search filters by, in a new folder by a hash of the term."""
    rows = postings(chunks, FILTERED).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{root}/positions")


def read(spark: SparkSession, root: str, query: Query | None = None, buckets: int = 64) -> DataFrame:
    """The stored postings; with a query, only the buckets of its words are listed."""
    df = spark.read.parquet(f"{root}/positions")
    if query is None:
        return df
    wanted = [F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)) for t in query.terms()]
    return df.where(reduce(or_, wanted, F.lit(False)))


def query_language(languages: tuple, default: str = "en") -> str:
    """The language a query is parsed in: the one language filtered for, else the default."""
    return languages[0] if len(languages) == 1 else default


def is_english(language: Column) -> Column:
    return F.coalesce(language == "en", F.lit(False))
