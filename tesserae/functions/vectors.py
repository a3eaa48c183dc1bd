"""Vector expressions in double precision, and a deterministic embedder for tests and demos."""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / norm))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def bag_vector(text: str, dimension: int) -> list[float]:
    """Every token adds or takes one at a hashed place; then unit length."""
    out = [0.0] * dimension
    for token in re.findall(r"[a-z0-9]+", (text or "").lower()) or ["\x00"]:
        digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
        out[int.from_bytes(digest[:4], "big") % dimension] += 1.0 if digest[4] % 2 else -1.0
    norm = math.sqrt(sum(x * x for x in out)) or 1.0
    return [x / norm for x in out]


def hashed_embedder(dimension: int = 768):
    """A pandas UDF text -> array<double>."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bag_vector(t, dimension))

    return embed
