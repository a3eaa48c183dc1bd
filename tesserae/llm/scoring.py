"""How a fitted scorer runs over documents: Arrow batches in, the same rows with a score out; no row moves."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod


def with_score(docs: DataFrame, scorer: Callable[[], Callable[[list], np.ndarray]], column: str = "score") -> DataFrame:
    """All columns of docs and a double. scorer() is called once in each task and returns texts -> scores; a null text is
    scored as the empty text; a column of docs that has the score's name gives way to it."""
    docs = docs.select(*(c for c in docs.columns if c.lower() != column.lower()))
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches):
        score = scorer()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            got = score(texts) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.asarray(got, dtype=np.float64))], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def judged(scored: DataFrame, mod: int, held: int) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), mod) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 40, weight: np.ndarray | None = None) -> np.ndarray:
    """Newton's method; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    k = np.ones(len(y)) if weight is None else weight
    ridge = np.eye(x.shape[1]) * l2
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (k * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (k * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
