"""A vector index at rest: inverted cells from k-means, residual codes in each cell, and the full vectors for exact re-ranking.

``write`` fits the cells on a bounded sample (``TRAIN`` vectors a cell, taken by a hash of row_id) by rounds of k-means whose sums are made by
Spark; only the centres, at most ``MAX_CELLS`` of them, come to the driver. Then every vector is indexed:

* ``vectors/`` by cell: row_id, embedding;
* ``codes/`` by cell: blocks of at most ``BLOCK`` rows, with ids and one signed byte a dimension for what the centre leaves over;
* ``cells/``: centre, number of rows, radius (the largest distance of a row from the centre) and error (the largest distance of a code from its row).

How many cells a query should ask is measured, not guessed: ``CALIBRATION`` rows, taken by a hash, are searched exactly, and ``probes`` is the smallest
number of nearest cells that hold ``TARGET`` of what was found. Vectors without clusters need most cells, clustered ones a few.

``search`` takes a table of queries. Each query asks the cells nearest to it, so that only their folders are listed; a block and the queries of its
cell meet in one matrix product, of which the best ``keep`` rows for each query leave the task; these are scored exactly on the full vectors.
``exact=True`` makes the result that of a full scan: the k-th exact score of that first search is a bound, and every cell whose centre and
radius can reach it is read, and every row whose code and error can reach it is scored.

Vectors are compared by cosine. Defined cases: null, zero and odd-sized vectors (not of the commonest size) are left out, of rows and of queries; equal
scores (to 12 places) are ordered by row_id; rows that repeat a row_id are rows of their own; fewer rows than k give fewer hits; an
empty table gives an index without cells and no hits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tesserae.functions import vectors as vx
from tesserae.sources.chunk_store import kept_table

MAX_CELLS, TRAIN, ROUNDS, BLOCK, WIDTH, SLICE = 4096, 64, 8, 2048, 256, 256
CALIBRATION, TARGET = 256, 0.98
STORED = "cell int, row_id long, embedding array<double>, code binary, far double, error double"


def _matrix(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of an array column, and the places of those that count: of the right size, without nulls, not zero. The column's own buffer is
    read; no number becomes a Python object."""
    fit = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    m = column.filter(fit).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))  # not a number where a vector holds a null
    ok = norm > 0
    return m[ok] / norm[ok, None], np.flatnonzero(fit.to_numpy(zero_copy_only=False))[ok]


def _lists(m: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an array column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m, dtype=np.float64).ravel()))


def _means(sample: DataFrame, centres: np.ndarray) -> np.ndarray:
    """One round of k-means: sums of each partition by cell, added up by Spark. A cell that nobody chose keeps its centre."""
    size = centres.shape[1]

    def run(batches):
        total, count = np.zeros_like(centres), np.zeros(len(centres))
        for batch in batches:
            m, _ = _matrix(batch.column("embedding"), size)
            cell = (m @ centres.T).argmax(axis=1)
            np.add.at(total, cell, m)
            count += np.bincount(cell, minlength=len(centres))
        met = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(met), _lists(total[met])], names=["cell", "total"])

    parts = sample.mapInArrow(run, "cell long, total array<double>")
    sums = parts.groupBy("cell").agg(*(F.sum(F.get("total", F.lit(j))).alias(f"_{j}") for j in range(size)))
    out = centres.copy()
    for r in sums.collect():  # at most MAX_CELLS rows
        v = np.array(r[1:])
        out[r[0]] = v / (np.linalg.norm(v) or 1)
    return out


def fit(rows: DataFrame, size: int, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres, from at most TRAIN * cells vectors."""
    sample = kept_table(rows.where(F.size("embedding") == size).orderBy(F.xxhash64("row_id", "embedding")).limit(TRAIN * cells).repartition(max(1, TRAIN * cells // 4096)), "vector-sample")
    first = sample.dropDuplicates(["embedding"]).orderBy(F.xxhash64(F.lit(1), "embedding")).limit(cells).select("embedding").toArrow()
    centres, _ = _matrix(first.column("embedding").combine_chunks(), size)
    for _ in range(rounds if len(centres) > 1 else 0):
        centres = _means(sample, centres)
    return centres


@dataclass(frozen=True)
class VectorIndex:
    root: str
    centres: np.ndarray
    radius: np.ndarray
    error: np.ndarray
    scale: np.ndarray
    probes: int
    spark: SparkSession

    def table(self, name: str, schema: str, cells: list[int] | None) -> DataFrame:
        """A table of the index; with cells, only their folders are listed."""
        df = self.spark.read.schema(T._parse_datatype_string(schema)).parquet(f"{self.root}/{name}")
        return df if cells is None else df.where(F.col("cell").isin(cells))

    def codes(self, cells: list[int] | None = None) -> DataFrame:
        return self.table("codes", "ids array<long>, codes binary, cell int", cells)

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        return self.table("vectors", "row_id long, embedding array<double>, cell int", cells)


def write(rows: DataFrame, root: str, cells: int | None = None, rounds: int = ROUNDS) -> VectorIndex:
    """The index of rows (row_id, embedding) in a new folder. Without a number of cells there are about as many as the square root of the rows."""
    spark = rows.sparkSession
    rows = rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    shape = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size, n = (shape[0], shape[1]) if shape else (1, 0)
    centres = fit(rows, size, cells or int(min(MAX_CELLS, max(1, n**0.5))), rounds) if n else np.zeros((0, size))
    # what the centre leaves over lies within [-1, 1] of each other in nearly all dimensions; the step is set by the sample of the fit
    scale = np.full(size, 1.0 / 127)

    def assign(batches):
        for batch in batches:
            m, at = _matrix(batch.column("embedding"), size)
            if not len(m):
                continue
            cell = (m @ centres.T).argmax(axis=1)
            rest = m - centres[cell]
            code = np.clip(np.rint(rest / scale), -127, 127).astype(np.int8)
            error = np.sqrt(((rest - code * scale) ** 2).sum(axis=1))
            cols = [pa.array(cell.astype(np.int32)), batch.column("row_id").take(pa.array(at)), batch.column("embedding").take(pa.array(at)), pa.array([c.tobytes() for c in code], type=pa.binary()), pa.array(np.sqrt((rest**2).sum(axis=1))), pa.array(error)]
            yield pa.RecordBatch.from_arrays(cols, names=["cell", "row_id", "embedding", "code", "far", "error"])

    if len(centres):
        placed = rows.mapInArrow(assign, STORED)
    else:
        placed = spark.createDataFrame([], STORED)
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{root}/vectors")
    stored = spark.read.schema(T._parse_datatype_string(STORED)).parquet(f"{root}/vectors")

    def blocks(batches):
        now, ids, codes = None, [], []
        for batch in batches:
            for cell, row, code in zip(*(batch.column(c).to_pylist() for c in ("cell", "row_id", "code")), strict=True):
                if ids and (cell != now or len(ids) == BLOCK):
                    yield block_of(now, ids, codes)
                    ids, codes = [], []
                now = cell
                ids.append(row)
                codes.append(code)
        if ids:
            yield block_of(now, ids, codes)

    def block_of(cell, ids, codes):
        return pa.RecordBatch.from_arrays([pa.array([ids], type=pa.list_(pa.int64())), pa.array([b"".join(codes)], type=pa.binary()), pa.array([cell], type=pa.int32())], names=["ids", "codes", "cell"])

    dealt = stored.select("cell", "row_id", "code").hint("rebalance", "cell").sortWithinPartitions("cell", "row_id")
    dealt.mapInArrow(blocks, "ids array<long>, codes binary, cell int").write.partitionBy("cell").parquet(f"{root}/codes")
    per_cell = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.max("error").alias("error"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    known.join(per_cell, "cell", "left").withColumn("scale", F.array(*(F.lit(float(x)) for x in scale))).repartition(1).write.parquet(f"{root}/cells")
    found = calibrated(read(spark, root, len(centres)), rows) if len(centres) else 0
    spark.createDataFrame([(found,)], "probes int").write.parquet(f"{root}/probes")
    return read(spark, root, found)


def calibrated(index: VectorIndex, rows: DataFrame, k: int = 10) -> int:
    """The number of nearest cells that hold TARGET of the k best rows of CALIBRATION rows."""
    picked = rows.orderBy(F.xxhash64(F.lit(2), "row_id"), "row_id").limit(CALIBRATION).select(F.monotonically_increasing_id().alias("query_id"), "embedding")
    asked = kept_table(picked, "vector-calibration")
    best = search(index, asked, k, probes=min(16, len(index.centres)), exact=True)
    met = best.join(index.vectors().select("row_id", "cell"), "row_id").join(asked, "query_id").select("query_id", "cell", "embedding").toArrow()  # at most k rows for each of CALIBRATION queries, but for repeated ids
    if not met.num_rows:
        return len(index.centres)
    m, at = _matrix(met.column("embedding").combine_chunks(), index.centres.shape[1])
    products, cell = m @ index.centres.T, met.column("cell").to_numpy()[at]
    rank = (products > products[np.arange(len(cell)), cell][:, None]).sum(axis=1) + 1
    return int(np.quantile(rank, TARGET, method="higher"))


def read(spark: SparkSession, root: str, probes: int | None = None) -> VectorIndex:
    got = spark.read.parquet(f"{root}/cells").orderBy("cell").collect()  # at most MAX_CELLS rows
    size = len(got[0]["centre"]) if got else 1
    centres = np.array([r["centre"] for r in got]).reshape(len(got), size)
    radius, error = (np.array([-np.inf if r[c] is None else r[c] for r in got]) for c in ("radius", "error"))
    probes = spark.read.parquet(f"{root}/probes").first()[0] if probes is None else probes
    return VectorIndex(root, centres, radius, error, np.array(got[0]["scale"]) if got else np.ones(1), probes, spark)


def _asked(index: VectorIndex, queries: DataFrame, pick) -> DataFrame:
    """cell, query_id, v, least for the cells that pick chooses by the products of queries with centres."""
    centres, size = index.centres, index.centres.shape[1]

    def run(batches):
        for batch in batches:
            m, at = _matrix(batch.column("embedding"), size)
            if not len(m):
                continue
            bound = pc.fill_null(batch.column("least"), -2.0).to_numpy(zero_copy_only=False)[at]
            who = batch.column("query_id").to_numpy(zero_copy_only=False)[at]
            for first in range(0, len(m), SLICE):  # a query may ask thousands of cells
                here = slice(first, first + SLICE)
                line, cell = np.nonzero(pick(m[here] @ centres.T, bound[here]))
                for a in range(0, len(line), BLOCK * 4):
                    q = line[a : a + BLOCK * 4] + first
                    yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + BLOCK * 4].astype(np.int32)), pa.array(who[q]), _lists(m[q]), pa.array(bound[q])], names=["cell", "query_id", "v", "least"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"), "least").mapInArrow(run, "cell int, query_id long, v array<double>, least double")


def _candidates(index: VectorIndex, asked: DataFrame, keep: int | None) -> DataFrame:
    """query_id, row_id, cell, about: the ``keep`` best rows by code for each query and block, or without keep all that can reach ``least``."""
    cells = [r[0] for r in asked.select("cell").distinct().collect()]  # at most MAX_CELLS
    n = max(1, -(-asked.count() // max(1, WIDTH * len(cells))))
    groups = asked.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("_g")).agg(F.collect_list(F.struct("query_id", "v", "least")).alias("asked"))
    centres, scale, error = index.centres, index.scale, index.error

    def run(batches):
        for batch in batches:
            for cell, row_ids, codes, asked in zip(*(batch.column(c) for c in ("cell", "ids", "codes", "asked")), strict=True):
                cell, ids = cell.as_py(), row_ids.values.to_numpy()
                asks, vectors, least = asked.values.flatten()
                q = vectors.flatten().to_numpy().reshape(len(asks), -1)
                rest = np.frombuffer(codes.as_buffer(), dtype=np.int8).reshape(len(ids), -1)
                about = (q @ centres[cell])[:, None] + (q * scale) @ rest.T.astype(np.float64)
                if keep is None:
                    line, row = np.nonzero(about >= least.to_numpy()[:, None] - error[cell] - 1e-9)
                else:
                    row = np.argsort(-about, axis=1, kind="stable")[:, :keep]
                    line, row = np.repeat(np.arange(len(asks)), row.shape[1]), row.ravel()
                for a in range(0, len(line), 1 << 16):
                    i, j = line[a : a + (1 << 16)], row[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(asks.to_numpy()[i]), pa.array(ids[j]), pa.array(np.full(len(i), cell, dtype=np.int32)), pa.array(about[i, j])], names=["query_id", "row_id", "cell", "about"])

    return index.codes(cells).join(groups, "cell").mapInArrow(run, "query_id long, row_id long, cell int, about double")


def _scored(index: VectorIndex, found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    cells = [r[0] for r in found.select("cell").distinct().collect()]  # at most MAX_CELLS
    full = found.select("query_id", "row_id", "cell").distinct().join(index.vectors(cells), ["cell", "row_id"])
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("_q"))
    score = F.round(vx.cosine(F.col("embedding"), F.col("_q")), 12)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "row_id")).cast("long")
    return full.join(asked, "query_id").select("query_id", "row_id", score.alias("score")).withColumn("place", place).where(F.col("place") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, keep: int | None = None, exact: bool = False) -> DataFrame:
    """query_id, row_id, score, place: the k rows most similar to each query (query_id, embedding) among the cells that it asks (index.probes unless
    said otherwise)."""
    if not len(index.centres):
        return index.spark.createDataFrame([], "query_id long, row_id long, score double, place long")
    keep = keep or max(4 * k, 40)
    queries = queries.where("embedding is not null")
    nearest = min(probes or index.probes, len(index.centres))

    def near(products, _):
        out = np.zeros_like(products, dtype=bool)
        np.put_along_axis(out, np.argpartition(-products, nearest - 1, axis=1)[:, :nearest], True, axis=1)
        return out

    found = _candidates(index, _asked(index, queries.withColumn("least", F.lit(None).cast("double")), near), keep)
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("about"), "row_id"))
    found = kept_table(found.withColumn("_row", best).where(F.col("_row") <= keep).drop("_row"), "vector-candidates")
    out = _scored(index, found, queries, k)
    if not exact:
        return out
    least = out.where(F.col("place") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("least"))
    bounded = kept_table(queries.join(least, F.col("query_id") == F.col("_id"), "left").select("query_id", "embedding", "least"), "vector-bounds")
    radius = index.radius
    every = _candidates(index, _asked(index, bounded, lambda products, bound: products + radius >= bound[:, None] - 1e-9), None)
    return _scored(index, kept_table(every, "vector-candidates"), queries, k)
