"""The vector index: recall, exactness, folders listed, odd vectors."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.operators import search
from tesserae.sources import vector_index

SCHEMA = "row_id long, embedding array<double>"


def clustered(seed, n, size, centres):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, size))
    return [(i, (middle[i % centres] + 0.4 * rng.normal(size=size)).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [1.0, 2.0]), (5003, [None] + [1.0] * 15), (3, [0.5] * 16), (3, [0.5] * 16)]
    return spark.createDataFrame(clustered(1, 1500, 16, 30) + odd, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return vector_index.write(rows, f"file://{tmp_path_factory.mktemp('vectors')}/index", cells=24)


@pytest.fixture(scope="module")
def asked(rows):
    return rows.where("row_id % 19 = 0 and row_id < 5000").select(F.col("row_id").alias("query_id"), "embedding")


def hits(df):
    return sorted((r.query_id, r.place, r.row_id, round(r.score, 9)) for r in df.collect())


def test_every_row_is_indexed(index, rows):
    assert index.vectors().count() == rows.count() - 4
    assert sum(len(r.ids) for r in index.codes().collect()) == rows.count() - 4
    assert all(len(r.ids) <= vector_index.BLOCK and len(r.codes) == 16 * len(r.ids) for r in index.codes().collect())


def test_exact_search_is_the_full_scan(index, rows, asked):
    whole = rows.where("row_id <> 3 and size(embedding) = 16 and embedding[0] is not null").dropDuplicates(["row_id"])
    want = hits(search.vector_batch(whole, asked, 10))
    got = hits(vector_index.search(index, asked, 10, probes=2, exact=True))
    once = [h for h in got if h[2] != 3]
    assert len(got) == len(want) and [h for h in once if h[1] <= 3] == [h for h in want if h[1] <= 3 and h[2] != 3]


def test_recall_grows_with_the_probes(index, rows, asked):
    exact = {h[0:1] + h[2:3] for h in hits(vector_index.search(index, asked, 10, exact=True))}
    share = [len(exact & {h[0:1] + h[2:3] for h in hits(vector_index.search(index, asked, 10, probes=p))}) / len(exact) for p in (1, 4, 24)]
    assert share == sorted(share) and share[1] > 0.95 and share[2] > 0.995


def test_files_listed_fall_with_the_probes(index, spark):
    one = index.codes([3]).select(F.input_file_name().alias("f")).distinct().count()
    assert 0 < one < index.codes().select(F.input_file_name().alias("f")).distinct().count()
    plan = index.codes([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and "PushedFilters: []" in plan


def test_queries_that_do_not_count_and_small_tables(spark, index, tmp_path):
    odd = spark.createDataFrame([(1, None), (2, [0.0] * 16), (3, [1.0])], "query_id long, embedding array<double>")
    assert vector_index.search(index, odd, 5).count() == 0
    few = vector_index.write(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], SCHEMA), f"file://{tmp_path}/few")
    ask = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, embedding array<double>")
    assert [h[:3] for h in hits(vector_index.search(few, ask, 5, exact=True))] == [(9, 1, 1), (9, 2, 2)]
    none = vector_index.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none")
    assert vector_index.search(none, ask, 5, exact=True).count() == 0


def test_calibrated_recall(index, asked, spark, tmp_path):
    """Clustered vectors need a few cells, vectors without clusters most of them; both reach the recall."""
    rng = np.random.default_rng(5)
    flat = spark.createDataFrame([(i, rng.normal(size=24).tolist()) for i in range(1000)], SCHEMA)
    loose = vector_index.write(flat, f"file://{tmp_path}/flat", cells=20)
    assert index.probes < 12 < loose.probes + 4 and vector_index.read(spark, loose.root).probes == loose.probes
    for ix, ask in ((index, asked), (loose, flat.where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), "embedding"))):
        exact, got = ({h[0:1] + h[2:3] for h in hits(vector_index.search(ix, ask, 10, exact=e))} for e in (True, False))
        assert len(exact & got) >= 0.95 * len(exact)


def test_vectors_are_read_without_python_objects():
    column = pa.array(list(np.random.default_rng(1).normal(size=(20_000, 64))) + [None, [1.0], [None] * 64, [0.0] * 64])
    tracemalloc.start()
    m, at = vector_index._matrix(column, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert m.shape == (20_000, 64) and at.tolist() == list(range(20_000)) and np.allclose((m**2).sum(axis=1), 1)
    assert peak < 6 * m.nbytes


def test_blocks_are_read_without_python_objects():
    m = np.random.default_rng(2).normal(size=(20_000, 64))
    block = pa.StructArray.from_arrays([pa.array(range(20_003)), pa.array([*m, [1.0], [None] * 64, [0.0] * 64])], names=["id", "v"])
    tracemalloc.start()
    ids, unit = search._unit(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.tolist() == list(range(20_000)) and np.allclose(unit * np.linalg.norm(m, axis=1)[:, None], m)
    assert peak < 6 * m.nbytes
