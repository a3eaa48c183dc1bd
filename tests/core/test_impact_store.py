"""Layered postings: the hits of a full scan, and a small share of the postings read."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import search
from tesserae.sources import chunk_store, impact_store


def corpus(seed, n):
    """Chunks of a few common words, of which some are long, and rare ones."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    return [(k, [rng.choice(common) if rng.random() < 0.8 else f"r{rng.randrange(300)}" for _ in range(rng.choice((3, 10, 30, 30, 90)))]) for k in range(n)]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([*corpus(2, 1500), (9001, []), (9002, None), (9003, ["c1"] * 400)], "chunk_id long, terms array<string>").repartition(4)


@pytest.fixture(scope="module")
def postings(chunks):
    return chunk_store.postings_of(chunks)


@pytest.fixture(scope="module")
def index(spark, postings, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('impacts')}/i"
    impact_store.write(postings, root)
    return impact_store.read(spark, root)


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(4)
    rows = [(k, [*(f"c{rng.randrange(12)}" for _ in range(6)), *(f"r{rng.randrange(300)}" for _ in range(2))]) for k in range(40)]
    return spark.createDataFrame([*rows, (100, []), (101, None), (102, ["absent", None]), (103, ["r1", "r1"]), (104, ["c1", "absent"])], "query_id long, terms array<string>")


def hits(df):
    return sorted((r.query_id, r.place, r.chunk_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10])
def test_the_hits_of_a_full_scan(index, postings, chunks, queries, k):
    assert hits(impact_store.search(index, chunks, queries, k)) == hits(search.keyword_batch(postings, queries, k)) == hits(search.posting_arms(postings, queries, k))


def test_blocks_hold_every_posting_once(index, postings):
    got = index.blocks.select("term", "n", F.explode("ids").alias("chunk_id"))
    assert sorted(map(tuple, got.collect())) == sorted((r.term, r.n, r.chunk_id) for r in postings.collect())
    assert index.blocks.where("head").groupBy("term").agg(F.sum(F.size("ids")).alias("n")).agg(F.max("n")).first()[0] < 600


def test_a_small_share_of_the_postings_is_read(index, postings, queries):
    steps = impact_store.plan(index, queries, 10)
    read = impact_store.wanted(index, steps).agg(F.sum(F.size("ids"))).first()[0]
    whole = postings.join(steps, "term").count()
    assert read < 0.6 * whole, (read, whole)


def test_an_empty_index(spark, postings, chunks, queries, tmp_path):
    impact_store.write(postings.limit(0), f"file://{tmp_path}/none")
    assert impact_store.search(impact_store.read(spark, f"file://{tmp_path}/none"), chunks, queries, 5).count() == 0
