"""A table that changes by commits: what is read, what is written, and two writers."""

import pytest
from pyspark.sql import functions as F

from tesserae.sources import segments

SCHEMA = "document_id long, ordinal long, content string, is_active boolean"


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return segments.Segments(spark, f"file://{tmp_path}/t", "document_id", schema, "is_active")


def df(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "document_id long")


def rows_of(table, at=None):
    return sorted(map(tuple, table.read(at).select("document_id", "ordinal", "content", "is_active").collect()))


def test_upsert_delete_flip_and_merge(spark, table):
    with pytest.raises(ValueError):
        table.read()
    many = df(spark, *((d, o, f"{d} {o} " * 40, True) for d in range(200) for o in range(5)))
    assert table.commit(0, many) == 1
    assert table.commit(1, df(spark, (3, 1, "new", False), (500, 1, "added", True)), delete=keys(spark, 3, 4)) == 2
    assert table.commit(2, flags=spark.createDataFrame([(3, True), (5, False), (4, True)], "document_id long, is_active boolean")) == 3
    want = sorted([(d, o, f"{d} {o} " * 40, d != 5) for d in range(200) for o in range(5) if d not in (3, 4)] + [(3, 1, "new", True), (500, 1, "added", True)])
    assert rows_of(table) == want
    assert len(rows_of(table, 1)) == 1000 and (3, 1, "new", False) in rows_of(table, 2)
    size = table.sizes(3)
    assert size[2] < size[1] and size[3] < size[1]  # in proportion to the change
    assert table.merge(share=1000.0) is None
    assert table.merge(share=0.0) == 4 and rows_of(table) == want and table.since(4) == [4]
    assert table.commit(4, delete=keys(spark, *range(1, 600))) == 5
    assert {r[0] for r in rows_of(table)} == {0} and rows_of(table, 3) == want


def test_two_writers(spark, table):
    table.commit(0, df(spark, (1, 1, "a", True), (2, 1, "b", True)))
    base = table.head()
    assert table.commit(base, df(spark, (1, 1, "first", True))) == 2
    with pytest.raises(segments.Conflict):  # the same document: one wins
        table.commit(base, df(spark, (1, 1, "second", True)))
    with pytest.raises(segments.Conflict):
        table.commit(base, flags=spark.createDataFrame([(1, False)], "document_id long, is_active boolean"))
    assert table.commit(base, df(spark, (2, 1, "other", True))) == 3  # another document: both win
    assert rows_of(table) == [(1, 1, "first", True), (2, 1, "other", True)]
    assert table.commit(table.head(), df(spark, (1, 1, "third", True))) == 4  # read again, it may


def test_a_writer_that_comes_second_takes_the_next_number(spark, table, monkeypatch):
    table.commit(0, df(spark, (1, 1, "a", True)))
    put = segments.Segments._put
    calls = []

    def slow(self, number, entry):
        if not calls:  # between this writer's look at the log and its commit another one commits
            calls.append(number)
            put(self, number, {"folder": self._log(1)["folder"], "begin": 1} if rival is None else {"folder": rival, "begin": 1})
        return put(self, number, entry)

    other = segments.Segments(spark, table.root + "-other", "document_id", table.schema, "is_active")
    other.commit(0, df(spark, (9, 1, "rival", True)))
    rival = "../" + table.root.rsplit("/", 1)[1] + "-other/" + other._log(1)["folder"]
    monkeypatch.setattr(segments.Segments, "_put", slow)
    assert table.commit(1, df(spark, (2, 1, "b", True))) == 3
    assert {r[0] for r in rows_of(table)} == {1, 2, 9}
    calls.clear()
    with pytest.raises(segments.Conflict):
        table.commit(3, df(spark, (9, 1, "too late", True)))


def test_null_keys_are_refused(spark, table):
    with pytest.raises(Exception, match="a key is null"):
        table.commit(0, df(spark, (None, 1, "a", True)))
    assert table.head() == 0
    assert table.commit(0) == 1 and table.read().count() == 0 and F is not None
