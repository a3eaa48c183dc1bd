"""The training-data queries that have SQL, against DuckDB on the smallest test tables."""

import os

import pytest

from tesserae.llm import queries
from tests.core.test_queries_match_sql import DATA, duck, rows  # noqa: F401


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):  # noqa: F811
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
