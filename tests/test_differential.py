"""Every core query with SQL gives the rows of its SQL in DuckDB; every other one runs."""

from __future__ import annotations

import pytest
from differential import SF, compare

from loomwork.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    compare(spark, name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    df.collect()
