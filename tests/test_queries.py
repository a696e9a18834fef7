"""Every query that has SQL gives the same rows as DuckDB does."""

from __future__ import annotations

import pytest
from compare import duck_rows, spark_rows
from opsgraph.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names, want = duck_rows(ORACLE_SQL[name], sf_dir)
    assert sorted(df.columns) == names
    assert spark_rows(df) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns[:2] == ["kind", "total"]
