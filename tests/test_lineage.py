"""Which queries of dashboards have variables, and so no services."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from opsgraph.operators import lineage

SERVICES = [
    ('up{job="api", path=~"/[[:alpha:]]+"}', [("api", "", "")]),
    ('up{job="api", path=~"${"}', [("api", "", "")]),
    ('up{app="a", cluster="c", note="${a.b}"}', [("a", "c", "")]),
    ('up{job="$job"}', []),
    ('up{job="api", env="${env:regex}"}', []),
    ('up{job="[[job]]"}', []),
]


def test_only_variables_keep_services_away(spark):
    df = spark.createDataFrame([(str(i), e) for i, (e, _) in enumerate(SERVICES)], "query string, expr string")
    got = {(r["query"], r["service"], r["cluster"], r["namespace"]) for r in lineage.services(df).collect()}
    assert got == {(str(i), *row) for i, (_, rows) in enumerate(SERVICES) for row in rows}


@pytest.mark.parametrize("expr", ["rate(x[${a.b}])", "x[[5 m]]"])
def test_what_is_no_variable_and_no_promql_names_nothing(spark, expr):
    got = spark.createDataFrame([(expr,)], "e string").select(lineage.promql(F.col("e")).alias("p")).first()["p"]
    assert (got["metrics"], got["functions"], got["has_variables"], got["well_formed"]) == ([], [], False, False)
