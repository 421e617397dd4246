"""Every registered query with an oracle matches DuckDB on the sf0.001
tables (row count, column names, order-insensitive values); every query
without one runs and returns rows."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle import compare

QUERIES = E.queries()
ORACLES = E.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and set(df.columns) == {"health_status", "n", "share"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, SF_SMALL, QUERIES, ORACLES)
    assert r["ok"], r


MODEL_QUERIES = sorted(set(QUERIES) - set(ORACLES) - {"temperature_boosted", "pump_grid_search",
                                                      "pump_boosted_ovr", "igbt_forest"})


@pytest.mark.parametrize("name", MODEL_QUERIES)
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0
