"""Driver contract: entry smoke test and Spark-vs-DuckDB checks at sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                "scripts"))

import __spark_entry__ as E  # noqa: E402
from metricmart.plans.named_queries import QUERIES  # noqa: E402
from check_oracle import check, duck  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "series_key" in df.columns and "time_unix_nano" in df.columns


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_duckdb(spark, name):
    con = duck(SF)
    assert check(spark, con, SF, name, E.queries()[name], E.oracle_sql()[name])
