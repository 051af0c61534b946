"""Every registered query with an oracle: Spark result == DuckDB SQL result
(column names, row count, values) on the same parquet tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import TABLES, canon  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF_SMALL).toPandas()
    odf = con.execute(SQL[name]).df()
    assert sorted(sdf.columns) == sorted(odf.columns)
    a, b = canon(sdf), canon(odf)
    assert len(a) == len(b)
    assert a == b


def test_every_query_has_callable_and_most_have_oracles():
    qs = entry.queries()
    assert set(SQL) <= set(qs)
    assert len(SQL) >= 100


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["payment_method", "transactions", "fraud_rate", "counterfeit_rate", "side_count",
                          "avg_amount"]
