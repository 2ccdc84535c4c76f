"""The driver contract: every queries() key runs, and matches its DuckDB oracle
at sf0.001 (row count and rounded values)."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from ticklens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _canon(df):
    df = df[sorted(df.columns)]
    def v(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, float):
            return round(x, 6) + 0.0
        return str(x)
    return sorted(repr(tuple(v(x) for x in r)) for r in df.itertuples(index=False))


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["timestamp", "open", "high", "low", "close", "volume"]


def test_every_query_has_an_oracle_or_is_streaming():
    missing = set(registry.queries()) - set(registry.oracle_sql())
    assert set(registry.queries()) <= set(E.queries())
    assert missing == set()


@pytest.mark.parametrize("key", sorted(registry.queries()))
def test_query_matches_oracle(spark, con, key):
    got = E.queries()[key](spark, SF).toPandas()
    exp = con.sql(E.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert _canon(got) == _canon(exp)
