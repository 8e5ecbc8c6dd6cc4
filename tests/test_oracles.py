"""Every query with SQL gives DuckDB's result on sf0.001."""

import duckdb
import pytest

from barloom import queries as indicators

TABLES = "region nation customer supplier part orders lineitem events".split()
SQL = indicators.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def cached(spark, sf):
    """The bars are the same for all: computed once."""
    from barloom.bars import minute_bars

    df = minute_bars(spark, sf).cache()
    df.count()
    yield
    df.unpersist()


def test_every_query_is_checked():
    assert set(indicators.queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf, duck, cached):
    got, want = indicators.queries()[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        if got[c].dtype.kind == "f":
            assert ((got[c] - want[c]).abs().fillna(0) == 0).all(), c
            assert (got[c].isna() == want[c].isna()).all(), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c
