"""Every registered query against its DuckDB form, on the smallest tables."""

import duckdb
import pytest

import granary.catalog  # noqa: F401
from granary.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    assert set(df.columns) == set(want.columns)
    got = sorted(tuple(shown(r[c]) for c in want.columns) for r in df.collect())
    assert got == sorted(tuple(map(shown, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
