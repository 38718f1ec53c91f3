"""Registered queries against their DuckDB forms, and the shape of the others."""

import duckdb
import pytest

from granary.llm import queries as Q

SF = "/root/testdata/sf0.001"


def shown(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = Q.QUERIES[name](spark, SF), con.sql(Q.ORACLES[name])
    assert set(df.columns) == set(want.columns)
    assert sorted(tuple(shown(r[c]) for c in want.columns) for r in df.collect()) == sorted(tuple(map(shown, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_a_row_for_each_input_row(spark, name):
    table = "pages" if name == "op6_html" else "documents"
    assert Q.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
