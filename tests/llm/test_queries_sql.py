"""Queries of the subpackage that SQL can express, against DuckDB on a small table."""
import duckdb
import pytest

from arborform.llm.queries import oracle_sql, queries

TABLES = ("documents", "pages", "labels", "benchmark")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries()[name](spark, sf)
    cols = sorted(df.columns)

    def norm(v):
        return round(v, 6) if isinstance(v, float) else v
    rel = con.sql(oracle_sql()[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(at) == cols
    order = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=order)
    want = sorted((tuple(norm(r[at[c]]) for c in cols) for r in rel.fetchall()), key=order)
    assert got == want
