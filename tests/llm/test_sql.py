"""Queries with SQL against DuckDB on the smallest tables."""

import os

import pytest

from shoalwork.llm import queries

DATA = os.environ.get("SHOALWORK_TESTDATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    queries.QUERIES[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    con.sql(f"create table o as {queries.ORACLE_SQL[name]}")
    columns = ", ".join(f'"{r[0]}"' for r in con.sql("describe o").fetchall())
    con.sql(f"create table s as select {columns} from read_parquet('{tmp_path}/out/*.parquet')")
    assert con.sql("select count(*) from o").fetchall() == con.sql("select count(*) from s").fetchall()
    assert con.sql("select * from o except all select * from s limit 3").fetchall() == []
    assert con.sql("select * from s except all select * from o limit 3").fetchall() == []
