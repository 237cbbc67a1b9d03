"""Queries that have SQL, against it, over whole tables of sf0.001."""

import duckdb
import pytest

from trajspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    r = con.execute(queries.ORACLE_SQL[name])
    order = [[d[0] for d in r.description].index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(row[i] for i in order)) for row in r.fetchall())
