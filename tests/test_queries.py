"""Every query of the library over sf0.001 against its SQL in DuckDB."""

import duckdb
import pytest

from trajspark.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = sorted(repr(tuple(map(plain, r))) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    r = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in df.columns]
    assert got == sorted(repr(tuple(plain(row[i]) for i in order)) for row in r.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
