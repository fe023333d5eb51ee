"""Every query that has SQL against DuckDB; the others give rows. Needs nothing of the training-data package."""

import os

import duckdb
import pytest

from framequarry import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = plain([tuple(r[c] for c in columns) for r in df.collect()])
    if name not in queries.ORACLE_SQL:
        assert got
        return
    result = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == plain([tuple(r[names.index(c)] for c in columns) for r in result.fetchall()])


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["video_id", "score", "sparse_rank", "dense_rank"]
    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
