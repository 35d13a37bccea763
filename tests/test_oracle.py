"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from palimpsest import queries as q


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def _plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query(spark, duck, sf_dir, name):
    df = q.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = duck.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = _plain(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    assert _plain(tuple(r[c] for c in columns) for r in df.collect()) == want
