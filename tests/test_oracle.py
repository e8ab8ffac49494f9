"""Every library query against its SQL."""

import os

import duckdb
import pytest

from prismalake.queries import ORACLE_SQL, QUERIES


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{data}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(name, spark, data, con):
    df = QUERIES[name](spark, data)
    want = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == sorted(tuple(plain(r[cols.index(c)]) for c in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() >= 0
