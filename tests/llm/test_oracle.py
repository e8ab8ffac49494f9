"""The operators that SQL can express against their SQL."""

import os

import duckdb
import pytest

from prismalake.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(name, spark, data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{data}/{f}')")
    df = QUERIES[name](spark, data)
    want = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    plain = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())
