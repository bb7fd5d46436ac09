"""The operators that SQL can express, held against it on whole tables."""

import os

import duckdb
import pytest

from textloom.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    cur = con.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    df = q.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall())
