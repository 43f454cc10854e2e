"""Every registered query that has SQL gives the same rows in both engines (sf0.001)."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def _canon(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_canon, x)) + "]"
    if isinstance(x, dict):
        return _canon(list(x.values()))
    return str(x)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_oracle_has_a_query():
    assert not set(ORACLES) - set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, data, duck, name):
    frame = QUERIES[name](spark, data)
    columns = sorted(frame.columns)
    ours = Counter(tuple(map(_canon, r)) for r in frame.select(*columns).collect())
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(_canon(r[i]) for i in at) for r in result.fetchall())
    assert ours == theirs
