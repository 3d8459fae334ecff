"""Every query with SQL returns what DuckDB returns for it, on the smallest tables."""

import difflib
import os

import duckdb
import pytest

from sedgeline.catalog import ORACLE_SQL, QUERIES
from sedgeline.plans.views import view

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    return None if v != v else round(float(v), 6)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = sorted((tuple(_plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    b = sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


def test_close_spellings_of_the_query(spark):
    """Every fiftieth key against all pairs of plain Python; test_dendrogram has the other query without SQL."""
    assert set(QUERIES) - set(ORACLE_SQL) == {"close_spellings", "leaf_orders"}
    keys = {r.id: r.key for r in view(spark, DATA, "spellings").collect()}
    every = sorted(set(keys.values()))
    want = set()
    for k in {k for i, k in keys.items() if i % 50 == 0}:
        same = [x for x in every if x.split()[:1] == k.split()[:1]]
        want |= {(k, other, place) for place, other in enumerate(difflib.get_close_matches(k, same, n=3, cutoff=0.9), 1)}
    got = QUERIES["close_spellings"](spark, DATA).collect()
    assert {(r.key, r.other, r.place) for r in got} == want and len(got) == len(want)
