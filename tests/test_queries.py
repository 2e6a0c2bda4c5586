"""Every registered query of the library against its SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from flowlattice.plans import queries as core

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
there = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@there
@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    df = core.queries()[name](spark, DIR)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(core.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = [tuple(r[c] for c in want.columns) for r in df.collect()]
    assert Counter(map(repr, got)) == Counter(map(repr, want.fetchall()))


@there
def test_entry(spark):
    assert entry.entry(spark).count() == 15
    assert set(entry.oracle_sql()) <= set(entry.queries())
