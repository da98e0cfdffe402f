from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from palimpsest.plans.oracle import SQL
from palimpsest.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["rev_winners", "changes_pending", "find_mixed_type_compare", "open_revs_latest", "search_fields", "coalesce_fixed"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    places = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in places)) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
