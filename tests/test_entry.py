"""The registry: every query has a callable, and comparisons name known queries only."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tomeline import plans

SF = "/root/testdata/sf0.001"


def test_registry(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and all(callable(f) for f in names.values())
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    found = plans.queries()[name](spark, SF)
    want = duck.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in found.collect()) == sorted(map(repr, want.fetchall()))
