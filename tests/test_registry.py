"""Registered queries against their oracles."""

import glob
import os

import pytest

import __spark_entry__ as entry_mod
from tabulario import registry

from conftest import SF

duckdb = pytest.importorskip("duckdb")

KEYS = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.queries()) <= set(entry_mod.queries()) and set(registry.oracle_sql()) <= set(entry_mod.oracle_sql())


def test_entry(spark):
    assert entry_mod.entry(spark).count() == 3


def clean(value):
    return round(value, 9) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("key", KEYS)
def test_equals_oracle(spark, duck, key):
    df = registry.queries()[key](spark, SF)
    rel = duck.execute(registry.oracle_sql()[key])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(clean(v) for v in r) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(clean(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == want
