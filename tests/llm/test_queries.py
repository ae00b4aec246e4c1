"""Registered queries: those with SQL against it, the names of all, and the package in the entry module."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from llm.tables import SF
from tabulario.llm import queries, url_filter


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert {*names, "pipeline"} <= set(entry_mod.queries())
    assert set(queries.oracle_sql()) <= set(names) and set(queries.oracle_sql()) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_equals_sql(spark, duck, key):
    df = queries.queries()[key](spark, SF)
    rel = duck.execute(queries.oracle_sql()[key])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


PAGES = "page_id bigint, url string, html string"


def link(to):
    return f'<html><head><LINK href="{to}" rel="canonical"></head></html>'


def test_decisions_reach_aliases(spark, clashing):
    rows = [
        (1, "http://free.example.com/x", link("https://bad.net/a?b=1&amp;c=2#top")),  # an alias of a blocked address
        (2, "http://other.com/y", '<meta http-equiv="refresh" content="0; url=http://free.example.com/x">'),  # an alias of that one
        (3, "http://fine.org/fr/z", link("http://bad.net/a?b=1&c=2")),  # allowed by a rule of its own, in the same component as 1 and 2
        (4, "http://lone.com/", link("http://worse.net/q")),
        (5, "http://lone.com/", None),  # the same address twice
        (6, "http://self.com/p/q", link("../elsewhere")),
        (7, None, link("http://bad.net/")),
        (8, "no scheme", ""),
        (None, "HTTP://EXAMPLE.NET/en/1", ""),
        (9, "http://sub.example.net/en?x", ""),
        (10, "http://example.com/de/", ""), (11, "http://anexample.com/de/", ""), (12, "http://a.net", ""),
    ]
    got = {(r.page_id, r.verdict, r.rule) for r in url_filter.judge(clashing(spark.createDataFrame(rows, PAGES))).collect()}
    assert got == {
        (1, "allow", None), (2, "allow", None), (3, "allow", "org/fr/"), (4, "block", None), (5, "block", None), (6, "allow", None), (7, "allow", None),
        (8, "allow", None), (None, "allow", "example.net/en/"), (9, "block", "net/"), (10, "block", "example.com/de/"), (11, "allow", None), (12, "allow", None),
    }
    assert url_filter.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_components(spark):
    from tabulario.llm.components import components

    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1100)]
    rows = spark.createDataFrame([*chain, *star, (500, 500), (2000, 2001), (2001, 2000)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(rows).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1100)} | {2000: 2000, 2001: 2000}
