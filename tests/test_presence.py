"""Presence as bit masks, long calendars, and reports from one stored table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabulario.functions.bits import Mask
from tabulario.operators import sales
from tabulario.plans.intervals import join_intervals
from tabulario.sources.fixtures import SALES_DAYS, SALES_PERIODS, SALES_WHOLE
from tabulario.sources.periods import Periods
from tabulario.sources.sinks import TableStore


@pytest.mark.parametrize("n", [1, 2, 3, 28, 63, 64, 130])
def test_masks_against_sets(spark, n):
    rng = random.Random(n)
    sets = [{1}, {n}, set(range(1, n + 1)), *[set(rng.sample(range(1, n + 1), rng.randint(1, n))) for _ in range(20)]]
    rows = spark.createDataFrame([(k, i) for k, s in enumerate(sets) for i in sorted(s) * rng.randint(1, 2)], "k int, i int")
    m = Mask.of("m", n)
    got = rows.groupBy("k").agg(*Mask.gather(F.col("i"), n, "m")).select(
        "k", m.members().alias("members"), m.first().alias("first"), m.last().alias("last"), m.size().alias("size"), m.full().alias("full"), m.only(1).alias("only"),
        m.has(n).alias("has"), m.text().alias("text"), m.gapless().alias("gapless"), m.absent().members().alias("absent"),
        m.without(m.earlier()).members().alias("ends"), m.earlier().members().alias("earlier"), m.absent().empty().alias("nothing"),
    ).collect()
    assert len(got) == len(sets)
    for r in got:
        s = sets[r.k]
        every = set(range(1, n + 1))
        assert r.members == sorted(s) and (r["first"], r["last"], r["size"]) == (min(s), max(s), len(s))
        assert (r.full, r.only, r.has, r.nothing) == (s == every, s == {1}, n in s, s == every)
        assert r.text == "".join("1" if i in s else "0" for i in range(1, n + 1))
        assert r.gapless == (len(s) == max(s) - min(s) + 1)
        assert r.absent == sorted(every - s) and r.ends == sorted(i for i in s if i + 1 not in s) and r.earlier == sorted(i - 1 for i in s if i > 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def days(n):
    return Periods.of(*[(str(i), d := (dt.date(1995, 1, 1) + dt.timedelta(days=i)).isoformat(), d) for i in range(n)])


def test_a_long_calendar_does_not_make_a_longer_plan(spark, tables):
    short, long = (plan_of(sales.distinct_products(tables.ventas, days(n))) for n in (100, 2000))
    assert len(long) <= len(short) + 200
    assert "CartesianProduct" not in long and "NestedLoop" not in long
    assert "GreaterThanOrEqual(l_shipdate" in long or "l_shipdate" in long


def test_long_and_short_calendars_agree(spark, tables, monkeypatch):
    report = lambda: sorted(map(tuple, sales.org_quarter_metrics(tables.ventas, SALES_WHOLE).collect()), key=repr)
    want = report()
    monkeypatch.setattr("tabulario.sources.periods.CASES", 5)
    assert report() == want
    assert sales.distinct_products(tables.ventas, SALES_DAYS).count() > 1000


def test_last_day_of_a_period_in_a_long_calendar(spark, monkeypatch):
    monkeypatch.setattr("tabulario.sources.periods.CASES", 0)
    periods = Periods.of(("A", "2025-01-01", "2025-03-31"), ("B", "2025-04-01", "2025-04-01"), ("C", "2025-06-01", "2026-06-30"))
    moments = [dt.datetime(2025, 3, 31), dt.datetime(2025, 3, 31, 0, 1), dt.datetime(2025, 4, 1, 9), dt.datetime(2025, 5, 1), dt.datetime(2026, 6, 30, 23), dt.datetime(2024, 12, 31), None]
    df = spark.createDataFrame([(m,) for m in moments], "t timestamp_ntz")
    assert sorted(r.trimestre for r in periods.tag(df, "t").collect()) == ["A"]
    assert sorted(r.trimestre for r in periods.tag(df, "t", inclusive_end=True).collect()) == ["A", "A", "B", "C"]
    assert sorted(r.trimestre for r in periods.tag(df.select(F.to_date("t").alias("t")), "t").collect()) == ["A", "A", "B", "C"]


def test_intervals_against_all_pairs(spark):
    rng = random.Random(4)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    intervals = [(i, day(a), day(a + rng.choice([0, 1, 30, 400, -2]))) for i, a in enumerate(rng.choices(range(-500, 500), k=60))] + [(99, None, day(3))]
    moments = [(i, day(rng.randint(-600, 1000))) for i in range(200)] + [(500, None)]
    left, right = spark.createDataFrame(moments, "r int, t date"), spark.createDataFrame(intervals, "i int, a date, b date")
    for closed in (True, False):
        want = {(r, i) for r, t in moments for i, a, b in intervals if t and a and a <= t and (t <= b if closed else t < b)}
        for width in (None, 1, 50):
            joined = join_intervals(left, right, "t", "a", "b", width, closed)
            assert "NestedLoop" not in plan_of(joined) and "Cartesian" not in plan_of(joined)
            got = [(r.r, r.i) for r in joined.collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_the_bundle_reads_the_sales_once(spark, tables, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    bundle = sales.presence_bundle(store, tables.ventas, SALES_PERIODS)
    assert set(bundle) == set(sales.PRESENCE_REPORTS)
    for name, df in bundle.items():
        assert "lineitem" not in plan_of(df)
        alone = getattr(sales, name)(tables.ventas, SALES_PERIODS)
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, alone.select(df.columns).collect()), key=repr)
