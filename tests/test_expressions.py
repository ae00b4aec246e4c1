"""Rounding, calendar and text rules."""

import datetime as dt
from decimal import Decimal, ROUND_HALF_UP

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulario.functions.exact import deviation, mean, mean_of_rounded, ratio, variance
from tabulario.functions.labels import comma_count, entries
from tabulario.functions.text import clock, clock_full, day_name, hour_of, month_name, stamp, week_from_monday, week_from_sunday, week_index, whole_minutes


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("num, den, digits, expected", [
    (1, 3, 2, 33.33), (2, 3, 2, 66.67), (1, 32, 2, 3.13), (201, 20000, 2, 1.01), (-1, 32, 2, -3.13), (0, 5, 2, 0.0), (1, 0, 2, None), (None, 4, 2, None),
])
def test_ratio_rounds_half_away_from_zero(spark, num, den, digits, expected):
    got = one(spark, ratio(F.lit(num).cast("bigint"), F.lit(den).cast("bigint"), digits))[0]
    assert got == expected


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(1, 10**6)), min_size=1, max_size=30))
def test_ratio_equals_exact_decimal(spark, pairs):
    got = spark.createDataFrame(pairs, "n bigint, d bigint").select("n", "d", ratio(F.col("n"), F.col("d")).alias("r")).collect()
    for row in got:
        exact = (Decimal(row.n) * 100 / Decimal(row.d)).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert row.r == float(exact)


def test_spread_is_of_the_population(spark):
    df = spark.createDataFrame([(2,), (4,), (4,), (4,), (5,), (5,), (7,), (9,), (None,)], "x bigint")
    row = df.agg(deviation(F.col("x")).alias("d"), variance(F.col("x")).alias("v"), mean(F.col("x"), 1).alias("m")).first()
    assert (row.d, row.v, row.m) == (2.0, 4.0, 5.0)


def test_variance_survives_values_beyond_the_exact_sums(spark):
    df = spark.range(100).select(F.when(F.col("id") % 2 == 0, 10**17).otherwise(10**17 + 2).cast("bigint").alias("x"))
    big = spark.range(4).select((F.col("id") * 300_000_000_000_000_000).cast("bigint").alias("x"))
    assert df.agg(variance(F.col("x"))).first()[0] == pytest.approx(1.0, abs=1.0)
    assert big.agg(deviation(F.col("x"))).first()[0] == pytest.approx(3.354e17, rel=1e-3)


def test_mean_of_rounded_figures(spark):
    df = spark.createDataFrame([(50.25,), (50.26,), (None,)], "x double")
    assert df.agg(mean_of_rounded(F.col("x"))).first()[0] == 50.26


# MariaDB: WEEK(d), WEEK(d, 1)
@pytest.mark.parametrize("day, sunday, monday", [
    ("2024-01-01", 0, 1), ("2024-01-06", 0, 1), ("2024-01-07", 1, 1), ("2024-01-08", 1, 2), ("2023-01-01", 1, 0), ("2023-01-02", 1, 1),
    ("2024-12-30", 52, 53), ("2021-01-03", 1, 0), ("2020-12-31", 52, 53), ("2022-12-31", 52, 52),
])
def test_week_numbers(spark, day, sunday, monday):
    d = F.lit(day).cast("date")
    assert tuple(one(spark, week_from_sunday(d), week_from_monday(d))) == (sunday, monday)


def test_week_index_is_continuous_over_new_year(spark):
    a, b, c = (F.lit(x).cast("date") for x in ("2023-12-31", "2024-01-06", "2024-01-07"))
    first, same, following = one(spark, week_index(a), week_index(b), week_index(c))
    assert same == first and following == first + 1


def test_clock_names_and_minutes(spark):
    d = F.lit(dt.date(2024, 2, 29))
    row = one(spark, clock(F.lit(34163)), clock_full(F.lit(34163)), clock_full(F.lit(-1)), hour_of(F.lit(-1)), day_name(d), month_name(d),
              whole_minutes(F.lit(119)), whole_minutes(F.lit(-119)), stamp(F.lit(dt.datetime(2024, 1, 2, 3, 4, 5, 678)).cast("timestamp_ntz")))
    assert tuple(row) == ("09:29", "09:29:23", "23:59:59", 23, "Thursday", "February", 1, -1, "2024-01-02 03:04:05")


@pytest.mark.parametrize("text, labels, commas", [
    ("2L,ZMB,VSI,NVS,", ["2L", "ZMB", "VSI", "NVS"], 5), ("1L,ZMB,DG,WTS,VSI,", ["1L", "ZMB", "DG", "WTS", "VSI"], 6),
    ("NoTmx_SOMC,NoTmx_SOMC,", ["NoTmx_SOMC", "NoTmx_SOMC"], 3), ("ZMB,WTS,TELCO,,", ["ZMB", "WTS", "TELCO"], 5), (" ZMB , MGC ", ["ZMB", "MGC"], 2),
    ("", None, 1), (None, None, None), (",,", None, 3), (",".join(f"E{i}" for i in range(40)), [f"E{i}" for i in range(40)], 40),
])
def test_label_lists(spark, text, labels, commas):
    col = F.lit(text).cast("string")
    got = one(spark, entries(col).alias("e"), comma_count(col).alias("c"))
    assert ([e.etiqueta for e in got.e] if got.e else None) == labels
    if text is not None:
        assert got.c == commas


def test_figures_of_any_size(spark):
    from tabulario.functions.exact import mean, ratio, variance

    big = 9 * 10**18
    df = spark.createDataFrame([(big - i % 3,) for i in range(400)], "v bigint")
    row = df.agg(mean(F.col("v")).alias("m"), variance(F.col("v")).alias("s2"), variance(F.col("v") - big).alias("small")).first()
    assert row.m == float(big - 1) and row.s2 is not None
    assert abs(row.small - 0.665) < 0.01
    wide = spark.sql("select cast('2000000000000000000001' as decimal(24,0)) as a, cast('4000000000000000000000' as decimal(24,0)) as b")
    assert wide.select(ratio(F.col("a"), F.col("b"), 2)).first()[0] == 50.0
    spread = spark.createDataFrame([(10**15 * (-1) ** i,) for i in range(400)] + [(9 * 10**17,)] * 400, "v bigint")
    assert spread.agg(variance(F.col("v"))).first()[0] > 10**35


def test_ratio_rounds_half_away_from_zero(spark):
    from tabulario.functions.exact import ratio

    df = spark.createDataFrame([(1, 8), (-1, 8), (3, 8), (1, 3), (2, 3), (-2, 3), (0, 5), (5, 0), (1, 800), (10**18, 3)], "a bigint, b bigint")
    got = [r[0] for r in df.select(ratio(F.col("a"), F.col("b"), 2, 1)).collect()]
    assert got == [0.13, -0.13, 0.38, 0.33, 0.67, -0.67, 0.0, None, 0.0, 333333333333333333.33]
