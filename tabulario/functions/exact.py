"""Rounded figures that do not depend on floating point noise.

Counts and integer sums are divided as decimals and rounded half away from
zero, which is what the analyses expect from a decimal SQL engine.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


# Holds sums of a million times as many rows as a bigint sum.
WIDE = "decimal(24,0)"


def ratio(num: Column, den: Column, digits: int = 2, scale: int = 100) -> Column:
    """`scale * num / den` of two counts of any size, rounded half away from zero; NULL for an empty denominator."""
    return wide_ratio(num, den, digits, scale)


def wide_ratio(num: Column, den: Column, digits: int = 2, scale: int = 100) -> Column:
    """`scale * num / den` of two sums, rounded half away from zero, in decimals of 24 digits; NULL for an empty denominator."""
    n = num.cast(WIDE) * F.lit(Decimal(scale * 10**digits))
    d = F.nullif(den.cast(WIDE), F.lit(Decimal(0)))
    rest = n % d
    up = F.when(F.abs(rest) * 2 >= F.abs(d), F.signum(n) * F.signum(d)).otherwise(F.lit(0.0)).cast("decimal(2,0)")
    return (((n - rest) / d + up) / F.lit(Decimal(10**digits))).cast("double")


def mean(col: Column, digits: int = 2) -> Column:
    """Rounded average of an integer column (aggregate)."""
    return wide_ratio(F.sum(col.cast(WIDE)), F.count(col), digits, 1)


def mean_of(total: Column, count: Column, digits: int = 2) -> Column:
    """Rounded average from a sum and a count."""
    return wide_ratio(total, count, digits, 1)


def share(cond: Column, digits: int = 2) -> Column:
    """Percentage of the group's rows that meet a condition (aggregate)."""
    return ratio(F.count_if(cond), F.count(F.lit(1)), digits)


def variance(col: Column) -> Column:
    """Population variance (aggregate), from running means, which no size of values or rows outgrows."""
    return F.var_pop(col)


def deviation(col: Column) -> Column:
    """Population standard deviation (aggregate)."""
    return F.stddev_pop(col)


def spread(col: Column) -> Column:
    """Population variance of an integer column times the square of its count, as a whole number (aggregate).

    It does not depend on the order of the rows, as running means do, so it can be held against bounds; decimals of 38 digits, beyond which it fails.
    """
    n = col.cast("decimal(19,0)")
    return F.count(col) * F.sum(n * n) - F.sum(n) * F.sum(n)


def figure(col: Column) -> Column:
    """A floating figure with twelve digits, which is what does not depend on the order of summing."""
    return F.when(col.isNotNull(), F.format_string("%.11e", col).cast("double"))


def cents(col: Column, places: int = 2) -> Column:
    """A figure already rounded to `places` decimals, as an integer number of last digits."""
    return F.round(col * 10**places).cast("bigint")


def mean_of_rounded(col: Column, digits: int = 2, places: int = 2) -> Column:
    """Average of rounded figures without summing doubles (aggregate)."""
    return wide_ratio(F.sum(cents(col, places).cast(WIDE)), F.count(col) * 10**places, digits, 1)


def mean_share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Average of per-row percentages, each kept to four decimals (aggregate)."""
    return mean_of_rounded(ratio(part, whole, 4), digits, 4)
