"""Rows joined with the intervals that hold their moment, by equality of day buckets.

A range condition alone makes Spark compare every row with every interval. Here
an interval is repeated for each bucket of days that it touches, rows know their
bucket, and the join is an equi join with the bounds as a further condition. With
buckets as wide as the mean interval there are at most about twice as many
bucket rows as intervals, whatever their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_number(when: Column) -> Column:
    return F.unix_date(when.cast("date"))


def bucket_of(when: Column, width: int) -> Column:
    return F.floor(day_number(when) / width).cast("int")


def mean_days(intervals: DataFrame, start: str, end: str) -> int:
    """Mean length of the intervals in days, rounded up; at least 1."""
    length = F.greatest(day_number(F.col(end)) - day_number(F.col(start)) + 1, F.lit(1))
    return max(1, intervals.agg(F.ceil(F.avg(length)).alias("n")).first()["n"] or 1)


def in_buckets(intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """`intervals` once for each bucket that it touches, as `_bucket`; nothing for those that end before they start or lack a bound."""
    inside = intervals.where(F.col(start) <= F.col(end))
    return inside.withColumn("_bucket", F.explode(F.sequence(bucket_of(F.col(start), width), bucket_of(F.col(end), width))))


def join_intervals(
    rows: DataFrame, intervals: DataFrame, when: str, start: str, end: str, width: int | None = None, closed: bool = True, how: str = "inner",
) -> DataFrame:
    """`rows` with the columns of each interval from `start` to `end` that holds `when`.

    `closed` intervals hold their end. Intervals may overlap, and a row then
    comes once for each. Without `width` the mean length is measured. Which side
    is broadcast, if any, is left to the sizes that Spark measures.
    """
    width = width or mean_days(intervals, start, end)
    upper = F.col(when) <= F.col(end) if closed else F.col(when) < F.col(end)
    dealt = rows.withColumn("_day", bucket_of(F.col(when), width))
    condition = (F.col("_day") == F.col("_bucket")) & (F.col(when) >= F.col(start)) & upper
    return dealt.join(in_buckets(intervals, start, end, width), condition, how).drop("_day", "_bucket")
