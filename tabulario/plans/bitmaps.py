"""Exact distinct counts that can be stored and merged: bitmaps of dense codes.

The values of a column get codes without gaps, dealt in buckets of BITS places,
and a group's values become one bitmap for each bucket that it touches. Bitmaps
of days merge to those of weeks, months and years by a bitwise or, and any
number of groupings is counted from the same stored table without looking at the
rows again. A bitmap has 4 KB, so this pays for groups with many values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Places of a bitmap (fixed by the bitmap functions).
BITS = 32768
# Values dealt to a bucket on average; more than BITS of them overflow into buckets of their own.
PER_BUCKET = 1 << 14


def dictionary(df: DataFrame, column: str, values: int | None = None) -> DataFrame:
    """(column, _bucket, _place) for every value of a column, NULL aside; each place of a bucket is given once.

    Codes are stable for the same set of values. `values`, their number or a
    guess of it, spares the count.
    """
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    buckets = max(1, -(-(distinct.count() if values is None else values) // PER_BUCKET))
    dealt = distinct.withColumn("_first", F.pmod(F.xxhash64(column), F.lit(buckets)))
    # A bucket's values are few, so numbering them is a small sort.
    number = F.row_number().over(Window.partitionBy("_first").orderBy(column)) - 1
    return dealt.withColumn("_number", number).select(
        column, (F.col("_first") + F.lit(buckets) * F.floor(F.col("_number") / BITS)).alias("_bucket"), (F.col("_number") % BITS).cast("bigint").alias("_place"),
    )


def bitmaps(df: DataFrame, keys: Sequence[str], column: str, codes: DataFrame) -> DataFrame:
    """(keys, _bucket, bitmap) of the values of `column` per key; codes of values that were not in the dictionary are missing."""
    return df.select(*keys, column).join(codes, column).groupBy(*keys, "_bucket").agg(F.bitmap_construct_agg("_place").alias("bitmap"))


def merged(parts: DataFrame, keys: Sequence) -> DataFrame:
    """Bitmaps of coarser keys."""
    return parts.groupBy(*keys, "_bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def counted(parts: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Distinct values per key, from its merged bitmaps."""
    return parts.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).alias(name))
