"""Joins of rows with one row per group, where a few groups may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A group with more than 1/PARTS of the rows counts as heavy, so there are fewer than PARTS of them.
PARTS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of `rows` with `groups` (one row per key with its number of rows, `total` in all).

    Heavy groups are fewer than PARTS and so can be broadcast, whatever the
    data; the rows of all others meet their group in a shuffle in which no key
    has more than 1/PARTS of the rows.
    """
    heavy = F.col(size) * PARTS > total
    hot = F.broadcast(groups.where(heavy))
    cold = rows.join(F.broadcast(groups.where(heavy).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(groups.where(~heavy), key))
