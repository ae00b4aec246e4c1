"""The most frequent groups of a frame without counting all of its groups.

Rows are first counted in a fixed number of cells by a hash of the group, so a
task sends at most CELLS counts, however many groups it meets. A cell's count
bounds the count of every group in it. The groups of the fullest cells are
counted exactly; the k-th largest of these counts is a floor, and no group of a
cell below the floor can be among the first k. So an exact count over the groups
of the remaining cells, ties included, gives the answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 16
# Cells looked into for the floor: this many for each group asked for.
FIRST_LOOK = 4


def frequent_groups(rows: DataFrame, keys: Sequence[str], name: str, k: int, cells: int = CELLS) -> DataFrame:
    """`keys` and their number of rows for the `k` most frequent groups and all that tie with the last of them.

    NULL is a group like any other. Fewer than `k` groups are all returned.
    """
    cell = F.pmod(F.xxhash64(*keys), F.lit(cells))
    dealt = rows.withColumn("_cell", cell)
    loads = dealt.groupBy("_cell").agg(F.count("*").alias("_load"))  # at most `cells` rows

    def counted(some: DataFrame) -> DataFrame:
        return dealt.join(F.broadcast(some.select("_cell")), "_cell", "left_semi").groupBy(*keys).agg(F.count("*").alias(name))

    fullest = loads.orderBy(F.col("_load").desc(), "_cell").limit(FIRST_LOOK * k)
    best = counted(fullest).orderBy(F.col(name).desc()).limit(k)
    # Without k groups in the fullest cells there is no floor.
    floor = best.agg(F.when(F.count("*") == k, F.min(name)).otherwise(F.lit(0).cast("bigint"))).scalar()
    return counted(loads.where(F.col("_load") >= floor)).where(F.col(name) >= floor)


def most_frequent(rows: DataFrame, keys: Sequence[str], name: str, k: int, ties: Sequence[Column] | None = None, cells: int = CELLS) -> DataFrame:
    """The first `k` of `frequent_groups`, ties broken by key unless `ties` says otherwise."""
    order = ties if ties is not None else [F.col(c).asc_nulls_first() for c in keys]
    return frequent_groups(rows, keys, name, k, cells).orderBy(F.col(name).desc(), *order).limit(k)
