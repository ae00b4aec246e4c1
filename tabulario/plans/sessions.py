"""Daily sessions and their steps.

A session is every row of one caller on one day, normally a handful; one caller
may however hold a large part of the log. So all sessions are put together in
two levels: rows are grouped per slot, that is per second and block of row ids,
and slots per session. A slot has a bounded number of ids whatever the size of
the session, and slots are in the order of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION = ("numero_entrada", "fecha")
# Row ids of a block: 2 to this power.
BLOCK_BITS = 12
_SLOT = ("_at", "_block")


def _slotted(df: DataFrame, at: Column) -> DataFrame:
    return df.withColumns({"_at": at, "_block": F.shiftright("idRe", BLOCK_BITS)})


def _joined(entries: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(entries), lambda e: e["t"]), sep)


def _text(order: Column, step: Column, sep: str) -> Column:
    """Known steps in order as one text; empty without any (aggregate)."""
    return _joined(F.collect_list(F.when(step.isNotNull(), F.struct(order.alias("o"), step.alias("t")))), sep)


def sessions(
    df: DataFrame,
    at: Column,
    keys: Sequence[str] = SESSION,
    step: Column | None = None,
    sep: str = " → ",
    sums: Mapping[str, Column] | None = None,
    sets: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    maxs: Mapping[str, Column] | None = None,
    firsts: Mapping[str, Column] | None = None,
    lists: Mapping[str, tuple[Column, str]] | None = None,
) -> DataFrame:
    """One row per session: `n` rows, optional `journey` text in time order and partial figures.

    sums/mins/maxs aggregate a value, sets count distinct values, lists join
    the distinct values in order (NULL without any), firsts take the earliest
    known value; ties go by idRe.
    """
    sums, sets, mins, maxs, firsts, lists = (dict(x or {}) for x in (sums, sets, mins, maxs, firsts, lists))
    collected = [*sets, *lists]
    order = F.struct("_at", "idRe")

    partial = [F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()]]
    partial += [F.min(c).alias(k) for k, c in mins.items()] + [F.max(c).alias(k) for k, c in maxs.items()]
    partial += [F.collect_set(c).alias(k) for k, c in sets.items()] + [F.collect_set(c).alias(k) for k, (c, _) in lists.items()]
    partial += [F.min(F.when(c.isNotNull(), F.struct(order.alias("o"), c.alias("v")))).alias(k) for k, c in firsts.items()]
    merge = [F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in sums], *[F.min(k).alias(k) for k in [*mins, *firsts]], *[F.max(k).alias(k) for k in maxs]]
    merge += [F.array_distinct(F.flatten(F.collect_list(k))).alias(k) for k in collected]
    if step is not None:
        partial.append(_text(order, step, sep).alias("journey"))
        merge.append(_text(F.struct(*_SLOT), F.nullif("journey", F.lit("")), sep).alias("journey"))

    grouped = _slotted(df, at).groupBy(*keys, *_SLOT).agg(*partial).groupBy(*keys).agg(*merge)

    final = {k: F.size(k).cast("bigint") for k in sets} | {k: F.col(k)["v"] for k in firsts}
    final |= {k: F.when(F.size(k) > 0, F.array_join(F.array_sort(k), s)) for k, (_, s) in lists.items()}
    if step is not None:
        final["journey"] = F.nullif("journey", F.lit(""))
    return grouped.withColumns(final) if final else grouped


def steps(df: DataFrame, at: Column, keys: Sequence[str] = SESSION, carry: Sequence[str] = ("idRe",)) -> DataFrame:
    """Rows with `paso` (1-based position), `pasos` (session length) and `anterior` (struct of `carry` of the row before).

    The earliest row of a session has a NULL `anterior`. Position and the row
    before are taken inside the slot, and across slots from their counts and
    last rows.
    """
    scope = [*keys, *_SLOT]
    held, order = F.struct(*[F.col(c) for c in carry]), F.struct("_at", "idRe")
    rows = _slotted(df, at)
    inside = Window.partitionBy(*scope).orderBy("idRe")
    numbered = rows.withColumns({"paso": F.row_number().over(inside).cast("bigint"), "anterior": F.lag(held).over(inside)})

    slots = rows.groupBy(*scope).agg(F.count("*").alias("_n"), F.max(F.struct(order.alias("o"), held.alias("h"))).alias("_last"))
    whole = Window.partitionBy(*keys)
    by_slot = whole.orderBy(*_SLOT)
    slots = slots.select(
        *[F.col(k).alias(f"_k_{k}") for k in scope],
        F.coalesce(F.sum("_n").over(by_slot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("pasos"), F.lag(F.col("_last")["h"]).over(by_slot).alias("_last_before"),
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in scope])
    out = numbered.join(slots, same).withColumns({
        "anterior": F.when(F.col("paso") == 1, F.col("_last_before")).otherwise(F.col("anterior")), "paso": F.col("_before") + F.col("paso"),
    })
    return out.select(*df.columns, "paso", "anterior", "pasos")
