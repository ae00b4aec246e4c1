"""Small plan shapes shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lit_or(col) -> Column:
    return col if isinstance(col, Column) else F.lit(col)


def rows_of(df: DataFrame, names: Sequence[str], rows: Sequence[Sequence], keep: Sequence[str] = ()) -> DataFrame:
    """Turn each input row into several: one per entry of `rows` (literals or columns)."""
    structs = [F.struct(*[lit_or(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return df.select(*keep, F.inline(F.array(*structs)))


def matching(df: DataFrame, names: Sequence[str], rules: Sequence[tuple], keep: Sequence[str] = ()) -> DataFrame:
    """One output row per rule that a row meets; a rule is (condition, values...).

    A single scan replaces one scan per rule.
    """
    structs = [
        F.when(cond, F.struct(*[lit_or(v).alias(n) for n, v in zip(names, values)])) for cond, *values in rules
    ]
    return df.select(*keep, F.explode(F.filter(F.array(*structs), lambda s: s.isNotNull())).alias("_r")).select(
        *keep, "_r.*"
    )


def first_match(rules: Sequence[tuple], otherwise=None) -> Column:
    """CASE over (condition, value) pairs."""
    out = None
    for cond, value in rules:
        out = F.when(cond, lit_or(value)) if out is None else out.when(cond, lit_or(value))
    return out if otherwise is None else out.otherwise(lit_or(otherwise))


def over_all() -> Window:
    """Window over a whole frame; only for frames already reduced to a bounded number of rows."""
    return Window.partitionBy()


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First `k` rows per key.

    The rank filter is planned as a partial limit before the shuffle, so a hot
    key sends at most `k` rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)


def bounded_list(
    df: DataFrame, keys: Sequence[str], value: str, k: int, sep: str, name: str,
    order: Sequence[Column] | None = None, order_cols: Sequence[str] = (),
) -> DataFrame:
    """Per key, the first `k` distinct values as one string (keys, name).

    Values are de-duplicated and cut to `k` before they are collected. An
    `order` other than by value names the extra columns it reads.
    """
    distinct = df.where(F.col(value).isNotNull()).select(*keys, value, *order_cols).distinct()
    ranked = top_per_key(distinct, keys, order or [F.col(value)], k)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.col(value).cast("string").alias("v")))), lambda s: s["v"]), sep)
    return ranked.groupBy(*keys).agg(joined.alias(name))


def value_rows(rows: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Distinct (keys, lista, valor): the values of several lists as rows, for keys of any size."""
    flat = rows.select(*keys, *[c.cast("string").alias(f"_l{i}") for i, c in enumerate(values.values())]).distinct()
    entries = [F.struct(F.lit(name).alias("lista"), F.col(f"_l{i}").alias("valor")) for i, name in enumerate(values)]
    return flat.select(*keys, F.inline(F.array(*entries))).where(F.col("valor").isNotNull()).distinct()


def whole_lists(rows: DataFrame, keys: Sequence[str], lists: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """Per key, all distinct values of several columns in order, each as one string (NULL without values).

    A value reaches the task of its key once, however often it occurs.
    """
    long = value_rows(rows, keys, {name: c for name, (c, _) in lists.items()})
    gathered = {name: F.array_sort(F.collect_list(F.when(F.col("lista") == name, F.col("valor")))) for name in lists}
    return long.groupBy(*keys).agg(*[F.when(F.size(g) > 0, F.array_join(g, lists[name][1])).alias(name) for name, g in gathered.items()])


def listed(lists: Mapping[str, tuple[Column, str]]) -> list[Column]:
    """`whole_lists` as aggregates, for the few keys of a report that is cut already: one pass over their rows for all lists.

    Values are gathered map-side in sets, so one reaches the task of its key once from every task that met it.
    """
    return [
        F.when(F.size(g := F.array_sort(F.collect_set(c.cast("string")))) > 0, F.array_join(g, sep)).alias(name) for name, (c, sep) in lists.items()
    ]


def leading_list(df: DataFrame, value: str, k: int, sep: str, order: Sequence[Column] | None = None) -> Column:
    """First `k` rows of the whole frame by `order` (default: the value) as one string, usable as a column.

    The cut is a distributed top-k; only its `k` rows are joined to a text.
    """
    order = order or [F.col(value)]
    w = Window.orderBy(*order)
    best = df.where(F.col(value).isNotNull()).orderBy(*order).limit(k).withColumn("_rn", F.row_number().over(w))
    entries = F.collect_list(F.struct("_rn", F.col(value).cast("string").alias("v")))
    return best.agg(F.array_join(F.transform(F.array_sort(entries), lambda s: s["v"]), sep)).scalar()


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join whose keys may be NULL; key columns come from the left side."""
    r = right.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(r, cond, how).drop(*[f"_k_{k}" for k in keys])


def distinct_count(df: DataFrame, keys: Sequence[str], values: Sequence, name: str) -> DataFrame:
    """Per key the number of distinct combinations without a NULL.

    Distinct first and counted then, so each count reads and shuffles its own
    columns only and no row is copied for the other counts of a report.
    """
    cols = [lit_or(F.col(v) if isinstance(v, str) else v).alias(f"_v{i}") for i, v in enumerate(values)]
    known = df.select(*keys, *cols).dropna(subset=[f"_v{i}" for i in range(len(cols))])
    return known.distinct().groupBy(*keys).agg(F.count("*").alias(name))


def with_distinct_counts(report: DataFrame, df: DataFrame, keys: Sequence[str], counts: Mapping[str, Sequence]) -> DataFrame:
    """A report with one row per key and the distinct counts of `df`, 0 where there is nothing to count."""
    for name, values in counts.items():
        report = join_on(report, distinct_count(df, keys, values, name), keys).withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return report


def number_of_values(df: DataFrame, value: Column) -> Column:
    """How many different values a column of a whole frame has, NULL aside; distinct first and counted then."""
    return df.select(value.alias("_v")).where(F.col("_v").isNotNull()).distinct().agg(F.count("*")).scalar()


# Copies of the smaller side of a salted join.
SALTS = 16


def salted_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join with a table of one row per key, where few keys (or NULL) hold most rows.

    Rows are dealt by a hash of `by` to SALTS copies of the table's rows, so
    those of one key meet it in as many tasks.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def only(rows: DataFrame, top: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is among the few rows of `top` (a limited frame, hence safe to broadcast)."""
    few = F.broadcast(top.select(*[F.col(k).alias(f"_k_{k}") for k in keys]))
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return rows.join(few, cond, "left_semi")


def ranked(df: DataFrame, by: str, keys: Sequence[str], limit: int) -> DataFrame:
    """Top `limit` rows by a figure, ties broken by key."""
    return df.orderBy(F.col(by).desc(), *[F.col(k).asc_nulls_first() for k in keys]).limit(limit)
