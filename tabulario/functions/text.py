"""Column expressions on text and calendar fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# English names, Sunday first; months from January.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


def is_blank(col: Column) -> Column:
    """NULL or ''; whitespace counts as content."""
    return col.isNull() | (col == "")


def filled(col: Column) -> Column:
    return col.isNotNull() & (col != "")


def stamp(col: Column) -> Column:
    """A timestamp as 'yyyy-MM-dd HH:mm:ss' text."""
    return F.left(col.cast("string"), F.lit(19))


def _name(names: Sequence[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index)


def day_name(date: Column, names: Sequence[str] = DAY_NAMES) -> Column:
    return _name(names, F.dayofweek(date))


def month_name(date: Column) -> Column:
    return _name(MONTH_NAMES, F.month(date))


def week_from_sunday(date: Column) -> Column:
    """Week 0-53 of the year, weeks start on Sunday; days before the first Sunday are week 0."""
    return F.floor((F.dayofyear(date) + 7 - F.dayofweek(date)) / 7).cast("int")


def week_from_monday(date: Column) -> Column:
    """Week 0-53 of the year, weeks start on Monday and count when most of their days are in the year."""
    iso, month = F.weekofyear(date), F.month(date)
    return F.when((month == 1) & (iso >= 52), 0).when((month == 12) & (iso == 1), 53).otherwise(iso)


def sorted_set(col: Column, sep: str = ", ") -> Column:
    """Distinct values as one sorted string, NULL without values (aggregate); for small vocabularies."""
    values = F.array_sort(F.collect_set(col))
    return F.when(F.size(values) > 0, F.array_join(values, sep))


def _of_day(seconds: Column) -> Column:
    """Second of the day; a repaired start may lie before midnight."""
    return F.pmod(seconds, F.lit(86400))


def vocabulary(col: Column | str) -> Column:
    """Distinct values of a small vocabulary such as menus, zones or dates (aggregate).

    The values are gathered map-side in a set, one pass for any number of
    columns; several exact distinct counts would copy every row once per column.
    For columns without a bound on their values use `count_distinct`.
    """
    return F.size(F.collect_set(col)).cast("bigint")


def hour_of(seconds: Column) -> Column:
    return F.floor(_of_day(seconds) / 3600).cast("int")


def _wall_clock(seconds: Column) -> Column:
    midnight = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", seconds, midnight).cast("string")


def clock(seconds: Column) -> Column:
    """Second of the day as 'HH:mm'."""
    return F.substring(_wall_clock(seconds), 12, 5)


def clock_full(seconds: Column) -> Column:
    """Second of the day as 'HH:mm:ss'."""
    return F.substring(_wall_clock(seconds), 12, 8)


def week_index(date: Column) -> Column:
    """Consecutive number of the Sunday-based week, continuous over New Year."""
    return F.floor(F.datediff(date, F.lit("1970-01-04").cast("date")) / 7)


def whole_minutes(seconds: Column) -> Column:
    """Complete minutes, cut towards zero."""
    return F.when(seconds < 0, F.ceil(seconds / 60)).otherwise(F.floor(seconds / 60))
