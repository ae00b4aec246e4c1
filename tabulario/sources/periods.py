"""Analysis periods: a driver-known calendar.

A short calendar is compiled into a CASE expression instead of a join, so tagging
a row costs no shuffle and no broadcast. A long one, of days over decades, say,
would make a plan that grows with it; its rows are joined by day buckets
(`plans.intervals`). Either way the outer date bounds reach the Parquet reader as
a pushed-down filter.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulario.plans.intervals import bucket_of, in_buckets

# Calendars of up to this many periods become expressions.
CASES = 64
# Longer ones of up to this many are broadcast, some 40 bytes a period.
BROADCAST_PERIODS = 1_000_000


@dataclass(frozen=True)
class Period:
    trimestre: str
    inicio: dt.date
    fin: dt.date


class Periods(Sequence):
    """Ordered, non-overlapping periods; any number of them."""

    def __init__(self, periods: Sequence[Period]):
        self._periods = tuple(periods)
        if not self._periods:
            raise ValueError("at least one period is needed")
        if len({p.trimestre for p in self._periods}) != len(self._periods):
            raise ValueError("period labels must be unique")
        by_start = sorted(self._periods, key=lambda p: p.inicio)
        for p in by_start:
            if p.fin < p.inicio:
                raise ValueError(f"{p.trimestre} ends before it starts")
        for a, b in zip(by_start, by_start[1:]):
            if b.inicio <= a.fin:
                raise ValueError(f"{a.trimestre} and {b.trimestre} overlap")

    @classmethod
    def of(cls, *triples: tuple[str, str, str]) -> "Periods":
        day = dt.date.fromisoformat
        return cls([Period(label, day(a), day(b)) for label, a, b in triples])

    def __len__(self) -> int:
        return len(self._periods)

    def __getitem__(self, i):
        return self._periods[i]

    @property
    def labels(self) -> list[str]:
        return [p.trimestre for p in self._periods]

    def _inside(self, when: Column, p: Period, inclusive_end: bool) -> Column:
        if inclusive_end:
            return (when >= F.lit(p.inicio)) & (when < F.lit(p.fin + dt.timedelta(days=1)))
        return (when >= F.lit(p.inicio)) & (when <= F.lit(p.fin))

    def label_of(self, when: Column, inclusive_end: bool = False) -> Column:
        """Label of the period holding `when`, NULL outside all of them.

        A timestamp on the last day is outside (the closing bound is its
        midnight) unless `inclusive_end` is set; dates are not affected.
        """
        return F.coalesce(*[F.when(self._inside(when, p, inclusive_end), F.lit(p.trimestre)) for p in self])

    def order_of(self, trimestre: Column) -> Column:
        return F.coalesce(*[F.when(trimestre == p.trimestre, F.lit(i)) for i, p in enumerate(self, 1)])

    def start_of(self, trimestre: Column) -> Column:
        return F.coalesce(*[F.when(trimestre == p.trimestre, F.lit(p.inicio)) for p in self])

    def end_of(self, trimestre: Column) -> Column:
        return F.coalesce(*[F.when(trimestre == p.trimestre, F.lit(p.fin)) for p in self])

    def tag(self, df: DataFrame, date_col: str, inclusive_end: bool = False) -> DataFrame:
        """Rows inside some period, with their `trimestre`."""
        when = F.col(date_col)
        if len(self) <= CASES:
            keep = reduce(lambda a, b: a | b, [self._inside(when, p, inclusive_end) for p in self])
            return df.where(keep).withColumn("trimestre", self.label_of(when, inclusive_end))
        outer = Period("", min(p.inicio for p in self), max(p.fin for p in self))
        width = max(1, -(-sum((p.fin - p.inicio).days + 1 for p in self) // len(self)))
        bounds = self.frame(df.sparkSession).select("trimestre", F.col("inicio").alias("_inicio"), F.col("fin").alias("_fin"))
        places = self._small(in_buckets(bounds, "_inicio", "_fin", width))
        upper = when < F.date_add("_fin", 1) if inclusive_end else when <= F.col("_fin")
        rows = df.where(self._inside(when, outer, inclusive_end)).withColumn("_day", bucket_of(when, width))
        joined = rows.join(places, (F.col("_day") == F.col("_bucket")) & (when >= F.col("_inicio")) & upper)
        return joined.select(*df.columns, "trimestre")

    def _small(self, calendar: DataFrame) -> DataFrame:
        return F.broadcast(calendar) if len(self) <= BROADCAST_PERIODS else calendar

    def numbered(self, df: DataFrame, name: str) -> DataFrame:
        """Tagged rows with the place of their period in the calendar, from 1 on."""
        if len(self) <= CASES:
            return df.withColumn(name, self.order_of(F.col("trimestre")))
        order = self.frame(df.sparkSession).select(F.col("trimestre").alias("_label"), F.col("orden").alias(name))
        return df.join(self._small(order), F.col("trimestre") == F.col("_label")).drop("_label")

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p.trimestre, p.inicio, p.fin, i) for i, p in enumerate(self, 1)]
        return spark.createDataFrame(rows, "trimestre string, inicio date, fin date, orden int")
