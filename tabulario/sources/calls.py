"""Normalisation of the raw call log.

Dates arrive as dd/mm/yyyy text and times as text with a dummy base date;
everything downstream works on a date and seconds of the day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulario.sources.schemas import LLAMADAS


def parse_date(text: Column) -> Column:
    """dd/mm/yyyy text as a date, NULL when it is not one."""
    return F.try_to_date(text, "dd/MM/yyyy")


def _second_of_day(text: Column) -> Column:
    def part(at: int) -> Column:
        return F.substring(text, at, 2).try_cast("int")

    return part(12) * 3600 + part(15) * 60 + part(18)


def normalise(crudas: DataFrame) -> DataFrame:
    """Typed call log; keeps `trimestre` when the raw rows carry it, adds the insertion date."""
    typed = crudas.withColumns({
        "fecha": parse_date(F.col("fecha")),
        "hora_inicio_seg": _second_of_day(F.col("hora_inicio")),
        "hora_fin_seg": _second_of_day(F.col("hora_fin")),
    })
    extra = [c for c in ("trimestre",) if c in crudas.columns]
    inserted = parse_date(F.left(F.col("fecha_inserta"), F.lit(10))).alias("fecha_inserta")
    return typed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LLAMADAS], *extra, inserted)


def union_quarters(tables: dict[str, DataFrame]) -> DataFrame:
    """One dataset from structurally equal quarterly tables, each row tagged with its quarter."""
    tagged = [df.withColumn("trimestre", F.lit(label)) for label, df in tables.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out
