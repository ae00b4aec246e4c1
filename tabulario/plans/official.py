"""Session tables of official rows (caller and dialled number equal)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulario.functions.calls import equal, menu_option, success
from tabulario.functions.text import week_from_sunday, week_index, whole_minutes
from tabulario.plans.sessions import SESSION, sessions


def official(llamadas: DataFrame) -> DataFrame:
    return llamadas.where(equal())


def _minutes(first: Column, last: Column) -> Column:
    return whole_minutes(last - first)


def session_table(llamadas: DataFrame) -> DataFrame:
    """Rows, minutes, success and vocabularies of each official session; plain map-side aggregates."""
    return official(llamadas).groupBy(*SESSION).agg(
        F.count("*").alias("n"), _minutes(F.min("hora_inicio_seg"), F.max("hora_fin_seg")).alias("minutos"),
        F.max(success().cast("int")).alias("exito"), F.collect_set("menu").alias("menus"), F.collect_set("opcion").alias("opciones"),
    )


def journey_table(llamadas: DataFrame) -> DataFrame:
    """Sessions with their journey text and first known menu."""
    s = sessions(
        official(llamadas), F.col("hora_inicio_seg"), step=menu_option(), sets={"menus": F.col("menu")}, firsts={"primer_menu": F.col("menu")},
        mins={"_a": F.col("hora_inicio_seg")}, maxs={"_b": F.col("hora_fin_seg"), "exito": success().cast("int")},
    )
    return s.withColumn("minutos", _minutes(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def success_days(llamadas: DataFrame) -> DataFrame:
    """(caller, date) with a success menu anywhere, and the time of the last one."""
    return llamadas.where(success() & F.col("numero_entrada").isNotNull()).groupBy(*SESSION).agg(F.max("hora_inicio_seg").alias("ultimo_exito"))


def with_week(df: DataFrame) -> DataFrame:
    """Year and week label of the date, and a week number that is continuous over New Year."""
    f = F.col("fecha")
    return df.withColumns({"año": F.year(f), "semana": week_from_sunday(f), "_week": week_index(f)})
