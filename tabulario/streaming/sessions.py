"""Sessions and distinct callers of a growing call log, exact, with state that is given up once a day is closed.

A row belongs to its date, and a date is closed when the watermark has passed
its end; only then are its sessions and counts emitted, each once. State holds
the open days only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulario.functions.calls import equal, menu_option
from tabulario.operators.reports import SESSION_KEYS, clean_interactions
from tabulario.sources.periods import Periods


def _moment(second: Column) -> Column:
    """A row's second within its own date; repaired times may lie before or after it."""
    inside = F.least(F.greatest(second, F.lit(0)), F.lit(86_399))
    return F.timestamp_add("SECOND", inside, F.col("fecha").cast("timestamp"))


def live_sessions(llamadas: DataFrame, periods: Periods, lateness: str = "1 day", gap: str | None = None) -> DataFrame:
    """The rows of `reports.daily_sessions`, as their days close.

    With a `gap`, such as '30 minutes', a session also ends after so long without
    a row, and `sesion` (struct of start and end) tells the sessions of a day
    apart; a row that comes in between joins those that it connects.
    """
    rows = clean_interactions(llamadas, periods).withColumn("inicio", _moment(F.col("hora_inicio_real"))).withWatermark("inicio", lateness)
    scope = F.window("inicio", "1 day") if gap is None else F.session_window("inicio", gap)
    moment = F.struct("hora_inicio_real", "idRe", menu_option().alias("paso"))
    grouped = rows.groupBy(scope.alias("sesion"), *SESSION_KEYS).agg(
        F.count("*").alias("total_interacciones"), F.min("hora_inicio_real").alias("primera_interaccion"), F.max("hora_fin_real").alias("ultima_interaccion"),
        F.collect_list(F.when(menu_option().isNotNull(), moment)).alias("_pasos"), F.collect_set("menu").alias("_m"), F.collect_set("opcion").alias("_o"),
    )
    journey = F.array_join(F.transform(F.array_sort("_pasos"), lambda s: s["paso"]), " → ")
    return grouped.select(
        *([] if gap is None else ["sesion"]), *SESSION_KEYS, "total_interacciones", F.nullif(journey, F.lit("")).alias("journey_navegacion"),
        F.size("_m").cast("bigint").alias("menus_visitados"), F.size("_o").cast("bigint").alias("opciones_diferentes"), "primera_interaccion", "ultima_interaccion",
        (F.col("ultima_interaccion") - F.col("primera_interaccion")).alias("duracion_sesion_seg"),
    )


def live_callers(llamadas: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Distinct callers per day and zone (dia, zona, usuarios_unicos), exact: those of `operations.daily_kpis`.

    A caller is let through once for each open day and zone and counted then, so
    state holds one entry per caller, zone and open day.
    """
    rows = llamadas.withColumn("inicio", _moment(F.col("hora_inicio_seg"))).withWatermark("inicio", lateness)
    official = rows.where(equal() & F.col("id_8T").isNotNull()).select(F.window("inicio", "1 day").alias("w"), F.col("id_8T").alias("zona"), "numero_entrada")
    once = official.dropDuplicates(["w", "zona", "numero_entrada"])
    return once.groupBy("w", "zona").agg(F.count("*").alias("usuarios_unicos")).select(F.to_date("w.start").alias("dia"), "zona", "usuarios_unicos")
