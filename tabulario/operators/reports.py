"""Periodic reports of interactions per caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulario.functions.calls import different, end, failed, has_label, inverted, kind, menu_option, raw_seconds, start
from tabulario.functions.exact import deviation, mean, mean_of, mean_of_rounded, ratio, share
from tabulario.functions.text import month_name, sorted_set, vocabulary, week_from_monday
from tabulario.plans.sessions import sessions
from tabulario.plans.shape import join_on
from tabulario.sources.periods import Periods
from tabulario.sources.sinks import TableStore


def _per_user(digits: int = 2) -> Column:
    return ratio(F.count("*"), F.count_distinct("numero_entrada"), digits, 1)


def daily_average(llamadas: DataFrame) -> DataFrame:
    return llamadas.where(F.col("numero_entrada").isNotNull()).groupBy("fecha").agg(
        F.count_distinct("numero_entrada").alias("usuarios_activos"), F.count("*").alias("total_interacciones"),
        _per_user().alias("promedio_interacciones_por_usuario"), F.min("hora_inicio_seg").alias("primera_interaccion_dia"),
        F.max("hora_fin_seg").alias("ultima_interaccion_dia"), vocabulary("menu").alias("menus_utilizados"),
        vocabulary("id_8T").alias("zonas_activas"))


def daily_average_filtered(llamadas: DataFrame) -> DataFrame:
    """Rows with a menu only, with validated and failed shares."""
    rows = llamadas.where(F.col("numero_entrada").isNotNull() & F.col("menu").isNotNull())
    return rows.groupBy("fecha").agg(
        F.count_distinct("numero_entrada").alias("usuarios_activos"), F.count("*").alias("interacciones_validas"),
        _per_user().alias("promedio_interacciones_por_usuario"), F.count_if(has_label("VSI")).alias("interacciones_validadas"),
        F.count_if(failed()).alias("interacciones_fallidas"), share(has_label("VSI"), 1).alias("pct_validadas"),
        share(failed(), 1).alias("pct_fallidas"))


def _period_average(llamadas: DataFrame, keys: list[Column], unit: str) -> DataFrame:
    users, days = F.count_distinct("numero_entrada"), vocabulary("fecha")
    return llamadas.where(F.col("numero_entrada").isNotNull()).groupBy(*keys).agg(
        days.alias("dias_con_datos"), users.alias(f"usuarios_unicos_{unit}"), F.count("*").alias(f"total_interacciones_{unit}"),
        _per_user().alias(f"promedio_interacciones_usuario_{unit}"), ratio(F.count("*"), users * days, 2, 1).alias(f"promedio_diario_en_{unit}"),
        F.min("fecha").alias("_a"), F.max("fecha").alias("_b"))


def weekly_average(llamadas: DataFrame) -> DataFrame:
    f = F.col("fecha")
    return _period_average(llamadas, [F.year(f).alias("año"), week_from_monday(f).alias("semana")], "semana").withColumnsRenamed(
        {"_a": "primer_dia_semana", "_b": "ultimo_dia_semana"})


def monthly_average(llamadas: DataFrame) -> DataFrame:
    f = F.col("fecha")
    return _period_average(llamadas, [F.year(f).alias("año"), F.month(f).alias("mes"), month_name(f).alias("nombre_mes")], "mes").drop("_a", "_b")


def annual_average(llamadas: DataFrame) -> DataFrame:
    month = F.month("fecha")
    return llamadas.where(F.col("numero_entrada").isNotNull()).groupBy(F.year("fecha").alias("año")).agg(
        vocabulary("fecha").alias("dias_con_datos"), F.count_distinct("numero_entrada").alias("usuarios_unicos_año"),
        F.count("*").alias("total_interacciones_año"), _per_user().alias("promedio_interacciones_usuario_año"),
        *[F.count_if(month.between(3 * q - 2, 3 * q)).alias(f"interacciones_Q{q}") for q in range(1, 5)])


def clean_interactions(llamadas: DataFrame, periods: Periods) -> DataFrame:
    """Rows of the calendar with repaired times and their kind; the quarter follows the date."""
    return periods.tag(llamadas.drop("trimestre"), "fecha").select(
        "idRe", "numero_entrada", "numero_digitado", "fecha", "menu", "opcion", "division", "area", "id_8T", "trimestre",
        start().alias("hora_inicio_real"), end().alias("hora_fin_real"), kind().alias("tipo_llamada"),
        F.when(inverted(), "TIMESTAMP_CORREGIDO").otherwise("TIMESTAMP_ORIGINAL").alias("calidad_dato"))


SESSION_KEYS = ["trimestre", "numero_entrada", "fecha", "tipo_llamada", "id_8T", "division", "area"]


def daily_sessions(llamadas: DataFrame, periods: Periods, journey: bool = True) -> DataFrame:
    rows = clean_interactions(llamadas, periods)
    s = sessions(
        rows, F.col("hora_inicio_real"), SESSION_KEYS, step=menu_option() if journey else None,
        sets={"menus_visitados": F.col("menu"), "opciones_diferentes": F.col("opcion")},
        mins={"primera_interaccion": F.col("hora_inicio_real")}, maxs={"ultima_interaccion": F.col("hora_fin_real")},
    )
    s = s.withColumnsRenamed({"n": "total_interacciones", "journey": "journey_navegacion"})
    return s.withColumn("duracion_sesion_seg", F.col("ultima_interaccion") - F.col("primera_interaccion"))


_ZONE = ["tipo_llamada", "grupo_zonas"]


def _light_sessions(llamadas: DataFrame, periods: Periods) -> DataFrame:
    """Session size and length without the journey; plain map-side aggregates."""
    return clean_interactions(llamadas, periods).groupBy(*SESSION_KEYS).agg(
        F.count("*").alias("n"), (F.max("hora_fin_real") - F.min("hora_inicio_real")).alias("s")
    ).withColumnRenamed("id_8T", "grupo_zonas")


def daily_report(llamadas: DataFrame, periods: Periods) -> DataFrame:
    n = F.col("n")
    return _light_sessions(llamadas, periods).groupBy("trimestre", "fecha", *_ZONE).agg(
        F.count_distinct("numero_entrada").alias("usuarios_activos"), F.sum(n).alias("interacciones_totales"),
        mean(n).alias("promedio_interacciones_por_usuario"), F.min(n).alias("min_interacciones"), F.max(n).alias("max_interacciones"),
        F.round(deviation(n), 2).alias("desviacion_estandar"), F.count_if(n == 1).alias("usuarios_1_interaccion"),
        F.count_if(n.between(2, 5)).alias("usuarios_2a5_interacciones"), F.count_if(n > 5).alias("usuarios_mas5_interacciones"),
        mean(F.col("s")).alias("duracion_promedio_sesion"))


def _roll_up(daily: DataFrame, keys: list, average: str, total: str) -> DataFrame:
    return daily.groupBy(*keys).agg(
        vocabulary("fecha").alias("dias_con_datos"), mean_of_rounded(F.col("promedio_interacciones_por_usuario")).alias(average),
        mean(F.col("usuarios_activos"), 0).alias("usuarios_promedio_dia"), F.sum("interacciones_totales").alias(total),
        sorted_set(F.col("trimestre"), ",").alias("_q"))


def weekly_report(llamadas: DataFrame, periods: Periods) -> DataFrame:
    return weekly_of(daily_report(llamadas, periods))


def weekly_of(daily: DataFrame) -> DataFrame:
    """The weekly report from the rows of the daily one, as stored by `refresh_daily`, say."""
    keys = ["trimestre", F.year("fecha").alias("año"), week_from_monday(F.col("fecha")).alias("semana"), *_ZONE]
    return _roll_up(daily, keys, "promedio_semanal", "interacciones_totales_semana").drop("_q")


def monthly_report(llamadas: DataFrame, periods: Periods) -> DataFrame:
    return monthly_of(daily_report(llamadas, periods))


def monthly_of(daily: DataFrame) -> DataFrame:
    keys = ["trimestre", F.year("fecha").alias("año"), F.month("fecha").alias("mes"), *_ZONE]
    return _roll_up(daily, keys, "promedio_mensual", "interacciones_totales_mes").drop("_q")


def quarterly_report(llamadas: DataFrame, periods: Periods) -> DataFrame:
    """Distinct callers come from the rows, not from a join that would repeat the daily figures."""
    keys = ["trimestre", *_ZONE]
    daily = _roll_up(daily_report(llamadas, periods), keys, "promedio_trimestral", "interacciones_totales_trimestre").drop("_q")
    users = clean_interactions(llamadas, periods).withColumnRenamed("id_8T", "grupo_zonas").groupBy(*keys).agg(
        F.count_distinct("numero_entrada").alias("usuarios_unicos_trimestre"))
    return join_on(daily, users, keys)


def annual_report(llamadas: DataFrame, periods: Periods) -> DataFrame:
    return annual_of(daily_report(llamadas, periods))


def annual_of(daily: DataFrame) -> DataFrame:
    keys = [F.year("fecha").alias("año"), *_ZONE]
    return _roll_up(daily, keys, "promedio_anual", "interacciones_totales_año").withColumnRenamed("_q", "trimestres_incluidos")


def refresh_daily(store: TableStore, llamadas: DataFrame, periods: Periods, quarters: Sequence[str] | None = None) -> DataFrame:
    """The stored daily report with the given quarters computed anew, after a correction of their calls.

    Only these quarters are read and only their folders rewritten; their weeks,
    months and years follow from the stored rows (`weekly_of` and so on). Without
    `quarters` the whole table is written. A quarter that has lost all its rows
    needs that too.
    """
    if quarters is None:
        return store.replace("daily_report", daily_report(llamadas, periods), by=["trimestre"])
    touched = Periods([p for p in periods if p.trimestre in set(quarters)])
    return store.replace_parts("daily_report", daily_report(llamadas, touched), by=["trimestre"])


def official_beside_derived(llamadas: DataFrame, periods: Periods) -> DataFrame:
    """Average and callers per date, official and derived side by side, over all zones."""
    s, kind_ = _light_sessions(llamadas, periods), F.col("tipo_llamada")
    # One row per date, kind and caller first: callers are then counted like rows.
    callers = s.groupBy("fecha", "tipo_llamada", "numero_entrada").agg(F.sum("n").alias("n"), F.count("*").alias("sesiones"))

    def of(label: str) -> tuple[Column, Column]:
        rows = kind_ == label
        return mean_of(F.sum(F.when(rows, F.col("n"))), F.sum(F.when(rows, F.col("sesiones")))), F.count_if(rows & F.col("numero_entrada").isNotNull())

    (a, b), (c, d) = of("OFICIAL"), of("DERIVADO")
    return callers.groupBy("fecha").agg(
        a.alias("promedio_oficial"), b.alias("usuarios_oficiales"), c.alias("promedio_derivado"), d.alias("usuarios_derivados"),
    ).where(F.col("promedio_oficial").isNotNull())


def quarter_context(llamadas: DataFrame, periods: Periods) -> DataFrame:
    counts = periods.tag(llamadas.drop("trimestre"), "fecha").groupBy("trimestre").agg(
        F.count("*").alias("total_registros"), F.count_distinct("numero_entrada").alias("usuarios_unicos"),
        vocabulary("fecha").alias("dias_con_datos"), vocabulary("id_8T").alias("zonas_activas"),
        F.count_if(inverted()).alias("timestamps_invertidos"), F.count_if(different()).alias("llamadas_derivadas"),
        share(inverted()).alias("pct_timestamps_mal"), share(different()).alias("pct_derivadas"))
    zeros = ["total_registros", "usuarios_unicos", "dias_con_datos", "zonas_activas", "timestamps_invertidos", "llamadas_derivadas"]
    return periods.frame(llamadas.sparkSession).join(counts, "trimestre", "left").select(
        "trimestre", F.col("inicio").alias("fecha_inicio"), F.col("fin").alias("fecha_fin"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in zeros], "pct_timestamps_mal", "pct_derivadas")


def usage_by_kind(llamadas: DataFrame, periods: Periods) -> DataFrame:
    """Menu and option use of official and derived rows, repaired times."""
    return clean_interactions(llamadas, periods).groupBy("tipo_llamada", "menu", "opcion").agg(
        F.count("*").alias("frecuencia_uso"), F.count_distinct("numero_entrada").alias("usuarios_unicos"),
        F.avg(F.col("hora_fin_real") - F.col("hora_inicio_real")).alias("duracion_promedio"))


def usage_by_kind_recorded(llamadas: DataFrame) -> DataFrame:
    """Same with known menu and option and the times as recorded."""
    return llamadas.where(F.col("menu").isNotNull() & F.col("opcion").isNotNull()).groupBy(kind().alias("tipo_llamada"), "menu", "opcion").agg(
        F.count("*").alias("frecuencia"), F.count_distinct("numero_entrada").alias("usuarios_unicos"), F.avg(raw_seconds()).alias("duracion_promedio"))
