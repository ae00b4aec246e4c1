"""Service-centre analytics: abandonment, resolution and frustration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulario.fixed import class_sql, points_sql
from tabulario.functions.calls import raw_seconds
from tabulario.functions.exact import ratio
from tabulario.plans.official import journey_table, official, session_table, with_week
from tabulario.plans.sessions import steps


def abandoned_sequences(llamadas: DataFrame, min_sessions: int = 10, limit: int = 20) -> DataFrame:
    """Multi-step journeys that end without success most often."""
    n, lost = F.col("frecuencia_journey"), F.col("abandonados")
    found = journey_table(llamadas).where(F.col("n") > 1).groupBy(F.col("journey").alias("secuencia_completa")).agg(
        F.count("*").alias("frecuencia_journey"), F.avg("n").alias("promedio_pasos"), F.avg("minutos").alias("promedio_duracion_min"),
        F.sum("exito").alias("completados_exitosos")).where(n >= min_sessions).withColumn("abandonados", n - F.col("completados_exitosos"))
    classed = found.withColumns({
        "tasa_abandono_pct": ratio(lost, n, 1),
        "nivel_problematico": F.expr(class_sql("nivel_problematico")),
    })
    return classed.orderBy(F.col("tasa_abandono_pct").desc(), n.desc(), F.col("secuencia_completa").asc_nulls_first()).limit(limit)


def abandonment_points(llamadas: DataFrame, min_rows: int = 20) -> DataFrame:
    """How often a menu option at a given step is the last of its session."""
    last, n, hits = F.col("paso") == F.col("pasos"), F.col("total_veces_visitado"), F.col("veces_fue_punto_abandono")
    rows = steps(official(llamadas), F.col("hora_inicio_seg"))
    return rows.groupBy("menu", "opcion", F.col("paso").alias("numero_paso")).agg(
        F.count_if(last).alias("veces_fue_punto_abandono"), F.count("*").alias("total_veces_visitado"),
        F.avg(F.when(last, F.col("pasos"))).alias("promedio_pasos_antes_abandono"), F.avg(F.when(last, raw_seconds())).alias("tiempo_promedio_antes_abandono_seg"),
    ).where(n >= min_rows).withColumns({
        "tasa_abandono_pct": ratio(hits, n, 1),
        "clasificacion_abandono": F.expr(class_sql("clasificacion_abandono")),
    })


def resolution_time(llamadas: DataFrame) -> DataFrame:
    """Success and duration of sessions by the menu they start with."""
    n, ok, mins = F.col("total_sesiones"), F.col("sesiones_exitosas"), F.col("minutos")
    return journey_table(llamadas).groupBy(F.col("primer_menu").alias("tipo_consulta_inicial")).agg(
        F.count("*").alias("total_sesiones"), F.sum("exito").alias("sesiones_exitosas"),
        F.avg(F.when(F.col("exito") == 1, mins)).alias("tiempo_promedio_exito_min"), F.avg(F.when(F.col("exito") == 0, mins)).alias("tiempo_promedio_abandono_min"),
        F.avg("n").alias("promedio_interacciones"), F.avg("menus").alias("promedio_menus_visitados"),
    ).withColumns({
        "tasa_exito_pct": ratio(ok, n, 1),
        "recomendacion": F.expr(class_sql("recomendacion")),
    })


def frustration(llamadas: DataFrame, min_days: int = 2, limit: int = 50) -> DataFrame:
    """Frustration score and risk of callers with repeated attempts."""
    c = F.col
    days = c("dias_intentos")
    users = session_table(llamadas).groupBy("numero_entrada").agg(
        F.count("*").alias("dias_intentos"), F.count("*").alias("total_sesiones"), F.avg("n").alias("promedio_interacciones_por_sesion"),
        F.avg("minutos").alias("promedio_duracion_sesion"), F.sum("exito").alias("sesiones_exitosas")).where(days >= min_days)
    scored = users.withColumns({
        "tasa_exito_pct": ratio(c("sesiones_exitosas"), days, 1), "score_frustracion": F.expr(points_sql()), "nivel_riesgo": F.expr(class_sql("nivel_riesgo")),
    })
    return scored.orderBy(c("score_frustracion").desc(), days.desc(), "numero_entrada").limit(limit)


def weekly_kpis(llamadas: DataFrame) -> DataFrame:
    """Weekly sessions, success and time; total_interacciones counts sessions, as the report does."""
    s, n, ok = with_week(session_table(llamadas)), F.col("total_sesiones"), F.col("total_exitosas")
    users = s.groupBy("año", "semana", "numero_entrada").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("exito").alias("e"), F.sum("minutos").alias("m"))
    return users.groupBy("año", "semana").agg(
        F.count("*").alias("clientes_unicos"), F.sum("k").alias("total_interacciones"), (F.sum("n") / F.sum("k")).alias("promedio_interacciones_cliente"),
        F.sum("e").alias("total_exitosas"), F.sum("k").alias("total_sesiones"), (F.sum("m") / F.sum("k")).alias("tiempo_promedio_resolucion"),
    ).withColumn("tasa_exito_semanal", ratio(ok, n, 1))
