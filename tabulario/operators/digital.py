"""Digital-product analytics: segments, retention, churn, funnel and features."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulario.functions.calls import raw_seconds
from tabulario.functions.exact import cents, deviation, mean, mean_of_rounded, ratio
from tabulario.functions.text import vocabulary, whole_minutes
from tabulario.plans.official import journey_table, official, session_table, success_days, with_week
from tabulario.plans.sessions import SESSION
from tabulario.plans.shape import first_match, over_all


def _vocabulary(sets: str):
    """Distinct values over a caller's sessions; the per-session sets are small."""
    return F.size(F.array_distinct(F.flatten(F.collect_list(sets)))).cast("bigint")


def archetypes(llamadas: DataFrame, min_days: int = 2) -> DataFrame:
    """Seven user segments; the first matching rule decides."""
    c = F.col
    days, span, n = c("dias"), c("span"), c("n")
    users = session_table(llamadas).groupBy("numero_entrada").agg(
        F.count("*").alias("dias"), F.sum("n").alias("n"), F.avg("minutos").alias("avg"), ratio(F.sum("minutos"), F.count("*"), 4, 1).alias("avg4"),
        deviation(c("minutos")).alias("dev"), _vocabulary("menus").alias("m"), _vocabulary("opciones").alias("o"), F.max("exito").alias("e"),
        (F.datediff(F.max("fecha"), F.min("fecha")) + 1).alias("span")).where(days >= min_days)
    label = first_match([
        ((days * 10 > span * 7) & (c("m") >= 5) & (c("avg") <= 8), "POWER_USER"), ((c("m") >= 4) & (c("o") >= 8) & (days * 2 <= span), "EXPLORADOR"),
        ((c("m") <= 2) & (n >= days * 3) & (c("dev") <= 2), "ESPECIALISTA"), ((c("avg") > 12) & (n > days * 6) & (c("e") == 0), "STRUGGLE_USER"),
        ((days * 10 <= span * 3) & (days <= 5), "OCASIONAL"), ((span > 7) & (days * 5 <= span), "EN_RIESGO_ABANDONO")], "REGULAR")
    found = users.groupBy(label.alias("segmento_usuario")).agg(
        F.count("*").alias("cantidad_usuarios"), mean(days, 1).alias("promedio_dias_activos"), mean_of_rounded(ratio(n, days, 4, 1), 1, 4).alias("promedio_interacciones_dia"),
        mean_of_rounded(c("avg4"), 1, 4).alias("promedio_duracion_sesion"), mean(c("m"), 1).alias("promedio_menus_explorados"),
        mean_of_rounded(ratio(days, span, 4, 1), 2, 4).alias("promedio_frecuencia_uso"), ratio(F.sum("e"), F.count("*"), 1).alias("tasa_exito_pct"))
    return found.withColumn("porcentaje_base_usuarios", ratio(c("cantidad_usuarios"), F.sum("cantidad_usuarios").over(over_all()), 1))


def _menu_days(llamadas: DataFrame) -> DataFrame:
    """Per caller over (date, menu) groups: average rows and minutes, distinct menus and dates."""
    groups = official(llamadas).groupBy(*SESSION, "menu").agg(
        F.count("*").alias("n"), whole_minutes(F.max("hora_fin_seg") - F.min("hora_inicio_seg")).alias("mins"))
    return groups.groupBy("numero_entrada").agg(
        F.avg("n").alias("n"), F.avg("mins").alias("mins"), vocabulary("menu").alias("m"), vocabulary("fecha").alias("d"))


def segment_journeys(llamadas: DataFrame, min_sessions: int = 2) -> DataFrame:
    """Frequent multi-step journeys of each segment with their share inside it."""
    c, keys = F.col, ["segmento", "journey_pattern"]
    label = first_match([((c("n") <= 3) & (c("m") >= 4), "EXPLORADOR"), ((c("n") >= 5) & (c("m") <= 2), "ESPECIALISTA"),
                         ((c("mins") > 10) & (c("d") >= 3), "STRUGGLE_USER")], "REGULAR")
    segments = _menu_days(llamadas).select("numero_entrada", label.alias("segmento"))
    s = journey_table(llamadas).where(c("n") > 1).select("numero_entrada", c("journey").alias("journey_pattern"), "minutos")
    found = s.join(segments, "numero_entrada").groupBy(*keys).agg(
        F.count("*").alias("frecuencia_journey"), mean(c("minutos"), 1).alias("duracion_promedio_min")).where(c("frecuencia_journey") >= min_sessions)
    totals = F.broadcast(found.groupBy("segmento").agg(F.sum("frecuencia_journey").alias("_t")))  # at most four segments
    return found.join(totals, "segmento").withColumn("porcentaje_dentro_segmento", ratio(c("frecuencia_journey"), c("_t"), 1)).drop("_t")


def retention_cohorts(llamadas: DataFrame, weeks: int = 3, min_users: int = 10) -> DataFrame:
    """Share of a first-week cohort that is active 1..n weeks later; weeks follow dates, also over New Year."""
    rows = with_week(official(llamadas))
    # A caller's active weeks are few, so first date and weeks come from one aggregate.
    users = rows.groupBy("numero_entrada").agg(F.min(F.struct("fecha", "año", "semana", "_week")).alias("f"), F.collect_set("_week").alias("w"))
    back = {i: F.count_if(F.array_contains("w", F.col("f._week") + i)) for i in range(1, weeks + 1)}
    n = F.col("usuarios_cohorte")
    out = users.groupBy(F.col("f.año").alias("cohorte_año"), F.col("f.semana").alias("cohorte_semana")).agg(
        F.count("*").alias("usuarios_cohorte"), *[v.alias(f"_r{i}") for i, v in back.items()]).where(n >= min_users)
    return out.withColumns({
        **{f"retencion_semana_{i}_pct": ratio(F.col(f"_r{i}"), n, 1) for i in back}, "churn_semana_1_pct": ratio(n - F.col("_r1"), n, 1),
    }).drop(*[f"_r{i}" for i in back])


def churn_risk(llamadas: DataFrame, as_of: dt.date, min_days: int = 3, recent: int = 3, limit: int = 100) -> DataFrame:
    """Risk score from the last sessions and the week before a caller's last activity."""
    c = F.col
    s = session_table(llamadas).select("numero_entrada", "fecha", "n", "minutos", "exito")
    newest = Window.partitionBy("numero_entrada").orderBy(c("fecha").desc())  # at most one session per day
    s = s.withColumns({"rn": F.row_number().over(newest), "last": F.max("fecha").over(Window.partitionBy("numero_entrada"))})
    new = c("rn") <= recent
    users = s.groupBy("numero_entrada").agg(
        F.max("fecha").alias("ultima_actividad"), F.count("*").alias("dias_activos_total"), F.avg(F.when(new, c("n"))).alias("i"),
        F.avg(F.when(new, c("minutos"))).alias("m"), mean(F.when(new, c("n")), 1).alias("interacciones_recientes_promedio"),
        mean(F.when(new, c("minutos")), 1).alias("duracion_reciente_promedio"), F.count_if(new & (c("exito") == 1)).alias("exitos_recientes"),
        F.count_if(c("fecha") >= F.date_sub("last", 7)).alias("dias_activos_ultima_semana"),
    ).where(c("dias_activos_total") >= min_days).withColumn("dias_sin_actividad", F.datediff(F.lit(as_of), "ultima_actividad"))
    idle = c("dias_sin_actividad")
    score = (
        F.when(idle > 7, 30).otherwise(idle * 4) + F.when(c("dias_activos_ultima_semana") == 0, 25).otherwise(0) + F.when(c("m") > 15, 20).otherwise(0)
        + F.when(c("exitos_recientes") == 0, 20).otherwise(0) + F.when(c("i") > 8, 15).otherwise(0))
    r = c("score_riesgo_churn")
    scored = users.withColumn("score_riesgo_churn", F.least(F.lit(100), score)).withColumn("categoria_riesgo", first_match(
        [(r >= 70, "CHURN_INMINENTE"), (r >= 50, "ALTO_RIESGO"), (r >= 30, "MEDIO_RIESGO")], "BAJO_RIESGO"))
    return scored.drop("i", "m").orderBy(r.desc(), "numero_entrada").limit(limit)


# Funnel steps, their menus and names.
FUNNEL: Sequence[tuple[Sequence[str], str]] = (
    (("INICIO", "LOGIN"), "Entrada/Login"), (("DASHBOARD", "PRINCIPAL"), "Dashboard Principal"), (("SELECCION", "CATEGORIA"), "Selección/Categoría"),
    (("PROCESO", "FORMULARIO"), "Proceso/Formulario"), (("CONFIRMACION", "EXITO"), "Confirmación/Éxito"),
)


def funnel(llamadas: DataFrame, path: Sequence[tuple[Sequence[str], str]] = FUNNEL) -> DataFrame:
    """Callers per funnel step, loss and conversion against the first and the previous step."""
    at = first_match([(F.col("menu").isin(*menus), i) for i, (menus, _) in enumerate(path, 1)])
    per_step = official(llamadas).withColumn("paso", at).where(F.col("paso").isNotNull()).groupBy("paso").agg(F.count_distinct("numero_entrada").alias("usuarios_unicos_paso"))
    w, n = Window.orderBy("paso"), F.col("usuarios_unicos_paso")  # one row per step
    prev, rate = F.lag(n).over(w), F.col("conversion_paso_anterior_pct")
    return per_step.select(
        first_match([(F.col("paso") == i, name) for i, (_, name) in enumerate(path, 1)]).alias("nombre_paso"), "usuarios_unicos_paso",
        (n - prev).alias("usuarios_perdidos"), ratio(n, F.first(n).over(w), 1).alias("conversion_desde_inicio_pct"), ratio(n, prev, 1).alias("conversion_paso_anterior_pct"),
    ).withColumn("estado_paso", first_match([(rate < 60, "CUELLO_BOTELLA_CRITICO"), (rate < 75, "REQUIERE_OPTIMIZACION")], "PERFORMANCE_ACEPTABLE"))


def journey_variants(llamadas: DataFrame, min_sessions: int = 5) -> DataFrame:
    """Conversion, steps and time of each multi-step journey."""
    c, n = F.col, F.col("sesiones_totales")
    found = journey_table(llamadas).where(c("n") > 1).groupBy(c("journey").alias("journey_completo")).agg(
        F.count("*").alias("sesiones_totales"), F.sum("exito").alias("conversiones"), ratio(F.sum("exito"), F.count("*"), 1).alias("tasa_conversion_pct"),
        mean(c("n"), 1).alias("promedio_pasos"), mean(c("minutos"), 1).alias("promedio_tiempo_min"),
        mean(F.when(c("exito") == 1, c("minutos")), 1).alias("tiempo_promedio_conversion")).where(n >= min_sessions)
    rate, steps_, mins = c("tasa_conversion_pct"), c("promedio_pasos"), c("promedio_tiempo_min")
    return found.withColumns({
        "eficiencia_por_paso": ratio(cents(rate, 1), cents(steps_, 1), 1, 1),
        "clasificacion_journey": first_match([((rate >= 80) & (steps_ <= 4), "JOURNEY_OPTIMO"), ((rate >= 60) & (mins <= 6), "JOURNEY_EFICIENTE"),
                                              (rate >= 40, "JOURNEY_MEJORABLE")], "JOURNEY_PROBLEMATICO"),
    })


def feature_preference(llamadas: DataFrame, min_rows: int = 10) -> DataFrame:
    """Features per segment with the share of uses followed by a success the same day.

    "Some success later that day" is a comparison with the day's last success,
    so the theta join becomes an equi join on (caller, date).
    """
    c, keys = F.col, ["segmento", "menu", "opcion"]
    label = first_match([((c("n") >= 5) & (c("m") <= 2), "POWER_USER"), ((c("m") >= 4) & (c("n") <= 3), "EXPLORADOR"), (c("mins") > 10, "STRUGGLE_USER")], "REGULAR")
    segments = _menu_days(llamadas).select("numero_entrada", label.alias("segmento"))
    # Rows are added up per caller, feature and second, then per caller and feature; only sums meet the days and the segments.
    uses = official(llamadas).groupBy(*SESSION, "menu", "opcion", "hora_inicio_seg").agg(
        F.count("*").alias("n"), F.sum(raw_seconds()).alias("s"), F.count(raw_seconds()).alias("k"))
    later = F.when(c("ultimo_exito") > c("hora_inicio_seg"), c("n")).otherwise(F.lit(0))
    per_caller = uses.join(success_days(llamadas), list(SESSION), "left").groupBy("numero_entrada", "menu", "opcion").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("k").alias("k"), F.sum(later).alias("l"))
    found = per_caller.join(segments, "numero_entrada").groupBy(*keys).agg(
        F.sum("n").alias("frecuencia_uso"), F.count("*").alias("usuarios_unicos"), ratio(F.sum("s"), F.sum("k"), 1, 1).alias("tiempo_promedio_seg"),
        ratio(F.sum("l"), F.sum("n"), 1).alias("tasa_exito_posterior_pct")).where(c("frecuencia_uso") >= min_rows)
    share_ = ratio(c("frecuencia_uso"), F.sum("frecuencia_uso").over(Window.partitionBy("segmento")), 1)  # one row per feature
    part, won = c("preferencia_segmento_pct"), c("tasa_exito_posterior_pct")
    return found.withColumn("preferencia_segmento_pct", share_).withColumn("recomendacion_personalizacion", first_match([
        ((part >= 15) & (won >= 60), "DESTACAR_PARA_SEGMENTO"), ((part >= 10) & (c("tiempo_promedio_seg") <= 30), "ACCESO_RAPIDO"), (won >= 75, "PROMOVER_USO"),
        (part <= 3, "OCULTAR_PARA_SEGMENTO")], "MANTENER_ACTUAL"))


def weekly_ux(llamadas: DataFrame) -> DataFrame:
    """Weekly users, retained users (active the week before in any way), conversions and time."""
    c = F.col
    s = with_week(session_table(llamadas)).groupBy("año", "semana", "_week", "numero_entrada").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("exito").alias("e"), F.sum("minutos").alias("m"), F.max("exito").alias("won"))
    active = with_week(llamadas.where(c("numero_entrada").isNotNull())).select("numero_entrada", (c("_week") + 1).alias("_week")).distinct().withColumn("_back", F.lit(True))
    users = s.join(active, ["numero_entrada", "_week"], "left")
    return users.groupBy("año", "semana").agg(
        F.count_distinct("numero_entrada").alias("usuarios_activos_semanales"), (F.sum("n") / F.sum("k")).alias("promedio_interacciones_usuario"),
        F.count_if(c("_back")).alias("usuarios_retenidos"), ratio(F.count_if(c("_back")), F.count("*"), 1).alias("tasa_retencion_semanal"),
        F.sum("e").alias("conversiones_totales"), ratio(F.sum("e"), F.sum("k"), 1).alias("tasa_conversion_general"),
        (F.sum("m") / F.sum("k")).alias("tiempo_promedio_sesion_min"), F.count_if(c("won") == 0).alias("usuarios_sin_exito"))
