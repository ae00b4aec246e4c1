"""Operating load, efficiency and cost per zone."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulario.functions.calls import hour, raw_seconds
from tabulario.functions.exact import deviation, mean, mean_of_rounded, ratio
from tabulario.functions.text import day_name, vocabulary
from tabulario.operators.eda import DIAS
from tabulario.plans.official import official, success_days
from tabulario.plans.sessions import SESSION
from tabulario.plans.shape import first_match, over_all, with_distinct_counts


def _zoned(llamadas: DataFrame) -> DataFrame:
    return official(llamadas).where(F.col("id_8T").isNotNull()).withColumnsRenamed({"id_8T": "zona"}).withColumns({"hora": hour(), "seg": raw_seconds()})


def hourly_load(llamadas: DataFrame, min_days: int = 5) -> DataFrame:
    """Load per zone and hour, with peak days, class and advice."""
    c = F.col
    per_hour = _zoned(llamadas).groupBy("zona", "fecha", "hora").agg(
        F.count("*").alias("n"), F.count_distinct("numero_entrada").alias("u"), mean(F.col("seg"), 4).alias("s"))
    zone = Window.partitionBy("zona")  # hours of the calendar
    peaks = per_hour.withColumn("pico", (c("n") > F.avg("n").over(zone) * 1.5).cast("int"))
    load = peaks.groupBy("zona", "hora").agg(
        F.count("*").alias("dias"), F.avg("n").alias("avg"), mean(c("n"), 0).alias("carga_promedio"), F.max("n").alias("carga_maxima"),
        mean(c("u"), 0).alias("usuarios_promedio"), mean_of_rounded(c("s"), 1, 4).alias("tiempo_promedio_seg"), ratio(F.sum("pico"), F.count("*"), 1).alias("porcentaje_dias_pico"),
    ).where(c("dias") >= min_days)
    usual = F.avg("avg").over(zone)
    return load.select(
        "zona", "hora", "carga_promedio", "carga_maxima", "usuarios_promedio", "tiempo_promedio_seg", "porcentaje_dias_pico",
        first_match([(c("avg") >= usual * 1.3, "HORA_PICO"), (c("avg") <= usual * 0.7, "HORA_VALLE")], "HORA_NORMAL").alias("clasificacion_carga"),
        first_match([((c("porcentaje_dias_pico") > 60) & (c("avg") > 100), "AUMENTAR_CAPACIDAD"), ((c("porcentaje_dias_pico") < 10) & (c("avg") < 20), "REDUCIR_CAPACIDAD"),
                     (c("tiempo_promedio_seg") > 120, "OPTIMIZAR_PERFORMANCE")], "CAPACIDAD_ADECUADA").alias("recomendacion_operativa"))


def _zone_sessions(llamadas: DataFrame) -> DataFrame:
    """Official rows per caller, date and zone, marked when the caller succeeded that day anywhere."""
    s = _zoned(llamadas).groupBy(*SESSION, "zona").agg(F.count("*").alias("n"), F.sum("seg").alias("seg"))
    won = success_days(llamadas).select(*SESSION, F.lit(True).alias("_won"))
    return s.join(won, list(SESSION), "left").withColumn("won", F.when(F.col("_won"), F.col("n")).otherwise(0)).drop("_won")


def _zone_totals(llamadas: DataFrame) -> DataFrame:
    """Per zone: rows, seconds, rows on successful days, and rows weighted by session size."""
    n = F.col("n")
    return _zone_sessions(llamadas).groupBy("zona").agg(
        F.sum(n).alias("n"), F.sum("seg").alias("seg"), F.sum("won").alias("won"), F.sum(n.cast("decimal(18,0)") * n.cast("decimal(18,0)")).alias("nn"),
        F.sum(F.when(n == 1, n).otherwise(0)).alias("simple"), F.sum(F.when(n.between(2, 5), n).otherwise(0)).alias("media"),
        F.sum(F.when(n > 5, n).otherwise(0)).alias("compleja"))


def zone_efficiency(llamadas: DataFrame) -> DataFrame:
    c, n = F.col, F.col("n")
    rows = _zoned(llamadas)
    spread = rows.groupBy("zona").agg(F.count_distinct("numero_entrada").alias("u"), vocabulary("fecha").alias("d"))
    spread = with_distinct_counts(spread, rows, ["zona"], {"h": ["fecha", "hora"]})
    t = _zone_totals(llamadas).join(spread, "zona")  # one row per zone
    secs, depth = c("seg") / n, c("nn").cast("double") / n
    score = (100 - F.least(F.lit(100.0), secs)) * 0.3 + F.least(F.lit(100.0), c("won") * 100.0 / n) * 0.4 + (100 - F.least(F.lit(100.0), depth * 10)) * 0.3
    z = t.select(
        "zona", n.alias("total_interacciones"), c("u").alias("usuarios_unicos"), ratio(n, c("d"), 0, 1).alias("interacciones_promedio_dia"),
        ratio(c("u"), c("d"), 0, 1).alias("usuarios_promedio_dia"), ratio(c("seg"), n, 1, 1).alias("tiempo_promedio_seg"),
        ratio(n, c("u"), 1, 1).alias("interacciones_por_usuario"), F.round(c("nn") / n.cast("decimal(18,0)"), 1).cast("double").alias("complejidad_sesion"),
        ratio(n, c("h"), 1, 1).alias("interacciones_promedio_hora"), ratio(c("won"), n, 1).alias("tasa_exito_pct"), F.round(score, 1).alias("score_eficiencia_operativa"))
    s, rate, secs_r = c("score_eficiencia_operativa"), c("tasa_exito_pct"), c("tiempo_promedio_seg")
    return z.withColumns({
        "ranking_eficiencia": F.rank().over(over_all().orderBy(s.desc())).cast("bigint"),
        "clasificacion_operativa": first_match([(s >= 80, "ZONA_OPTIMA"), (s >= 65, "ZONA_EFICIENTE"), (s >= 50, "ZONA_PROMEDIO")], "ZONA_REQUIERE_MEJORA"),
        "recomendacion_especifica": first_match([
            ((secs_r > 90) & (rate < 60), "OPTIMIZAR_PROCESOS"), ((c("interacciones_por_usuario") > 5) & (rate > 80), "SIMPLIFICAR_FLUJOS"),
            ((rate > 85) & (secs_r < 45), "MODELO_A_REPLICAR"), (c("usuarios_promedio_dia") < 50, "EVALUAR_RECURSOS")], "MANTENER_OPERACION"),
    })


def capacity(llamadas: DataFrame, min_days: int = 3, hourly_rate: int = 25) -> DataFrame:
    """Expected demand per zone, weekday and hour over the observed dates, and the capacity it needs."""
    c = F.col
    per_date = _zoned(llamadas).groupBy("zona", "fecha", "hora").agg(F.count("*").alias("n"), F.avg("seg").alias("s"))
    grouped = per_date.groupBy("zona", F.dayofweek("fecha").alias("_dow"), day_name(c("fecha"), DIAS).alias("dia_nombre"), "hora").agg(
        F.count("*").alias("k"), F.avg("n").alias("avg"), deviation(c("n")).alias("dev"), mean(c("n"), 0).alias("demanda_esperada"), F.max("n").alias("demanda_pico"),
        F.ceil(F.avg("n") * F.avg("s") / 3600).alias("horas_procesamiento_requeridas")).where(c("k") >= min_days)
    avg, dev, hours = c("avg"), c("dev"), c("horas_procesamiento_requeridas")
    return grouped.select(
        "zona", "dia_nombre", "hora", "demanda_esperada", "demanda_pico", "horas_procesamiento_requeridas",
        first_match([((avg >= 100) & (dev > 30), "ALTO_ELASTICO"), (avg >= 100, "ALTO_ESTABLE"), ((avg >= 50) & (dev > 20), "MEDIO_ELASTICO"),
                     (avg >= 50, "MEDIO_ESTABLE"), (avg >= 20, "BAJO_ESTABLE")], "MINIMO").alias("nivel_recursos_recomendado"),
        first_match([(dev > avg * 0.5, "RECURSOS_DINAMICOS"), (hours > 2, "RECURSOS_DEDICADOS")], "RECURSOS_COMPARTIDOS").alias("estrategia_recursos"),
        (hours * hourly_rate).cast("double").alias("costo_estimado_hora"))


def load_distribution(llamadas: DataFrame) -> DataFrame:
    """Share, density and relative speed of each zone."""
    c = F.col
    n, days, hours = c("total_operaciones"), c("d"), c("horas_operativas_diferentes")
    z = _zoned(llamadas).groupBy("zona").agg(
        F.count("*").alias("total_operaciones"), F.count_distinct("numero_entrada").alias("usuarios_unicos"), vocabulary("fecha").alias("d"),
        F.min("hora").alias("a"), F.max("hora").alias("b"), vocabulary("hora").alias("horas_operativas_diferentes"), F.avg("seg").alias("s"),
        mean(c("seg"), 1).alias("tiempo_promedio_seg"))
    z = z.select(
        "zona", "total_operaciones", "usuarios_unicos", ratio(n, days, 4, 1).alias("operaciones_promedio_dia"),
        F.concat(c("a").cast("string"), F.lit(":00 - "), c("b").cast("string"), F.lit(":00")).alias("ventana_operativa"),
        ratio(n, F.sum(n).over(over_all()), 1).alias("porcentaje_carga_total"), ratio(n, days * hours, 1, 1).alias("densidad_operaciones_hora"),
        "tiempo_promedio_seg", F.round(c("s") / F.avg("s").over(over_all()) * 100, 1).alias("eficiencia_relativa_pct"))
    part, rel = c("porcentaje_carga_total"), c("eficiencia_relativa_pct")
    return z.withColumns({
        "clasificacion_carga": first_match([(part >= 25, "ZONA_CRITICA"), (part >= 15, "ZONA_ALTA_DEMANDA"), (part >= 8, "ZONA_DEMANDA_MEDIA")], "ZONA_BAJA_DEMANDA"),
        "estrategia_balanceamiento": first_match([
            ((part >= 25) & (rel > 110), "DISTRIBUIR_CARGA"), ((part >= 20) & (c("densidad_operaciones_hora") > 50), "AMPLIAR_VENTANA_OPERATIVA"),
            (part <= 5, "CONSOLIDAR_CON_OTRA_ZONA"), (rel <= 80, "OPTIMIZAR_PROCESOS")], "MANTENER_OPERACION_ACTUAL"),
    })


def bottlenecks(llamadas: DataFrame, min_rows: int = 10) -> DataFrame:
    """Slow, unsteady and heavily used options per zone."""
    c = F.col
    n, avg, dev, top = c("frecuencia_uso"), c("tiempo_promedio_seg"), c("_dev"), c("tiempo_maximo_seg")
    rows = _zoned(llamadas).where(c("menu").isNotNull() & c("opcion").isNotNull())
    found = rows.groupBy("zona", "menu", "opcion").agg(
        F.count("*").alias("frecuencia_uso"), F.avg("seg").alias("tiempo_promedio_seg"), F.max("seg").alias("tiempo_maximo_seg"), deviation(c("seg")).alias("_dev"),
        F.sum("seg").alias("_sum")).where(n >= min_rows)
    score = (F.when(avg > 60, (avg - 60) * 0.5).otherwise(0.0) + F.when(dev > 30, dev * 0.3).otherwise(0.0) + F.when(n > 100, F.log(n.cast("double")) * 5).otherwise(0.0))
    level, impact = c("nivel_problema"), c("minutos_impacto_diario")
    return found.withColumns({
        "desviacion_tiempo": F.round(dev, 1), "score_cuello_botella": F.round(score, 1), "minutos_impacto_diario": ratio(c("_sum") - n * 30, F.lit(60), 0, 1),
        "nivel_problema": first_match([((avg > 120) & (n > 50), "CRITICO"), ((avg > 90) | ((dev > 45) & (n > 30)), "ALTO_IMPACTO"),
                                       ((avg > 60) & (n > 20), "MEDIO_IMPACTO")], "BAJO_IMPACTO"),
    }).withColumns({
        "prioridad_optimizacion": first_match([(level == "CRITICO", 1), ((level == "ALTO_IMPACTO") & (impact > 60), 2), (level == "ALTO_IMPACTO", 3),
                                               ((level == "MEDIO_IMPACTO") & (n > 100), 4)], 5),
        "recomendacion_accion": first_match([(avg > 120, "REDISEÑAR_PROCESO_URGENTE"), (dev > 60, "ESTANDARIZAR_PROCEDIMIENTO"), (top > 300, "IMPLEMENTAR_TIMEOUT"),
                                             (impact > 120, "AUTOMATIZAR_PROCESO")], "OPTIMIZAR_PERFORMANCE"),
    }).drop("_dev", "_sum")


def operating_cost(llamadas: DataFrame, hourly_rate: str = "30", per_operation: str = "0.10") -> DataFrame:
    """Cost model per zone: processing time plus a fee per operation."""
    c, n = F.col, F.col("n")
    users = _zoned(llamadas).groupBy("zona").agg(F.count_distinct("numero_entrada").alias("u"))
    t = _zone_totals(llamadas).join(users, "zona")  # one row per zone
    money = F.round(
        c("seg").cast("decimal(18,0)") * F.lit(Decimal(hourly_rate)) / F.lit(Decimal(3600)) + n.cast("decimal(18,0)") * F.lit(Decimal(per_operation)), 2)
    t = t.withColumns({"cents": (money * 100).cast("bigint"), "tenths": F.round(ratio(c("seg"), F.lit(3600), 1, 1) * 10).cast("bigint")})

    def pct(col: str) -> Column:
        return ratio(c(col), n, 1)

    z = t.select(
        "zona", n.alias("total_operaciones"), (c("tenths") / 10).alias("horas_procesamiento_total"), ratio(c("seg"), n, 1, 1).alias("segundos_promedio_op"),
        pct("simple").alias("pct_ops_simples"), pct("media").alias("pct_ops_medias"), pct("compleja").alias("pct_ops_complejas"), pct("won").alias("tasa_exito_pct"),
        (c("cents") / 100).alias("costo_total_estimado"), ratio(c("cents"), n * 100, 3, 1).alias("costo_por_operacion"),
        ratio(c("cents"), c("u") * 100, 2, 1).alias("costo_por_usuario"), ratio(n * 10, c("tenths"), 1, 1).alias("operaciones_por_hora"),
        (c("cents") > c("u") * 500).alias("_dear"))
    return z.withColumns({
        "ranking_eficiencia_costo": F.rank().over(over_all().orderBy(c("costo_total_estimado") / c("total_operaciones"))).cast("bigint"),
        "oportunidad_optimizacion": first_match([
            ((c("pct_ops_complejas") > 30) & (c("tasa_exito_pct") < 70), "SIMPLIFICAR_PROCESOS"), (c("segundos_promedio_op") > 90, "OPTIMIZAR_PERFORMANCE"),
            (c("_dear"), "REDUCIR_COMPLEJIDAD"), (c("operaciones_por_hora") < 20, "MEJORAR_THROUGHPUT")], "EFICIENCIA_ACEPTABLE"),
    }).drop("_dear")


def daily_kpis(llamadas: DataFrame, slow: int = 120) -> DataFrame:
    """Daily figures per zone with the busiest hour (the earliest among equals)."""
    rows, keys = _zoned(llamadas), ["fecha", "zona"]
    day = rows.groupBy(*keys).agg(
        F.count("*").alias("operaciones_totales"), F.count_distinct("numero_entrada").alias("usuarios_unicos"),
        mean(F.col("seg"), 1).alias("tiempo_promedio_operacion_seg"), F.max("seg").alias("tiempo_maximo_operacion_seg"),
        F.count_if(F.col("seg") > slow).alias("operaciones_lentas"), ratio(F.count_if(F.col("seg") > slow), F.count("*"), 1).alias("pct_operaciones_lentas"))
    hours = rows.groupBy(*keys, "hora").agg(F.count("*").alias("n")).groupBy(*keys).agg(
        F.count("*").alias("horas_activas"), F.max("n").alias("pico_operaciones_hora"), F.max(F.struct(F.col("n"), (-F.col("hora")).alias("h")))["h"].alias("_h"))
    return day.join(hours, keys).select(
        F.col("fecha").alias("dia"), "zona", "operaciones_totales", "usuarios_unicos", "horas_activas", "tiempo_promedio_operacion_seg",
        "tiempo_maximo_operacion_seg", ratio(F.col("operaciones_totales"), F.col("horas_activas"), 1, 1).alias("operaciones_por_hora_activa"),
        "operaciones_lentas", "pct_operaciones_lentas", "pico_operaciones_hora", (-F.col("_h")).alias("hora_pico"))
