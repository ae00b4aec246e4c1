"""Callers, their daily journeys and behaviour classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulario.functions.calls import (
    different, end, equal, failed, has_label, hour, inverted, labelled, location, menu_option, raw_seconds, redirected, seconds, start, unlabelled,
)
from tabulario.functions.exact import mean, mean_of_rounded, mean_share, ratio, share, spread
from tabulario.functions.text import clock, clock_full, day_name, filled, hour_of, is_blank, sorted_set, vocabulary
from tabulario.operators.labels import _commercial, _n, _res, _users
from tabulario.plans.sessions import SESSION, sessions, steps
from tabulario.plans.shape import bounded_list, first_match, join_on, matching, only, ranked
from tabulario.sources.periods import Periods


def _known(llamadas: DataFrame) -> DataFrame:
    return llamadas.where(F.col("numero_entrada").isNotNull())


def _flag(cond: Column) -> Column:
    return F.coalesce(cond.cast("int"), F.lit(0))


def _named_step() -> Column:
    return F.concat(clock(start()), F.lit(":["), F.coalesce("menu", F.lit("SIN_MENU")), F.lit("-"), F.coalesce("opcion", F.lit("SIN_OPCION")), F.lit("]"))


def daily_journeys(llamadas: DataFrame) -> DataFrame:
    """Journey per caller and day with redirections and processed numbers."""
    s = sessions(
        _known(llamadas), start(), step=_named_step(), sums={"casos_procesamiento_interno": _flag(different())},
        sets={"redirecciones_diferentes": F.col("id_CTransferencia"), "numeros_procesados_diferentes": F.col("numero_digitado")},
        lists={"destinos_redireccion": (F.col("id_CTransferencia"), ","), "etiquetas_sesion": (F.col("etiquetas"), "|")},
    )
    return s.withColumnsRenamed({"n": "total_interacciones", "journey": "patron_navegacion"})


def daily_journeys_with_destinations(llamadas: DataFrame) -> DataFrame:
    s = sessions(
        _known(llamadas), start(), step=_named_step(), sets={"destinos_diferentes": F.col("numero_digitado")},
        lists={"numeros_destino": (F.col("numero_digitado"), ","), "etiquetas_sesion": (F.col("etiquetas"), "|")},
    )
    return s.withColumnsRenamed({"n": "total_interacciones", "journey": "patron_navegacion"})


def detailed_journeys(llamadas: DataFrame) -> DataFrame:
    """Journey with labels and destinations of every step."""
    step = F.concat(
        clock_full(start()), F.lit(" ["), F.coalesce("menu", F.lit("NULL")), F.lit(":"), F.when(filled(F.col("opcion")), F.col("opcion")).otherwise("NULL"), F.lit("]"),
        F.when(labelled(), F.concat(F.lit(" {"), F.left("etiquetas", F.lit(20)), F.lit("}"))).otherwise(" {SIN_ETIQ}"),
        F.when(redirected(), F.concat(F.lit(" →"), "id_CTransferencia")).otherwise(""),
    )
    s = sessions(
        _known(llamadas), start(), step=step, sep=" | ",
        sums={"casos_procesamiento_interno": _flag(different()), "interacciones_validadas": _flag(has_label("VSI")),
              "interacciones_humanas": _flag(has_label("NOBOT")), "interacciones_error": _flag(has_label("NoTmx_SOMC"))},
        sets={"destinos_redireccion_diferentes": F.col("id_CTransferencia"), "numeros_procesados": F.col("numero_digitado"), "zonas_utilizadas": F.col("id_8T")},
        lists={"lista_redirecciones": (F.col("id_CTransferencia"), ","), "ubicaciones_organizacionales": (location(), ",")},
        mins={"_a": start()}, maxs={"_b": end()},
    )
    return s.withColumnsRenamed({"n": "total_interacciones_dia", "journey": "journey_detallado"}).withColumn(
        "duracion_total_segundos", F.col("_b") - F.col("_a")).drop("_a", "_b")


def recorded_journeys(llamadas: DataFrame) -> DataFrame:
    """Journey per caller, day and dialled number, with the times as recorded."""
    step = F.concat(clock(F.col("hora_inicio_seg")), F.lit(":["), "menu", F.lit("-"), "opcion", F.lit("]"))
    s = sessions(
        llamadas, F.col("hora_inicio_seg"), ["numero_entrada", "fecha", "numero_digitado"], step=step,
        sets={"menus_visitados": F.col("menu"), "opciones_diferentes": F.col("opcion")}, mins={"_a": F.col("hora_inicio_seg")}, maxs={"_b": F.col("hora_fin_seg")},
    )
    return s.withColumnsRenamed({"n": "total_interacciones", "journey": "patron_navegacion_temporal", "fecha": "dia"}).withColumns({
        "relacion_numeros": F.when(equal(), "MISMO").otherwise("DIFERENTE"), "duracion_total_sesion": F.col("_b") - F.col("_a")}).drop("_a", "_b")


def validated_journeys(llamadas: DataFrame) -> DataFrame:
    step = F.concat(clock(start()), F.lit(":["), F.coalesce("menu", F.lit("SIN_MENU")), F.when(filled(F.col("opcion")), F.concat(F.lit("-"), "opcion")).otherwise(""), F.lit("]"))
    s = sessions(
        _known(llamadas), start(), step=step, sums={"interacciones_validadas": _flag(has_label("VSI")), "interacciones_fallidas": _flag(failed())},
        sets={"menus_diferentes": F.col("menu"), "redirecciones_diferentes": F.col("id_CTransferencia")}, lists={"menus_utilizados": (F.col("menu"), ",")},
        mins={"_a": start()}, maxs={"_b": end()},
    )
    return s.withColumnsRenamed({"n": "total_interacciones_dia", "journey": "patron_navegacion"}).withColumn(
        "duracion_sesion_segundos", F.col("_b") - F.col("_a")).drop("_a", "_b")


def frequent_sequences(llamadas: DataFrame, min_sessions: int = 2, limit: int = 20, sample: int = 3) -> DataFrame:
    """Most frequent daily sequences with their callers."""
    step = F.concat("menu", F.coalesce(F.concat(F.lit(":"), "opcion"), F.lit("")))
    s = sessions(llamadas.where(F.col("menu").isNotNull()), F.col("hora_inicio_seg"), step=step).withColumnRenamed("journey", "secuencia_navegacion")
    key = ["secuencia_navegacion"]
    # Per sequence and caller: totals and samples share this aggregate's exchange.
    base = s.groupBy(*key, "numero_entrada").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    found = base.groupBy(*key).agg(
        F.sum("k").alias("frecuencia_secuencia"), (F.sum("n") / F.sum("k")).alias("promedio_pasos"), F.count("numero_entrada").alias("usuarios_unicos"),
    ).where(F.col("frecuencia_secuencia") >= min_sessions)
    shown = ranked(found, "frecuencia_secuencia", key, limit)
    return shown.join(bounded_list(only(base, shown, key), key, "numero_entrada", sample, ",", "usuarios_ejemplo"), "secuencia_navegacion", "left")


def transitions(llamadas: DataFrame, min_rows: int = 5, sample: int = 5) -> DataFrame:
    """Steps following each other inside a session; the gap runs from the end of the step before."""
    rows = _known(llamadas).where(F.col("menu").isNotNull()).withColumn("_end", end())
    moved = steps(rows, start(), carry=["menu", "opcion", "_end"]).where(F.col("anterior").isNotNull())
    keys, c = ["desde", "hacia"], F.col
    # Per transition and caller: totals and samples share this aggregate's exchange.
    base = moved.groupBy(
        F.concat("anterior.menu", F.lit(":"), F.coalesce("anterior.opcion", F.lit("NULL"))).alias("desde"),
        F.concat("menu", F.lit(":"), F.coalesce("opcion", F.lit("NULL"))).alias("hacia"), "numero_entrada",
    ).agg(F.count("*").alias("n"), F.sum(start() - c("anterior._end")).alias("gap"), _n(has_label("VSI"), "vsi"), _n(redirected(), "red"))
    found = base.groupBy(*keys).agg(
        F.sum("n").alias("frecuencia_transicion"), F.count("*").alias("usuarios_unicos"), ratio(F.sum("gap"), F.sum("n"), 2, 1).alias("tiempo_promedio_transicion"),
        F.sum("vsi").alias("transiciones_validadas"), F.sum("red").alias("transiciones_con_redireccion")).where(c("frecuencia_transicion") >= min_rows)
    return found.join(bounded_list(base, keys, "numero_entrada", sample, ",", "usuarios_ejemplo"), keys, "left")


def step_transitions(llamadas: DataFrame, limit: int = 20) -> DataFrame:
    """Same on recorded times; a step with a missing part is unknown, the gap runs from start to start."""
    rows = llamadas.withColumn("_step", menu_option())
    moved = steps(rows, F.col("hora_inicio_seg"), carry=["_step", "hora_inicio_seg"]).where(F.col("anterior._step").isNotNull())
    found = moved.groupBy(F.col("anterior._step").alias("paso_anterior"), F.col("_step").alias("paso_actual")).agg(
        F.count("*").alias("frecuencia_transicion"), _users(),
        mean(F.col("hora_inicio_seg") - F.col("anterior.hora_inicio_seg")).alias("tiempo_promedio_transicion"))
    return ranked(found, "frecuencia_transicion", ["paso_anterior", "paso_actual"], limit)


def _avg_secs() -> Column:
    return F.avg(raw_seconds())


def user_patterns(llamadas: DataFrame) -> DataFrame:
    n, bad, serv, moves = (F.col(c) for c in ("total_interacciones", "interacciones_fallidas", "interacciones_servicio", "transferencias_realizadas"))
    users = llamadas.groupBy("numero_entrada").agg(
        F.count("*").alias("total_interacciones"), vocabulary("fecha").alias("dias_activos"), _n(failed(), "interacciones_fallidas"),
        _n(_res(), "interacciones_servicio"), _n(_commercial(), "_com"), _n(F.col("menu") == "SDO", "_sdo"),
        (F.count_distinct("numero_digitado") - 1).alias("transferencias_realizadas"), mean(raw_seconds()).alias("duracion_promedio_seg"))
    return users.withColumn("patron_comportamiento", first_match([
        (bad * 100 > n * 70, "USUARIO_PROBLEMATICO"), (F.col("_com") > 0, "USUARIO_COMERCIAL"), (serv > bad, "USUARIO_SERVICIOS"),
        (F.col("_sdo") == n, "USUARIO_CONSULTA_SIMPLE"), (moves > 3, "USUARIO_MULTI_SERVICIO"),
        ((n > 10) & (F.col("dias_activos") == 1), "USUARIO_INTENSIVO")], "USUARIO_NORMAL")).drop("_com", "_sdo")


def user_types(llamadas: DataFrame) -> DataFrame:
    n, days, bad, kinds = F.col("n"), F.col("days"), F.col("bad"), F.col("kinds")
    users = _known(llamadas).groupBy("numero_entrada").agg(
        F.count("*").alias("n"), vocabulary("fecha").alias("days"), vocabulary("menu").alias("kinds"), _n(_res(), "serv"), _n(_commercial(), "com"),
        _n(failed(), "bad"), _n(F.col("menu") == "SDO", "sdo")).withColumn("per_day", ratio(n, days, 2, 1))
    label = first_match([
        (F.col("per_day") >= 10, "USUARIO_INTENSIVO"), (F.col("com") > 0, "USUARIO_COMERCIAL"), (F.col("serv") > bad, "USUARIO_SERVICIOS"),
        (F.col("sdo") == n, "USUARIO_CONSULTA_SIMPLE"), (bad * 10 > n * 6, "USUARIO_PROBLEMATICO"), (kinds >= 5, "USUARIO_EXPLORADOR"),
        (days >= 10, "USUARIO_RECURRENTE")], "USUARIO_ESTANDAR")
    return users.groupBy(label.alias("tipo_usuario")).agg(
        F.count("*").alias("cantidad_usuarios"), mean(n).alias("promedio_interacciones_tipo"), mean_of_rounded(F.col("per_day")).alias("promedio_diario_tipo"),
        mean(kinds, 1).alias("promedio_diversidad_menus"))


def anomalous_users(llamadas: DataFrame, volume: int = 20) -> DataFrame:
    """Callers beyond one of four limits, with the kind of anomaly."""
    n, days, menus, zones, divs, avg = (F.col(c) for c in ("total_interacciones", "dias_activos", "menus_diferentes", "zonas_geograficas", "divisiones_diferentes", "_avg"))
    users = llamadas.groupBy("numero_entrada").agg(
        F.count("*").alias("total_interacciones"), vocabulary("fecha").alias("dias_activos"), vocabulary("menu").alias("menus_diferentes"),
        F.count_distinct("numero_digitado").alias("numeros_destino"), sorted_set(F.col("menu"), ",").alias("menus_usados"),
        vocabulary("id_8T").alias("zonas_geograficas"), vocabulary("division").alias("divisiones_diferentes"), _avg_secs().alias("_avg"),
        mean(raw_seconds()).alias("duracion_promedio_seg"), F.min("fecha").alias("primera_fecha"), F.max("fecha").alias("ultima_fecha"))
    odd = users.where((n > days * volume) | ((menus == 1) & (n > 10)) | (avg < 5) | (zones > 3))
    return odd.withColumns({
        "interacciones_por_dia": ratio(n, days, 4, 1),
        "tipo_anomalia": first_match([
            (n > days * 50, "VOLUMEN_EXTREMO"), ((menus == 1) & (n > 20), "MENU_UNICO_REPETITIVO"), (avg < 2, "DURACION_SOSPECHOSA"),
            (zones > 5, "MULTI_ZONA_ANOMALO"), (divs > 3, "MULTI_DIVISION_ANOMALO"), (days > 25, "USO_CONTINUO_SOSPECHOSO")], "NORMAL"),
    }).drop("_avg")


def _with_sample(users: DataFrame, key: str, found: DataFrame, sample: int, name: str) -> DataFrame:
    """Add the callers with most interactions of each class."""
    listed = bounded_list(users.select(key, "numero_entrada", "n"), [key], "numero_entrada", sample, ",", name, [F.col("n").desc(), F.col("numero_entrada")], ["n"])
    return found.join(listed, key, "left")


def behaviour_clusters(llamadas: DataFrame, sample: int = 3) -> DataFrame:
    n, days, key = F.col("n"), F.col("days"), "cluster_comportamiento"
    users = llamadas.groupBy("numero_entrada").agg(
        F.count("*").alias("n"), vocabulary("fecha").alias("days"), _n(_res(), "serv"), _n(failed(), "bad"), _n(_commercial(), "com"),
        _n(different(), "moved"), F.round(_avg_secs(), 4).alias("avg"))
    users = users.withColumn(key, first_match([
        (n == 1, "SINGLE_TOUCH"), (F.col("com") * 100 > n * 50, "COMERCIAL_ORIENTED"), (F.col("serv") * 100 > n * 60, "SERVICE_ORIENTED"),
        (F.col("bad") * 100 > n * 50, "HIGH_DROPOUT"), (F.col("moved") * 100 > n * 40, "MULTI_SERVICE"),
        ((n > 15) & (days == 1), "INTENSIVE_SINGLE_DAY"), (days > 5, "RECURRING_USER")], "STANDARD_USER"))
    found = users.groupBy(key).agg(
        F.count("*").alias("usuarios_en_cluster"), mean(n).alias("promedio_interacciones"), mean(days).alias("promedio_dias_activos"),
        mean_share(F.col("serv"), n).alias("promedio_pct_servicios"), mean_share(F.col("bad"), n).alias("promedio_pct_abandonos"),
        mean_of_rounded(F.col("avg"), 2, 4).alias("promedio_duracion_seg"))
    return _with_sample(users, key, found, sample, "usuarios_ejemplo")


def five_profiles(llamadas: DataFrame, min_rows: int = 2) -> DataFrame:
    """Intensity, diversity, service, validation and mobility class of each caller."""
    c = F.col
    n, vsi = c("total_interacciones"), c("vsi")
    users = _known(llamadas).groupBy("numero_entrada").agg(
        F.count("*").alias("total_interacciones"), vocabulary("fecha").alias("dias_activos"), vocabulary("menu").alias("diversidad_menus"),
        _n(_res(), "serv"), _n(_commercial(), "com"), _n(c("menu") == "SDO", "sdo"), _n(failed(), "bad"), _n(c("menu").like("Desborde_%"), "over"),
        _n(has_label("VSI"), "vsi"), _n(has_label("NOBOT"), "human"), _n(has_label("NoTmx_SOMC"), "error"), _n(unlabelled(), "empty"),
        F.count_distinct("id_CTransferencia").alias("destinos_redireccion"), vocabulary("id_8T").alias("zonas_geograficas"),
        vocabulary("division").alias("divs"), vocabulary("area").alias("areas"),
    ).where(n >= min_rows).withColumn("intensidad_diaria", ratio(n, c("dias_activos"), 2, 1))
    i, d, z = c("intensidad_diaria"), c("diversidad_menus"), c("zonas_geograficas")
    return users.select(
        "numero_entrada",
        first_match([(i >= 20, "ULTRA_INTENSIVO"), (i >= 10, "MUY_INTENSIVO"), (i >= 5, "INTENSIVO"), (i >= 2, "MODERADO")], "LIGERO").alias("perfil_intensidad"),
        first_match([(d >= 8, "EXPLORADOR_AVANZADO"), (d >= 5, "EXPLORADOR_MODERADO"), (d >= 3, "USUARIO_DIVERSO"), (d == 2, "USUARIO_DUAL")], "USUARIO_FOCALIZADO").alias("perfil_diversidad"),
        first_match([(c("serv") * 10 > n * 6, "ORIENTADO_SERVICIOS"), (c("com") > 0, "PERFIL_COMERCIAL"), (c("sdo") == n, "SOLO_CONSULTAS"),
                     (c("bad") * 2 > n, "PROBLEMATICO"), (c("over") * 10 > n * 3, "AFECTADO_SOBRECARGA")], "MIXTO").alias("perfil_servicio"),
        first_match([(vsi * 100 >= n * 80, "ALTAMENTE_VALIDADO"), (c("human") > 0, "INTERACCION_HUMANA_CONFIRMADA"), (c("error") > vsi, "AFECTADO_ERRORES_SISTEMA"),
                     (c("empty") * 100 >= n * 70, "BAJO_PROCESAMIENTO")], "VALIDACION_MIXTA").alias("perfil_validacion"),
        first_match([(z >= 5, "MULTI_ZONA_EXTREMO"), (z >= 3, "MULTI_ZONA"), (c("divs") >= 3, "MULTI_DIVISION"), (c("areas") >= 3, "MULTI_AREA")],
                    "GEOGRAFICAMENTE_ESTABLE").alias("perfil_movilidad"),
        "total_interacciones", "dias_activos", "intensidad_diaria", "diversidad_menus", ratio(vsi, n, 1).alias("porcentaje_validado"),
        ratio(c("bad"), n, 1).alias("porcentaje_fallidas"), "destinos_redireccion", "zonas_geograficas",
    )


def _stepped(value: Column, bounds: tuple[int, ...]) -> Column:
    """Score in tenths: 1, 3, 5, 7, 9 by ascending upper bounds."""
    return first_match([(value <= b, 1 + 2 * i) for i, b in enumerate(bounds)], 9)


def score_clusters(llamadas: DataFrame, min_rows: int = 2, sample: int = 5) -> DataFrame:
    """Callers clustered by four stepped scores (kept in tenths)."""
    c, key = F.col, "cluster_comportamiento"
    n, vsi = c("n"), c("vsi")
    users = _known(llamadas).groupBy("numero_entrada").agg(
        F.count("*").alias("n"), vocabulary("menu").alias("menus"), _n(has_label("VSI"), "vsi"), _n(_commercial(), "com"), _n(_res(), "serv"),
        _n(c("menu") == "SDO", "sdo")).where(n >= min_rows).withColumns({
        "vol": _stepped(n, (2, 5, 10, 20)),
        "div": first_match([(c("menus") == 1, 1), (c("menus") <= 3, 3), (c("menus") <= 5, 5), (c("menus") <= 8, 7)], 9),
        "suc": first_match([(vsi * 100 >= n * 80, 9), (vsi * 100 >= n * 60, 7), (vsi * 100 >= n * 40, 5), (vsi * 100 >= n * 20, 3)], 1),
        "com_score": first_match([(c("com") > 0, 9), (c("serv") * 2 > n, 7), (c("sdo") == n, 3)], 5), "pct": ratio(vsi, n, 4),
    })
    users = users.withColumn(key, first_match([
        ((c("vol") >= 7) & (c("div") >= 7), "POWER_USER_EXPLORADOR"), ((c("vol") >= 7) & (c("suc") >= 7), "POWER_USER_EFICIENTE"),
        ((c("com_score") >= 7) & (c("suc") >= 7), "USUARIO_COMERCIAL_EXITOSO"), ((c("div") >= 7) & (c("suc") <= 3), "EXPLORADOR_PROBLEMATICO"),
        ((c("vol") <= 3) & (c("com_score") <= 3), "USUARIO_SIMPLE"), ((c("suc") <= 3) & (c("vol") >= 5), "USUARIO_PROBLEMATICO_PERSISTENTE"),
        ((c("div") <= 3) & (c("vol") >= 5), "USUARIO_REPETITIVO")], "USUARIO_ESTANDAR"))
    score = lambda col: ratio(F.sum(col), F.count("*") * 10, 2, 1)
    found = users.groupBy(key).agg(
        F.count("*").alias("usuarios_en_cluster"), mean(n, 1).alias("promedio_interacciones"), mean(c("menus"), 1).alias("promedio_diversidad_menus"),
        mean_share(vsi, n).alias("promedio_pct_exito"), F.min(n).alias("min_interacciones"), F.max(n).alias("max_interacciones"),
        F.min("pct").alias("min_pct_exito"), F.max("pct").alias("max_pct_exito"), score("vol").alias("score_promedio_volumen"),
        score("div").alias("score_promedio_diversidad"), score("suc").alias("score_promedio_exito"), score("com_score").alias("score_promedio_complejidad"))
    return _with_sample(users, key, found, sample, "usuarios_ejemplo_top")


def circadian(llamadas: DataFrame) -> DataFrame:
    over = F.col("menu").like("Desborde_%")
    return _known(llamadas).groupBy(hour_of(start()).alias("hora_del_dia"), F.dayofweek("fecha").alias("dia_semana"), day_name(F.col("fecha")).alias("nombre_dia")).agg(
        F.count("*").alias("total_interacciones"), _users(), ratio(F.count("*"), F.count_distinct("numero_entrada"), 2, 1).alias("promedio_interacciones_por_usuario"),
        _n(_res(), "servicios_resolucion"), _n(F.col("menu") == "SDO", "consultas_saldo"), _n(_commercial(), "interacciones_comerciales"),
        _n(failed(), "interacciones_fallidas"), _n(over, "experiencias_sobrecarga"), share(has_label("VSI"), 1).alias("tasa_validacion"),
        share(failed(), 1).alias("tasa_abandono"), share(over, 1).alias("tasa_sobrecarga"), mean(seconds()).alias("duracion_promedio_segundos"))


def user_evolution(llamadas: DataFrame, min_sessions: int = 3) -> DataFrame:
    """First against last session, variability and consistency of each caller."""
    s = _known(llamadas).groupBy(*SESSION).agg(
        F.count("*").alias("n"), _n(has_label("VSI"), "vsi"), _n(failed(), "bad"))
    n, c = F.col("n"), F.col
    first, last = (lambda v: F.min_by(v, "fecha")), (lambda v: F.max_by(v, "fecha"))
    users = s.groupBy("numero_entrada").agg(
        F.count("*").alias("total_sesiones"), first("n").alias("interacciones_primera_sesion"), last("n").alias("interacciones_ultima_sesion"),
        first("vsi").alias("validaciones_primera_sesion"), last("vsi").alias("validaciones_ultima_sesion"), mean(n).alias("promedio_interacciones_por_sesion"),
        mean_share(c("vsi"), n).alias("promedio_tasa_validacion"), F.sum(n.cast("decimal(19,0)")).alias("_sum"), spread(n).alias("_spread")).where(c("total_sesiones") >= min_sessions)
    a, b = c("interacciones_primera_sesion"), c("interacciones_ultima_sesion")

    def within(tenths: int) -> Column:
        """Whether the deviation is at most so many tenths of the average, both taken times the sessions and squared."""
        return c("_spread") * 100 <= c("_sum") * c("_sum") * tenths**2

    return users.withColumns({
        "cambio_interacciones": b - a, "cambio_validaciones": c("validaciones_ultima_sesion") - c("validaciones_primera_sesion"),
        "variabilidad_interacciones": F.round(F.sqrt(c("_spread").cast("double")) / c("total_sesiones"), 2),
        "patron_evolucion": first_match([
            (b * 10 < a * 7, "MEJORO_EFICIENCIA"), (b * 10 > a * 13, "AUMENTO_COMPLEJIDAD"),
            (c("validaciones_ultima_sesion") > c("validaciones_primera_sesion"), "MEJORO_EXITO"), (within(3), "COMPORTAMIENTO_ESTABLE")], "SIN_PATRON_CLARO"),
        "nivel_consistencia": first_match([(within(2), "MUY_CONSISTENTE"), (within(5), "CONSISTENTE"), (within(8), "MODERADAMENTE_VARIABLE")], "ALTAMENTE_VARIABLE"),
    }).drop("_sum", "_spread")


def intensity_segments(llamadas: DataFrame) -> DataFrame:
    n = F.col("n")
    users = llamadas.groupBy("numero_entrada").agg(F.count("*").alias("n"), vocabulary("menu").alias("menus"), (_avg_secs() / 60).alias("mins"))
    label = first_match([(n == 1, "1_SINGLE_TOUCH"), (n <= 5, "2-5_MODERATE"), (n <= 10, "6-10_ACTIVE")], "11+_POWER_USER")
    return users.groupBy(label.alias("segmento_usuario")).agg(
        F.count("numero_entrada").alias("cantidad_usuarios"), mean(n, 4).alias("promedio_interacciones"), mean(F.col("menus"), 4).alias("promedio_menus"),
        F.round(F.avg("mins"), 4).alias("duracion_promedio_min"))


def number_behaviour(llamadas: DataFrame) -> DataFrame:
    n, days, avg = F.col("total_interacciones"), F.col("dias_activos"), F.col("_avg")
    return llamadas.groupBy("numero_entrada", "numero_digitado").agg(
        F.count("*").alias("total_interacciones"), vocabulary("fecha").alias("dias_activos"), vocabulary("menu").alias("menus_diferentes"),
        vocabulary("opcion").alias("opciones_diferentes"), ratio(F.count("*"), vocabulary("fecha"), 2, 1).alias("interacciones_por_dia"),
        F.min("fecha").alias("primera_aparicion"), F.max("fecha").alias("ultima_aparicion"), mean(seconds()).alias("duracion_promedio_seg"), F.avg(seconds()).alias("_avg"),
    ).withColumn("patron_comportamiento", first_match([
        (n > days * 20, "ALTO_VOLUMEN"), ((F.col("menus_diferentes") == 1) & (n > 10), "MENU_UNICO"), (avg < 5, "DURACION_MUY_CORTA"),
        (days > 30, "USO_CONTINUO")], "NORMAL")).drop("_avg")


def time_direction(llamadas: DataFrame, sample: int = 5) -> DataFrame:
    key = "tipo_timestamp"
    rows = llamadas.withColumn(key, F.when(inverted(), "TIMESTAMPS_INVERTIDOS").otherwise("TIMESTAMPS_NORMALES"))
    found = rows.groupBy(key).agg(F.count("*").alias("cantidad"), mean(seconds()).alias("duracion_promedio_seg"), _users("usuarios_afectados"))
    return found.join(bounded_list(rows, [key], "menu", sample, ",", "menus_frecuentes"), key, "left")


def anomaly_list(llamadas: DataFrame, sample: int = 3) -> DataFrame:
    """Inverted times, rows without menu and option, rows without dialled number."""
    total = llamadas.agg(F.count("*")).scalar()
    rules = [(inverted(), "TIMESTAMPS_INVERTIDOS"), (F.col("menu").isNull() & F.col("opcion").isNull(), "SIN_MENU_NI_OPCION"),
             (is_blank(F.col("numero_digitado")), "SIN_NUMERO_DIGITADO")]
    key = "tipo_anomalia"
    hits = matching(llamadas, [key], rules, keep=["numero_entrada", "menu"])
    found = hits.groupBy(key).agg(F.count("*").alias("casos"), _users("usuarios_afectados"))
    frame = llamadas.sparkSession.createDataFrame([(r[1],) for r in rules], f"{key} string")
    out = frame.join(found, key, "left").join(bounded_list(hits, [key], "menu", sample, ",", "menus_frecuentes"), key, "left")
    return out.select(
        key, F.coalesce("casos", F.lit(0)).alias("casos"), F.coalesce("usuarios_afectados", F.lit(0)).alias("usuarios_afectados"),
        F.when(F.col(key) == "SIN_MENU_NI_OPCION", "N/A").otherwise(F.col("menus_frecuentes")).alias("menus_frecuentes"),
        ratio(F.coalesce("casos", F.lit(0)), total).alias("porcentaje_total"))


def hourly_activity(llamadas: DataFrame) -> DataFrame:
    return llamadas.groupBy(hour().alias("hora_del_dia")).agg(
        F.count("*").alias("total_interacciones"), _users(), mean(raw_seconds()).alias("duracion_promedio"), _n(equal(), "numeros_iguales"),
        _n(different(), "numeros_diferentes"), sorted_set(F.col("menu"), ",").alias("menus_activos"))


def daily_hourly_activity(llamadas: DataFrame) -> DataFrame:
    return llamadas.groupBy(F.date_format("fecha", "yyyy-MM-dd").alias("fecha_formateada"), hour().alias("hora_del_dia")).agg(
        F.count("*").alias("total_interacciones"), _users("usuarios_activos"), _n(_res(), "servicios"), _n(F.col("menu") == "SDO", "consultas_saldo"),
        _n(_commercial(), "comerciales"), _n(failed(), "fallidas"), _n(different(), "transferencias"), mean(raw_seconds()).alias("duracion_promedio_seg"))


def _per_user_day() -> Column:
    return ratio(F.count("*"), F.count_distinct("numero_entrada") * vocabulary("fecha"), 2, 1)


def zone_behaviour(llamadas: DataFrame) -> DataFrame:
    return llamadas.groupBy(F.col("id_8T").alias("zona_geografica")).agg(
        F.count("*").alias("total_interacciones"), _users("usuarios_unicos_zona"), vocabulary("fecha").alias("dias_activos"),
        _per_user_day().alias("promedio_interacciones_usuario_dia"), share(equal(), 1).alias("porcentaje_numeros_iguales"),
        vocabulary(menu_option()).alias("combinaciones_menu_opcion"), sorted_set(F.col("menu"), ",").alias("menus_disponibles"))


def zone_division_area(llamadas: DataFrame, sample: int = 3) -> DataFrame:
    keys = ["zona_geografica", "division", "area"]
    rows = llamadas.where(F.col("id_8T").isNotNull()).withColumnRenamed("id_8T", "zona_geografica")
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("total_interacciones"), _users(), vocabulary("fecha").alias("dias_activos"),
        _per_user_day().alias("promedio_interacciones_usuario_dia"), share(equal(), 1).alias("pct_numeros_iguales"),
        share(inverted(), 1).alias("pct_timestamps_invertidos"))
    return join_on(found, bounded_list(rows, keys, "menu", sample, ",", "menus_principales"), keys)


def zone_totals(llamadas: DataFrame, periods: Periods) -> DataFrame:
    return periods.tag(llamadas.drop("trimestre"), "fecha").groupBy(F.col("id_8T").alias("zona")).agg(
        F.count("*").alias("total_interacciones"), _users(), vocabulary("fecha").alias("dias_activos"), _per_user_day().alias("promedio_bruto_diario"),
        _n(equal(), "oficiales"), _n(different(), "derivadas"), share(equal(), 1).alias("pct_oficiales"))


def division_area(llamadas: DataFrame) -> DataFrame:
    return llamadas.where(F.col("division").isNotNull() & F.col("area").isNotNull()).groupBy("division", "area").agg(
        F.count("*").alias("total_interacciones"), _users(), F.count("*").cast("double").alias("promedio_por_area"), _n(equal(), "numeros_iguales"),
        _n(different(), "numeros_diferentes"), vocabulary(menu_option()).alias("diversidad_navegacion"), vocabulary("id_8T").alias("zonas_geograficas"))
