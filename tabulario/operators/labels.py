"""Menus, options and labels of the call log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulario.functions.calls import (
    FAILED_MENUS, different, equal, failed, has_label, hour, labelled, menu_option, option_reflected, raw_seconds, redirected, seconds,
    transfer, unlabelled,
)
from tabulario.functions.exact import mean, mean_share, ratio, share
from tabulario.functions.labels import clean_list, comma_count, entries
from tabulario.functions.text import filled, is_blank, sorted_set, vocabulary
from tabulario.operators.calls import GENERIC_OPTIONS
from tabulario.plans.shape import bounded_list, first_match, join_on, matching, only, ranked, top_per_key, whole_lists, with_distinct_counts

KEY = ["menu", "opcion"]


def _n(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def _users(name: str = "usuarios_unicos") -> Column:
    return F.count_distinct("numero_entrada").alias(name)


def _moved() -> Column:
    """Transfer as most label reports count it: a missing dialled number is one."""
    return transfer("null_kept")


def _top(df: DataFrame, by: str, keys: Sequence[str], limit: int | None) -> DataFrame:
    return df if limit is None else ranked(df, by, keys, limit)


def exploded_labels(llamadas: DataFrame) -> DataFrame:
    """One row per label with its position; any number of labels."""
    return llamadas.select("idRe", "numero_entrada", *KEY, "fecha", F.inline(entries(F.col("etiquetas")))).withColumnsRenamed(
        {"etiqueta": "etiqueta_individual", "posicion": "posicion_etiqueta"})


def label_frequency(llamadas: DataFrame, limit: int = 20) -> DataFrame:
    """Frequency of single labels against the labelled rows, with an inferred class."""
    e = F.col("etiqueta")
    total = llamadas.agg(F.count("etiquetas")).scalar()
    freq = exploded_labels(llamadas).groupBy(F.col("etiqueta_individual").alias("etiqueta")).agg(F.count("*").alias("frecuencia"))
    return _top(freq, "frecuencia", ["etiqueta"], limit).withColumns({
        "porcentaje": ratio(F.col("frecuencia"), total),
        "categoria_inferida": first_match([
            (e.contains("VSI"), "Validación/Verificación"), (e.contains("ZMB"), "Zona/Región"), (e.contains("TELCO"), "Telecomunicaciones"),
            (e.contains("WTS"), "Sistema Técnico"), (e.contains("2L") | e.contains("1L"), "Línea/Nivel"), (e.contains("NOBOT"), "Sin Robot/Manual"),
        ], "Otra categoría"),
    })


def label_functions(llamadas: DataFrame, limit: int = 25) -> DataFrame:
    """Frequency of single labels against all labels, with a functional class."""
    e = F.col("etiqueta")
    labels = exploded_labels(llamadas).select(F.col("etiqueta_individual").alias("etiqueta"))
    total = labels.agg(F.count("*")).scalar()
    return _top(labels.groupBy("etiqueta").agg(F.count("*").alias("frecuencia")), "frecuencia", ["etiqueta"], limit).withColumns({
        "porcentaje": ratio(F.col("frecuencia"), total),
        "categoria_funcional": first_match([
            (e == "ZMB", "ZONA_METROPOLITANA"), (e.isin("VSI", "DG", "WTS"), "VALIDACION_TECNICA"), (e.isin("2L", "1L", "ML"), "TIPO_LINEA"),
            (e.like("RES_%") | e.like("TELCO%"), "RESULTADO_OPERACION"), (e.like("SEG_%") | e.like("PR_%"), "SEGMENTO_CLIENTE"),
            (e.like("IN25%") | e.like("VALS%"), "IDENTIFICADOR_SISTEMA"), (e == "NOBOT", "SIN_ROBOT"),
            (e.like("%_MA%") | e.like("%_AB_%"), "CODIGO_PROCESO"),
        ], "OTRO_CODIGO"),
    })


# Labels with an indicator column.
INDICATORS = ("ZMB", "VSI", "2L", "1L", "WTS", "TELCO", "MGC", "NOBOT", "DEFAULT")


def label_indicators(llamadas: DataFrame, whole_labels: bool = False) -> DataFrame:
    """0/1 column per known label: substring of the list, or `whole_labels` only."""
    def has(label: str) -> Column:
        if whole_labels:
            return F.coalesce(F.exists(entries(F.col("etiquetas")), lambda e: e["etiqueta"] == label), F.lit(False))
        return has_label(label)

    return llamadas.select("idRe", "numero_entrada", *KEY, "fecha", "etiquetas", *[has(x).cast("int").alias(f"tiene_{x}") for x in INDICATORS])


def menu_usage(llamadas: DataFrame, limit: int = 15) -> DataFrame:
    total = llamadas.agg(F.count("*")).scalar()
    per_menu = llamadas.where(F.col("menu").isNotNull()).groupBy("menu").agg(
        F.count("*").alias("total_usos"), _users(), ratio(F.count("*"), F.count_distinct("numero_entrada"), 2, 1).alias("promedio_por_usuario"),
        vocabulary("fecha").alias("dias_activos"))
    return _top(per_menu, "total_usos", ["menu"], limit).withColumn("porcentaje_total", ratio(F.col("total_usos"), total))


def menu_abandonment(llamadas: DataFrame, min_rows: int = 10) -> DataFrame:
    return llamadas.where(F.col("menu").isNotNull()).groupBy("menu").agg(
        F.count("*").alias("total"), _n(unlabelled(), "sin_etiquetas"), share(unlabelled()).alias("tasa_abandono")).where(F.col("total") >= min_rows)


def option_usage(llamadas: DataFrame, sample: int = 10) -> DataFrame:
    rows = llamadas.where(filled(F.col("opcion")))
    used = rows.groupBy("opcion").agg(F.count("*").alias("frecuencia"), vocabulary("menu").alias("menus_diferentes"))
    return used.join(bounded_list(rows, ["opcion"], "menu", sample, ",", "menus_asociados"), "opcion", "left")


def option_transfers(llamadas: DataFrame, min_rows: int = 5) -> DataFrame:
    return llamadas.where(F.col("opcion").isNotNull()).groupBy("opcion").agg(
        F.count("*").alias("total"), _n(_moved(), "transferencias"), share(_moved()).alias("tasa_transferencia")).where(F.col("total") >= min_rows)


def combination_success(llamadas: DataFrame, min_rows: int = 5, limit: int = 20) -> DataFrame:
    found = llamadas.where(F.col("menu").isNotNull() & F.col("opcion").isNotNull()).groupBy(*KEY).agg(
        F.count("*").alias("frecuencia"), _n(labelled(), "con_etiquetas"), share(labelled()).alias("tasa_completitud"),
        _n(_moved(), "transferencias"), share(_moved()).alias("tasa_transferencia"), F.avg(raw_seconds()).alias("segundos_promedio"))
    return _top(found.where(F.col("frecuencia") >= min_rows), "frecuencia", KEY, limit)


def _res() -> Column:
    return F.col("menu").like("RES-%")


def _commercial() -> Column:
    return F.col("menu").like("comercial_%")


def menu_label_patterns(llamadas: DataFrame, min_rows: int = 10, chars: int = 200) -> DataFrame:
    rows, n, kinds = llamadas.where(F.col("menu").isNotNull()), F.col("total_usos"), F.col("patrones_diferentes")
    found = rows.groupBy("menu").agg(
        F.count("*").alias("total_usos"), F.count_distinct("etiquetas").alias("patrones_diferentes"), _n(has_label("VSI"), "_vsi"),
        _n(unlabelled(), "_empty")).where(n >= min_rows)
    listed = bounded_list(rows, ["menu"], "etiquetas", chars + 1, " | ", "patrones_etiquetas")
    return found.join(listed, "menu", "left").select(
        "menu", "total_usos", "patrones_diferentes", F.left("patrones_etiquetas", F.lit(chars)).alias("patrones_etiquetas"),
        first_match([(_res() & (F.col("_vsi") * 10 > n * 7), "CONSISTENTE_RES"), (_commercial() & (F.col("_empty") * 10 > n * 8), "CONSISTENTE_COMERCIAL"),
                     (kinds == 1, "PATRON_UNICO"), (kinds * 10 > n * 8, "ALTAMENTE_VARIABLE")], "PATRON_MODERADO").alias("tipo_patron"))


def option_reflection(llamadas: DataFrame, min_rows: int = 5, sample: int = 5) -> DataFrame:
    """How often an option shows up in the labels."""
    rows, n, hits = llamadas.where(filled(F.col("opcion"))), F.col("total"), F.col("opcion_en_etiquetas")
    found = rows.groupBy("opcion").agg(F.count("*").alias("total"), _n(option_reflected(), "opcion_en_etiquetas")).where(n >= min_rows)
    listed = bounded_list(rows.select("opcion", F.left("etiquetas", F.lit(50)).alias("_e")), ["opcion"], "_e", sample, ",", "ejemplos_etiquetas")
    return found.join(listed, "opcion", "left").withColumns({
        "porcentaje_reflejo": ratio(hits, n),
        "nivel_consistencia": first_match([
            (F.col("opcion").isin("DEFAULT", "1", "2", "21") & (hits * 10 < n), "OPCION_GENERICA"), (hits * 10 > n * 7, "ALTA_CONSISTENCIA"),
            (hits * 10 > n * 3, "CONSISTENCIA_MEDIA")], "BAJA_CONSISTENCIA"),
    })


def _class_order(col: str, names: Sequence[str]) -> Column:
    return first_match([(F.col(col) == name, i) for i, name in enumerate(names)], len(names))


def menu_option_flow(llamadas: DataFrame, min_rows: int = 10, limit: int = 25) -> DataFrame:
    n, done, empty, moved = (F.col(c) for c in ("frecuencia", "_done", "sin_procesamiento", "transferencias_exitosas"))
    flow = F.concat("menu", F.lit(" → "), F.coalesce("opcion", F.lit("SIN_OPCION")))
    found = llamadas.where(F.col("menu").isNotNull()).groupBy("menu", flow.alias("flujo")).agg(
        F.count("*").alias("frecuencia"), F.count_distinct("etiquetas").alias("variabilidad_etiquetas"),
        F.avg(comma_count(F.col("etiquetas"))).alias("promedio_etiquetas_por_interaccion"), _n(_moved(), "transferencias_exitosas"),
        _n(has_label("VSI"), "con_validacion"), _n(unlabelled(), "sin_procesamiento"), _n(labelled(), "_done"),
        share(labelled()).alias("tasa_completitud"), share(_moved()).alias("tasa_transferencia")).where(n >= min_rows)
    classed = found.withColumn("clasificacion_flujo", first_match([
        ((done * 10 > n * 9) & (moved * 10 > n * 3), "FLUJO_OPTIMO"), (empty * 2 > n, "FLUJO_PROBLEMATICO"),
        (F.col("menu").contains("cte_colgo") | F.col("menu").contains("SinOpcion"), "FLUJO_ABANDONO")], "FLUJO_NORMAL"))
    order = _class_order("clasificacion_flujo", ["FLUJO_OPTIMO", "FLUJO_NORMAL", "FLUJO_PROBLEMATICO", "FLUJO_ABANDONO"])
    return classed.orderBy(order, n.desc(), "flujo").limit(limit).drop("_done", "menu")


def rule_violations(llamadas: DataFrame, limit: int = 20) -> DataFrame:
    """Most frequent menu-option-label combinations that break one of three rules."""
    e, o, size = F.col("etiquetas"), F.col("opcion"), F.octet_length
    rules = [
        (_res() & e.isNotNull() & ~has_label("VSI"), "REGLA_VIOLADA", "RES sin VSI"),
        (~o.isin("DEFAULT", "1", "21", "2") & (size(o) > 2) & ~option_reflected(), "OPCION_NO_REFLEJADA", "Opción no aparece en etiquetas"),
        (_commercial() & (size(e) > 10) & ~e.contains("DEFAULT"), "COMERCIAL_CON_ETIQUETAS_COMPLEJAS", "Menu comercial con etiquetas inesperadas"),
    ]
    keys = ["tipo_anomalia", "descripcion", *KEY, "etiquetas"]
    found = matching(llamadas, ["tipo_anomalia", "descripcion"], rules, keep=[*KEY, "etiquetas"]).groupBy(*keys).agg(F.count("*").alias("frecuencia_anomalia"))
    return ranked(found, "frecuencia_anomalia", keys, limit)


def rule_violation_counts(llamadas: DataFrame, sample: int = 5) -> DataFrame:
    o = F.col("opcion")
    rules = [
        (_res() & ~has_label("VSI"), "MENU_RES_SIN_VSI"),
        (filled(o) & ~o.isin(*GENERIC_OPTIONS) & ~option_reflected(), "OPCION_NO_REFLEJADA_EN_ETIQUETAS"),
        (_commercial() & labelled() & (F.octet_length("etiquetas") > 10), "COMERCIAL_CON_ETIQUETAS_COMPLEJAS"),
    ]
    hits = matching(llamadas.withColumn("_mo", menu_option()), ["tipo_anomalia"], rules, keep=["_mo"])
    found = hits.groupBy("tipo_anomalia").agg(F.count("*").alias("casos_anomalos"))
    frame = llamadas.sparkSession.createDataFrame([(r[1],) for r in rules], "tipo_anomalia string")
    return frame.join(found, "tipo_anomalia", "left").join(bounded_list(hits, ["tipo_anomalia"], "_mo", sample, ",", "ejemplos"), "tipo_anomalia", "left").withColumn(
        "casos_anomalos", F.coalesce("casos_anomalos", F.lit(0)))


def pattern_evolution(llamadas: DataFrame) -> DataFrame:
    combo = F.concat("menu", F.lit("|"), F.coalesce("opcion", F.lit("NULL")))
    res_vsi = _res() & has_label("VSI")
    rows = llamadas.where(F.col("menu").isNotNull())
    found = rows.groupBy("trimestre").agg(
        vocabulary(combo).alias("combinaciones_menu_opcion"), F.count_distinct("etiquetas").alias("patrones_etiquetas_unicos"),
        _n(res_vsi, "res_con_vsi"), _n(_res(), "total_res"), ratio(F.count_if(res_vsi), F.count_if(_res())).alias("consistencia_res_vsi"))
    return with_distinct_counts(found, rows, ["trimestre"], {"patrones_completos": [F.concat("menu", F.lit(":"), "etiquetas")]})


def menu_dashboard(llamadas: DataFrame, min_rows: int = 10, options: int = 3) -> DataFrame:
    rows, n = llamadas.where(F.col("menu").isNotNull()), F.col("volumen_total")
    found = rows.groupBy("menu").agg(
        F.count("*").alias("volumen_total"), _users("usuarios_alcanzados"), ratio(F.count("*"), F.count_distinct("numero_entrada"), 2, 1).alias("interacciones_por_usuario"),
        share(labelled()).alias("tasa_procesamiento"), share(_moved()).alias("tasa_transferencia"), _n(labelled(), "_done"), _n(unlabelled(), "_empty"),
    ).where(n >= min_rows)
    per_option = rows.where(F.col("opcion").isNotNull()).groupBy(*KEY).agg(F.count("*").alias("_c"))
    top = top_per_key(per_option, ["menu"], [F.col("_c").desc(), F.col("opcion")], options).groupBy("menu").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "opcion"))), lambda s: s["opcion"]), ",").alias("top_opciones"))
    return found.join(top, "menu", "left").withColumn("categoria_rendimiento", first_match([
        ((F.col("_done") * 100 >= n * 90) & (n >= 100), "ALTO_RENDIMIENTO"), (F.col("_empty") * 2 >= n, "RENDIMIENTO_CRITICO")], "RENDIMIENTO_MEDIO")).drop("_done", "_empty")


def combination_search(
    llamadas: DataFrame, menu: str | None = None, opcion: str | None = None, etiqueta: str | None = None, limit: int = 20
) -> DataFrame:
    """Combinations matching the given filters, with their share of all rows."""
    total = llamadas.agg(F.count("*")).scalar()
    rows = llamadas
    if menu is not None:
        rows = rows.where(F.col("menu") == menu)
    if opcion is not None:
        rows = rows.where(F.col("opcion") == opcion)
    if etiqueta is not None:
        rows = rows.where(F.col("etiquetas").contains(etiqueta))
    keys = [*KEY, "etiquetas"]
    return ranked(rows.groupBy(*keys).agg(F.count("*").alias("frecuencia")), "frecuencia", keys, limit).withColumn("porcentaje", ratio(F.col("frecuencia"), total))


def menu_classes(llamadas: DataFrame) -> DataFrame:
    m = F.col("menu")
    label = first_match([
        (is_blank(m), "MENU_FALTANTE"), (_res(), "TIPO_RES"), (_commercial(), "TIPO_COMERCIAL"), (m.isin(*FAILED_MENUS), "ABANDONO_SISTEMA"),
        (m == "Numero tel", "CAPTURA_NUMERO"), (m.contains("Desborde"), "DESBORDE"), (m.like("NOTMX-%"), "NO_MEXICO"), (m == "SDO", "SALDO"),
        (m.like("PG_%") | (m == "ZMB"), "CODIGOS_ESPECIALES")], "OTROS_MENUS")
    return llamadas.groupBy(label.alias("categoria_menu")).agg(
        F.count("*").alias("total_registros"), _users(), _n(unlabelled(), "sin_etiquetas"), share(unlabelled()).alias("porcentaje_sin_etiquetas"),
        _n(different(), "con_transferencias"), share(different()).alias("tasa_transferencia"), F.left(sorted_set(m), F.lit(100)).alias("ejemplos_menus"))


def option_types(llamadas: DataFrame) -> DataFrame:
    o = F.col("opcion")
    label = first_match([
        (is_blank(o), "OPCION_FALTANTE"), (o == "DEFAULT", "DEFAULT"), (o.isin("1", "2", "5", "11", "21"), "OPCION_NUMERICA"),
        (o.isin("2L", "1L", "ML"), "TIPO_LINEA"), (F.octet_length(o) > 5, "OPCION_COMPLEJA")], "OPCION_ESPECIFICA")
    return llamadas.groupBy(label.alias("tipo_opcion")).agg(
        F.count("*").alias("frecuencia"), vocabulary("menu").alias("menus_asociados"), _n(labelled(), "con_resultado"),
        share(labelled()).alias("tasa_efectividad"), F.left(sorted_set(o), F.lit(100)).alias("valores_opcion_reales"))


def _dominant_pattern(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Most frequent cleaned label list per key, alphabetical among equals; no window over the rows."""
    counts = rows.where(labelled()).groupBy(*keys, F.coalesce(clean_list(F.col("etiquetas")), F.lit("")).alias("_p")).agg(F.count("*").alias("_c"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col("_p").alias("p")))["p"].alias(name))


def combination_profile(llamadas: DataFrame, min_rows: int = 3, limit: int = 30) -> DataFrame:
    """Most used menu-option combinations with their dominant label pattern."""
    rows = llamadas.where(F.col("menu").isNotNull()).withColumn("opcion", F.coalesce("opcion", F.lit("SIN_OPCION")))
    n, empty, moved = F.col("frecuencia"), F.col("registros_incompletos"), F.col("transferencias")
    found = rows.groupBy(*KEY).agg(
        F.count("*").alias("frecuencia"), _n(unlabelled(), "registros_incompletos"), share(labelled()).alias("tasa_completitud"),
        _n(different(), "transferencias"), share(different()).alias("tasa_transferencia")).where(n >= min_rows)
    shown = _top(found, "frecuencia", KEY, limit)
    return join_on(shown, _dominant_pattern(rows, KEY, "patron_etiquetas_principal"), KEY).withColumn("clasificacion", first_match([
        (empty * 100 > n * 70, "PROBLEMATICA"), (moved * 100 > n * 50, "ALTA_TRANSFERENCIA"), (n < 5, "BAJA_FRECUENCIA")], "NORMAL"))


def rule_compliance(llamadas: DataFrame) -> DataFrame:
    m, n = F.col("menu"), F.col("total_casos")
    vsi, zmb, empty, group = (F.col(c) for c in ("casos_con_vsi", "casos_con_zmb", "casos_sin_etiquetas", "menu_categoria"))
    label = first_match([(_res(), "TIPO_RES"), (m.contains("Desborde"), "DESBORDE"), (_commercial(), "COMERCIAL"), (failed(), "ABANDONO")], "OTROS")
    return llamadas.where(m.isNotNull()).groupBy(label.alias("menu_categoria")).agg(
        F.count("*").alias("total_casos"), _n(has_label("VSI"), "casos_con_vsi"), _n(has_label("ZMB"), "casos_con_zmb"), _n(unlabelled(), "casos_sin_etiquetas"),
    ).withColumns({
        "porcentaje_vsi": ratio(vsi, n), "porcentaje_zmb": ratio(zmb, n), "porcentaje_vacios": ratio(empty, n),
        "evaluacion_reglas": first_match([
            ((group == "TIPO_RES") & (vsi * 100 < n * 30), "REGLA_VSI_INCUMPLIDA"), ((group == "DESBORDE") & (zmb * 100 < n * 50), "REGLA_ZMB_INCUMPLIDA"),
            (empty * 100 > n * 60, "ALTO_ABANDONO")], "CUMPLIMIENTO_ACEPTABLE"),
    })


def option_label_consistency(llamadas: DataFrame, min_rows: int = 3, limit: int = 20, chars: int = 150) -> DataFrame:
    o, e = F.col("opcion"), F.col("etiquetas")
    rows = llamadas.where(filled(o))
    right = (o == "DEFAULT") | (F.octet_length(o) <= 2) | option_reflected()

    def not_shown(option: str) -> Column:
        return (o == option) & ~e.contains(option) & e.isNotNull()

    found = rows.groupBy("opcion").agg(
        F.count("*").alias("total_usos"), _n(right, "reflexion_correcta"), _n(not_shown("2L"), "opcion_2l_no_reflejada"),
        _n(not_shown("CECOR"), "opcion_cecor_no_reflejada"), _n(labelled(), "con_procesamiento"), share(labelled()).alias("tasa_procesamiento"),
    ).where(F.col("total_usos") >= min_rows)
    listed = bounded_list(rows.where(labelled()).select("opcion", F.left(e, F.lit(30)).alias("_e")), ["opcion"], "_e", chars + 1, " | ", "ejemplos_etiquetas")
    return _top(found, "total_usos", ["opcion"], limit).join(listed, "opcion", "left").withColumn("ejemplos_etiquetas", F.left("ejemplos_etiquetas", F.lit(chars)))


def complete_flows(llamadas: DataFrame, min_rows: int = 5, limit: int = 25) -> DataFrame:
    """Flows with class, the best classes first; missing menu or option is a flow of its own."""
    n, done, empty, moved = F.col("volumen"), F.col("flujos_procesados"), F.col("_empty"), F.col("transferencias_exitosas")
    found = llamadas.groupBy(*KEY).agg(
        F.count("*").alias("volumen"), _users(), _n(labelled(), "flujos_procesados"), share(labelled()).alias("tasa_completitud"),
        _n(different(), "transferencias_exitosas"), share(different()).alias("tasa_exito"), _n(unlabelled(), "_empty")).where(n >= min_rows)
    classed = found.withColumns({
        "flujo_navegacion": F.concat(F.coalesce("menu", F.lit("NULL_MENU")), F.lit(" → "), F.coalesce("opcion", F.lit("NULL_OPCION"))),
        "clasificacion_flujo": first_match([
            (failed(), "FLUJO_ABANDONO"), (F.col("menu").isNull() & F.col("opcion").isNotNull(), "FLUJO_INCONSISTENTE"),
            ((done * 100 >= n * 80) & (moved * 100 >= n * 30), "FLUJO_OPTIMO"), (empty * 100 > n * 60, "FLUJO_PROBLEMATICO")], "FLUJO_NORMAL"),
    })
    order = _class_order("clasificacion_flujo", ["FLUJO_OPTIMO", "FLUJO_NORMAL", "FLUJO_PROBLEMATICO", "FLUJO_INCONSISTENTE", "FLUJO_ABANDONO"])
    shown = classed.orderBy(order, n.desc(), "flujo_navegacion").limit(limit)
    return join_on(shown, _dominant_pattern(llamadas, KEY, "patron_etiquetas_dominante"), KEY).drop(*KEY, "_empty")


def record_anomalies(llamadas: DataFrame, chars: int = 200) -> DataFrame:
    """Four record anomalies with sample cases; one scan, one exploded rule row per hit."""
    e = F.col("etiquetas")
    rules = [
        (is_blank(F.col("menu")) & filled(F.col("opcion")), "MENU_NULL_CON_OPCION"), (_res() & labelled() & ~has_label("VSI"), "RES_SIN_VSI"),
        ((F.col("opcion") == "2L") & labelled() & ~has_label("2L"), "OPCION_2L_NO_REFLEJADA"), (e.endswith(","), "ETIQUETAS_FORMATO_INCORRECTO"),
    ]
    case = F.concat(F.lit("idRe:"), F.col("idRe").cast("string"), F.lit(" Menu:"), F.coalesce("menu", F.lit("NULL")), F.lit(" Opc:"), F.coalesce("opcion", F.lit("NULL")))
    hits = matching(llamadas.withColumn("_case", case), ["tipo_anomalia"], rules, keep=["_case"])
    # A case text has at least 16 characters and its separator three.
    listed = bounded_list(hits, ["tipo_anomalia"], "_case", chars // 19 + 2, " | ", "ejemplos_casos")
    return hits.groupBy("tipo_anomalia").agg(F.count("*").alias("casos_detectados")).join(listed, "tipo_anomalia", "left").withColumn(
        "ejemplos_casos", F.left("ejemplos_casos", F.lit(chars)))


def routes(llamadas: DataFrame, min_rows: int = 10, good: tuple[int, int] = (70, 30), bad: tuple[int, int] = (30, 5)) -> DataFrame:
    """Successful and problematic menu-option routes; a route may be both."""
    done, moved = F.col("tasa_procesamiento"), F.col("tasa_transferencia")
    found = llamadas.where(F.col("menu").isNotNull()).groupBy(*KEY).agg(
        F.count("*").alias("volumen"), share(labelled()).alias("tasa_procesamiento"), share(different()).alias("tasa_transferencia")).where(F.col("volumen") >= min_rows)
    return matching(found, ["tipo_ruta"], [
        (~failed() & (done >= good[0]) & (moved >= good[1]), "RUTA_EXITOSA"), ((done < bad[0]) | (moved < bad[1]), "RUTA_PROBLEMATICA"),
    ], keep=[*KEY, "volumen", "tasa_procesamiento", "tasa_transferencia"])


def label_validity(llamadas: DataFrame, sample: int = 5) -> DataFrame:
    label = first_match([
        (unlabelled(), "SIN_ETIQUETAS"), (has_label("VSI") & has_label("ZMB"), "VALIDADO_COMPLETO"), (has_label("NOBOT"), "INTERACCION_HUMANA"),
        (has_label("NoTmx_SOMC"), "ERROR_SISTEMA"), (has_label("VSI"), "VALIDADO_PARCIAL"), (has_label("ZMB"), "SISTEMA_BASE")], "OTROS_ESTADOS")
    rows, key = llamadas.withColumn("categoria_validacion", label), "categoria_validacion"
    found = rows.groupBy(key).agg(
        F.count("*").alias("total_registros"), _users(), mean(raw_seconds()).alias("duracion_promedio_seg"), _n(different(), "transferencias"),
        share(different(), 1).alias("pct_transferencias"))
    return found.join(bounded_list(rows, [key], "menu", sample, ",", "menus_frecuentes"), key, "left")


def label_kinds(llamadas: DataFrame, sample: int = 5) -> DataFrame:
    label = first_match([(has_label("VSI"), "CON_VSI"), (has_label("NOBOT"), "INTERACCION_HUMANA"), (has_label("ZMB"), "ZONA_BASE"), (unlabelled(), "SIN_ETIQUETAS")], "OTROS")
    rows, key = llamadas.withColumn("tipo_por_etiqueta", label), "tipo_por_etiqueta"
    found = rows.groupBy(key).agg(
        F.count("*").alias("total_registros"), _users(), _n(equal(), "numeros_iguales"), _n(different(), "numeros_diferentes"),
        _n(F.col("numero_digitado").isNull(), "sin_numero_digitado"))
    return found.join(bounded_list(rows, [key], "menu", sample, ",", "menus_frecuentes"), key, "left")


def service_levels(llamadas: DataFrame, sample: int = 5) -> DataFrame:
    label = first_match([(has_label("1L"), "1L_PRIMER_NIVEL"), (has_label("2L"), "2L_SEGUNDO_NIVEL"), (has_label("ML"), "ML_MULTI_NIVEL")], "SIN_NIVEL_DEFINIDO")
    rows, key = llamadas.where(labelled()).withColumn("nivel_servicio", label), "nivel_servicio"
    served = F.coalesce(~F.col("menu").isin(*FAILED_MENUS), F.lit(False))
    found = rows.groupBy(key).agg(
        F.count("*").alias("total_casos"), _users(), _n(served, "interacciones_exitosas"), share(served, 1).alias("tasa_exito_pct"),
        mean(raw_seconds()).alias("duracion_promedio_seg"), vocabulary("id_8T").alias("zonas_geograficas"), vocabulary("division").alias("divisiones_activas"))
    return found.join(bounded_list(rows, [key], "menu", sample, ",", "menus_por_nivel"), key, "left")


# Label fragment and the process it stands for.
TECHNICAL_CODES = {
    "MIGRAFTTH": "MIGRACION_FIBRA", "PSB_FLL_DSLAM": "DSLAM_PROCESS", "FM_CFE": "FALLA_CFE", "BDEMANDA": "BAJO_DEMANDA",
    "TELECOB": "TELECOBRANZA", "QJA_": "PROCESO_QUEJA",
}


def technical_codes(llamadas: DataFrame, codes: dict[str, str] = TECHNICAL_CODES, sample: int = 3) -> DataFrame:
    """Cases per technical code ('_' in a fragment stands for any character); codes without cases show 0."""
    rules = [(F.coalesce(F.col("etiquetas").like(f"%{part}%"), F.lit(False)), name) for part, name in codes.items()]
    hits = matching(llamadas, ["tipo_codigo"], rules, keep=["numero_entrada", "menu"])
    found = hits.groupBy("tipo_codigo").agg(F.count("*").alias("casos"), _users("usuarios_afectados"))
    frame = llamadas.sparkSession.createDataFrame([(c,) for c in codes.values()], "tipo_codigo string")
    return frame.join(found, "tipo_codigo", "left").join(bounded_list(hits, ["tipo_codigo"], "menu", sample, ",", "menus_asociados"), "tipo_codigo", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("casos", "usuarios_afectados")})


def label_segments(llamadas: DataFrame) -> DataFrame:
    """Callers with at least two rows, classed by their labels."""
    n = F.col("n")
    users = llamadas.groupBy("numero_entrada").agg(
        F.count("*").alias("n"), _n(has_label("VSI"), "vsi"), _n(has_label("NOBOT"), "human"), _n(has_label("NoTmx_SOMC"), "error"),
        _n(has_label("2L"), "l2"), _n(has_label("ML"), "ml"), _n(has_label("TELCO") | has_label("TELECOB"), "telco"),
        _n(F.coalesce(F.col("etiquetas").like("%QJA_%"), F.lit(False)), "qja"), _n(unlabelled(), "empty")).where(n > 1)
    c = F.col
    profile = first_match([
        (c("error") * 2 > n, "USUARIO_PROBLEMAS_SISTEMA"), ((c("human") > 0) & (c("vsi") > 0), "USUARIO_MIXTO_HUMANO_SISTEMA"), (c("qja") > 0, "USUARIO_CON_QUEJAS"),
        (c("telco") > 0, "USUARIO_SERVICIOS_TELCO"), (c("ml") > 0, "USUARIO_MULTINIVEL"), (c("l2") > 0, "USUARIO_ESCALADO"),
        (c("vsi") * 100 > n * 80, "USUARIO_VALIDADO_SISTEMA"), (c("empty") * 100 > n * 70, "USUARIO_SIN_PROCESAMIENTO")], "USUARIO_ESTANDAR")
    return users.groupBy(profile.alias("perfil_usuario")).agg(
        F.count("*").alias("usuarios_en_perfil"), mean(n).alias("promedio_interacciones"), mean_share(c("vsi"), n).alias("promedio_pct_vsi"),
        mean_share(c("human"), n).alias("promedio_pct_humanas"), mean_share(c("empty"), n).alias("promedio_pct_sin_etiquetas"))


def labels_and_behaviour(llamadas: DataFrame, min_rows: int = 5, limit: int = 20) -> DataFrame:
    vsi, s = has_label("VSI"), raw_seconds()
    found = llamadas.where(F.col("menu").isNotNull()).groupBy(*KEY).agg(
        F.count("*").alias("total_usos"), _n(vsi, "con_vsi"), _n(has_label("NOBOT"), "con_nobot"), _n(has_label("NoTmx_SOMC"), "con_error"),
        _n(unlabelled(), "sin_etiquetas"), share(vsi, 1).alias("tasa_vsi_pct"), share(has_label("NOBOT"), 1).alias("tasa_nobot_pct"),
        share(has_label("NoTmx_SOMC"), 1).alias("tasa_error_pct"), _n(different() & vsi, "transferencias_vsi"),
        _n(different() & unlabelled(), "transferencias_sin_etiqueta"), mean(F.when(vsi, s)).alias("duracion_promedio_vsi"),
        mean(F.when(unlabelled(), s)).alias("duracion_promedio_sin_etiqueta")).where(F.col("total_usos") >= min_rows)
    return _top(found, "total_usos", KEY, limit)


def labels_by_hour(llamadas: DataFrame, min_rows: int = 10) -> DataFrame:
    return llamadas.groupBy(F.date_format("fecha", "yyyy-MM-dd").alias("fecha_formateada"), hour().alias("hora_del_dia")).agg(
        F.count("*").alias("total_interacciones"), _n(has_label("VSI"), "con_vsi"), _n(has_label("NOBOT"), "con_nobot"), _n(has_label("NoTmx_SOMC"), "con_error"),
        _n(unlabelled(), "sin_etiquetas"), share(has_label("VSI"), 1).alias("tasa_vsi_pct"), share(has_label("NoTmx_SOMC"), 1).alias("tasa_error_pct"),
        share(unlabelled(), 1).alias("tasa_sin_etiquetas_pct")).where(F.col("total_interacciones") >= min_rows)


def label_correlation(llamadas: DataFrame, limit: int = 30, sample: int = 3) -> DataFrame:
    found = llamadas.groupBy(*KEY).agg(
        F.count("*").alias("total_casos"), F.count_distinct("etiquetas").alias("etiquetas_diferentes"), _n(has_label("VSI"), "casos_con_vsi"),
        _n(has_label("TELCO"), "casos_con_telco"), _n(has_label("NoTmx_SOMC"), "casos_con_error"), _n(has_label("NOBOT"), "casos_con_nobot"),
        _n(unlabelled(), "casos_sin_etiquetas"), share(has_label("VSI"), 1).alias("pct_vsi"), share(unlabelled(), 1).alias("pct_sin_etiquetas"),
        _n(different(), "transferencias"))
    shown = _top(found, "total_casos", KEY, limit)
    listed = bounded_list(llamadas.where(labelled()), KEY, "etiquetas", sample, ",", "etiquetas_principales")
    return join_on(shown, listed, KEY)


def option_label_dependency(llamadas: DataFrame, min_pattern: int = 2, min_rows: int = 5, limit: int = 20) -> DataFrame:
    """Share of a combination's rows whose label pattern reflects the option, over patterns seen at least twice."""
    groups = llamadas.where(F.col("menu").isNotNull()).groupBy(
        *KEY, "etiquetas", option_reflected().alias("hit"), F.coalesce(different(), F.lit(False)).alias("moved")
    ).agg(F.count("*").alias("f")).where(F.col("f") >= min_pattern)
    hits, n = F.sum(F.when(F.col("hit"), F.col("f")).otherwise(0)), F.sum("f")
    found = groups.groupBy(*KEY).agg(
        hits.alias("casos_opcion_reflejada"), n.alias("total_casos"), ratio(hits, n, 1).alias("pct_opcion_reflejada")).where(F.col("total_casos") >= min_rows)
    shown = found.orderBy(F.col("pct_opcion_reflejada").desc(), F.col("total_casos").desc(), *[F.col(k).asc_nulls_first() for k in KEY]).limit(limit)
    listed = whole_lists(only(groups.where("hit"), shown, KEY), KEY, {"ejemplos_reflexion": (F.concat(F.lit("REFLEJA:"), "etiquetas"), " | ")})
    return join_on(shown, listed, KEY)


def label_combinations(llamadas: DataFrame) -> DataFrame:
    rows = llamadas.where(labelled())
    found = rows.groupBy("etiquetas").agg(
        F.count("*").alias("frecuencia"), _users("numeros_entrada_unicos"),
        _n(equal(), "iguales"), _n(different(), "diferentes"), vocabulary(menu_option()).alias("combinaciones_menu_opcion"))
    return with_distinct_counts(found, rows, ["etiquetas"], {"numeros_digitado_unicos": ["numero_digitado"]})


def navigation_by_relation(llamadas: DataFrame, limit: int = 20, sample: int = 10) -> DataFrame:
    """Menu-option use by relation of the numbers, with a sample of dialled numbers."""
    rows, keys = llamadas.withColumn("tipo_relacion", F.when(equal(), "IGUALES").otherwise("DIFERENTES")), ["tipo_relacion", *KEY]
    found = rows.groupBy(*keys).agg(F.count("*").alias("frecuencia_uso"), _users(), mean(raw_seconds()).alias("duracion_promedio"))
    shown = found.orderBy("tipo_relacion", F.col("frecuencia_uso").desc(), *[F.col(k).asc_nulls_first() for k in KEY]).limit(limit)
    listed = bounded_list(only(rows, shown, keys), keys, "numero_digitado", sample, ",", "numeros_digitados_muestra")
    return join_on(shown, listed, keys)


def combination_usage(llamadas: DataFrame) -> DataFrame:
    return llamadas.groupBy(*KEY).agg(
        F.count("*").alias("frecuencia_total"), _users(), mean(raw_seconds()).alias("duracion_promedio_seg"), _n(equal(), "con_numeros_iguales"),
        _n(different(), "con_numeros_diferentes"), vocabulary("id_8T").alias("zonas_geograficas_activas"), vocabulary("fecha").alias("dias_activos"))


def combination_usage_repaired(llamadas: DataFrame, limit: int = 20, sample: int = 3) -> DataFrame:
    rows = llamadas.where(F.col("menu").isNotNull())
    found = rows.groupBy(*KEY).agg(
        F.count("*").alias("frecuencia_uso"), _users(), share(equal(), 1).alias("pct_numeros_iguales"), mean(seconds()).alias("duracion_promedio_seg"),
        vocabulary("id_8T").alias("zonas_geograficas"))
    return join_on(_top(found, "frecuencia_uso", KEY, limit), bounded_list(rows, KEY, "division", sample, ",", "divisiones_principales"), KEY)


def _validated() -> Column:
    return has_label("VSI") | has_label("ZMB")


def menu_efficiency(llamadas: DataFrame) -> DataFrame:
    rows = llamadas.where(F.col("menu").isNotNull())
    found = rows.groupBy(*KEY).agg(
        F.count("*").alias("total_usos"), _users(), _n(_validated(), "interacciones_validadas"), _n(failed(), "interacciones_fallidas"),
        share(_validated()).alias("tasa_validacion_pct"),
        _n(redirected(), "casos_con_redireccion"), _n(different(), "casos_procesamiento_diferente"), mean(raw_seconds()).alias("duracion_promedio_seg"))
    return with_distinct_counts(found, rows, KEY, {"destinos_redireccion_diferentes": ["id_CTransferencia"]})


def menu_efficiency_by_destination(llamadas: DataFrame, sample: int = 3) -> DataFrame:
    rows = llamadas.where(F.col("menu").isNotNull())
    found = rows.groupBy(*KEY).agg(
        F.count("*").alias("total_usos"), _users(), _n(_validated(), "interacciones_exitosas"), _n(failed(), "interacciones_fallidas"),
        share(_validated()).alias("tasa_exito_pct"), _n(different(), "transferencias"),
        mean(raw_seconds()).alias("duracion_promedio_seg"), vocabulary("division").alias("divisiones_activas"))
    found = with_distinct_counts(found, rows, KEY, {"destinos_diferentes": ["numero_digitado"]})
    return join_on(found, bounded_list(rows, KEY, "division", sample, ",", "principales_divisiones"), KEY)
