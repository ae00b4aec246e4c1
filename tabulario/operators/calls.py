"""Data model checks and data quality of the call log.

Inputs are normalised calls with a `trimestre` column naming their quarterly
table; functions that say so take the raw text form instead.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulario.functions.calls import FAILED_MENUS, inverted, labelled, option_reflected, has_label
from tabulario.functions.exact import ratio, share
from tabulario.functions.text import clock_full, filled, is_blank, sorted_set, vocabulary
from tabulario.plans.order_stats import order_statistics, percentile_rank
from tabulario.plans.shape import bounded_list, first_match, join_on, leading_list, matching, number_of_values, rows_of, top_per_key, with_distinct_counts
from tabulario.sources.calls import normalise, parse_date
from tabulario.sources.periods import Periods
from tabulario.sources.sinks import TableStore

FIELDS = ("numero_entrada", "numero_digitado", "menu", "opcion", "id_CTransferencia", "etiquetas", "division", "area", "cIdentifica")
# Options whose text is not expected among the labels.
GENERIC_OPTIONS = ("DEFAULT", "21", "1", "5", "11")
_LIST = 101  # values that are certain to fill a 100-character list


def _n(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def _cut(col: str, chars: int = 100) -> Column:
    return F.left(F.col(col), F.lit(chars))


def cardinality(llamadas: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows and distinct values per quarter; `approximate` estimates the open-ended columns in one small shuffle."""
    open_ended = {
        "ids_unicos": "idRe", "numeros_entrada_unicos": "numero_entrada", "numeros_digitado_unicos": "numero_digitado",
        "destinos_transferencia_unicos": "id_CTransferencia", "claves_cIdentifica": "cIdentifica",
    }
    small = {"menus_diferentes": "menu", "opciones_diferentes": "opcion", "zonas_geograficas": "id_8T", "divisiones": "division", "areas": "area"}
    rows = llamadas.withColumnRenamed("trimestre", "tabla")
    guesses = [F.approx_count_distinct(c).alias(a) for a, c in open_ended.items()] if approximate else []
    report = rows.groupBy("tabla").agg(
        F.count("*").alias("total_registros"), *guesses, *[vocabulary(c).alias(a) for a, c in small.items()],
        F.min("fecha").alias("fecha_minima"), F.max("fecha").alias("fecha_maxima"),
    )
    return report if approximate else with_distinct_counts(report, rows, ["tabla"], {a: [c] for a, c in open_ended.items()})


def _missing_per_field(llamadas: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One scan: missing counts of all fields, then one row per field."""
    wide = llamadas.groupBy(*keys).agg(F.count("*").alias("_t"), *[_n(is_blank(F.col(f)), f"_{f}") for f in fields])
    return rows_of(wide, ["campo", "n", "t"], [(f, F.col(f"_{f}"), F.col("_t")) for f in fields], keep=keys)


def completeness(llamadas: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    return _missing_per_field(llamadas, fields, []).select(
        "campo", F.col("n").alias("nulos_vacios"), F.col("t").alias("total"), ratio(F.col("n"), F.col("t")).alias("porcentaje_nulos"))


def field_domains(llamadas: DataFrame) -> DataFrame:
    """Distinct and missing values of the free-text fields."""
    names = ("etiquetas", "cIdentifica", "nidMQ")
    wide = llamadas.agg(_n(is_blank(F.col("etiquetas")), "n_etiquetas"), *[_n(F.col(c).isNull(), f"n_{c}") for c in names[1:]])
    return rows_of(wide, ["campo", "valores_distintos", "valores_nulos"], [(c, number_of_values(llamadas, F.col(c)), F.col(f"n_{c}")) for c in names])


def criticality(llamadas: DataFrame, fields: Sequence[str] = ("numero_entrada", "menu", "numero_digitado", "etiquetas")) -> DataFrame:
    n, t = F.col("n"), F.col("t")
    return _missing_per_field(llamadas, fields, ["trimestre"]).select(
        "campo", F.col("trimestre").alias("tabla"), n.alias("registros_nulos"), t.alias("total_registros"), ratio(n, t).alias("porcentaje_nulo"),
        first_match([(n * 100 > t * 10, "CRITICO"), (n * 100 > t * 5, "ALTO"), (n * 100 > t, "MODERADO")], "BAJO").alias("nivel_criticidad"),
    )


def value_domains(llamadas: DataFrame, limit: int = 20) -> DataFrame:
    """Frequency of the values of four fields; menus and options cut to the top `limit`."""
    fields = ("menu", "opcion", "division", "id_8T")
    long = rows_of(llamadas, ["tipo_campo", "valor"], [(f, F.col(f)) for f in fields])
    freq = long.groupBy("tipo_campo", "valor").agg(F.count("*").alias("frecuencia"))
    # Every row yields one entry per field, so a field's frequencies add up to the row count.
    total = freq.groupBy("tipo_campo").agg(F.sum("frecuencia").alias("_t"))
    freq = freq.where(filled(F.col("valor"))).join(F.broadcast(total), "tipo_campo")
    capped = top_per_key(freq.where(F.col("tipo_campo").isin("menu", "opcion")), ["tipo_campo"], [F.col("frecuencia").desc(), F.col("valor")], limit)
    whole = freq.where(~F.col("tipo_campo").isin("menu", "opcion"))
    return whole.unionByName(capped.drop("_rn")).select(
        "tipo_campo", "valor", "frecuencia", ratio(F.col("frecuencia"), F.col("_t")).alias("porcentaje"))


def division_areas(llamadas: DataFrame) -> DataFrame:
    return llamadas.where(F.col("division").isNotNull() & F.col("area").isNotNull()).groupBy("division").agg(
        vocabulary("area").alias("areas_por_division"), sorted_set(F.col("area"), ",").alias("areas_listado"))


def menu_options(llamadas: DataFrame, limit: int = 15) -> DataFrame:
    per_menu = llamadas.where(F.col("menu").isNotNull()).groupBy("menu").agg(
        vocabulary("opcion").alias("opciones_por_menu"), F.count("*").alias("total_usos"),
        sorted_set(F.col("opcion"), ",").alias("opciones_disponibles"))
    return per_menu.orderBy(F.col("total_usos").desc(), "menu").limit(limit)


def zone_locations(llamadas: DataFrame) -> DataFrame:
    return llamadas.where(F.col("id_8T").isNotNull() & F.col("division").isNotNull()).groupBy("id_8T").agg(
        vocabulary("division").alias("divisiones_por_zona"), vocabulary("area").alias("areas_por_zona"),
        sorted_set(F.concat("division", F.lit("-"), "area"), ",").alias("ubicaciones"))


def key_checks(llamadas: DataFrame, periods: Periods) -> DataFrame:
    """Repeated ids inside a quarter, ids shared by consecutive quarters, callers with several dialled numbers.

    Row counts per id and quarter come from one shuffle; the size of the join
    between two quarters is the sum of their products.
    """
    labels = periods.labels
    per_id = llamadas.groupBy("idRe").agg(*[_n(F.col("trimestre") == t, f"c{i}") for i, t in enumerate(labels)])
    c = [F.col(f"c{i}") for i in range(len(labels))]
    sums = per_id.agg(
        *[F.coalesce(F.sum(F.greatest(x - 1, F.lit(0).cast("bigint"))), F.lit(0)).alias(f"d{i}") for i, x in enumerate(c)],
        *[F.coalesce(F.sum(a.cast("decimal(18,0)") * b.cast("decimal(18,0)")).cast("bigint"), F.lit(0)).alias(f"x{i}") for i, (a, b) in enumerate(zip(c, c[1:]))],
    )
    ids = rows_of(sums, ["analisis", "trimestre", "n"], [
        *[("idRe_duplicados", t, F.col(f"d{i}")) for i, t in enumerate(labels)],
        *[("idRe_entre_trimestres", f"{a}-{b}", F.col(f"x{i}")) for i, (a, b) in enumerate(zip(labels, labels[1:]))],
    ])
    # More than one distinct value is the same as min <> max, which combines map-side.
    several = llamadas.where(F.col("numero_entrada").isNotNull()).groupBy("trimestre", "numero_entrada").agg(
        (F.min("numero_digitado") != F.max("numero_digitado")).alias("several"))
    callers = several.groupBy("trimestre").agg(F.count_if("several").alias("n")).withColumn("analisis", F.lit("numero_entrada_cardinalidad"))
    return ids.unionByName(callers)


def repeated_ids(llamadas: DataFrame, first: int | None = None) -> DataFrame:
    """Ids in several rows of the quarters. One wording shows 100 characters of the list, the other the `first` ids."""
    per_id = llamadas.groupBy("idRe").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("trimestre")).alias("q")).where(F.col("n") > 1)
    shown = leading_list(per_id, "idRe", first or _LIST, ",", [F.col("n").desc(), F.col("idRe")])
    return per_id.agg(
        F.count("*").alias("ids_duplicados_total"), F.coalesce(F.sum("n"), F.lit(0)).alias("registros_afectados"),
        sorted_set(F.array_join("q", ","), ";").alias("combinaciones_trimestres"),
    ).withColumn("ejemplos_ids_duplicados", F.nullif(shown if first else F.left(shown, F.lit(100)), F.lit("")))


def daily_distribution(llamadas: DataFrame) -> DataFrame:
    return llamadas.groupBy("fecha").agg(
        F.count("*").alias("registros_por_dia"), F.count_distinct("numero_entrada").alias("usuarios_unicos_dia"),
        F.min("hora_inicio_seg").alias("primera_hora"), F.max("hora_fin_seg").alias("ultima_hora"),
        vocabulary("menu").alias("menus_activos_dia"))


def time_inconsistencies(crudas: DataFrame) -> DataFrame:
    """Inverted times and rows inserted on another day, from raw rows."""
    t = normalise(crudas).agg(F.count("*").alias("t"), _n(inverted(), "i"), _n(F.col("fecha") != F.col("fecha_inserta"), "d"))
    return rows_of(t, ["problema", "casos", "porcentaje"], [
        (name, F.col(c), ratio(F.col(c), F.col("t"))) for name, c in (("timestamps_invertidos", "i"), ("fecha_vs_fecha_inserta", "d"))])


def reference_prefixes(llamadas: DataFrame, limit: int = 10) -> DataFrame:
    prefix = F.left(F.col("cIdentifica"), F.lit(10))
    return llamadas.where(filled(F.col("cIdentifica"))).groupBy(F.lit("cIdentifica_patron").alias("analisis"), prefix.alias("patron_inicio")).agg(
        F.count("*").alias("frecuencia"), F.count_distinct("numero_entrada").alias("usuarios_con_patron")
    ).orderBy(F.col("frecuencia").desc(), "patron_inicio").limit(limit)


def queue_vs_dialled(llamadas: DataFrame) -> DataFrame:
    inside = F.expr("nidMQ like concat('%', numero_digitado, '%')")
    return llamadas.agg(
        F.lit("nidMQ_vs_numero_digitado").alias("analisis"), F.count("*").alias("total_registros"), _n(filled(F.col("nidMQ")), "con_nidMQ"),
        _n(filled(F.col("numero_digitado")), "con_numero_digitado"), _n(inside, "nidMQ_contiene_numero_digitado"))


def integral_quality(llamadas: DataFrame) -> DataFrame:
    n, inv = F.count(F.lit(1)), F.count_if(inverted())
    no_caller, no_menu = F.count_if(F.col("numero_entrada").isNull()), F.count_if(F.col("menu").isNull())
    return llamadas.agg(
        n.alias("total_registros"), no_caller.alias("sin_numero_entrada"), no_menu.alias("sin_menu"), inv.alias("timestamps_invertidos"),
        _n(F.col("numero_digitado").isNull() & F.col("nidMQ").isNotNull(), "inconsistencia_digitado_nidMQ"),
        _n(F.col("division").isNull() & F.col("area").isNotNull(), "area_sin_division"), _n(filled(F.col("cIdentifica")), "con_referencias_externas"),
        ratio(n - inv - no_caller - no_menu, n).alias("score_calidad_pct"))


def inverted_times(llamadas: DataFrame, first: int | None = None) -> DataFrame:
    """Inverted times per quarter with the menus concerned: 100 characters of the list or the `first` menus."""
    menus = F.array_sort(F.collect_set(F.when(inverted(), F.col("menu"))))
    shown = F.array_join(F.slice(menus, 1, first) if first else menus, ",")
    return llamadas.groupBy(F.col("trimestre").alias("tabla")).agg(
        F.count("*").alias("total_registros"), _n(inverted(), "timestamps_invertidos"), share(inverted()).alias("porcentaje_invertidos"),
        F.when(F.size(menus) > 0, shown if first else F.left(shown, F.lit(100))).alias("menus_mas_afectados"))


def base_dates(crudas: DataFrame, base: str = "01/01/1900", first: int | None = None) -> DataFrame:
    """Use of the dummy base date in the raw time texts, with 100 characters of other texts or the `first` ones."""
    a, b = F.left(F.col("hora_inicio"), F.lit(10)), F.left(F.col("hora_fin"), F.lit(10))
    odd = leading_list(crudas.where(a != base).select("hora_inicio").distinct(), "hora_inicio", first or _LIST, ",")
    return crudas.agg(
        F.lit("Análisis_timestamps").alias("analisis"), F.count("*").alias("total_registros"),
        _n(a == base, "usa_fecha_base_inicio"), _n(b == base, "usa_fecha_base_fin"),
    ).withColumns({"fechas_diferentes_hora_inicio": number_of_values(crudas, a), "fechas_diferentes_hora_fin": number_of_values(crudas, b)}).withColumn("ejemplos_fechas_anomalas", F.nullif(odd if first else F.left(odd, F.lit(100)), F.lit("")))


def _option_not_reflected() -> Column:
    o = F.col("opcion")
    return filled(o) & ~o.isin(*GENERIC_OPTIONS) & ~option_reflected()


def _res_without_vsi() -> Column:
    return F.col("menu").like("RES-%") & ~has_label("VSI")


def _complex_commercial() -> Column:
    return F.col("menu").like("comercial_%") & labelled() & (F.octet_length("etiquetas") > 10)


def label_consistency(llamadas: DataFrame, min_rows: int = 5) -> DataFrame:
    """Menu-option-label inconsistencies per combination."""
    rows, keys = llamadas.where(F.col("menu").isNotNull()), ["menu", "opcion"]
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("frecuencia"), F.count_distinct("etiquetas").alias("variaciones_etiquetas"),
        _n(_option_not_reflected(), "casos_opcion_no_reflejada"), _n(_res_without_vsi(), "casos_res_sin_vsi"),
        _n(_complex_commercial(), "casos_comercial_con_etiquetas_complejas"),
    ).where(F.col("frecuencia") >= min_rows)
    odd = F.col("casos_opcion_no_reflejada") + F.col("casos_res_sin_vsi") + F.col("casos_comercial_con_etiquetas_complejas")
    patterns = bounded_list(rows, keys, "etiquetas", _LIST, "|", "muestra_patrones")
    return join_on(counts, patterns, keys).withColumns({
        "nivel_consistencia": first_match([(odd * 10 > F.col("frecuencia") * 3, "ALTA_INCONSISTENCIA"),
                                           (odd * 10 > F.col("frecuencia"), "INCONSISTENCIA_MODERADA")], "CONSISTENTE"),
        "muestra_patrones": _cut("muestra_patrones"),
    })


def outside_calendar(crudas: DataFrame, periods: Periods) -> DataFrame:
    """Rows whose date lies outside the quarter of their table; extremes are of the date text."""
    day, t = parse_date(F.col("fecha")), F.col("trimestre")
    wrong = crudas.where((day < periods.start_of(t)) | (day > periods.end_of(t)))
    counts = wrong.groupBy("trimestre").agg(F.count("*").alias("n"), F.min("fecha").alias("a"), F.max("fecha").alias("b"))
    return periods.frame(crudas.sparkSession).join(counts, "trimestre", "left").select(
        F.concat("trimestre", F.lit("_fuera_rango")).alias("problema"), F.coalesce("n", F.lit(0)).alias("registros_erroneos"),
        F.col("a").alias("fecha_minima_erronea"), F.col("b").alias("fecha_maxima_erronea"))


def _rule_report(
    rows: DataFrame, names: tuple[str, str, str], rules, all_rules: Sequence[tuple], extra: Sequence[str] = (), first: int | None = None,
) -> DataFrame:
    """Count and sample values per rule from one exploded scan; rules without hits show 0.

    The sample is what 100 characters of the list of values show, or the `first` values.
    """
    name, count, sample = names
    hits = matching(rows, [name, "_v"], rules, keep=extra)
    keys = [*extra, name]
    found = hits.groupBy(*keys).agg(F.count("*").alias(count))
    listed = bounded_list(hits, keys, "_v", first or _LIST, ",", sample)
    report = found.join(listed, keys, "left")
    report = report if first else report.withColumn(sample, _cut(sample))
    if extra:
        return report
    frame = rows.sparkSession.createDataFrame([(r,) for r in all_rules], f"{name} string")
    return frame.join(report, name, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def malformed_references(llamadas: DataFrame) -> DataFrame:
    ident, queue, dest = F.col("cIdentifica"), F.col("nidMQ"), F.col("id_CTransferencia")
    rules = [
        (filled(ident) & ((F.octet_length(ident) < 10) | ~ident.rlike("^[0-9]+$")), "cIdentifica_patron_anomalo", ident),
        (filled(queue) & is_blank(F.col("numero_digitado")), "nidMQ_sin_numero_digitado", queue),
        (filled(dest) & ~dest.rlike("^[0-9]+$"), "id_CTransferencia_invalido", dest),
    ]
    # Wording of the three rules.
    words = {
        "cIdentifica_patron_anomalo": "Valores que no siguen patrón esperado",
        "nidMQ_sin_numero_digitado": "nidMQ poblado pero numero_digitado nulo",
        "id_CTransferencia_invalido": "Valores de transferencia que no siguen patrón esperado",
    }
    report = _rule_report(llamadas, ("tipo_problema", "casos", "ejemplos"), rules, list(words))
    return report.withColumn("descripcion", first_match([(F.col("tipo_problema") == k, v) for k, v in words.items()]))


def _odd_number(c: Column, shortest: int, longest: int = 15) -> Column:
    return ~F.octet_length(c).between(shortest, longest) | ~c.rlike("^[0-9]+$") | c.rlike("^0+$")


def number_formats(llamadas: DataFrame) -> DataFrame:
    """Suspicious phone numbers: not 4 to 15 digits, or only zeros or (callers) ones."""
    a, b = F.col("numero_entrada"), F.col("numero_digitado")
    rules = [
        (_odd_number(a, 4) | a.rlike("^1+$"), "numero_entrada_formato_sospechoso", a),
        (filled(b) & _odd_number(b, 4), "numero_digitado_formato_sospechoso", b),
    ]
    return _rule_report(llamadas, ("problema", "casos_problematicos", "ejemplos_sospechosos"), rules, [r[1] for r in rules])


def invalid_numbers(llamadas: DataFrame, first: int = 10) -> DataFrame:
    """The wording with 7 to 15 digits, which shows the first numbers."""
    a, b = F.col("numero_entrada"), F.col("numero_digitado")
    rules = [
        (_odd_number(a, 7), "numero_entrada_formato_invalido", a),
        (filled(b) & _odd_number(b, 7), "numero_digitado_formato_invalido", b),
    ]
    return _rule_report(llamadas, ("problema", "casos_problematicos", "ejemplos_invalidos"), rules, [r[1] for r in rules], first=first)


def date_validation(crudas: DataFrame, first: dt.date = dt.date(2020, 1, 1), last: dt.date = dt.date(2030, 12, 31)) -> DataFrame:
    day = parse_date(F.col("fecha"))
    rows = crudas.select(F.col("trimestre").alias("tabla"), "fecha")
    rules = [
        (day.isNull(), "fechas_no_convertibles", F.col("fecha")),
        ((day < F.lit(first)) | (day > F.lit(last)), "fechas_fuera_rango", F.col("fecha")),
    ]
    return _rule_report(rows, ("problema", "casos_problematicos", "ejemplos_fechas_problematicas"), rules, [], extra=["tabla"])


def invalid_dates(crudas: DataFrame, first_day: dt.date = dt.date(2020, 1, 1), last_day: dt.date = dt.date(2030, 12, 31), first: int = 10) -> DataFrame:
    """The wording with one problem per quarter, which shows the first dates."""
    day = parse_date(F.col("fecha"))
    rows = crudas.select(F.col("trimestre").alias("tabla"), "fecha")
    rules = [(day.isNull() | (day < F.lit(first_day)) | (day > F.lit(last_day)), "fechas_invalidas", F.col("fecha"))]
    return _rule_report(rows, ("problema", "casos_problematicos", "ejemplos_fechas_problematicas"), rules, [], extra=["tabla"], first=first)


def user_outliers(llamadas: DataFrame, mode: str = "position") -> DataFrame:
    """Callers far above the 95th percentile of volume (x2), zones and menus (x1.5).

    mode='position' takes the element at floor(0.95 n) and shows 100 characters
    of the callers; mode='interpolated' takes the linear interpolation between
    neighbours and shows the first ten.
    """
    users = llamadas.where(F.col("numero_entrada").isNotNull()).groupBy("numero_entrada").agg(
        F.count("*").alias("v"), vocabulary("id_8T").alias("z"), vocabulary("menu").alias("m"))
    # Metric label and the tenths of P95 a caller has to exceed.
    metrics = [("usuarios_outliers_volumen", "v", 20), ("usuarios_outliers_geograficos", "z", 15), ("usuarios_outliers_diversidad", "m", 15)]
    long = rows_of(users, ["tipo_outlier", "valor"], [(name, F.col(c)) for name, c, _ in metrics], keep=["numero_entrada"])
    # Callers are counted per metric and value once; limits and figures are read off that small table.
    counts = long.groupBy("tipo_outlier", "valor").agg(F.count("*").alias("n"))
    if mode == "position":
        limits = order_statistics(counts, ["tipo_outlier"], "valor", {"lo": percentile_rank(95)}, weight="n").withColumn("p", F.col("lo") * 100)
    else:
        at = lambda n: F.floor(((n - 1) * 95 - (n - 1) * 95 % 100) / 100)
        size = counts.groupBy("tipo_outlier").agg(((F.sum("n") - 1) * 95 % 100).alias("frac"))
        limits = order_statistics(counts, ["tipo_outlier"], "valor", {"lo": at, "hi": lambda n: at(n) + 1}, weight="n").join(size, "tipo_outlier").withColumn(
            "p", F.col("lo") * 100 + (F.col("hi") - F.col("lo")) * F.col("frac"))
    # p is in hundredths and the factor in tenths, so the comparison stays in integers.
    frame = llamadas.sparkSession.createDataFrame([(m[0], m[2]) for m in metrics], "tipo_outlier string, factor int")
    bounds = F.broadcast(limits.join(frame, "tipo_outlier").select("tipo_outlier", (F.col("p") * F.col("factor")).alias("_bound")))
    beyond = F.col("valor") * 1000 > F.col("_bound")
    found = counts.join(bounds, "tipo_outlier").where(beyond).groupBy("tipo_outlier").agg(F.sum("n").alias("n"), F.min("valor").alias("a"), F.max("valor").alias("b"))
    far = long.join(bounds, "tipo_outlier").where(beyond)
    listed = bounded_list(far, ["tipo_outlier"], "numero_entrada", _LIST if mode == "position" else 10, ",", "ejemplos_usuarios")
    listed = listed.withColumn("ejemplos_usuarios", _cut("ejemplos_usuarios")) if mode == "position" else listed
    return frame.join(found, "tipo_outlier", "left").join(listed, "tipo_outlier", "left").select(
        "tipo_outlier", F.coalesce("n", F.lit(0)).alias("cantidad_outliers"), F.col("a").alias("min_valor_outlier"),
        F.col("b").alias("max_valor_outlier"), "ejemplos_usuarios")


def _defects() -> tuple[Column, Column, Column]:
    return (F.count_if(inverted()), F.count_if(F.col("numero_entrada").isNull() | F.col("menu").isNull()), F.count_if(F.col("fecha").isNull()))


def quality_scores(llamadas: DataFrame) -> DataFrame:
    a, b, c, n = (F.col(x) for x in ("timestamps_invertidos", "campos_criticos_nulos", "fechas_invalidas", "total_registros"))
    inv, crit, bad = _defects()
    # 100 - (0.3 a + 0.4 b + 0.3 c) * 100 / n, kept in integers.
    score = ratio(n * 10 - a * 3 - b * 4 - c * 3, n * 10)
    s = F.col("score_calidad")
    return llamadas.groupBy(F.col("trimestre").alias("tabla")).agg(
        F.count("*").alias("total_registros"), inv.alias("timestamps_invertidos"), crit.alias("campos_criticos_nulos"), bad.alias("fechas_invalidas"),
    ).withColumn("score_calidad", score).withColumns({
        "registros_limpios": n - a - b - c, "porcentaje_utilizable": ratio(n - a - b - c, n),
        "clasificacion_calidad": first_match([(s >= 90, "EXCELENTE"), (s >= 75, "BUENA"), (s >= 60, "REGULAR"), (s >= 40, "MALA")], "CRITICA"),
    })


def cleaning_impact(llamadas: DataFrame, ordered_times: bool = True) -> DataFrame:
    """Average interactions per caller under three nested scenarios, from one scan."""
    clean = F.col("numero_entrada").isNotNull() & F.col("menu").isNotNull() & F.col("fecha").isNotNull()
    if ordered_times:
        clean = clean & ~inverted()
    ultra = clean & labelled() & ~F.col("menu").isin(*FAILED_MENUS)
    rows = matching(llamadas, ["escenario"], [(F.lit(True), "CON_TODOS_LOS_DATOS"), (clean, "SOLO_DATOS_LIMPIOS"), (ultra, "DATOS_ULTRA_LIMPIOS")],
                    keep=["numero_entrada"])
    users, n = F.count_distinct("numero_entrada"), F.count("*")
    return rows.groupBy("escenario").agg(users.alias("usuarios_unicos"), n.alias("total_interacciones"), ratio(n, users, 2, 1).alias("promedio_por_usuario"))


def clean_calls(llamadas: DataFrame) -> DataFrame:
    """Usable rows with inverted times swapped back and their quality flags."""
    a, b = F.least("hora_inicio_seg", "hora_fin_seg"), F.greatest("hora_inicio_seg", "hora_fin_seg")
    return llamadas.where(filled(F.col("numero_entrada")) & filled(F.col("menu")) & F.col("fecha").isNotNull()).select(
        "idRe", "numero_entrada", "numero_digitado", "menu", "opcion", "id_CTransferencia", "fecha", "division", "area",
        a.alias("hora_inicio_corregida"), b.alias("hora_fin_corregida"),
        F.concat(F.col("fecha").cast("string"), F.lit(" "), clock_full(a)).alias("timestamp_inicio_completo"),
        "id_8T", "etiquetas", "cIdentifica", "nidMQ",
        F.when(inverted(), "CORREGIDO").otherwise("ORIGINAL").alias("flag_timestamp"),
        F.when(labelled(), "CON_ETIQUETAS").otherwise("SIN_ETIQUETAS").alias("flag_procesamiento"),
        F.col("trimestre").alias("trimestre_origen"),
    )


def refresh_clean_calls(store: TableStore, llamadas: DataFrame, quarters: Sequence[str] | None = None) -> DataFrame:
    """The stored clean data set, one folder a quarter; with `quarters` only theirs are computed and rewritten."""
    if quarters is None:
        return store.replace("clean_calls", clean_calls(llamadas), by=["trimestre_origen"])
    return store.replace_parts("clean_calls", clean_calls(llamadas.where(F.col("trimestre").isin(*quarters))), by=["trimestre_origen"])


def problem_records(llamadas: DataFrame, limit: int = 100) -> DataFrame:
    a, b, size = F.col("numero_entrada"), F.col("numero_digitado"), F.octet_length
    rules = [
        (inverted(), "TIMESTAMP_INVERTIDO"), (is_blank(a), "SIN_NUMERO_ENTRADA"), (is_blank(F.col("menu")), "SIN_MENU"),
        (F.col("fecha").isNull(), "FECHA_INVALIDA"), (~size(a).between(4, 15), "NUMERO_SOSPECHOSO"),
        (filled(b) & ~size(b).between(4, 15), "DIGITADO_SOSPECHOSO"),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda x: x.isNotNull())
    level = first_match([(inverted() | a.isNull() | F.col("menu").isNull(), 1), (F.col("fecha").isNull(), 2), (size(a) < 4, 3)], 4)
    rows = llamadas.withColumns({"_p": found, "_s": level}).where(F.size("_p") > 0)
    return rows.orderBy("_s", "idRe", "trimestre", "hora_inicio_seg", "hora_fin_seg").limit(limit).select(
        "idRe", "numero_entrada", "numero_digitado", "menu", "fecha", "hora_inicio_seg", "hora_fin_seg",
        F.array_join("_p", ",").alias("problemas_detectados"),
        F.element_at(F.array(*[F.lit(x) for x in ("CRITICO", "ALTO", "MEDIO", "BAJO")]), F.col("_s")).alias("severidad"),
    )


def quality_dashboard(llamadas: DataFrame, as_of: dt.date) -> DataFrame:
    inv, crit, bad = _defects()
    t = llamadas.agg(F.count("*").alias("t"), (F.count("*") - inv - crit - bad).alias("c"))
    n, c = F.col("t"), F.col("c")
    return t.select(
        F.lit(as_of).alias("fecha_revision"), F.lit("RESUMEN_GENERAL").alias("tipo_metrica"), n.alias("total_registros_sistema"),
        c.alias("total_registros_limpios"), ratio(c, n).alias("porcentaje_calidad_global"),
        first_match([(c * 100 >= n * 90, "SISTEMA_SALUDABLE"), (c * 100 >= n * 75, "REQUIERE_ATENCION")], "ESTADO_CRITICO").alias("estado_sistema"),
    )


def sample_rows(llamadas: DataFrame, limit: int = 20) -> DataFrame:
    """First rows by id."""
    return llamadas.orderBy("idRe").limit(limit).select(
        "idRe", "numero_entrada", "numero_digitado", "menu", "opcion", "etiquetas", "fecha", "hora_inicio_seg", "hora_fin_seg",
        "division", "area", "id_8T", "cIdentifica", "nidMQ")


def number_bounds(llamadas: DataFrame) -> DataFrame:
    return llamadas.agg(
        F.min("numero_entrada").alias("min_numero_entrada"), F.max("numero_entrada").alias("max_numero_entrada"),
        F.min("numero_digitado").alias("min_numero_digitado"), F.max("numero_digitado").alias("max_numero_digitado"),
        vocabulary("menu").alias("menus_distintos"), vocabulary("opcion").alias("opciones_distintas"))


def quarter_quality(llamadas: DataFrame) -> DataFrame:
    e, n = F.col("etiquetas"), F.count(F.lit(1))
    no_menu, no_labels, comma = F.count_if(is_blank(F.col("menu"))), F.count_if(is_blank(e)), F.count_if(e.endswith(","))
    return llamadas.groupBy("trimestre").agg(
        n.alias("total_registros"), no_menu.alias("menu_faltante"), _n(is_blank(F.col("opcion")), "opcion_faltante"),
        no_labels.alias("etiquetas_faltantes"), _n(e.endswith(",,"), "etiquetas_doble_coma"), comma.alias("etiquetas_coma_final"),
        _n(F.col("numero_entrada") == F.col("numero_digitado"), "sin_transferencia"),
        _n(F.col("numero_entrada") != F.coalesce("numero_digitado", "numero_entrada"), "con_transferencia"),
        # 100 - (20 a + 30 b + 10 c) / n, kept in integers.
        ratio(n * 10 - no_menu * 2 - no_labels * 3 - comma, n * 10).alias("score_calidad"),
    )
