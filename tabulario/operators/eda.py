"""Exploratory profiles and data quality of the product-selection tables.

Inputs carry a `trimestre` column naming the quarterly table a row comes from;
`ids` optionally restricts the analysis to some `cIDT` values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulario.functions.exact import cents, deviation, figure, mean, mean_of_rounded, ratio, share, variance
from tabulario.functions.text import day_name, stamp, vocabulary
from tabulario.plans.order_stats import ntile_start, order_statistics, percentile_rank, sketched_statistics
from tabulario.plans.shape import first_match, rows_of, salted_join, top_per_key, with_distinct_counts
from tabulario.sources.periods import Periods

# Words that stand for a missing category.
NULL_WORDS = ("N/A", "NA", "NULL", "n/a", "-", "--", "null")
# Upper bounds and labels of the product histogram.
BINS = ((1_000_000, "Rango_1: <1M"), (5_000_000, "Rango_2: 1M-5M"), (10_000_000, "Rango_3: 5M-10M"), (50_000_000, "Rango_4: 10M-50M"))
COARSE_BINS = ((1_000_000, "Bin_1: <1M"), (5_000_000, "Bin_2: 1M-5M"), (10_000_000, "Bin_3: 5M-10M"))
DIAS = ("Domingo", "Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado")


def _rows(productos: DataFrame, ids: Sequence[int] | None) -> DataFrame:
    return productos if ids is None else productos.where(F.col("cIDT").isin(*ids))


def _count(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def _word() -> Column:
    return F.col("cCategoria").isin(*NULL_WORDS)


def _text() -> Column:
    """A category that is not NULL, empty or blank."""
    return F.col("cCategoria").isNotNull() & (F.trim("cCategoria") != "")


def _inverted() -> Column:
    return F.col("cHInicio_seg") >= F.col("cHFin_seg")


def _seconds() -> Column:
    return F.col("cHFin_seg") - F.col("cHInicio_seg")


def _selected_only() -> Column:
    return (F.col("cSeleccion") == 1) & (F.col("cIOT") == 0)


def _iot_only() -> Column:
    return (F.col("cSeleccion") == 0) & (F.col("cIOT") == 1)


def _flags_agree() -> Column:
    return ((F.col("cSeleccion") == 1) & (F.col("cIOT") == 1)) | ((F.col("cSeleccion") == 0) & (F.col("cIOT") == 0))


def _too_late(periods: Periods) -> Column:
    return F.col("cFecha") > periods.end_of(F.col("trimestre"))


def _too_early(periods: Periods) -> Column:
    return F.col("cFecha") < periods.start_of(F.col("trimestre"))


def _day() -> Column:
    return F.to_date("cFecha")


def _weekend() -> Column:
    return F.dayofweek(_day()).isin(1, 7)


def _in_period(df: DataFrame, periods: Periods) -> DataFrame:
    return df.where(~_too_early(periods) & ~_too_late(periods))


def _calendar(df: DataFrame, periods: Periods, counts: Sequence[str]) -> DataFrame:
    """Quarterly counts with the period bounds; quarters without rows show 0."""
    return periods.frame(df.sparkSession).join(df, "trimestre", "left").select(
        "trimestre", F.col("inicio").alias("fecha_inicio"), F.col("fin").alias("fecha_fin"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
    )


def pre_check(productos: DataFrame, periods: Periods, ids: Sequence[int] | None = None) -> DataFrame:
    counts = _rows(productos, ids).groupBy("trimestre").agg(
        F.count("*").alias("registros_existentes"), F.count_distinct("cIDT").alias("idt_unicos"),
        vocabulary("cCategoria").alias("categorias_unicas"),
    )
    return _calendar(counts, periods, ["registros_existentes", "idt_unicos", "categorias_unicas"])


_NULL_COUNTS = {
    "producto_null": "cProducto", "idt_null": "cIDT", "seleccion_null": "cSeleccion", "iot_null": "cIOT",
    "fecha_null": "cFecha", "hinicio_null": "cHInicio_seg", "hfin_null": "cHFin_seg", "categoria_null": "cCategoria",
}


def _null_counts() -> list[Column]:
    return [_count(F.col(c).isNull(), name) for name, c in _NULL_COUNTS.items()]


def _valid_cells() -> Column:
    return F.count("cProducto") + F.count_if(_text()) + F.count("cSeleccion") + F.count("cIOT")


def null_profile(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """Missing values per quarter, id and category."""
    c, n, valid = F.col("cCategoria"), F.count(F.lit(1)), _valid_cells()
    return _rows(productos, ids).groupBy("trimestre", "cIDT", "cCategoria").agg(
        n.alias("total_registros"), *_null_counts(),
        _count(c == "", "categoria_cadena_vacia"), _count(c == " ", "categoria_solo_espacio"),
        _count((F.trim(c) == "") & (c != ""), "categoria_espacios_multiples"), _count(_word(), "categoria_nulos_semanticos"),
        ratio(F.count("cProducto"), n).alias("completitud_producto_pct"),
        share(_text() & ~_word()).alias("completitud_categoria_pct"),
        ratio(F.count("cSeleccion"), n).alias("completitud_seleccion_pct"), ratio(F.count("cIOT"), n).alias("completitud_iot_pct"),
        ratio(valid, n * 4).alias("indice_completitud_global_pct"),
        first_match([(valid * 100 >= n * 4 * 95, "EXCELENTE"), (valid * 100 >= n * 4 * 85, "BUENA"), (valid * 100 >= n * 4 * 75, "ACEPTABLE")],
                    "REQUIERE_MEJORA").alias("clasificacion_calidad_datos"),
    ).withColumn("categoria_analizada", F.coalesce("cCategoria", F.lit("[NULL_CATEGORIA]"))).drop("cCategoria")


def null_summary(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    groups = _rows(productos, ids).groupBy("trimestre", "cIDT", "cCategoria").agg(
        F.count("*").alias("n"), F.count("cProducto").alias("p"), F.count_if(_text() & ~_word()).alias("c")
    )
    n, p, c = F.sum("n"), F.sum("p"), F.sum("c")
    return groups.groupBy("trimestre").agg(
        n.alias("registros_totales"), (n - p).alias("total_nulos_producto"), (n - c).alias("total_nulos_categoria"),
        mean_of_rounded(ratio(F.col("p"), F.col("n"))).alias("completitud_promedio_producto"),
        mean_of_rounded(ratio(F.col("c"), F.col("n"))).alias("completitud_promedio_categoria"),
        F.count_distinct("cIDT").alias("idt_analizados"), vocabulary("cCategoria").alias("categorias_analizadas"),
        ratio(p + c, n * 2).alias("indice_calidad_trimestral"),
    )


def consistency_pre_check(productos: DataFrame, periods: Periods, ids: Sequence[int] | None = None) -> DataFrame:
    counts = _rows(productos, ids).groupBy("trimestre").agg(
        F.count("*").alias("registros_existentes"),
        _count(F.col("cHInicio_seg").isNotNull() & F.col("cHFin_seg").isNotNull(), "registros_con_horarios"),
        _count(F.col("cSeleccion").isNotNull() & F.col("cIOT").isNotNull(), "registros_con_logica_negocio"),
    )
    return _calendar(counts, periods, ["registros_existentes", "registros_con_horarios", "registros_con_logica_negocio"])


def _logical_duplicates() -> Column:
    """Rows beyond the first of each (product, day, id); rows with a NULL part count too."""
    return F.count(F.lit(1)) - F.count_distinct("cProducto", _day(), "cIDT")


def consistency_report(productos: DataFrame, periods: Periods, ids: Sequence[int] | None = None) -> DataFrame:
    ordered, timed = F.count_if(~_inverted()), F.count(_seconds())
    agree, flagged = F.count_if(_flags_agree()), F.count_if(F.col("cSeleccion").isNotNull() & F.col("cIOT").isNotNull())
    positive, known = F.count_if(F.col("cProducto") > 0), F.count("cProducto")
    rows = _rows(productos, ids)
    counts = rows.groupBy("trimestre").agg(
        F.count("*").alias("total_registros"), _count(_inverted(), "violaciones_orden_temporal"),
        _count(_seconds() > 28800, "sesiones_excesivas_8h"), _count(_seconds() < 60, "sesiones_muy_cortas_1min"),
        _count(F.col("cHInicio_seg") < 6 * 3600, "inicio_muy_temprano"), _count(F.col("cHFin_seg") > 23 * 3600, "fin_muy_tarde"),
        _count(_selected_only(), "seleccionado_sin_iot"), _count(_iot_only(), "no_seleccionado_con_iot"),
        _count(F.col("cSeleccion").isNull() | F.col("cIOT").isNull(), "logica_negocio_nula"),
        _count(~F.col("cSeleccion").isin(0, 1), "seleccion_fuera_rango"), _count(~F.col("cIOT").isin(0, 1), "iot_fuera_rango"),
        _count(F.col("cProducto") <= 0, "productos_invalidos_cero_negativo"),
        _count(_too_early(periods) | _too_late(periods), "fechas_fuera_rango_trimestre"),
        _count(_weekend(), "registros_fines_semana"), _count(F.hour("cFecha").between(0, 5), "registros_madrugada"),
        ordered.alias("_o"), timed.alias("_t"), agree.alias("_a"), flagged.alias("_f"), positive.alias("_p"), known.alias("_k"),
    )

    # Rows beyond the first of each combination, rows with a NULL part included.
    counts = with_distinct_counts(counts, rows, ["trimestre"], {
        "duplicados_logicos_mismo_dia": ["cProducto", _day(), "cIDT"], "duplicados_exactos_horario": ["cProducto", "cIDT", "cHInicio_seg", "cHFin_seg"],
    })
    counts = counts.withColumns({c: F.col("total_registros") - F.col(c) for c in ("duplicados_logicos_mismo_dia", "duplicados_exactos_horario")})

    def pct(num: str, den: str) -> Column:
        return F.col(num) * 100.0 / F.nullif(F.col(den), F.lit(0).cast("bigint"))

    score = pct("_o", "_t") * 0.4 + pct("_a", "_f") * 0.3 + pct("_p", "_k") * 0.3
    return counts.withColumns({
        "consistencia_temporal_pct": ratio(F.col("_o"), F.col("_t")),
        "consistencia_logica_negocio_pct": ratio(F.col("_a"), F.col("_f")),
        "consistencia_productos_validos_pct": ratio(F.col("_p"), F.col("_k")),
        "score_integridad_global": F.round(score, 2),
        "clasificacion_consistencia": first_match([
            (score >= 98, "CONSISTENCIA_EXCELENTE"), (score >= 95, "CONSISTENCIA_BUENA"), (score >= 90, "CONSISTENCIA_ACEPTABLE"),
        ], "CONSISTENCIA_CRÍTICA"),
    }).drop("_o", "_t", "_a", "_f", "_p", "_k")


def group_consistency(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    bad_time, sel, iot = F.count_if(_inverted()), F.count_if(_selected_only()), F.count_if(_iot_only())
    return _rows(productos, ids).groupBy("trimestre", "cIDT", "cCategoria").agg(
        F.count("*").alias("total_registros"), bad_time.alias("horarios_inconsistentes"), sel.alias("sel_sin_iot"),
        iot.alias("no_sel_con_iot"), (F.count("*") - F.count_distinct("cProducto", _day())).alias("dup_producto_fecha"),
        ratio(F.count_if(~_inverted()), F.count(_seconds())).alias("consistencia_temporal_pct"),
        ratio(F.count_if(_flags_agree()), F.count_if(F.col("cSeleccion").isNotNull() & F.col("cIOT").isNotNull())).alias("consistencia_logica_pct"),
        first_match([((bad_time == 0) & (sel == 0) & (iot == 0), "GRUPO_SALUDABLE"), ((bad_time <= 2) & (sel <= 2), "GRUPO_ACEPTABLE")],
                    "GRUPO_PROBLEMÁTICO").alias("estado_grupo"),
    ).withColumn("categoria_analizada", F.coalesce("cCategoria", F.lit("[NULL_CATEGORIA]"))).drop("cCategoria")


def worst_records(productos: DataFrame, periods: Periods, ids: Sequence[int] | None = None, limit: int = 100) -> DataFrame:
    """Records with most violations, `limit` per quarter."""
    rules = [
        (_inverted(), "Horario_Inconsistente"), (_selected_only(), "Seleccionado_Sin_IOT"),
        (_iot_only(), "No_Seleccionado_Con_IOT"), (F.col("cProducto") <= 0, "Producto_Inválido"),
        (_too_early(periods) | _too_late(periods), "Fecha_Fuera_Rango"),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda x: x.isNotNull())
    rows = _rows(productos, ids).withColumn("_v", found).where(F.size("_v") > 0).withColumn("total_violaciones", F.size("_v"))
    order = [F.col("total_violaciones").desc(), F.col("cFecha").desc(), F.col("cIDT"), F.col("cProducto").asc_nulls_first(), F.col("cHFin_seg")]
    return top_per_key(rows, ["trimestre"], order, limit).select(
        "trimestre", "cProducto", "cIDT", "cCategoria", stamp(F.col("cFecha")).alias("cFecha"), "cHInicio_seg", "cHFin_seg",
        "cSeleccion", "cIOT", "total_violaciones", F.array_join("_v", ", ").alias("descripcion_violaciones"),
    )


def valid_counts(productos: DataFrame, periods: Periods, ids: Sequence[int] | None = None) -> DataFrame:
    counts = _rows(productos, ids).groupBy("trimestre").agg(
        F.count("*").alias("registros_existentes"), F.count("cProducto").alias("registros_producto_validos"),
        F.count("cSeleccion").alias("registros_seleccion_validos"), F.count("cIOT").alias("registros_iot_validos"),
    )
    return _calendar(counts, periods, [
        "registros_existentes", "registros_producto_validos", "registros_seleccion_validos", "registros_iot_validos"])


def numeric_summary(productos: DataFrame, ids: Sequence[int] | None = None, sketched: bool = False) -> DataFrame:
    """Summary of cProducto with exact quartiles by position, or `sketched` ones from a single pass."""
    rows, x = _rows(productos, ids), F.col("cProducto")
    basic = rows.groupBy("trimestre").agg(
        F.lit("cProducto").alias("variable"), F.count("*").alias("n_total"), F.count(x).alias("n_validos"),
        (F.count("*") - F.count(x)).alias("n_nulos"), ratio(F.count(x), F.count("*")).alias("completitud_pct"),
        F.min(x).alias("minimo"), F.max(x).alias("maximo"), mean(x, 0).alias("media_aritmetica"),
        F.round(deviation(x), 0).alias("desviacion_estandar"), F.round(variance(x), 0).alias("varianza"),
        (F.max(x) - F.min(x)).alias("rango_total"), F.avg(x).alias("_avg"), deviation(x).alias("_dev"),
    )
    wanted = {"Q1_percentil_25": 25, "mediana_percentil_50": 50, "Q3_percentil_75": 75}
    if sketched:
        quartiles = sketched_statistics(rows, ["trimestre"], "cProducto", {name: p / 100 for name, p in wanted.items()})
    else:
        quartiles = order_statistics(rows, ["trimestre"], "cProducto", {name: percentile_rank(p) for name, p in wanted.items()})
    cv = F.col("_dev") / F.nullif(F.col("_avg"), F.lit(0.0))
    return basic.join(quartiles, "trimestre", "left").withColumns({
        "coeficiente_variacion_pct": F.round(cv * 100, 2),
        "IQR_rango_intercuartilico": F.col("Q3_percentil_75") - F.col("Q1_percentil_25"),
        "indice_asimetria_aprox": F.round((F.col("_avg") - F.col("mediana_percentil_50")) / F.nullif(F.col("_dev"), F.lit(0.0)), 3),
        "clasificacion_variabilidad": first_match([
            (cv < 0.1, "VARIABILIDAD_MUY_BAJA"), (cv < 0.2, "VARIABILIDAD_BAJA"), (cv < 0.5, "VARIABILIDAD_MODERADA"), (cv < 1.0, "VARIABILIDAD_ALTA"),
        ], "VARIABILIDAD_MUY_ALTA"),
    }).drop("_avg", "_dev")


def binary_summary(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """Summary of both flags; a mean between 0.3 and 0.4 falls through to PREDOMINIO_1_MODERADO."""
    long = rows_of(_rows(productos, ids), ["variable", "valor"], [("cSeleccion", F.col("cSeleccion")), ("cIOT", F.col("cIOT"))], keep=["trimestre"])
    x = F.col("valor")
    zeros, ones, avg = F.count_if(x == 0), F.count_if(x == 1), F.avg(x)
    return long.groupBy("trimestre", "variable").agg(
        F.count("*").alias("n_total"), F.count(x).alias("n_validos"), (F.count("*") - F.count(x)).alias("n_nulos"),
        ratio(F.count(x), F.count("*")).alias("completitud_pct"), F.min(x).alias("valor_minimo"), F.max(x).alias("valor_maximo"),
        zeros.alias("frecuencia_0"), ones.alias("frecuencia_1"), ratio(zeros, F.count(x)).alias("porcentaje_0"),
        ratio(ones, F.count(x)).alias("porcentaje_1"), mean(x, 4).alias("proporcion_media_1"),
        F.round(deviation(x), 4).alias("desviacion_estandar"), F.round(variance(x), 4).alias("varianza"),
        first_match([(ones > zeros, "1"), (zeros > ones, "0")], "BIMODAL").alias("moda"),
        first_match([(avg < 0.1, "PREDOMINIO_0_FUERTE"), (avg < 0.3, "PREDOMINIO_0_MODERADO"),
                     (avg.between(0.4, 0.6), "DISTRIBUCIÓN_BALANCEADA"), (avg < 0.8, "PREDOMINIO_1_MODERADO")],
                    "PREDOMINIO_1_FUERTE").alias("clasificacion_distribucion"),
    )


def quarter_comparison(productos: DataFrame, periods: Periods, ids: Sequence[int] | None = None) -> DataFrame:
    stats = _rows(productos, ids).groupBy("trimestre").agg(
        F.count("*").alias("registros"), mean(F.col("cProducto"), 0).alias("media_producto"),
        F.round(deviation(F.col("cProducto")), 0).alias("std_producto"), mean(F.col("cSeleccion"), 3).alias("media_seleccion"),
        mean(F.col("cIOT"), 3).alias("media_iot"), F.count_distinct("cProducto").alias("productos_unicos"),
        vocabulary("cCategoria").alias("categorias_unicas"),
    )
    w = Window.orderBy(periods.order_of(F.col("trimestre")))  # one row per quarter
    now, was = F.col("media_producto"), F.col("media_producto_anterior")
    rate, old_rate = F.col("media_seleccion"), F.col("media_seleccion_anterior")
    return stats.withColumns({
        "registros_anterior": F.lag("registros").over(w), "media_producto_anterior": F.lag("media_producto").over(w),
        "media_seleccion_anterior": F.lag("media_seleccion").over(w),
    }).withColumns({
        "crecimiento_registros_pct": ratio(F.col("registros") - F.col("registros_anterior"), F.col("registros_anterior")),
        "cambio_media_producto": F.round(now - was, 0), "cambio_media_seleccion": F.round(rate - old_rate, 4),
        "tendencia_producto": first_match([(was.isNull(), "BASELINE"), (now > was * 1.05, "TENDENCIA_CRECIENTE"),
                                           (now < was * 0.95, "TENDENCIA_DECRECIENTE")], "TENDENCIA_ESTABLE"),
        "tendencia_seleccion": first_match([(old_rate.isNull(), "BASELINE"), (F.abs(rate - old_rate) > 0.05, "CAMBIO_SIGNIFICATIVO")], "ESTABLE"),
    })


def _binned(rows: DataFrame, name: str, bins, rest: str) -> DataFrame:
    x = F.col("cProducto")
    label = first_match([(x.isNull(), "NULL"), *[(x < top, text) for top, text in bins]], rest)
    order = first_match([(x.isNull(), 0), *[(x < top, i) for i, (top, _) in enumerate(bins, 1)]], len(bins) + 1)
    return rows.groupBy("trimestre", label.alias(name), order.alias("_o")).agg(F.count("*").alias("frecuencia"))


def histogram(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    whole = Window.partitionBy("trimestre")  # at most one row per bin
    running = whole.orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    return _binned(_rows(productos, ids), "rango_producto", BINS, "Rango_5: >50M").select(
        "trimestre", "rango_producto", "frecuencia", ratio(F.col("frecuencia"), F.sum("frecuencia").over(whole)).alias("porcentaje"),
        F.sum("frecuencia").over(running).alias("frecuencia_acumulada"),
    )


def executive_dashboard(productos: DataFrame, periods: Periods, ids: Sequence[int] | None = None) -> DataFrame:
    per_quarter = _rows(productos, ids).groupBy("trimestre").agg(
        F.count("*").alias("n"), F.avg("cProducto").alias("p"), F.avg("cSeleccion").alias("s"),
        mean(F.col("cProducto"), 0).alias("pr"), mean(F.col("cSeleccion"), 3).alias("sr"),
    )

    def of(label: str, col: str) -> Column:
        return F.max(F.when(F.col("trimestre") == label, F.col(col)))

    numbered = list(enumerate(periods.labels, 1))
    spread = F.stddev_pop("p") / F.avg("p")
    return per_quarter.agg(
        F.lit("RESUMEN_ESTADÍSTICO_EJECUTIVO").alias("tipo_reporte"),
        *[F.coalesce(of(t, "n"), F.lit(0)).alias(f"total_registros_q{i}") for i, t in numbered],
        F.sum("n").alias("gran_total_registros"),
        *[of(t, "pr").alias(f"media_producto_q{i}") for i, t in numbered],
        *[of(t, "sr").alias(f"tasa_seleccion_q{i}") for i, t in numbered],
        F.round(F.stddev_pop("p"), 0).alias("volatilidad_media_producto"),
        F.round(F.stddev_pop("s") * 100, 2).alias("volatilidad_tasa_seleccion_pct"),
        first_match([(spread < 0.05, "SISTEMA_MUY_ESTABLE"), (spread < 0.10, "SISTEMA_ESTABLE"),
                     (spread < 0.20, "SISTEMA_MODERADAMENTE_VARIABLE")], "SISTEMA_ALTAMENTE_VARIABLE").alias("clasificacion_estabilidad_sistema"),
    )


def percentiles(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    names = {"P05": 5, "P10": 10, "P25_Q1": 25, "P50_Mediana": 50, "P75_Q3": 75, "P90": 90, "P95": 95}
    found = order_statistics(_rows(productos, ids), ["trimestre"], "cProducto", {k: percentile_rank(p) for k, p in names.items()})
    return found.select("trimestre", F.lit("cProducto").alias("variable"), F.lit("Percentiles_Detallados").alias("analisis"), *names)


def percentiles_sketched(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """`percentiles` from one pass and one small shuffle, ranks off by less than 0.2% of the rows."""
    names = {"P05": 5, "P10": 10, "P25_Q1": 25, "P50_Mediana": 50, "P75_Q3": 75, "P90": 90, "P95": 95}
    found = sketched_statistics(_rows(productos, ids), ["trimestre"], "cProducto", {name: p / 100 for name, p in names.items()})
    return found.select("trimestre", F.lit("cProducto").alias("variable"), F.lit("Percentiles_Estimados").alias("analisis"), *names)


def flag_correlation(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    s, i = F.col("cSeleccion"), F.col("cIOT")
    r = F.abs(F.corr(s, i))
    return _rows(productos, ids).where(s.isNotNull() & i.isNotNull()).groupBy("trimestre").agg(
        F.lit("Correlacion_Seleccion_IOT").alias("analisis"), F.count("*").alias("n_pares_validos"),
        F.round(F.corr(s, i), 4).alias("correlacion_pearson_aprox"),
        *[_count((s == a) & (i == b), f"sel{a}_iot{b}") for a in (0, 1) for b in (0, 1)],
        first_match([(r > 0.7, "CORRELACIÓN_FUERTE"), (r > 0.3, "CORRELACIÓN_MODERADA"), (r > 0.1, "CORRELACIÓN_DÉBIL")],
                    "SIN_CORRELACIÓN").alias("interpretacion_correlacion"),
    )


def structure(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    rows = _rows(productos, ids).withColumnRenamed("trimestre", "tabla")
    report = rows.groupBy("tabla").agg(
        F.count("*").alias("total_registros"), vocabulary("cCategoria").alias("categorias_unicas"),
        stamp(F.min("cFecha")).alias("fecha_minima"), stamp(F.max("cFecha")).alias("fecha_maxima"),
        F.datediff(F.max(_day()), F.min(_day())).alias("rango_dias"),
    )
    return with_distinct_counts(report, rows, ["tabla"], {"productos_unicos": ["cProducto"], "idt_unicos": ["cIDT"]})


def null_report(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    c, n = F.col("cCategoria"), F.count(F.lit(1))
    words = [w for w in NULL_WORDS if w != "null"]
    return _rows(productos, ids).groupBy("trimestre").agg(
        F.lit("Análisis_Nulos").alias("tipo_analisis"), *_null_counts(),
        _count(c == "", "categoria_vacia"), _count(c == " ", "categoria_espacio"), _count(F.trim(c) == "", "categoria_solo_espacios"),
        _count(c.isin(*words), "categoria_semanticos"), n.alias("total_registros"),
        ratio(F.count("cProducto"), n).alias("completitud_producto_pct"),
        share(_text() & ~c.isin("N/A", "NA", "NULL", "n/a")).alias("completitud_categoria_pct"),
    )


def time_integrity(productos: DataFrame, periods: Periods, ids: Sequence[int] | None = None) -> DataFrame:
    return _rows(productos, ids).groupBy("trimestre").agg(
        F.lit("Integridad_Temporal").alias("validacion"), _count(_inverted(), "horarios_inconsistentes"),
        _count(_too_early(periods) | _too_late(periods), "fechas_fuera_rango"),
        _count(~F.hour("cFecha").between(6, 22), "registros_fuera_horario_normal"), _count(_weekend(), "registros_fines_semana"),
    )


def numeric_ranges(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    return _rows(productos, ids).groupBy("trimestre").agg(
        F.lit("Rangos_Numericos").alias("validacion"), _count(F.col("cProducto") <= 0, "productos_invalidos"),
        _count(~F.col("cSeleccion").isin(0, 1), "seleccion_fuera_rango"), _count(~F.col("cIOT").isin(0, 1), "iot_fuera_rango"),
        F.min("cProducto").alias("min_producto"), F.max("cProducto").alias("max_producto"),
    )


def descriptive_statistics(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    names = ("cProducto", "cSeleccion", "cIOT")
    long = rows_of(_rows(productos, ids), ["variable", "valor"], [(v, F.col(v).cast("bigint")) for v in names], keep=["trimestre"])
    x = F.col("valor")
    return long.groupBy("trimestre", "variable").agg(
        F.count("*").alias("n"), F.count(x).alias("n_validos"), F.min(x).alias("minimo"), F.max(x).alias("maximo"),
        F.avg(x).alias("media"), figure(deviation(x)).alias("desviacion_estandar"), figure(variance(x)).alias("varianza"),
        (F.count(x) * 0.25).alias("q1_posicion"), (F.count(x) * 0.50).alias("mediana_posicion"), (F.count(x) * 0.75).alias("q3_posicion"),
        F.round(deviation(x) / F.nullif(F.avg(x), F.lit(0.0)) * 100, 2).alias("coef_variacion_pct"),
        (F.max(x) - F.min(x)).alias("rango_total"),
    )


def distribution_shape(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """Second scan compares every row with its quarter's mean (one broadcast row per quarter)."""
    rows, x = _rows(productos, ids).where(F.col("cProducto").isNotNull()), F.col("cProducto")
    stats = rows.groupBy("trimestre").agg(
        F.avg(x).alias("m"), F.nullif(deviation(x), F.lit(0.0)).alias("d"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n"))
    above = rows.join(F.broadcast(stats.select("trimestre", "m")), "trimestre").groupBy("trimestre").agg(F.count_if(x > F.col("m")).alias("above"))
    cv = F.col("d") / F.col("m")
    return stats.join(above, "trimestre").select(
        "trimestre", F.lit("cProducto").alias("variable"), ratio(F.col("above"), F.col("n"), 3, 1).alias("prop_sobre_media"),
        F.round((F.col("hi") - F.col("m")) / F.col("d"), 2).alias("distancia_max_std"),
        F.round((F.col("m") - F.col("lo")) / F.col("d"), 2).alias("distancia_min_std"),
        F.round(cv * 100, 2).alias("coef_variacion_pct"),
        first_match([(cv < 0.1, "BAJA_VARIABILIDAD"), (cv < 0.3, "VARIABILIDAD_MODERADA")], "ALTA_VARIABILIDAD").alias("clasificacion_variabilidad"),
    )


def iqr_outliers(productos: DataFrame, ids: Sequence[int] | None = None, mode: str = "tiles") -> DataFrame:
    """Rows beyond 1.5 IQR of the quartiles.

    mode='tiles' takes Q1 and Q3 as the first values of the first and third
    NTILE(4) buckets (so Q1 is the minimum); mode='iqr' takes the first values
    of the second and fourth buckets.
    """
    tiles = {"tiles": (1, 3), "iqr": (2, 4)}[mode]
    rows, x = _rows(productos, ids).where(F.col("cProducto").isNotNull()), F.col("cProducto")
    q = order_statistics(rows, ["trimestre"], "cProducto", {"Q1": ntile_start(tiles[0], 4), "Q3": ntile_start(tiles[1], 4)})
    limits = q.withColumn("IQR", F.col("Q3") - F.col("Q1")).withColumns({
        "limite_inferior": F.col("Q1") - F.col("IQR") * 1.5, "limite_superior": F.col("Q3") + F.col("IQR") * 1.5})
    low, high = x < F.col("limite_inferior"), x > F.col("limite_superior")
    keys = ["trimestre", "Q1", "Q3", "IQR", "limite_inferior", "limite_superior"]
    return rows.join(F.broadcast(limits), "trimestre").groupBy(*keys).agg(
        _count(low | high, "outliers_detectados"), share(low | high).alias("pct_outliers"),
        F.min(F.when(low, x)).alias("outlier_inferior_extremo"), F.max(F.when(high, x)).alias("outlier_superior_extremo"),
    )


def rare_combinations(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    rows, n = _rows(productos, ids), F.col("frecuencia_combinacion")
    totals = rows.groupBy("trimestre").agg(F.count("*").alias("_t"))
    combos = rows.groupBy("trimestre", "cIDT", "cCategoria", "cSeleccion", "cIOT").agg(F.count("*").alias("frecuencia_combinacion"))
    return combos.join(F.broadcast(totals), "trimestre").select(
        "trimestre", "cIDT", "cCategoria", "cSeleccion", "cIOT", "frecuencia_combinacion", ratio(n, F.col("_t"), 4).alias("porcentaje_total"),
        first_match([(n == 1, "COMBINACIÓN_ÚNICA"), (n <= 3, "COMBINACIÓN_RARA"), (n >= 100, "COMBINACIÓN_COMÚN")],
                    "COMBINACIÓN_NORMAL").alias("clasificacion_frecuencia"),
    )


def exact_duplicates(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    cols = ["trimestre", "cProducto", "cIDT", "cCategoria", "cSeleccion", "cIOT", "cFecha", "cHInicio_seg", "cHFin_seg"]
    return _rows(productos, ids).groupBy(*cols).agg(F.count("*").alias("veces_duplicado")).where(F.col("veces_duplicado") > 1).withColumns({
        "cFecha": stamp(F.col("cFecha")), "tipo_duplicado": F.lit("DUPLICADO_EXACTO")})


def logical_duplicates(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    # Counted per category first: a group, such as all rows of an id and day without a product, gets each category once.
    keys = ["trimestre", "cProducto", "cIDT", "fecha_solo"]
    per_category = _rows(productos, ids).groupBy("trimestre", "cProducto", "cIDT", _day().alias("fecha_solo"), "cCategoria").agg(F.count("*").alias("_n"))
    return per_category.groupBy(*keys).agg(
        F.sum("_n").alias("registros_mismo_dia"), F.array_sort(F.collect_list("cCategoria")).alias("_c"),
    ).where(F.col("registros_mismo_dia") > 1).select(
        "trimestre", "cProducto", "cIDT", "fecha_solo", "registros_mismo_dia",
        F.when(F.size("_c") > 0, F.array_join("_c", ", ")).alias("categorias_diferentes"),
        F.size("_c").cast("bigint").alias("num_categorias_distintas"), F.lit("DUPLICADO_LOGICO").alias("tipo_duplicado"),
    )


def category_pareto(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """Cumulative frequency of categories; equal frequencies accumulate together.

    Running totals are taken over the different frequencies, of which there are
    about as many as the root of the row count, and positions for the deciles
    inside a frequency and the first letters of the category, so an open
    vocabulary, most of which occurs once, is never in one task.
    """
    freq = _rows(productos, ids).where(_text()).groupBy("trimestre", "cCategoria").agg(F.count("*").alias("frecuencia"))
    freq = freq.withColumn("_letters", F.left("cCategoria", F.lit(2)))
    cell = ["trimestre", "frecuencia", "_letters"]
    cells = freq.groupBy(*cell).agg(F.count("*").alias("_k"))
    n, k = F.col("frecuencia"), F.col("_k")
    whole = Window.partitionBy("trimestre")
    down = whole.orderBy(n.desc())
    peers, above = down.rangeBetween(Window.unboundedPreceding, 0), Window.unboundedPreceding
    # One row per frequency: totals, share, and the running sums with all categories of the frequency.
    levels = cells.groupBy("trimestre", "frecuencia").agg(F.sum("_k").alias("_k")).withColumns({"_t": F.sum(n * k).over(whole), "_c": F.sum("_k").over(whole)})
    levels = levels.withColumn("porcentaje", ratio(n, F.col("_t"))).withColumns({
        "frecuencia_acumulada": F.sum(n * k).over(peers), "porcentaje_acumulado": F.sum(cents(F.col("porcentaje")) * k).over(peers) / 100,
        "_first": F.coalesce(F.sum("_k").over(down.rowsBetween(above, -1)), F.lit(0)),
    }).drop("_k")
    inside = Window.partitionBy("trimestre", "frecuencia").orderBy("_letters").rowsBetween(above, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_k").over(inside), F.lit(0))).drop("_k").join(levels, ["trimestre", "frecuencia"])
    own = F.row_number().over(Window.partitionBy(*cell).orderBy("cCategoria"))
    placed = freq.withColumn("_own", own).join(cells, cell).withColumn("_at", F.col("_first") + F.col("_before") + F.col("_own"))
    # NTILE(10): the first `rest` tiles have one row more.
    size, rest, pct = F.expr("_c div 10"), F.col("_c") % 10, F.col("porcentaje")
    wide = rest * (size + 1)
    tile = F.when(F.col("_at") <= wide, F.ceil(F.col("_at") / (size + 1))).otherwise(rest + F.ceil((F.col("_at") - wide) / F.greatest(size, F.lit(1))))
    return placed.select(
        "trimestre", "cCategoria", "frecuencia", "porcentaje", "frecuencia_acumulada", "porcentaje_acumulado",
        first_match([(pct >= 20, "CATEGORÍA_DOMINANTE"), (pct >= 5, "CATEGORÍA_IMPORTANTE"), (pct >= 1, "CATEGORÍA_MENOR")],
                    "CATEGORÍA_RARA").alias("clasificacion_categoria"),
        tile.cast("int").alias("decil_frecuencia"),
    )


def category_cardinality(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    freq = _rows(productos, ids).groupBy("trimestre", "cCategoria").agg(F.count("*").alias("n"))
    total, square = F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n"))
    # Highest frequency first; the alphabetically first category wins a tie.
    modal = F.min(F.when(F.col("cCategoria").isNotNull(), F.struct((-F.col("n")).alias("o"), F.col("cCategoria").alias("c"))))
    return freq.groupBy("trimestre").agg(
        F.count("cCategoria").alias("cardinalidad_categorias"), total.alias("total_registros"),
        ratio(F.count("cCategoria"), total, 4, 1).alias("ratio_cardinalidad"),
        F.round(square / (total.cast("double") * total), 4).alias("indice_concentracion"),
        modal.alias("_m"),
    ).withColumns({"categoria_modal": F.col("_m.c"), "frecuencia_modal": -F.col("_m.o")}).drop("_m")


def weekday_hour_pattern(productos: DataFrame, periods: Periods, ids: Sequence[int] | None = None) -> DataFrame:
    grouped = _in_period(_rows(productos, ids), periods).groupBy(
        "trimestre", F.dayofweek(_day()).alias("dia_semana"), day_name(_day(), DIAS).alias("nombre_dia"), F.hour("cFecha").alias("hora")
    ).agg(
        F.count("*").alias("registros"), F.count_distinct("cProducto").alias("productos_unicos"),
        vocabulary("cCategoria").alias("categorias_unicas"), mean(F.col("cSeleccion")).alias("promedio_seleccion"),
        mean(F.col("cIOT")).alias("promedio_iot"),
    )
    return grouped.withColumn("densidad_pct", ratio(F.col("registros"), F.sum("registros").over(Window.partitionBy("trimestre"))))


def date_gaps(productos: DataFrame, periods: Periods, ids: Sequence[int] | None = None) -> DataFrame:
    days = _rows(productos, ids).select("trimestre", _day().alias("d")).distinct()  # bounded by the calendar
    gap = F.datediff("d", F.lag("d").over(Window.partitionBy("trimestre").orderBy("d")))
    t = F.col("trimestre")
    span = F.datediff(periods.end_of(t), periods.start_of(t)) + 1
    return days.withColumn("g", gap).groupBy("trimestre").agg(
        _count(F.col("g") > 1, "gaps_detectados"), F.max("g").alias("gap_maximo_dias"), F.avg("g").alias("promedio_dias_entre_registros"),
        F.count("d").alias("dias_con_actividad"),
    ).withColumn("dias_totales_periodo", span).withColumn(
        "cobertura_temporal_pct", ratio(F.col("dias_con_actividad"), F.col("dias_totales_periodo")))


def correlation_matrix(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    p, s, i = (F.col(c) for c in ("cProducto", "cSeleccion", "cIOT"))
    return _rows(productos, ids).where(p.isNotNull() & s.isNotNull() & i.isNotNull()).groupBy("trimestre").agg(
        F.lit("Correlaciones").alias("analisis"), F.round(F.corr(p, s), 4).alias("corr_producto_seleccion"),
        F.round(F.corr(p, i), 4).alias("corr_producto_iot"), F.round(F.corr(s, i), 4).alias("corr_seleccion_iot"),
    )


def _expected(row: Column, column: Column, total: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    return F.round(wide(row) * wide(column) / wide(total), 2).cast("double")


def _with_margins(cells: DataFrame, rows: str, columns: str) -> DataFrame:
    """Cell counts `n` with quarter, row and column totals; cells of one row or column are spread over several tasks."""
    out = cells.join(F.broadcast(cells.groupBy("trimestre").agg(F.sum("n").alias("_t"))), "trimestre")
    out = salted_join(out, cells.groupBy("trimestre", rows).agg(F.sum("n").alias("_r")), ["trimestre", rows], [columns])
    return salted_join(out, cells.groupBy("trimestre", columns).agg(F.sum("n").alias("_c")), ["trimestre", columns], [rows])


def contingency(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    cells = _rows(productos, ids).where(F.col("cCategoria").isNotNull()).groupBy("trimestre", "cIDT", "cCategoria").agg(F.count("*").alias("n"))
    n = F.col("n")
    return _with_margins(cells, "cIDT", "cCategoria").select(
        "trimestre", "cIDT", "cCategoria", n.alias("frecuencia_observada"), ratio(n, F.col("_t")).alias("porcentaje_total"),
        ratio(n, F.col("_r")).alias("porcentaje_por_idt"), ratio(n, F.col("_c")).alias("porcentaje_por_categoria"),
        _expected(F.col("_r"), F.col("_c"), F.col("_t")).alias("frecuencia_esperada"),
    )


def _quality_inputs(productos: DataFrame, periods: Periods, ids, mode: str) -> DataFrame:
    rows = _rows(productos, ids)
    base = rows.groupBy("trimestre").agg(
        F.count("*").alias("total_registros"),
        vocabulary("cCategoria").alias("categorias_unicas"), ratio(F.count("cProducto"), F.count("*")).alias("completitud_pct"),
        ratio(_valid_cells(), F.count("*") * 4).alias("_global"), _logical_duplicates().alias("duplicados_logicos"),
        ratio(F.count_if(~_inverted()), F.count(_seconds())).alias("consistencia_temporal_pct"),
    )
    base = with_distinct_counts(base, rows, ["trimestre"], {"productos_unicos": ["cProducto"]})
    outliers = iqr_outliers(rows, mode=mode).select("trimestre", F.col("pct_outliers").alias("outliers_pct"))
    w = Window.orderBy(periods.order_of(F.col("trimestre")))  # one row per quarter
    return base.join(outliers, "trimestre", "left").withColumn("registros_trimestre_anterior", F.lag("total_registros").over(w)).withColumn(
        "crecimiento_pct", ratio(F.col("total_registros") - F.col("registros_trimestre_anterior"), F.col("registros_trimestre_anterior")))


def evolution_dashboard(productos: DataFrame, periods: Periods, ids: Sequence[int] | None = None, mode: str = "tiles") -> DataFrame:
    """Quality index per quarter with measured outliers and duplicates."""
    index = F.col("completitud_pct") * 0.4 + F.col("consistencia_temporal_pct") * 0.3 + (100 - F.col("outliers_pct")) * 0.3
    return _quality_inputs(productos, periods, ids, mode).select(
        "trimestre", F.concat(F.lit("T"), periods.order_of(F.col("trimestre")).cast("string")).alias("tabla"), "total_registros",
        "productos_unicos", "categorias_unicas", "completitud_pct", "outliers_pct", "duplicados_logicos", "consistencia_temporal_pct",
        F.round(index, 2).alias("indice_calidad_global"), "registros_trimestre_anterior", "crecimiento_pct",
    )


def category_stability(productos: DataFrame, periods: Periods, ids: Sequence[int] | None = None) -> DataFrame:
    k = len(periods)
    freq = [F.count_if(F.col("trimestre") == t).alias(f"freq_q{i}") for i, t in enumerate(periods.labels, 1)]
    f = [F.col(f"freq_q{i}") for i in range(1, k + 1)]
    total = sum(f[1:], f[0])
    squares = sum((c * c for c in f[1:]), f[0] * f[0])
    present = sum(((c > 0).cast("bigint") for c in f[1:]), (f[0] > 0).cast("bigint"))
    steps = list(zip(f, f[1:]))

    def all_of(test: Callable[[Column, Column], Column]) -> Column:
        out = F.lit(True)
        for a, b in steps:
            out = out & test(a, b)
        return out

    cv = F.sqrt((squares * k - total * total).cast("double")) / total * 100
    seen = F.col("trimestres_presente")
    return _rows(productos, ids).groupBy("cCategoria").agg(*freq).withColumn("trimestres_presente", present).withColumns({
        "clasificacion_estabilidad": first_match([(seen == k, "CATEGORÍA_ESTABLE"), (seen == k - 1, "CATEGORÍA_INTERMITENTE")], "CATEGORÍA_TEMPORAL"),
        "coef_variacion_temporal": F.round(cv, 2),
        "tendencia": first_match([(all_of(lambda a, b: a < b), "CRECIENTE"), (all_of(lambda a, b: a > b), "DECRECIENTE"),
                                  (all_of(lambda a, b: a == b), "ESTABLE")], "IRREGULAR"),
    })


def session_durations(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    s = _seconds()
    return _rows(productos, ids).groupBy("trimestre", "cIDT", "cCategoria").agg(
        F.count("*").alias("total_sesiones"), F.count(s).alias("sesiones_con_duracion"), mean(s, 0).alias("duracion_promedio_seg"),
        F.min(s).alias("duracion_minima_seg"), F.max(s).alias("duracion_maxima_seg"), F.round(deviation(s), 0).alias("std_duracion_seg"),
        _count(s < 300, "sesiones_cortas_5min"), _count(s.between(300, 1800), "sesiones_medias_30min"), _count(s > 1800, "sesiones_largas_30min"),
        _count(s < 0, "duraciones_negativas"), _count(s > 28800, "duraciones_excesivas_8h"),
    )


def business_rules(productos: DataFrame, periods: Periods, ids: Sequence[int] | None = None) -> DataFrame:
    return _rows(productos, ids).groupBy("trimestre").agg(
        F.lit("Validaciones_Negocio").alias("tipo_analisis"), _count(_inverted(), "violaciones_orden_temporal"),
        _count(_seconds() > 28800, "sesiones_mas_8h"), _count(F.col("cHInicio_seg") < 6 * 3600, "inicio_muy_temprano"),
        _count(F.col("cHFin_seg") > 23 * 3600, "fin_muy_tarde"), _count(_selected_only(), "seleccionado_sin_iot"),
        _count(_iot_only(), "no_seleccionado_con_iot"), _logical_duplicates().alias("productos_duplicados_mismo_dia"),
        _count(_too_late(periods), "fechas_futuras"), _count(_too_early(periods), "fechas_pasadas"),
    )


def cumulative_histogram(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    whole = Window.partitionBy("trimestre")  # at most one row per bin
    running = F.sum("frecuencia").over(whole.orderBy("bin_producto").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("frecuencia").over(whole)
    return _binned(_rows(productos, ids), "bin_producto", COARSE_BINS, "Bin_4: >10M").select(
        "trimestre", "bin_producto", "frecuencia", ratio(F.col("frecuencia"), total).alias("porcentaje"),
        running.alias("freq_acumulada"), ratio(running, total).alias("pct_acumulado"),
    )


def user_profile(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    n, days = F.col("total_actividad"), F.col("dias_activos")
    prods, cats = F.col("productos_diferentes"), F.col("categorias_diferentes")
    return _rows(productos, ids).where(_seconds().isNotNull()).groupBy("trimestre", "cIDT").agg(
        F.count("*").alias("total_actividad"), F.count_distinct("cProducto").alias("productos_diferentes"),
        vocabulary("cCategoria").alias("categorias_diferentes"), vocabulary(_day()).alias("dias_activos"),
        mean(F.col("cSeleccion")).alias("tasa_seleccion"), mean(F.col("cIOT")).alias("tasa_iot"),
        mean(_seconds(), 0).alias("duracion_promedio_seg"), F.min(_day()).alias("_a"), F.max(_day()).alias("_b"),
    ).withColumns({
        "perfil_usuario": first_match([((n >= 100) & (days >= 20), "USUARIO_INTENSIVO"), ((n >= 50) & (days >= 10), "USUARIO_REGULAR"),
                                       ((n >= 10) & (days >= 5), "USUARIO_OCASIONAL")], "USUARIO_ESPORÁDICO"),
        "ratio_diversidad_productos": ratio(prods, n, 3, 1), "ratio_categorias_por_producto": ratio(cats, prods, 3, 1),
        "actividad_promedio_por_dia": ratio(n, days, 2, 1), "span_actividad_dias": F.datediff("_b", "_a") + 1,
    }).drop("_a", "_b")


def anomaly_scores(productos: DataFrame, ids: Sequence[int] | None = None, min_category_rows: int = 10) -> DataFrame:
    rows = _rows(productos, ids)
    common = rows.where(F.col("cCategoria").isNotNull()).groupBy("trimestre", "cCategoria").agg(F.count("*").alias("_n")).where(
        F.col("_n") >= min_category_rows).select("trimestre", "cCategoria", F.lit(True).alias("_common"))
    rules = [
        (~F.hour("cFecha").between(6, 22), "Horario_Inusual"),
        (~F.coalesce(F.col("cProducto").between(1_000_000, 50_000_000), F.lit(False)), "Producto_Atípico"),
        (F.col("_common").isNull(), "Categoría_Rara"), (~F.coalesce(_flags_agree(), F.lit(False)), "Lógica_Inconsistente"),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda x: x.isNotNull())
    score = F.col("score_anomalia_total")
    # A few categories, and rows without one, may be most of the table.
    dealt = salted_join(rows, common, ["trimestre", "cCategoria"], ["cIDT", "cFecha", "cProducto"], "left")
    return dealt.withColumn("_d", found).withColumn("score_anomalia_total", F.size("_d")).where(
        score > 0).select(
        "trimestre", "cProducto", "cIDT", "cCategoria", stamp(F.col("cFecha")).alias("cFecha"), "score_anomalia_total",
        first_match([(score >= 3, "ANOMALÍA_CRÍTICA"), (score == 2, "ANOMALÍA_MODERADA")], "ANOMALÍA_LEVE").alias("clasificacion_anomalia"),
        F.array_join("_d", ", ").alias("detalles_anomalia"),
    )


def hourly_throughput(productos: DataFrame, periods: Periods, ids: Sequence[int] | None = None, min_rows: int = 5) -> DataFrame:
    n = F.col("registros_por_hora")
    keys = ["trimestre", "fecha", "hora"]
    rows = _in_period(_rows(productos, ids), periods).withColumns({"fecha": _day(), "hora": F.hour("cFecha")})
    hours = rows.groupBy(*keys).agg(
        F.count("*").alias("registros_por_hora"), F.count_distinct("cIDT").alias("usuarios_activos_hora"),
        mean(_seconds(), 1).alias("duracion_promedio_seg"), ratio(F.count("*"), F.count_distinct("cIDT"), 4, 1).alias("actividad_promedio_por_usuario"),
        share(F.col("cSeleccion") == 1).alias("tasa_seleccion_pct"), share(F.col("cIOT") == 1).alias("tasa_iot_pct"),
    ).where(n >= min_rows)
    return with_distinct_counts(hours, rows, keys, {"productos_unicos_hora": ["cProducto"]}).withColumns({
        "dia_semana": day_name(F.col("fecha")),
        "clasificacion_carga": first_match([(n >= 100, "PICO_ALTO"), (n >= 50, "CARGA_MEDIA"), (n >= 10, "CARGA_BAJA")], "PERÍODO_INACTIVO"),
    })


def trend_projection(productos: DataFrame, periods: Periods, ids: Sequence[int] | None = None) -> DataFrame:
    stats = _rows(productos, ids).groupBy("trimestre").agg(
        F.count("*").alias("registros"), F.count_distinct("cProducto").alias("productos"), vocabulary("cCategoria").alias("categorias"),
        mean(F.col("cSeleccion"), 3).alias("tasa_seleccion"), mean(F.col("cIOT"), 3).alias("tasa_iot"),
    )
    order = periods.order_of(F.col("trimestre"))
    w = Window.orderBy(order)  # one row per quarter
    n = F.col("registros")
    return stats.withColumns({
        "registros_anterior": F.lag("registros").over(w), "seleccion_anterior": F.lag("tasa_seleccion").over(w), "_two": F.lag("registros", 2).over(w),
    }).withColumns({
        "crecimiento_registros_pct": ratio(n - F.col("registros_anterior"), F.col("registros_anterior")),
        "cambio_tasa_seleccion": F.round(F.col("tasa_seleccion") - F.col("seleccion_anterior"), 4),
        f"proyeccion_q{len(periods) + 1}_registros": F.when(order == len(periods), ratio(n * 3 - F.col("_two"), F.lit(2), 0, 1)),
    }).drop("_two")


def quality_scorecard(productos: DataFrame, periods: Periods, ids: Sequence[int] | None = None, mode: str = "tiles") -> DataFrame:
    """Weighted score from measured completeness, outliers, time order, duplicates and coverage."""
    cover = date_gaps(productos, periods, ids).select("trimestre", "cobertura_temporal_pct")
    cap = lambda c: F.least(F.lit(100.0), c)
    parts = _quality_inputs(productos, periods, ids, mode).join(cover, "trimestre").select(
        "trimestre", cap(F.col("_global")).alias("score_completitud"), cap(100 - F.col("outliers_pct")).alias("score_outliers"),
        cap(F.col("consistencia_temporal_pct")).alias("score_consistencia"),
        cap(100 - ratio(F.col("duplicados_logicos"), F.col("total_registros"))).alias("score_duplicados"),
        cap(F.col("cobertura_temporal_pct")).alias("score_cobertura_temporal"), "total_registros",
        F.col("crecimiento_pct").alias("crecimiento_vs_anterior_pct"),
    )
    score = (F.col("score_completitud") * 0.25 + F.col("score_outliers") * 0.20 + F.col("score_consistencia") * 0.25
             + F.col("score_duplicados") * 0.15 + F.col("score_cobertura_temporal") * 0.15)
    return parts.withColumns({
        "score_calidad_global": F.round(score, 1),
        "clasificacion_calidad": first_match([(score >= 95, "EXCELENTE"), (score >= 85, "BUENA"), (score >= 75, "ACEPTABLE")], "REQUIERE_MEJORA"),
    })


def normality(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    x, s, k = F.col("cProducto"), F.col("skewness_aprox"), F.col("curtosis_aprox")
    return _rows(productos, ids).where(x.isNotNull()).groupBy("trimestre").agg(
        F.lit("Test_Normalidad").alias("test_tipo"), F.avg(x).alias("media"), figure(deviation(x)).alias("std_dev"), F.min(x).alias("minimo"),
        F.max(x).alias("maximo"), F.count("*").alias("n"), F.round(F.skewness(x), 4).alias("skewness_aprox"),
        F.round(F.kurtosis(x), 4).alias("curtosis_aprox"),
    ).withColumns({
        "interpretacion_normalidad": first_match([((F.abs(s) < 0.5) & (F.abs(k) < 0.5), "APROXIMADAMENTE_NORMAL"),
                                                  ((F.abs(s) < 1.0) & (F.abs(k) < 1.0), "MODERADAMENTE_NORMAL")], "NO_NORMAL"),
        "recomendacion_transformacion": first_match([(s > 1, "CONSIDERAR_LOG_TRANSFORM"), (s < -1, "CONSIDERAR_SQRT_TRANSFORM"),
                                                     (F.abs(k) > 2, "CONSIDERAR_OUTLIER_TREATMENT")], "NO_TRANSFORMACIÓN_NECESARIA"),
    })


def chi_square(productos: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    rows = _rows(productos, ids).where(F.col("cSeleccion").isNotNull() & F.col("cCategoria").isNotNull())
    cells = rows.groupBy("trimestre", "cSeleccion", "cCategoria").agg(F.count("*").alias("n"))
    e = F.col("_r").cast("double") * F.col("_c") / F.col("_t")
    diff = F.col("n") - e
    return _with_margins(cells, "cSeleccion", "cCategoria").select(
        "trimestre", F.lit("Chi_Cuadrado_Independencia").alias("test"), "cSeleccion", "cCategoria", F.col("n").alias("freq_observada"),
        _expected(F.col("_r"), F.col("_c"), F.col("_t")).alias("freq_esperada"),
        F.round(diff * diff / e, 4).alias("contribucion_chi2"), F.round(diff / F.sqrt(e), 2).alias("residuo_estandarizado"),
    )
