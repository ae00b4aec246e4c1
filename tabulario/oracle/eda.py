"""Oracle statements of the exploratory profiles."""

from tabulario.oracle.base import LOG_PERIODS, PRODUCTOS, deviation, figure, mean, mean_of_rounded, q, ratio, share, variance

P = """p AS (SELECT trimestre, orden, inicio, fin, productos.*, cast(cFecha AS DATE) AS dia, cHFin_seg - cHInicio_seg AS seg
 FROM productos JOIN per ON cast(cFecha AS DATE) BETWEEN inicio AND fin)"""
WORDS = "('N/A', 'NA', 'NULL', 'n/a', '-', '--', 'null')"
TEXT = "(cCategoria IS NOT NULL AND trim(cCategoria) <> '')"
GOOD = f"({TEXT} AND cCategoria NOT IN {WORDS})"
AGREE = "((cSeleccion = 1 AND cIOT = 1) OR (cSeleccion = 0 AND cIOT = 0))"
OUT = "(cFecha < inicio OR cFecha > fin)"
INV = "cHInicio_seg >= cHFin_seg"
VALID = f"(count(cProducto) + count(*) FILTER (WHERE {TEXT}) + count(cSeleccion) + count(cIOT))"
DUP = "(count(*) - count(DISTINCT CASE WHEN cProducto IS NOT NULL THEN concat_ws('|', cProducto, dia, cIDT) END))"


def n(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) AS {name}"


def s(*parts: str) -> str:
    return q(PRODUCTOS, LOG_PERIODS, P, *parts)


def kth(pct: int, col: str = "cProducto") -> str:
    return f"list({col} ORDER BY {col}) FILTER (WHERE {col} IS NOT NULL)[least(count({col}) - 1, count({col}) * {pct} // 100)::INT + 1]"


NULLS = ", ".join(n(f"{c} IS NULL", a) for a, c in [
    ("producto_null", "cProducto"), ("idt_null", "cIDT"), ("seleccion_null", "cSeleccion"), ("iot_null", "cIOT"),
    ("fecha_null", "cFecha"), ("hinicio_null", "cHInicio_seg"), ("hfin_null", "cHFin_seg"), ("categoria_null", "cCategoria")])
CAL = "per.trimestre, per.inicio AS fecha_inicio, per.fin AS fecha_fin"
STAMP = "strftime(cFecha, '%Y-%m-%d %H:%M:%S')"
OUTLIERS = f"""q4 AS (SELECT trimestre, cProducto AS x, ntile(4) OVER (PARTITION BY trimestre ORDER BY cProducto) AS t FROM p WHERE cProducto IS NOT
 NULL),
lim AS (SELECT trimestre, min(x) FILTER (WHERE t = 1) AS Q1, min(x) FILTER (WHERE t = 3) AS Q3 FROM q4 GROUP BY 1),
lims AS (SELECT *, Q3 - Q1 AS IQR, Q1 - (Q3 - Q1) * 1.5::DOUBLE AS li, Q3 + (Q3 - Q1) * 1.5::DOUBLE AS ls FROM lim),
outl AS (SELECT l.trimestre, Q1, Q3, IQR, li AS limite_inferior, ls AS limite_superior, count(*) FILTER (WHERE x < li OR x > ls) AS
 outliers_detectados,
 {share('x < li OR x > ls')} AS pct_outliers, min(x) FILTER (WHERE x < li) AS outlier_inferior_extremo, max(x) FILTER (WHERE x > ls) AS
 outlier_superior_extremo
 FROM q4 JOIN lims l USING (trimestre) GROUP BY ALL)"""
QUAL = f"""b AS (SELECT trimestre, orden, count(*) AS total_registros, count(DISTINCT cProducto) AS productos_unicos, count(DISTINCT cCategoria) AS
 categorias_unicas,
 {ratio('count(cProducto)', 'count(*)')} AS completitud_pct, {ratio(VALID, 'count(*) * 4')} AS global_pct, {DUP} AS duplicados_logicos,
 {ratio('count(*) FILTER (WHERE cHInicio_seg < cHFin_seg)', 'count(seg)')} AS consistencia_temporal_pct FROM p GROUP BY ALL),
qual AS (SELECT b.*, o.pct_outliers AS outliers_pct, lag(total_registros) OVER (ORDER BY orden) AS prev FROM b LEFT JOIN outl o USING (trimestre))"""
GAPS = f"""days AS (SELECT DISTINCT trimestre, inicio, fin, dia FROM p), gp AS (SELECT *, date_diff('day', lag(dia) OVER (PARTITION BY trimestre
 ORDER BY dia), dia) AS g FROM days),
gaps AS (SELECT trimestre, count(*) FILTER (WHERE g > 1) AS gaps_detectados, max(g)::INT AS gap_maximo_dias, avg(g) AS promedio_dias_entre_registros,
 count(*) AS dias_con_actividad, (date_diff('day', inicio, fin) + 1)::INT AS dias_totales_periodo,
 {ratio('count(*)', "(date_diff('day', inicio, fin) + 1)")} AS cobertura_temporal_pct FROM gp GROUP BY trimestre, inicio, fin)"""


def binned(name: str, bins: list[tuple[int, str]], rest: str) -> str:
    label = "CASE WHEN cProducto IS NULL THEN 'NULL' " + " ".join(f"WHEN cProducto < {b} THEN '{t}'" for b, t in bins) + f" ELSE '{rest}' END"
    order = "CASE WHEN cProducto IS NULL THEN 0 " + " ".join(f"WHEN cProducto < {b} THEN "
        f"{i}" for i, (b, _) in enumerate(bins, 1)) + f" ELSE {len(bins) + 1} END"
    return f"h AS (SELECT trimestre, {label} AS {name}, {order} AS o, count(*) AS frecuencia FROM p GROUP BY 1, 2, 3)"


FIVE = [(1000000, "Rango_1: <1M"), (5000000, "Rango_2: 1M-5M"), (10000000, "Rango_3: 5M-10M"), (50000000, "Rango_4: 10M-50M")]
FOUR = [(1000000, "Bin_1: <1M"), (5000000, "Bin_2: 1M-5M"), (10000000, "Bin_3: 5M-10M")]
CVAR = f"({deviation('cProducto')} / nullif(avg(cProducto), 0))"
SCORE = f"""(count(*) FILTER (WHERE cHInicio_seg < cHFin_seg) * 100.0::DOUBLE / nullif(count(seg), 0) * 0.4::DOUBLE
 + count(*) FILTER (WHERE {AGREE}) * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE cSeleccion IS NOT NULL AND cIOT IS NOT NULL), 0) * 0.3::DOUBLE
 + count(*) FILTER (WHERE cProducto > 0) * 100.0::DOUBLE / nullif(count(cProducto), 0) * 0.3::DOUBLE)"""
CORR = "corr(cSeleccion, cIOT)"
BSUM = f"""SELECT trimestre, variable, count(*) AS n_total, count(v) AS n_validos, count(*) - count(v) AS n_nulos, {ratio('count(v)', 'count(*)')} AS
 completitud_pct,
 min(v) AS valor_minimo, max(v) AS valor_maximo, {n('v = 0', 'frecuencia_0')}, {n('v = 1', 'frecuencia_1')},
 {ratio('count(*) FILTER (WHERE v = 0)', 'count(v)')} AS porcentaje_0, {ratio('count(*) FILTER (WHERE v = 1)', 'count(v)')} AS porcentaje_1,
 {mean('v', 4)} AS proporcion_media_1, round({deviation('v')}, 4) AS desviacion_estandar, round({variance('v')}, 4) AS varianza,
 CASE WHEN count(*) FILTER (WHERE v = 1) > count(*) FILTER (WHERE v = 0) THEN '1' WHEN count(*) FILTER (WHERE v = 0) > count(*) FILTER (WHERE v = 1)
 THEN '0' ELSE 'BIMODAL' END AS moda,
 CASE WHEN avg(v) < 0.1 THEN 'PREDOMINIO_0_FUERTE' WHEN avg(v) < 0.3 THEN 'PREDOMINIO_0_MODERADO' WHEN avg(v) BETWEEN 0.4 AND 0.6 THEN
 'DISTRIBUCIÓN_BALANCEADA'
  WHEN avg(v) < 0.8 THEN 'PREDOMINIO_1_MODERADO' ELSE 'PREDOMINIO_1_FUERTE' END AS clasificacion_distribucion FROM l GROUP BY 1, 2"""
LONG2 = "l AS (SELECT trimestre, 'cSeleccion' AS variable, cSeleccion AS v FROM p UNION ALL SELECT trimestre, 'cIOT', cIOT FROM p)"
LONG3 = "l AS (SELECT trimestre, 'cProducto' AS variable, cProducto AS v FROM p UNION ALL SELECT trimestre, 'cSeleccion', cSeleccion FROM p UNION ALL SELECT trimestre, 'cIOT', cIOT FROM p)"
MARG = "m AS (SELECT *, sum(n) OVER (PARTITION BY trimestre)::BIGINT AS t, sum(n) OVER (PARTITION BY trimestre, r)::BIGINT AS nr, sum(n) OVER (PARTITION BY trimestre, cCategoria)::BIGINT AS nc FROM c)"
RULES = "[CASE WHEN cHInicio_seg >= cHFin_seg THEN 'Horario_Inconsistente' END, CASE WHEN cSeleccion = 1 AND cIOT = 0 THEN 'Seleccionado_Sin_IOT' END, CASE WHEN cSeleccion = 0 AND cIOT = 1 THEN 'No_Seleccionado_Con_IOT' END, CASE WHEN cProducto <= 0 THEN 'Producto_Inválido' END, CASE WHEN cFecha < inicio OR cFecha > fin THEN 'Fecha_Fuera_Rango' END]"

SQL = {
    "e01_pre_check": s(f"SELECT {CAL}, count(p.trimestre) AS registros_existentes, count(DISTINCT cIDT) AS idt_unicos, count(DISTINCT cCategoria) "
        f"AS categorias_unicas FROM per LEFT JOIN p USING (trimestre) GROUP BY ALL"),
    "e02_null_profile": s(f"""SELECT trimestre, cIDT, coalesce(cCategoria, '[NULL_CATEGORIA]') AS categoria_analizada, count(*) AS total_registros,
 {NULLS},
 {n("cCategoria = ''", 'categoria_cadena_vacia')}, {n("cCategoria = ' '", 'categoria_solo_espacio')},
 {n("trim(cCategoria) = '' AND cCategoria <> ''", 'categoria_espacios_multiples')},
 {n(f"cCategoria IN {WORDS}", 'categoria_nulos_semanticos')}, {ratio('count(cProducto)', 'count(*)')} AS completitud_producto_pct, {share(GOOD)} AS
 completitud_categoria_pct,
 {ratio('count(cSeleccion)', 'count(*)')} AS completitud_seleccion_pct, {ratio('count(cIOT)', 'count(*)')} AS completitud_iot_pct,
 {ratio(VALID, 'count(*) * 4')} AS indice_completitud_global_pct, CASE WHEN {VALID} * 100 >= count(*) * 380 THEN 'EXCELENTE' WHEN {VALID} * 100 >=
 count(*) * 340 THEN 'BUENA'
 WHEN {VALID} * 100 >= count(*) * 300 THEN 'ACEPTABLE' ELSE 'REQUIERE_MEJORA' END AS clasificacion_calidad_datos FROM p GROUP BY trimestre, cIDT,
 cCategoria"""),
    "e03_null_summary": s(f"g AS (SELECT trimestre, cIDT, cCategoria, count(*) AS n, count(cProducto) AS p, count(*) FILTER (WHERE {GOOD}) AS c "
        f"FROM p GROUP BY 1, 2, 3)", f"""
SELECT trimestre, sum(n)::BIGINT AS registros_totales, (sum(n) - sum(p))::BIGINT AS total_nulos_producto, (sum(n) - sum(c))::BIGINT AS
 total_nulos_categoria,
 {mean_of_rounded(ratio('p', 'n'))} AS completitud_promedio_producto, {mean_of_rounded(ratio('c', 'n'))} AS completitud_promedio_categoria,
 count(DISTINCT cIDT) AS idt_analizados, count(DISTINCT cCategoria) AS categorias_analizadas, {ratio('sum(p) + sum(c)', 'sum(n) * 2')} AS
 indice_calidad_trimestral FROM g GROUP BY 1"""),
    "e04_consistency_pre_check": s(f"SELECT {CAL}, count(p.trimestre) AS registros_existentes, count(seg) AS registros_con_horarios, "
        f"count(cSeleccion + cIOT) AS registros_con_logica_negocio FROM per LEFT JOIN p USING (trimestre) GROUP BY ALL"),
    "e05_consistency_report": s(f"""SELECT trimestre, count(*) AS total_registros, {n(INV, 'violaciones_orden_temporal')},
 {n('seg > 28800', 'sesiones_excesivas_8h')}, {n('seg < 60', 'sesiones_muy_cortas_1min')},
 {n('cHInicio_seg < 21600', 'inicio_muy_temprano')}, {n('cHFin_seg > 82800', 'fin_muy_tarde')},
 {n('cSeleccion = 1 AND cIOT = 0', 'seleccionado_sin_iot')}, {n('cSeleccion = 0 AND cIOT = 1', 'no_seleccionado_con_iot')},
 {n('cSeleccion IS NULL OR cIOT IS NULL', 'logica_negocio_nula')}, {n('cSeleccion NOT IN (0, 1)', 'seleccion_fuera_rango')},
 {n('cIOT NOT IN (0, 1)', 'iot_fuera_rango')}, {DUP} AS duplicados_logicos_mismo_dia,
 count(*) - count(DISTINCT CASE WHEN cProducto IS NOT NULL THEN concat_ws('|', cProducto, cIDT, cHInicio_seg, cHFin_seg) END) AS
 duplicados_exactos_horario, {n('cProducto <= 0', 'productos_invalidos_cero_negativo')},
 {n(OUT, 'fechas_fuera_rango_trimestre')}, {n('dayofweek(dia) IN (0, 6)', 'registros_fines_semana')},
 {n('hour(cFecha) BETWEEN 0 AND 5', 'registros_madrugada')},
 {ratio('count(*) FILTER (WHERE cHInicio_seg < cHFin_seg)', 'count(seg)')} AS consistencia_temporal_pct,
 {ratio(f'count(*) FILTER (WHERE {AGREE})', 'count(cSeleccion + cIOT)')} AS consistencia_logica_negocio_pct,
 {ratio('count(*) FILTER (WHERE cProducto > 0)', 'count(cProducto)')} AS consistencia_productos_validos_pct,
 round({SCORE}, 2) AS score_integridad_global, CASE WHEN {SCORE} >= 98 THEN 'CONSISTENCIA_EXCELENTE' WHEN {SCORE} >= 95 THEN 'CONSISTENCIA_BUENA'
 WHEN {SCORE} >= 90 THEN 'CONSISTENCIA_ACEPTABLE' ELSE 'CONSISTENCIA_CRÍTICA' END AS clasificacion_consistencia
FROM p GROUP BY 1"""),
    "e06_group_consistency": s(f"""g AS (SELECT trimestre, cIDT, coalesce(cCategoria, '[NULL_CATEGORIA]') AS categoria_analizada, count(*) AS
 total_registros, {n(INV, 'horarios_inconsistentes')}, {n('cSeleccion = 1 AND cIOT = 0', 'sel_sin_iot')},
 {n('cSeleccion = 0 AND cIOT = 1', 'no_sel_con_iot')}, count(*) - count(DISTINCT CASE WHEN cProducto IS NOT NULL THEN concat_ws('|', cProducto, dia)
 END) AS dup_producto_fecha,
 {ratio('count(*) FILTER (WHERE cHInicio_seg < cHFin_seg)', 'count(seg)')} AS consistencia_temporal_pct,
 {ratio(f'count(*) FILTER (WHERE {AGREE})', 'count(cSeleccion + cIOT)')} AS consistencia_logica_pct FROM p GROUP BY trimestre, cIDT, cCategoria)""",
        """SELECT *, CASE WHEN horarios_inconsistentes = 0 AND sel_sin_iot = 0 AND no_sel_con_iot = 0 THEN 'GRUPO_SALUDABLE' WHEN
 horarios_inconsistentes <= 2 AND sel_sin_iot <= 2 THEN 'GRUPO_ACEPTABLE' ELSE 'GRUPO_PROBLEMÁTICO' END AS estado_grupo FROM g"""),
    "e07_worst_records": s(f"v AS (SELECT *, list_filter({RULES}, lambda x: x IS NOT NULL) AS r FROM "
        f"p)", f"""SELECT trimestre, cProducto, cIDT, cCategoria, {STAMP} AS cFecha, cHInicio_seg, cHFin_seg, cSeleccion, cIOT, len(r)::INT AS
 total_violaciones, array_to_string(r, ', ') AS descripcion_violaciones
FROM v WHERE len(r) > 0 QUALIFY row_number() OVER (PARTITION BY trimestre ORDER BY len(r) DESC, v.cFecha DESC, cIDT, cProducto NULLS FIRST,
 cHFin_seg) <= 100"""),
    "e08_valid_counts": s(f"SELECT {CAL}, count(p.trimestre) AS registros_existentes, count(cProducto) AS registros_producto_validos, "
        f"count(cSeleccion) AS registros_seleccion_validos, count(cIOT) AS registros_iot_validos FROM per LEFT JOIN p USING (trimestre) GROUP BY "
        f"ALL"),
    "e09_numeric_summary": s(f"""g AS (SELECT trimestre, 'cProducto' AS variable, count(*) AS n_total, count(cProducto) AS n_validos, count(*) -
 count(cProducto) AS n_nulos, {ratio('count(cProducto)', 'count(*)')} AS completitud_pct, min(cProducto) AS minimo, max(cProducto) AS maximo,
 {mean('cProducto', 0)} AS media_aritmetica, round({deviation('cProducto')}, 0) AS desviacion_estandar, round({variance('cProducto')}, 0) AS
 varianza, max(cProducto) - min(cProducto) AS rango_total, round({CVAR} * 100, 2) AS coeficiente_variacion_pct,
 {kth(25)} AS Q1_percentil_25, {kth(50)} AS mediana_percentil_50, {kth(75)} AS Q3_percentil_75, avg(cProducto) AS a, {deviation('cProducto')} AS d,
 CASE WHEN {CVAR} < 0.1 THEN 'VARIABILIDAD_MUY_BAJA' WHEN {CVAR} < 0.2 THEN 'VARIABILIDAD_BAJA' WHEN {CVAR} < 0.5 THEN 'VARIABILIDAD_MODERADA' WHEN
 {CVAR} < 1.0 THEN 'VARIABILIDAD_ALTA' ELSE 'VARIABILIDAD_MUY_ALTA' END AS clasificacion_variabilidad FROM p GROUP BY 1)""",
        "SELECT * EXCLUDE (a, d), Q3_percentil_75 - Q1_percentil_25 AS IQR_rango_intercuartilico, round((a - mediana_percentil_50) / nullif(d, 0), "
        "3) AS indice_asimetria_aprox FROM g"),
    "e10_binary_summary": s(LONG2, BSUM),
    "e11_quarter_comparison": s(f"""g AS (SELECT orden, trimestre, count(*) AS registros, {mean('cProducto', 0)} AS media_producto,
 round({deviation('cProducto')}, 0) AS std_producto, {mean('cSeleccion', 3)} AS media_seleccion, {mean('cIOT', 3)} AS media_iot,
 count(DISTINCT cProducto) AS productos_unicos, count(DISTINCT cCategoria) AS categorias_unicas FROM p GROUP BY 1, 2),
l AS (SELECT *, lag(registros) OVER (ORDER BY orden) AS registros_anterior, lag(media_producto) OVER (ORDER BY orden) AS media_producto_anterior,
 lag(media_seleccion) OVER (ORDER BY orden) AS media_seleccion_anterior FROM g)""", f"""
SELECT * EXCLUDE (orden), {ratio('registros - registros_anterior', 'registros_anterior')} AS crecimiento_registros_pct, round(media_producto -
 media_producto_anterior, 0) AS cambio_media_producto, round(media_seleccion - media_seleccion_anterior, 4) AS cambio_media_seleccion,
 CASE WHEN media_producto_anterior IS NULL THEN 'BASELINE' WHEN media_producto > media_producto_anterior * 1.05::DOUBLE THEN 'TENDENCIA_CRECIENTE'
 WHEN media_producto < media_producto_anterior * 0.95::DOUBLE THEN 'TENDENCIA_DECRECIENTE' ELSE 'TENDENCIA_ESTABLE' END AS tendencia_producto,
 CASE WHEN media_seleccion_anterior IS NULL THEN 'BASELINE' WHEN abs(media_seleccion - media_seleccion_anterior) > 0.05 THEN 'CAMBIO_SIGNIFICATIVO'
 ELSE 'ESTABLE' END AS tendencia_seleccion FROM l"""),
    "e12_histogram": s(binned("rango_producto", FIVE, "Rango_5: >50M"), f"SELECT trimestre, rango_producto, frecuencia, "
        f"{ratio('frecuencia', 'sum(frecuencia) OVER (PARTITION BY trimestre)')} AS porcentaje, sum(frecuencia) OVER (PARTITION BY trimestre ORDER "
        f"BY o)::BIGINT AS frecuencia_acumulada FROM h"),
    "e13_executive_dashboard": s(f"g AS (SELECT orden, count(*) AS n, avg(cProducto) AS p, avg(cSeleccion) AS s, {mean('cProducto', 0)} AS pr, "
        f"{mean('cSeleccion', 3)} AS sr FROM p GROUP BY 1)", f"""
SELECT 'RESUMEN_ESTADÍSTICO_EJECUTIVO' AS tipo_reporte,
 {', '.join(f"coalesce(max(n) FILTER (WHERE orden = {i}), 0) AS total_registros_q{i}, max(pr) FILTER (WHERE orden = {i}) AS media_producto_q{i}, max(sr) FILTER (WHERE orden = {i}) AS tasa_seleccion_q{i}" for i in (1, 2, 3))},
 sum(n)::BIGINT AS gran_total_registros, round(stddev_pop(p), 0) AS volatilidad_media_producto, round(stddev_pop(s) * 100, 2) AS
 volatilidad_tasa_seleccion_pct,
 CASE WHEN stddev_pop(p) / avg(p) < 0.05 THEN 'SISTEMA_MUY_ESTABLE' WHEN stddev_pop(p) / avg(p) < 0.10 THEN 'SISTEMA_ESTABLE' WHEN stddev_pop(p) /
 avg(p) < 0.20 THEN 'SISTEMA_MODERADAMENTE_VARIABLE' ELSE 'SISTEMA_ALTAMENTE_VARIABLE' END AS clasificacion_estabilidad_sistema FROM g"""),
    "e14_percentiles": s(f"SELECT trimestre, 'cProducto' AS variable, 'Percentiles_Detallados' AS analisis, {kth(5)} AS P05, {kth(10)} AS P10, "
        f"{kth(25)} AS P25_Q1, {kth(50)} AS P50_Mediana, {kth(75)} AS P75_Q3, {kth(90)} AS P90, {kth(95)} AS P95 FROM p GROUP BY 1"),
    "e14_percentiles_sketched": s("SELECT trimestre, 'cProducto' AS variable, TRUE AS P05, TRUE AS P10, TRUE AS P25_Q1, TRUE AS P50_Mediana, "
        "TRUE AS P75_Q3, TRUE AS P90, TRUE AS P95 FROM p WHERE cProducto IS NOT NULL GROUP BY 1"),
    "e15_flag_correlation": s(f"""SELECT trimestre, 'Correlacion_Seleccion_IOT' AS analisis, count(*) AS n_pares_validos, round({CORR}, 4) AS
 correlacion_pearson_aprox, {', '.join(n(f'cSeleccion = {a} AND cIOT = {b}', f'sel{a}_iot{b}') for a in (0, 1) for b in (0, 1))},
 CASE WHEN abs({CORR}) > 0.7 THEN 'CORRELACIÓN_FUERTE' WHEN abs({CORR}) > 0.3 THEN 'CORRELACIÓN_MODERADA' WHEN abs({CORR}) > 0.1 THEN
 'CORRELACIÓN_DÉBIL' ELSE 'SIN_CORRELACIÓN' END AS interpretacion_correlacion FROM p WHERE cSeleccion IS NOT NULL AND cIOT IS NOT NULL GROUP BY 1"""),
    "e16_structure": s("SELECT trimestre AS tabla, count(*) AS total_registros, count(DISTINCT cProducto) AS productos_unicos, count(DISTINCT cIDT) "
        "AS idt_unicos, count(DISTINCT cCategoria) AS categorias_unicas, strftime(min(cFecha), '%Y-%m-%d %H:%M:%S') AS fecha_minima, "
        "strftime(max(cFecha), '%Y-%m-%d %H:%M:%S') AS fecha_maxima, date_diff('day', min(dia), max(dia))::INT AS rango_dias FROM p GROUP BY 1"),
    "e17_null_report": s(f"""SELECT trimestre, 'Análisis_Nulos' AS tipo_analisis, {NULLS}, {n("cCategoria = ''", 'categoria_vacia')},
 {n("cCategoria = ' '", 'categoria_espacio')}, {n("trim(cCategoria) = ''", 'categoria_solo_espacios')},
 {n("cCategoria IN ('N/A', 'NA', 'NULL', 'n/a', '-', '--')", 'categoria_semanticos')}, count(*) AS total_registros,
 {ratio('count(cProducto)', 'count(*)')} AS completitud_producto_pct, {share(f"{TEXT} AND cCategoria NOT IN ('N/A', 'NA', 'NULL', 'n/a')")} AS
 completitud_categoria_pct FROM p GROUP BY 1"""),
    "e18_time_integrity": s(f"SELECT trimestre, 'Integridad_Temporal' AS validacion, {n(INV, 'horarios_inconsistentes')}, "
        f"{n(OUT, 'fechas_fuera_rango')}, {n('hour(cFecha) < 6 OR hour(cFecha) > 22', 'registros_fuera_horario_normal')}, "
        f"{n('dayofweek(dia) IN (0, 6)', 'registros_fines_semana')} FROM p GROUP BY 1"),
    "e18_numeric_ranges": s(f"SELECT trimestre, 'Rangos_Numericos' AS validacion, {n('cProducto <= 0', 'productos_invalidos')}, "
        f"{n('cSeleccion NOT IN (0, 1)', 'seleccion_fuera_rango')}, {n('cIOT NOT IN (0, 1)', 'iot_fuera_rango')}, min(cProducto) AS min_producto, "
        f"max(cProducto) AS max_producto FROM p GROUP BY 1"),
    "e19_descriptive_statistics": s(LONG3, f"SELECT trimestre, variable, count(*) AS n, count(v) AS n_validos, min(v) AS minimo, max(v) AS maximo, "
        f"avg(v) AS media, {figure(deviation('v'))} AS desviacion_estandar, {figure(variance('v'))} AS varianza, count(v) * 0.25::DOUBLE AS "
        f"q1_posicion, count(v) * 0.5::DOUBLE AS mediana_posicion, count(v) * 0.75::DOUBLE AS q3_posicion, round({deviation('v')} / nullif(avg(v), "
        f"0) * 100, 2) AS coef_variacion_pct, max(v) - min(v) AS rango_total FROM l GROUP BY 1, 2"),
    "e20_distribution_shape": s(f"g AS (SELECT trimestre, avg(cProducto) AS m, {deviation('cProducto')} AS d FROM p GROUP BY "
        f"1)", f"""SELECT trimestre, 'cProducto' AS variable, {ratio('count(*) FILTER (WHERE cProducto > m)', 'count(*)', 3, 1)} AS prop_sobre_media,
 round((max(cProducto) - m) / d, 2) AS distancia_max_std, round((m - min(cProducto)) / d, 2) AS distancia_min_std,
 round(d / m * 100, 2) AS coef_variacion_pct, CASE WHEN d / m < 0.1 THEN 'BAJA_VARIABILIDAD' WHEN d / m < 0.3 THEN 'VARIABILIDAD_MODERADA' ELSE
 'ALTA_VARIABILIDAD' END AS clasificacion_variabilidad FROM p JOIN g USING (trimestre) WHERE cProducto IS NOT NULL GROUP BY trimestre, m, d"""),
    "e21_iqr_outliers": s(OUTLIERS, "SELECT * FROM outl"),
    "e21_iqr_outliers_true_quartiles": s(OUTLIERS.replace("t = 3", "t = 4").replace("t = 1)", "t = 2)"), "SELECT * FROM outl"),
    "e22_rare_combinations": s(f"SELECT trimestre, cIDT, cCategoria, cSeleccion, cIOT, count(*) AS frecuencia_combinacion, "
        f"{ratio('count(*)', 'sum(count(*)) OVER (PARTITION BY trimestre)', 4)} AS porcentaje_total, CASE WHEN count(*) = 1 THEN "
        f"'COMBINACIÓN_ÚNICA' WHEN count(*) <= 3 THEN 'COMBINACIÓN_RARA' WHEN count(*) >= 100 THEN 'COMBINACIÓN_COMÚN' ELSE 'COMBINACIÓN_NORMAL' "
        f"END AS clasificacion_frecuencia FROM p GROUP BY 1, 2, 3, 4, 5"),
    "e23_exact_duplicates": s("pp AS (SELECT * REPLACE (trunc(cProducto / 10000000.0)::BIGINT AS cProducto, date_trunc('hour', cFecha) AS cFecha, "
        "(trunc(cHInicio_seg / 3600.0) * 3600)::INT AS cHInicio_seg, (trunc(cHFin_seg / 3600.0) * 3600)::INT AS cHFin_seg) FROM p)", f"SELECT "
        f"trimestre, cProducto, cIDT, cCategoria, cSeleccion, cIOT, {STAMP} AS cFecha, cHInicio_seg, cHFin_seg, count(*) AS veces_duplicado, "
        f"'DUPLICADO_EXACTO' AS tipo_duplicado FROM pp GROUP BY trimestre, cProducto, cIDT, cCategoria, cSeleccion, cIOT, pp.cFecha, cHInicio_seg, "
        f"cHFin_seg HAVING count(*) > 1"),
    "e24_logical_duplicates": s("SELECT trimestre, cProducto, cIDT, dia AS fecha_solo, count(*) AS registros_mismo_dia, string_agg(DISTINCT "
        "cCategoria, ', ' ORDER BY cCategoria) AS categorias_diferentes, count(DISTINCT cCategoria) AS num_categorias_distintas, 'DUPLICADO_LOGICO' "
        "AS tipo_duplicado FROM p GROUP BY 1, 2, 3, 4 HAVING count(*) > 1"),
    "e25_category_pareto": s(f"f AS (SELECT trimestre, cCategoria, count(*) AS frecuencia, "
        f"{ratio('count(*)', 'sum(count(*)) OVER (PARTITION BY trimestre)')} AS porcentaje FROM p WHERE {TEXT} GROUP BY 1, 2)", """
SELECT trimestre, cCategoria, frecuencia, porcentaje, sum(frecuencia) OVER w::BIGINT AS frecuencia_acumulada, (sum(round(porcentaje * 100)::BIGINT)
 OVER w)::DOUBLE / 100 AS porcentaje_acumulado,
 CASE WHEN porcentaje >= 20 THEN 'CATEGORÍA_DOMINANTE' WHEN porcentaje >= 5 THEN 'CATEGORÍA_IMPORTANTE' WHEN porcentaje >= 1 THEN 'CATEGORÍA_MENOR'
 ELSE 'CATEGORÍA_RARA' END AS clasificacion_categoria,
 ntile(10) OVER (PARTITION BY trimestre ORDER BY frecuencia DESC, cCategoria)::INT AS decil_frecuencia FROM f WINDOW w AS (PARTITION BY trimestre
 ORDER BY frecuencia DESC)""".replace("sum(frecuencia) OVER w::BIGINT", "(sum(frecuencia) OVER w)::BIGINT")),
    "e26_category_cardinality": s("f AS (SELECT trimestre, cCategoria, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT trimestre, sum(n) AS t "
        "FROM f GROUP BY 1)", f"""SELECT f.trimestre, count(cCategoria) AS cardinalidad_categorias, sum(n)::BIGINT AS total_registros,
 {ratio('count(cCategoria)', 'sum(n)', 4, 1)} AS ratio_cardinalidad,
 round(sum(pow(n::DOUBLE / t, 2)), 4) AS indice_concentracion, first(cCategoria ORDER BY n DESC, cCategoria) FILTER (WHERE cCategoria IS NOT NULL) AS
 categoria_modal, max(n) FILTER (WHERE cCategoria IS NOT NULL) AS frecuencia_modal FROM f JOIN t USING (trimestre) GROUP BY 1"""),
    "e27_weekday_hour_pattern": s(f"""SELECT trimestre, (dayofweek(dia) + 1)::INT AS dia_semana, CASE dayofweek(dia) WHEN 0 THEN 'Domingo' WHEN 1
 THEN 'Lunes' WHEN 2 THEN 'Martes' WHEN 3 THEN 'Miércoles' WHEN 4 THEN 'Jueves' WHEN 5 THEN 'Viernes' ELSE 'Sábado' END AS nombre_dia,
 hour(cFecha)::INT AS hora, count(*) AS registros, count(DISTINCT cProducto) AS productos_unicos, count(DISTINCT cCategoria) AS categorias_unicas,
 {mean('cSeleccion')} AS promedio_seleccion, {mean('cIOT')} AS promedio_iot,
 {ratio('count(*)', 'sum(count(*)) OVER (PARTITION BY trimestre)')} AS densidad_pct FROM p WHERE cFecha >= inicio AND cFecha <= fin GROUP BY 1, 2, 3,
 4"""),
    "e28_date_gaps": s(GAPS, "SELECT * FROM gaps"),
    "e29_correlation_matrix": s("SELECT trimestre, 'Correlaciones' AS analisis, round(corr(cProducto, cSeleccion), 4) AS corr_producto_seleccion, "
        "round(corr(cProducto, cIOT), 4) AS corr_producto_iot, round(corr(cSeleccion, cIOT), 4) AS corr_seleccion_iot FROM p WHERE cProducto IS NOT "
        "NULL AND cSeleccion IS NOT NULL AND cIOT IS NOT NULL GROUP BY 1"),
    "e30_contingency": s("c AS (SELECT trimestre, cIDT AS r, cCategoria, count(*) AS n FROM p WHERE cCategoria IS NOT NULL GROUP BY 1, 2, "
        "3)", MARG, f"SELECT trimestre, r AS cIDT, cCategoria, n AS frecuencia_observada, {ratio('n', 't')} AS porcentaje_total, {ratio('n', 'nr')} "
        f"AS porcentaje_por_idt, {ratio('n', 'nc')} AS porcentaje_por_categoria, {ratio('nr * nc', 't', 2, 1)} AS frecuencia_esperada FROM m"),
    "e31_evolution_dashboard": s(OUTLIERS, QUAL, f"""SELECT trimestre, concat('T', orden) AS tabla, total_registros, productos_unicos,
 categorias_unicas, completitud_pct, outliers_pct, duplicados_logicos, consistencia_temporal_pct,
 round(completitud_pct * 0.4::DOUBLE + consistencia_temporal_pct * 0.3::DOUBLE + (100 - outliers_pct) * 0.3::DOUBLE, 2) AS indice_calidad_global,
 prev AS registros_trimestre_anterior, {ratio('total_registros - prev', 'prev')} AS crecimiento_pct FROM qual"""),
    "e32_category_stability": s(f"c AS (SELECT cCategoria, {', '.join(n(f'orden = {i}', f'freq_q{i}') for i in (1, 2, 3))}, count(DISTINCT "
        f"trimestre) AS trimestres_presente FROM p GROUP BY 1)", """
SELECT *, CASE trimestres_presente WHEN 3 THEN 'CATEGORÍA_ESTABLE' WHEN 2 THEN 'CATEGORÍA_INTERMITENTE' ELSE 'CATEGORÍA_TEMPORAL' END AS
 clasificacion_estabilidad,
 round((SELECT stddev_pop(v) / avg(v) * 100 FROM (VALUES (freq_q1), (freq_q2), (freq_q3)) x(v)), 2) AS coef_variacion_temporal,
 CASE WHEN freq_q3 > freq_q2 AND freq_q2 > freq_q1 THEN 'CRECIENTE' WHEN freq_q3 < freq_q2 AND freq_q2 < freq_q1 THEN 'DECRECIENTE' WHEN freq_q1 =
 freq_q2 AND freq_q2 = freq_q3 THEN 'ESTABLE' ELSE 'IRREGULAR' END AS tendencia FROM c"""),
    "e33_session_durations": s(f"SELECT trimestre, cIDT, cCategoria, count(*) AS total_sesiones, count(seg) AS sesiones_con_duracion, "
        f"{mean('seg', 0)} AS duracion_promedio_seg, min(seg) AS duracion_minima_seg, max(seg) AS duracion_maxima_seg, round({deviation('seg')}, 0) "
        f"AS std_duracion_seg, {n('seg < 300', 'sesiones_cortas_5min')}, {n('seg BETWEEN 300 AND 1800', 'sesiones_medias_30min')}, "
        f"{n('seg > 1800', 'sesiones_largas_30min')}, {n('seg < 0', 'duraciones_negativas')}, {n('seg > 28800', 'duraciones_excesivas_8h')} FROM p "
        f"GROUP BY 1, 2, 3"),
    "e34_business_rules": s(f"SELECT trimestre, 'Validaciones_Negocio' AS tipo_analisis, {n(INV, 'violaciones_orden_temporal')}, "
        f"{n('seg > 28800', 'sesiones_mas_8h')}, {n('cHInicio_seg < 21600', 'inicio_muy_temprano')}, {n('cHFin_seg > 82800', 'fin_muy_tarde')}, "
        f"{n('cSeleccion = 1 AND cIOT = 0', 'seleccionado_sin_iot')}, {n('cSeleccion = 0 AND cIOT = 1', 'no_seleccionado_con_iot')}, {DUP} AS "
        f"productos_duplicados_mismo_dia, {n('cFecha > fin', 'fechas_futuras')}, {n('cFecha < inicio', 'fechas_pasadas')} FROM p GROUP BY 1"),
    "e35_cumulative_histogram": s(binned("bin_producto", FOUR, "Bin_4: >10M"), f"SELECT trimestre, bin_producto, frecuencia, "
        f"{ratio('frecuencia', 'sum(frecuencia) OVER (PARTITION BY trimestre)')} AS porcentaje, sum(frecuencia) OVER (PARTITION BY trimestre ORDER "
        f"BY bin_producto)::BIGINT AS freq_acumulada, {ratio('sum(frecuencia) OVER (PARTITION BY trimestre ORDER BY bin_producto)', 'sum(frecuencia) OVER (PARTITION BY trimestre)')} AS pct_acumulado FROM h"),
    "e36_user_profile": s(f"g AS (SELECT trimestre, cIDT, count(*) AS total_actividad, count(DISTINCT cProducto) AS productos_diferentes, "
        f"count(DISTINCT cCategoria) AS categorias_diferentes, count(DISTINCT dia) AS dias_activos, {mean('cSeleccion')} AS tasa_seleccion, "
        f"{mean('cIOT')} AS tasa_iot, {mean('seg', 0)} AS duracion_promedio_seg, (date_diff('day', min(dia), max(dia)) + 1)::INT AS "
        f"span_actividad_dias FROM p WHERE seg IS NOT NULL GROUP BY 1, 2)", f"""SELECT *,
 CASE WHEN total_actividad >= 100 AND dias_activos >= 20 THEN 'USUARIO_INTENSIVO' WHEN total_actividad >= 50 AND dias_activos >= 10 THEN
 'USUARIO_REGULAR' WHEN total_actividad >= 10 AND dias_activos >= 5 THEN 'USUARIO_OCASIONAL' ELSE 'USUARIO_ESPORÁDICO' END AS perfil_usuario,
 {ratio('productos_diferentes', 'total_actividad', 3, 1)} AS ratio_diversidad_productos,
 {ratio('categorias_diferentes', 'productos_diferentes', 3, 1)} AS ratio_categorias_por_producto, {ratio('total_actividad', 'dias_activos', 2, 1)} AS
 actividad_promedio_por_dia FROM g"""),
    "e37_anomaly_scores": s("""common AS (SELECT trimestre, cCategoria FROM p WHERE cCategoria IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10),
a AS (SELECT p.*, list_filter([CASE WHEN hour(cFecha) BETWEEN 6 AND 22 THEN NULL ELSE 'Horario_Inusual' END, CASE WHEN cProducto BETWEEN 1000000 AND
 50000000 THEN NULL ELSE 'Producto_Atípico' END,
 CASE WHEN EXISTS (SELECT 1 FROM common c WHERE c.trimestre = p.trimestre AND c.cCategoria = p.cCategoria) THEN NULL ELSE 'Categoría_Rara' END, CASE
 WHEN cSeleccion = cIOT THEN NULL ELSE 'Lógica_Inconsistente' END], lambda x: x IS NOT NULL) AS r FROM p)""", f"""
SELECT trimestre, cProducto, cIDT, cCategoria, {STAMP} AS cFecha, len(r)::INT AS score_anomalia_total, CASE WHEN len(r) >= 3 THEN 'ANOMALÍA_CRÍTICA'
 WHEN len(r) = 2 THEN 'ANOMALÍA_MODERADA' ELSE 'ANOMALÍA_LEVE' END AS clasificacion_anomalia, array_to_string(r, ', ') AS detalles_anomalia FROM a
 WHERE len(r) > 0"""),
    "e38_hourly_throughput": s(f"""SELECT trimestre, dia AS fecha, dayname(dia) AS dia_semana, hour(cFecha)::INT AS hora, count(*) AS
 registros_por_hora, count(DISTINCT cProducto) AS productos_unicos_hora, count(DISTINCT cIDT) AS usuarios_activos_hora, {mean('seg', 1)} AS
 duracion_promedio_seg, {ratio('count(*)', 'count(DISTINCT cIDT)', 4, 1)} AS actividad_promedio_por_usuario,
 CASE WHEN count(*) >= 100 THEN 'PICO_ALTO' WHEN count(*) >= 50 THEN 'CARGA_MEDIA' WHEN count(*) >= 10 THEN 'CARGA_BAJA' ELSE 'PERÍODO_INACTIVO' END
 AS clasificacion_carga, {share('cSeleccion = 1')} AS tasa_seleccion_pct, {share('cIOT = 1')} AS tasa_iot_pct FROM p WHERE cFecha >= inicio AND
 cFecha <= fin GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5"""),
    "e39_trend_projection": s(f"g AS (SELECT trimestre, orden, count(*) AS registros, count(DISTINCT cProducto) AS productos, count(DISTINCT "
        f"cCategoria) AS categorias, {mean('cSeleccion', 3)} AS tasa_seleccion, {mean('cIOT', 3)} AS tasa_iot FROM p GROUP BY 1, 2), l AS (SELECT "
        f"*, lag(registros) OVER (ORDER BY orden) AS registros_anterior, lag(tasa_seleccion) OVER (ORDER BY orden) AS seleccion_anterior, "
        f"lag(registros, 2) OVER (ORDER BY orden) AS two FROM g)", f"""
SELECT * EXCLUDE (orden, two), {ratio('registros - registros_anterior', 'registros_anterior')} AS crecimiento_registros_pct, round(tasa_seleccion -
 seleccion_anterior, 4) AS cambio_tasa_seleccion, CASE WHEN orden = 3 THEN {ratio('3 * registros - two', '2', 0, 1)} END AS proyeccion_q4_registros
 FROM l"""),
    "e40_quality_scorecard": s(OUTLIERS, QUAL, GAPS, f"""k AS (SELECT trimestre, least(100.0::DOUBLE, global_pct) AS score_completitud,
 least(100.0::DOUBLE, 100 - outliers_pct) AS score_outliers, least(100.0::DOUBLE, consistencia_temporal_pct) AS score_consistencia,
 least(100.0::DOUBLE, 100 - {ratio('duplicados_logicos', 'total_registros')}) AS score_duplicados, least(100.0::DOUBLE, cobertura_temporal_pct) AS
 score_cobertura_temporal, total_registros, {ratio('total_registros - prev', 'prev')} AS crecimiento_vs_anterior_pct FROM qual JOIN gaps USING
 (trimestre)),
kk AS (SELECT *, score_completitud * 0.25::DOUBLE + score_outliers * 0.20::DOUBLE + score_consistencia * 0.25::DOUBLE + score_duplicados *
 0.15::DOUBLE + score_cobertura_temporal * 0.15::DOUBLE AS z FROM k)""",
        "SELECT * EXCLUDE (z), round(z, 1) AS score_calidad_global, CASE WHEN z >= 95 THEN 'EXCELENTE' WHEN z >= 85 THEN 'BUENA' WHEN z >= 75 THEN "
        "'ACEPTABLE' ELSE 'REQUIERE_MEJORA' END AS clasificacion_calidad FROM kk"),
    "e41_normality": s(f"g AS (SELECT trimestre, avg(cProducto) AS m, {deviation('cProducto')} AS d FROM p GROUP BY 1), z AS (SELECT trimestre, "
        f"'Test_Normalidad' AS test_tipo, m AS media, {figure('d')} AS std_dev, min(cProducto) AS minimo, max(cProducto) AS maximo, count(*) AS n, "
        f"round(avg(pow((cProducto - m) / d, 3)), 4) AS skewness_aprox, round(avg(pow((cProducto - m) / d, 4)) - 3, 4) AS curtosis_aprox FROM p "
        f"JOIN g USING (trimestre) WHERE cProducto IS NOT NULL GROUP BY trimestre, m, d)", """
SELECT *, CASE WHEN abs(skewness_aprox) < 0.5 AND abs(curtosis_aprox) < 0.5 THEN 'APROXIMADAMENTE_NORMAL' WHEN abs(skewness_aprox) < 1 AND
 abs(curtosis_aprox) < 1 THEN 'MODERADAMENTE_NORMAL' ELSE 'NO_NORMAL' END AS interpretacion_normalidad,
 CASE WHEN skewness_aprox > 1 THEN 'CONSIDERAR_LOG_TRANSFORM' WHEN skewness_aprox < -1 THEN 'CONSIDERAR_SQRT_TRANSFORM' WHEN abs(curtosis_aprox) > 2
 THEN 'CONSIDERAR_OUTLIER_TREATMENT' ELSE 'NO_TRANSFORMACIÓN_NECESARIA' END AS recomendacion_transformacion FROM z"""),
    "e42_chi_square": s("c AS (SELECT trimestre, cSeleccion AS r, cCategoria, count(*) AS n FROM p WHERE cCategoria IS NOT NULL AND cSeleccion IS "
        "NOT NULL GROUP BY 1, 2, 3)", MARG, f"""SELECT trimestre, 'Chi_Cuadrado_Independencia' AS test, r AS cSeleccion, cCategoria, n AS
 freq_observada, {ratio('nr * nc', 't', 2, 1)} AS freq_esperada,
 round(pow(n - nr::DOUBLE * nc / t, 2) / (nr::DOUBLE * nc / t), 4) AS contribucion_chi2, round((n - nr::DOUBLE * nc / t) / sqrt(nr::DOUBLE * nc / t),
 2) AS residuo_estandarizado FROM m"""),
}
SQL["e02_null_profile_of_ids"] = SQL["e02_null_profile"].replace(P, P.replace("FROM productos JOIN", "FROM (SELECT * FROM productos WHERE cIDT "
        "BETWEEN 1 AND 50) productos JOIN"))
