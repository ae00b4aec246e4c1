"""Oracle statements of the sales reports."""

from tabulario.oracle.base import SALES_PERIODS, VENTAS, deviation, figure, mean, mean_of_rounded, q, ratio

V = """v AS (SELECT trimestre, orden, CASE cIDR WHEN 123 THEN 'OP' WHEN 369 THEN 'ONa' ELSE 'OTRO' END AS organizacion, cIDR, categoria, producto_id
 FROM ventas, per WHERE fechaTabla BETWEEN inicio AND fin AND cIDR IN (123, 369))"""
QC = "qc AS (SELECT trimestre, orden, categoria, count(DISTINCT producto_id) AS n FROM v GROUP BY ALL)"
QCO = "qco AS (SELECT organizacion, categoria, trimestre, count(DISTINCT producto_id) AS n FROM v GROUP BY ALL)"
QO = "qo AS (SELECT organizacion, trimestre, orden, count(*) AS n FROM (SELECT DISTINCT organizacion, trimestre, orden, producto_id FROM v) GROUP BY ALL)"
QP = "qp AS (SELECT producto_id, bool_or(orden = 1) AS q1, bool_or(orden = 2) AS q2, bool_or(orden = 3) AS q3 FROM v WHERE producto_id IS NOT NULL GROUP BY 1)"
PRES = """pres AS (SELECT categoria, bool_or(orden = 1) AS p1, bool_or(orden = 2) AS p2, bool_or(orden = 3) AS p3 FROM v WHERE categoria IS NOT NULL
 GROUP BY 1),
pat AS (SELECT *, concat(p1::INT, p2::INT, p3::INT) AS patron FROM pres)"""
CM = f"cm AS (SELECT categoria, {mean('n')} AS p FROM qc GROUP BY 1)"
STATES = """SELECT per.trimestre, c.categoria, CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.trimestre = per.trimestre AND v.categoria = c.categoria)
 THEN 'vacia' ELSE 'no comprada' END AS estado FROM per, (SELECT DISTINCT categoria FROM v WHERE categoria IS NOT NULL) c"""


def s(*parts: str) -> str:
    return q(VENTAS, SALES_PERIODS, V, *parts)


# The quarters of the whole sales table.
CALENDAR = """per AS (SELECT concat('Q0', q, '_', lpad((y % 100)::VARCHAR, 2, '0')) AS trimestre, make_date(y, 3 * q - 2, 1) AS inicio,
 last_day(make_date(y, 3 * q, 1)) AS fin,
 ((y - 1992) * 4 + q)::INT AS orden FROM range(1992, 2002) ys(y), range(1, 5) qs(q))"""

SQL = {
    "s01_pre_check": s("""SELECT per.trimestre, per.inicio AS fecha_inicio, per.fin AS fecha_fin, count(v.trimestre) AS registros_existentes,
 count(DISTINCT v.categoria) AS categorias_distintas FROM per LEFT JOIN v USING (trimestre) GROUP BY ALL"""),
    "s02_distinct_products": s("SELECT trimestre, count(DISTINCT producto_id) AS productos_unicos FROM v GROUP BY 1"),
    "s03_product_diversity": s(f"""SELECT trimestre, count(DISTINCT producto_id) AS productos_unicos, count(*) AS total_transacciones,
 {ratio('count(DISTINCT producto_id)', 'count(*)', 4)} AS ratio_diversidad_productos FROM v GROUP BY 1"""),
    "s04_products_by_org": s("SELECT organizacion, trimestre, count(DISTINCT producto_id) AS productos_unicos FROM v GROUP BY 1, 2"),
    "s05_products_by_first_appearance": s(QO, "SELECT organizacion, trimestre, n AS productos_unicos FROM qo"),
    "s06_quarter_variation": s("b AS (SELECT trimestre, orden, count(DISTINCT producto_id) AS n FROM v GROUP BY ALL)", f"""
SELECT a.trimestre, a.n AS productos_unicos, p.n AS productos_trimestre_anterior, a.n - p.n AS diferencia_absoluta,
 CASE WHEN p.n > 0 THEN {ratio('a.n - p.n', 'p.n')} END AS variacion_porcentual,
 CASE WHEN p.n IS NULL THEN 'TRIMESTRE_BASE' WHEN a.n > p.n THEN 'CRECIMIENTO' WHEN a.n = p.n THEN 'ESTABLE' ELSE 'DECRECIMIENTO' END AS tendencia
FROM b a LEFT JOIN b p ON p.orden = a.orden - 1"""),
    "s07_org_quarter_metrics": s(QO, "l AS (SELECT *, lag(n) OVER (PARTITION BY organizacion ORDER BY orden) AS p FROM qo)", f"""
SELECT organizacion, trimestre, n AS productos_unicos, p AS productos_trimestre_anterior, n - p AS diferencia_absoluta,
 {ratio('n - p', 'p')} AS crecimiento_porcentual, avg(n) OVER (PARTITION BY organizacion) AS promedio_organizacion,
 rank() OVER (PARTITION BY trimestre ORDER BY n DESC) AS ranking_por_trimestre FROM l"""),
    "s08_org_summary": s(QO, f"""SELECT organizacion, sum(n)::BIGINT AS total_productos_periodo, avg(n) AS promedio_productos_trimestre,
 min(n) AS min_productos_trimestre, max(n) AS max_productos_trimestre, {figure(deviation('n'))} AS volatilidad_productos,
 rank() OVER (ORDER BY avg(n) DESC) AS ranking_performance FROM qo GROUP BY 1"""),
    "s09_product_lifecycle": s(QP, """SELECT 'PRODUCTOS_NUEVOS_Q2' AS categoria, count(*) AS cantidad,
 'Productos que aparecen en Q2 pero no estaban en Q1' AS descripcion FROM qp WHERE q2 AND NOT q1
UNION ALL SELECT 'PRODUCTOS_NUEVOS_Q3', count(*), 'Productos que aparecen en Q3 pero no estaban en Q1 ni Q2' FROM qp WHERE q3 AND NOT q1 AND NOT q2
UNION ALL SELECT 'PRODUCTOS_DESCONTINUADOS_Q2', count(*), 'Productos que estaban en Q1 pero no aparecen en Q2' FROM qp WHERE q1 AND NOT q2
UNION ALL SELECT 'PRODUCTOS_DESCONTINUADOS_Q3', count(*), 'Productos que estaban en Q2 pero no aparecen en Q3' FROM qp WHERE q2 AND NOT q3
UNION ALL SELECT 'PRODUCTOS_CONSISTENTES', count(*), 'Productos que aparecen en los 3 trimestres' FROM qp WHERE q1 AND q2 AND q3"""),
    "s10_executive_products": s(f"""SELECT 'RESUMEN_EJECUTIVO' AS tipo_reporte,
 count(DISTINCT producto_id) FILTER (WHERE orden = 1) AS productos_Q1, count(DISTINCT producto_id) FILTER (WHERE orden = 2) AS productos_Q2,
 count(DISTINCT producto_id) FILTER (WHERE orden = 3) AS productos_Q3, count(DISTINCT producto_id) AS productos_unicos_totales,
 {ratio("count(DISTINCT producto_id) FILTER (WHERE orden = 3) - count(DISTINCT producto_id) FILTER (WHERE orden = 1)", "count(DISTINCT producto_id) FILTER (WHERE orden = 1)")} AS crecimiento_Q1_a_Q3_pct FROM v"""),
    "s11_category_products": s(QC, "SELECT trimestre, categoria, n AS productos_unicos FROM qc"),
    "s12_category_statistics": s(QC, f"""SELECT categoria, count(*) AS trimestres_con_actividad, min(n) AS min_productos, max(n) AS max_productos,
 {mean('n')} AS promedio_productos, round({deviation('n')}, 2) AS desviacion_estandar,
 round(CASE WHEN avg(n) > 0 THEN {deviation('n')} / avg(n) * 100 ELSE 0 END, 2) AS coeficiente_variacion_pct FROM qc GROUP BY 1"""),
    "s13_overall_statistics": s(QC, CM, f"""SELECT 'ESTADÍSTICAS_GENERALES' AS tipo_analisis, count(*) AS total_categorias, min(p) AS promedio_minimo,
 max(p) AS promedio_maximo, {mean_of_rounded('p')} AS promedio_de_promedios, round({deviation('round(p * 100)::BIGINT')} / 100, 2) AS
 desviacion_entre_categorias FROM cm"""),
    "s14_average_ranges": s(QC, CM, f"""SELECT CASE WHEN p >= 100 THEN 'ALTO (100+)' WHEN p >= 50 THEN 'MEDIO_ALTO (50-99)' WHEN p >= 20 THEN
 'MEDIO (20-49)'
 WHEN p >= 10 THEN 'MEDIO_BAJO (10-19)' WHEN p >= 5 THEN 'BAJO (5-9)' ELSE 'MUY_BAJO (<5)' END AS rango_promedio,
 count(*) AS cantidad_categorias, min(p) AS promedio_minimo_rango, max(p) AS promedio_maximo_rango, {mean_of_rounded('p')} AS promedio_del_rango FROM
 cm GROUP BY 1"""),
    "s15_category_variability": s(QC, f"""SELECT categoria, count(*) AS trimestres_activos, {mean('n')} AS promedio_productos, min(n) AS
 min_productos,
 max(n) AS max_productos, max(n) - min(n) AS rango_variacion, round({deviation('n')}, 2) AS desviacion_estandar,
 CASE count(*) WHEN 3 THEN 'CATEGORÍA_ESTABLE' WHEN 2 THEN 'CATEGORÍA_INTERMITENTE' ELSE 'CATEGORÍA_ESPORÁDICA' END AS tipo_categoria,
 CASE WHEN {deviation('n')} <= avg(n) * 0.1 THEN 'MUY_ESTABLE' WHEN {deviation('n')} <= avg(n) * 0.3 THEN 'ESTABLE'
 WHEN {deviation('n')} <= avg(n) * 0.5 THEN 'MODERADAMENTE_VARIABLE' ELSE 'ALTAMENTE_VARIABLE' END AS clasificacion_variabilidad FROM qc GROUP BY
 1"""),
    "s16_top_bottom_categories": s(QC, f"c AS (SELECT categoria, {mean('n')} AS promedio_productos, min(n) AS min_productos, max(n) AS "
        f"max_productos, count(*) AS trimestres_activos, avg(n) AS a FROM qc GROUP BY 1)", """
(SELECT 'TOP_10_CATEGORÍAS' AS tipo_ranking, * EXCLUDE (a) FROM c ORDER BY a DESC, categoria NULLS FIRST LIMIT 10)
UNION ALL (SELECT 'BOTTOM_10_CATEGORÍAS', * EXCLUDE (a) FROM c ORDER BY a, categoria NULLS FIRST LIMIT 10)"""),
    "s17_executive_categories": s(QC, "c AS (SELECT categoria, avg(n) AS a, count(*) AS k FROM qc GROUP BY 1)", """
SELECT 'TOTAL_CATEGORÍAS' AS metrica, count(categoria)::DOUBLE AS valor, 'Total de categorías únicas que tuvieron actividad en al menos un trimestre'
 AS descripcion FROM c
UNION ALL SELECT 'PROMEDIO_GENERAL', round(avg(a), 2), 'Promedio general de productos por categoría across todas las categorías' FROM c
UNION ALL SELECT 'CATEGORÍA_MÁS_AMPLIA', round(max(a), 2), 'Mayor promedio de productos por categoría' FROM c
UNION ALL SELECT 'CATEGORÍA_MÁS_PEQUEÑA', round(min(a), 2), 'Menor promedio de productos por categoría' FROM c
UNION ALL SELECT 'CATEGORÍAS_ESTABLES', count(*)::DOUBLE, 'Categorías que aparecen en los 3 trimestres' FROM c WHERE k = 3"""),
    "s18_category_average": s(QC, "SELECT categoria, avg(n) AS promedio_productos, min(n) AS min_productos, max(n) AS max_productos, count(*) AS "
        "trimestres_con_datos FROM qc GROUP BY 1"),
    "s19_org_comparison": s(QCO, "o AS (SELECT categoria, CASE organizacion WHEN 'OP' THEN n END AS a, CASE organizacion WHEN 'ONa' THEN n END AS b "
        "FROM qco)", f"""
SELECT categoria, {mean('a')} AS promedio_productos_OP, {mean('b')} AS promedio_productos_ONa, round(avg(a) - avg(b), 2) AS diferencia_OP_vs_ONa FROM
 o GROUP BY 1"""),
    "s20_org_comparison_with_activity": s(QCO, """SELECT categoria, avg(n) FILTER (WHERE organizacion = 'OP') AS promedio_productos_OP,
 avg(n) FILTER (WHERE organizacion = 'ONa') AS promedio_productos_ONa, avg(n) AS promedio_productos_total,
 count(DISTINCT trimestre) FILTER (WHERE organizacion = 'OP') AS trimestres_OP, count(DISTINCT trimestre) FILTER (WHERE organizacion = 'ONa') AS
 trimestres_ONa FROM qco GROUP BY 1"""),
    "s21_org_matrix": s(QCO, "o AS (SELECT categoria, CASE organizacion WHEN 'OP' THEN n END AS a, CASE organizacion WHEN 'ONa' THEN n END AS b "
        "FROM qco)", f"""
SELECT categoria, {mean('a')} AS promedio_OP, {mean('b')} AS promedio_ONa, round(avg(a) - avg(b), 2) AS diferencia_OP_minus_ONa FROM o GROUP BY 1
 HAVING count(a) + count(b) > 0"""),
    "s22_org_category_average": s(QCO, f"SELECT organizacion, categoria, {mean('n')} AS promedio_productos, min(n) AS min_productos, max(n) AS "
        f"max_productos FROM qco GROUP BY 1, 2"),
    "s23_org_matrix_with_total": s(QCO, "o AS (SELECT categoria, trimestre, n, CASE organizacion WHEN 'OP' THEN n END AS a, CASE organizacion WHEN "
        "'ONa' THEN n END AS b FROM qco)", f"""
SELECT CASE WHEN grouping(categoria) = 1 THEN 'TOTAL_GENERAL' ELSE categoria END AS categoria, {mean('a')} AS OP, {mean('b')} AS ONa, {mean('n')} AS
 PROMEDIO_GENERAL,
 count(DISTINCT CASE WHEN a IS NOT NULL THEN trimestre END) AS trimestres_OP, count(DISTINCT CASE WHEN b IS NOT NULL THEN trimestre END) AS
 trimestres_ONa
FROM o GROUP BY ROLLUP (categoria)"""),
    "s24_average_by_dedup": s(f"""SELECT organizacion, categoria, {mean('n')} AS promedio_productos FROM (SELECT organizacion, categoria, trimestre,
 count(*) AS n
 FROM (SELECT DISTINCT organizacion, categoria, trimestre, producto_id FROM v) GROUP BY ALL) GROUP BY 1, 2"""),
    "s25_lost_categories": s(PRES, """SELECT 'CATEGORÍAS_NO_COMPRADAS_EN_Q2' AS tipo_analisis, 'Q02_95' AS trimestre_sin_compra, 'Q01_95' AS
 trimestre_referencia, count(*) AS cantidad_categorias FROM pres WHERE p1 AND NOT p2
UNION ALL SELECT 'CATEGORÍAS_NO_COMPRADAS_EN_Q3', 'Q03_95', 'Q02_95', count(*) FROM pres WHERE p2 AND NOT p3
UNION ALL SELECT 'CATEGORÍAS_NO_COMPRADAS_EN_Q3_VS_Q1', 'Q03_95', 'Q01_95', count(*) FROM pres WHERE p1 AND NOT p3"""),
    "s26_lost_category_listing": s(PRES, """SELECT 'LISTADO_CATEGORÍAS_Q1_NO_Q2' AS tipo_listado, categoria,
 'Categoría presente en Q1 pero ausente en Q2' AS descripcion FROM pres WHERE p1 AND NOT p2
UNION ALL SELECT 'LISTADO_CATEGORÍAS_Q2_NO_Q3', categoria, 'Categoría presente en Q2 pero ausente en Q3' FROM pres WHERE p2 AND NOT p3
UNION ALL SELECT 'LISTADO_CATEGORÍAS_Q1_NO_Q3', categoria, 'Categoría presente en Q1 pero ausente en Q3' FROM pres WHERE p1 AND NOT p3"""),
    "s27_categories_per_quarter": s("""SELECT 'ESTADÍSTICAS_CATEGORÍAS_POR_TRIMESTRE' AS analisis, count(DISTINCT categoria) FILTER (WHERE orden = 1)
 AS categorias_Q1,
 count(DISTINCT categoria) FILTER (WHERE orden = 2) AS categorias_Q2, count(DISTINCT categoria) FILTER (WHERE orden = 3) AS categorias_Q3 FROM v"""),
    "s28_presence": s(PRES, "SELECT categoria, p1 AS presente_q1, p2 AS presente_q2, p3 AS presente_q3, patron AS patron_presencia, (p1::INT + "
        "p2::INT + p3::INT)::INT AS trimestres_activos FROM pat"),
    "s29_presence_distribution": s(PRES, f"""SELECT patron AS patron_presencia, CASE patron WHEN '111' THEN 'PRESENTE_EN_TODOS' WHEN '110' THEN
 'PRESENTE_Q1_Q2_AUSENTE_Q3'
 WHEN '101' THEN 'PRESENTE_Q1_Q3_AUSENTE_Q2' WHEN '011' THEN 'AUSENTE_Q1_PRESENTE_Q2_Q3' WHEN '100' THEN 'SOLO_Q1' WHEN '010' THEN 'SOLO_Q2' WHEN
 '001' THEN 'SOLO_Q3'
 ELSE 'PATRON_INESPERADO' END AS descripcion_patron, count(*) AS cantidad_categorias, {ratio('count(*)', '(SELECT count(*) FROM pat)')} AS porcentaje
 FROM pat GROUP BY 1"""),
    "s30_presence_problems": s(PRES, """SELECT 'CATEGORÍAS_DESAPARECIDAS_DESPUÉS_Q1' AS tipo_problema, count(*) AS cantidad,
 'Categorías que solo aparecen en Q1' AS descripcion FROM pat WHERE patron = '100'
UNION ALL SELECT 'CATEGORÍAS_INTERMITENTES', count(*), 'Categorías con patrón de presencia irregular' FROM pat WHERE patron IN ('101', '010')
UNION ALL SELECT 'CATEGORÍAS_APARICIÓN_TARDÍA', count(*), 'Categorías que no estaban en Q1 pero aparecen después' FROM pat WHERE patron IN ('011',
 '001', '010')"""),
    "s30_problem_listing": s(PRES, """SELECT CASE patron WHEN '100' THEN 'POSIBLE_DESCONTINUACIÓN' WHEN '101' THEN 'CATEGORÍA_INTERMITENTE_Q1_Q3'
 ELSE 'NUEVA_CATEGORÍA_EXITOSA' END AS tipo_problema, categoria,
 CASE patron WHEN '100' THEN 'Solo presente en Q1' WHEN '101' THEN 'Presente en Q1 y Q3 pero ausente en Q2' ELSE
 'Ausente en Q1 pero presente en Q2 y Q3' END AS detalle
FROM pat WHERE patron IN ('100', '101', '011')"""),
    "s31_presence_executive": s(PRES, f"""m AS (SELECT 1 AS o, 'TOTAL_CATEGORÍAS_ÚNICAS' AS metrica, count(*) AS valor,
 'Total de categorías únicas que aparecieron en al menos un trimestre' AS descripcion FROM pat
UNION ALL SELECT 2, 'CATEGORÍAS_ESTABLES', count(*), 'Categorías que aparecen en los 3 trimestres (patrón 111)' FROM pat WHERE patron = '111'
UNION ALL SELECT 3, 'CATEGORÍAS_PROBLEMÁTICAS', count(*), 'Categorías que NO aparecen en los 3 trimestres' FROM pat WHERE patron != '111'
UNION ALL SELECT 4, 'CATEGORÍAS_DESCONTINUADAS', count(*), 'Categorías que desaparecieron después de aparecer' FROM pat WHERE patron IN ('100', '110')
UNION ALL SELECT 5, 'CATEGORÍAS_NUEVAS', count(*), 'Categorías que aparecieron después de Q1' FROM pat WHERE patron IN ('011', '001', '010')
UNION ALL SELECT 6, 'CATEGORÍAS_INTERMITENTES', count(*), 'Categorías con presencia irregular (patrón 101 o 010)' FROM pat WHERE patron IN ('101',
 '010'))""",
        f"SELECT metrica, valor, descripcion, {ratio('valor', '(SELECT count(*) FROM pat)')} AS porcentaje_del_total FROM m"),
    "s32_catalogue_stability": s(PRES, "t AS (SELECT count(*) FILTER (WHERE patron = '111') AS s, count(*) AS n FROM pat)", f"""
SELECT 'ÍNDICE_ESTABILIDAD_CATÁLOGO' AS metrica, {ratio('s', 'n')} AS porcentaje_estabilidad, CASE WHEN s * 100 >= n * 80 THEN 'CATÁLOGO_MUY_ESTABLE'
 WHEN s * 100 >= n * 60 THEN 'CATÁLOGO_ESTABLE' WHEN s * 100 >= n * 40 THEN 'CATÁLOGO_MODERADAMENTE_ESTABLE' ELSE 'CATÁLOGO_INESTABLE' END AS
 clasificacion_estabilidad,
 concat('De ', n, ' categorías únicas, ', s, ' aparecen en los 3 trimestres') AS interpretacion FROM t"""),
    "s33_category_states": s(STATES),
    "s34_category_states_by_join": s(STATES),
    "s35_category_states_by_sum": s(STATES),
    "s36_category_states_by_rank": s(STATES),
    "s37_cleaned_categories": s("""SELECT organizacion, trimestre, CASE WHEN categoria IS NULL OR trim(categoria) = '' OR categoria = 'sin categoria'
 THEN 'vacio'
 ELSE upper(trim(categoria)) END AS categoria_limpia, count(*) AS cantidad_registros FROM v GROUP BY 1, 2, 3"""),
    "s38_rows_without_category": s("""SELECT organizacion, trimestre, count(*) AS registros_sin_categoria FROM v
 WHERE categoria IS NULL OR trim(categoria) = '' OR categoria = 'sin categoria' GROUP BY 1, 2"""),
}
SQL |= {f"{key}_all_quarters": SQL[key].replace(SALES_PERIODS, CALENDAR) for key in ("s02_distinct_products", "s07_org_quarter_metrics", "s11_category_products")}

# Every quarter of the sales table, 1995 to 2001.
N = 28
WHOLE = """per AS (SELECT concat('Q0', q, '_', lpad((y % 100)::VARCHAR, 2, '0')) AS trimestre, make_date(y, 3 * q - 2, 1) AS inicio,
 last_day(make_date(y, 3 * q, 1)) AS fin,
 ((y - 1995) * 4 + q)::INT AS orden FROM range(1995, 2002) ys(y), range(1, 5) qs(q))"""
# What statements say about the number of quarters.
_COUNTS = {
    "s15_category_variability": [("WHEN 3 THEN", f"WHEN {N} THEN"), ("WHEN 2 THEN", f"WHEN {N - 1} THEN")],
    "s17_executive_categories": [("k = 3", f"k = {N}"), ("los 3 trimestres", f"los {N} trimestres")],
}


def _whole(key: str) -> str:
    text = SQL[key].replace(SALES_PERIODS, WHOLE)
    for old, new in _COUNTS.get(key, []):
        text = text.replace(old, new)
    return text


# Reports with a column, a pattern or a sentence for each quarter, for any number of quarters.
_PER_QUARTER = ("s09", "s10", "s25", "s26", "s27", "s28", "s29", "s30", "s31", "s32")
SQL |= {f"{key}_whole_table": _whole(key) for key in SQL if not key.startswith(_PER_QUARTER) and not key.endswith("_all_quarters")}


def w(*parts: str) -> str:
    return q(VENTAS, WHOLE, V, *parts)


def _sets(key: str) -> str:
    """The quarters of each key, in order, as `o`."""
    return f"""sets AS (SELECT {key} AS k, list_sort(list(DISTINCT orden)) AS o FROM v WHERE {key} IS NOT NULL GROUP BY 1),
pat AS (SELECT k AS categoria, o, array_to_string([CASE WHEN list_contains(o, i) THEN '1' ELSE '0' END for i in range(1, {N + 1})], '') AS patron,
 [i for i in range(1, {N + 1}) if NOT list_contains(o, i)] AS sin, len(o) = o[-1] - o[1] + 1 AS seguido FROM sets)"""


CATS, PRODS = _sets("categoria"), _sets("producto_id")
LOSSES = f"""losses AS (SELECT categoria, i, i + 1 AS j FROM (SELECT categoria, o, unnest(o) AS i FROM pat) WHERE i < {N} AND NOT list_contains(o, i + 1)
UNION ALL SELECT categoria, 1, {N} FROM pat WHERE list_contains(o, 1) AND NOT list_contains(o, {N}))"""
IRREGULAR = f"(NOT seguido OR (NOT list_contains(o, 1) AND NOT list_contains(o, {N})))"


def _columns(template: str) -> str:
    return ", ".join(template.format(i=i) for i in range(1, N + 1))


def _listed(numbers: str) -> str:
    names = f"[concat('Q', i) for i in {numbers}]"
    return f"CASE WHEN len({numbers}) > 1 THEN concat(array_to_string({names}[:-2], ', '), ' y ', {names}[-1]) ELSE array_to_string({names}, '') END"


SQL |= {f"{key}_whole_table": text for key, text in {
    "s09_product_lifecycle": w(PRODS, f"""SELECT concat('PRODUCTOS_NUEVOS_Q', orden) AS categoria, (SELECT count(*) FROM sets WHERE o[1] = orden) AS cantidad,
 concat('Productos que aparecen en Q', orden, ' pero no estaban en ', array_to_string([concat('Q', j) for j in range(1, orden)], ' ni ')) AS descripcion
 FROM per WHERE orden > 1
UNION ALL SELECT concat('PRODUCTOS_DESCONTINUADOS_Q', orden), (SELECT count(*) FROM sets WHERE list_contains(o, orden - 1) AND NOT list_contains(o, orden)),
 concat('Productos que estaban en Q', orden - 1, ' pero no aparecen en Q', orden) FROM per WHERE orden > 1
UNION ALL SELECT 'PRODUCTOS_CONSISTENTES', count(*) FILTER (WHERE len(o) = {N}), 'Productos que aparecen en los {N} trimestres' FROM sets"""),
    "s10_executive_products": w(f"""SELECT 'RESUMEN_EJECUTIVO' AS tipo_reporte, {_columns("count(DISTINCT producto_id) FILTER (WHERE orden = {i}) AS productos_Q{i}")},
 count(DISTINCT producto_id) AS productos_unicos_totales,
 {ratio(f"count(DISTINCT producto_id) FILTER (WHERE orden = {N}) - count(DISTINCT producto_id) FILTER (WHERE orden = 1)", "count(DISTINCT producto_id) FILTER (WHERE orden = 1)")}
 AS crecimiento_Q1_a_Q{N}_pct FROM v"""),
    "s25_lost_categories": w(CATS, LOSSES, f"""pairs AS (SELECT orden AS i, orden + 1 AS j FROM per WHERE orden < {N} UNION ALL SELECT 1, {N})""", f"""
SELECT concat('CATEGORÍAS_NO_COMPRADAS_EN_Q', p.j, CASE WHEN p.j - p.i > 1 THEN '_VS_Q1' ELSE '' END) AS tipo_analisis, b.trimestre AS trimestre_sin_compra,
 a.trimestre AS trimestre_referencia, (SELECT count(*) FROM losses l WHERE l.i = p.i AND l.j = p.j) AS cantidad_categorias
FROM pairs p JOIN per a ON a.orden = p.i JOIN per b ON b.orden = p.j"""),
    "s26_lost_category_listing": w(CATS, LOSSES, """SELECT concat('LISTADO_CATEGORÍAS_Q', i, '_NO_Q', j) AS tipo_listado, categoria,
 concat('Categoría presente en Q', i, ' pero ausente en Q', j) AS descripcion FROM losses"""),
    "s27_categories_per_quarter": w(f"""SELECT 'ESTADÍSTICAS_CATEGORÍAS_POR_TRIMESTRE' AS analisis,
 {_columns("count(DISTINCT categoria) FILTER (WHERE orden = {i}) AS categorias_Q{i}")} FROM v"""),
    "s28_presence": w(CATS, f"""SELECT categoria, {_columns("list_contains(o, {i}) AS presente_q{i}")}, patron AS patron_presencia, len(o)::INT AS trimestres_activos
 FROM pat"""),
    "s29_presence_distribution": w(CATS, f"""named AS (SELECT patron, CASE WHEN len(o) = {N} THEN 'PRESENTE_EN_TODOS' WHEN len(o) = 1 THEN concat('SOLO_Q', o[1])
 WHEN o[1] = 1 THEN concat('PRESENTE_', array_to_string([concat('Q', i) for i in o], '_'), '_AUSENTE_', array_to_string([concat('Q', i) for i in sin], '_'))
 ELSE concat('AUSENTE_', array_to_string([concat('Q', i) for i in sin], '_'), '_PRESENTE_', array_to_string([concat('Q', i) for i in o], '_')) END AS d FROM pat)""",
        f"""SELECT patron AS patron_presencia, d AS descripcion_patron, count(*) AS cantidad_categorias, {ratio('count(*)', '(SELECT count(*) FROM pat)')} AS porcentaje
 FROM named GROUP BY 1, 2"""),
    "s30_presence_problems": w(CATS, f"""SELECT 'CATEGORÍAS_DESAPARECIDAS_DESPUÉS_Q1' AS tipo_problema, count(*) FILTER (WHERE o = [1]) AS cantidad,
 'Categorías que solo aparecen en Q1' AS descripcion FROM pat
UNION ALL SELECT 'CATEGORÍAS_INTERMITENTES', count(*) FILTER (WHERE {IRREGULAR}), 'Categorías con patrón de presencia irregular' FROM pat
UNION ALL SELECT 'CATEGORÍAS_APARICIÓN_TARDÍA', count(*) FILTER (WHERE o[1] > 1), 'Categorías que no estaban en Q1 pero aparecen después' FROM pat"""),
    "s30_problem_listing": w(CATS, f"""SELECT 'POSIBLE_DESCONTINUACIÓN' AS tipo_problema, categoria, 'Solo presente en Q1' AS detalle FROM pat WHERE o = [1]
UNION ALL SELECT 'CATEGORÍA_INTERMITENTE_Q1_Q{N}', categoria, concat('Presente en Q1 y Q{N} pero ausente en ', {_listed('sin')}) FROM pat
 WHERE o[1] = 1 AND o[-1] = {N} AND len(o) < {N}
UNION ALL SELECT 'NUEVA_CATEGORÍA_EXITOSA', categoria, concat('Ausente en Q1 pero presente en ', {_listed(f'range(2, {N + 1})')}) FROM pat
 WHERE o[1] > 1 AND len(o) = {N - 1}"""),
    "s31_presence_executive": w(CATS, f"""m AS (SELECT 'TOTAL_CATEGORÍAS_ÚNICAS' AS metrica, count(*) AS valor,
 'Total de categorías únicas que aparecieron en al menos un trimestre' AS descripcion FROM pat
UNION ALL SELECT 'CATEGORÍAS_ESTABLES', count(*) FILTER (WHERE len(o) = {N}), 'Categorías que aparecen en los {N} trimestres (patrón {"1" * N})' FROM pat
UNION ALL SELECT 'CATEGORÍAS_PROBLEMÁTICAS', count(*) FILTER (WHERE len(o) < {N}), 'Categorías que NO aparecen en los {N} trimestres' FROM pat
UNION ALL SELECT 'CATEGORÍAS_DESCONTINUADAS', count(*) FILTER (WHERE o[1] = 1 AND seguido AND len(o) < {N}), 'Categorías que desaparecieron después de aparecer'
 FROM pat
UNION ALL SELECT 'CATEGORÍAS_NUEVAS', count(*) FILTER (WHERE o[1] > 1), 'Categorías que aparecieron después de Q1' FROM pat
UNION ALL SELECT 'CATEGORÍAS_INTERMITENTES', count(*) FILTER (WHERE {IRREGULAR}),
 'Categorías con presencia irregular (con huecos, o ausentes en el primero y el último trimestre)' FROM pat)""",
        f"SELECT metrica, valor, descripcion, {ratio('valor', '(SELECT count(*) FROM pat)')} AS porcentaje_del_total FROM m"),
    "s32_catalogue_stability": w(CATS, f"t AS (SELECT count(*) FILTER (WHERE len(o) = {N}) AS s, count(*) AS n FROM pat)", f"""
SELECT 'ÍNDICE_ESTABILIDAD_CATÁLOGO' AS metrica, {ratio('s', 'n')} AS porcentaje_estabilidad, CASE WHEN s * 100 >= n * 80 THEN 'CATÁLOGO_MUY_ESTABLE'
 WHEN s * 100 >= n * 60 THEN 'CATÁLOGO_ESTABLE' WHEN s * 100 >= n * 40 THEN 'CATÁLOGO_MODERADAMENTE_ESTABLE' ELSE 'CATÁLOGO_INESTABLE' END AS
 clasificacion_estabilidad,
 concat('De ', n, ' categorías únicas, ', s, ' aparecen en los {N} trimestres') AS interpretacion FROM t"""),
}.items()}

# Ten thousand periods of one day each.
DAYS = """per AS (SELECT strftime(d, '%Y-%m-%d') AS trimestre, d::DATE AS inicio, d::DATE AS fin, (row_number() OVER (ORDER BY d))::INT AS orden
 FROM range(DATE '1992-01-01', DATE '1992-01-01' + 10000, INTERVAL 1 DAY) ds(d))"""
SQL |= {f"{key}_by_day": SQL[key].replace(SALES_PERIODS, DAYS) for key in ("s02_distinct_products", "s06_quarter_variation", "s11_category_products")}

# The reports of the presence script, by the name of their function.
BUNDLE = {
    "presence": "s28_presence", "lost_categories": "s25_lost_categories", "lost_category_listing": "s26_lost_category_listing",
    "categories_per_quarter": "s27_categories_per_quarter", "presence_distribution": "s29_presence_distribution", "presence_problems": "s30_presence_problems",
    "problem_listing": "s30_problem_listing", "presence_executive": "s31_presence_executive", "catalogue_stability": "s32_catalogue_stability",
}
SQL["s32_presence_bundle"] = "\nUNION ALL ".join(
    f"SELECT '{name}' AS informe, count(*) AS filas FROM ({SQL[key + '_whole_table']})" for name, key in BUNDLE.items()
)
