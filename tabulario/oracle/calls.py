"""Oracle statements of the call-log data model and quality reports."""

from tabulario.oracle.base import CRUDAS, LLAMADAS, LOG_PERIODS, q, ratio, share

C = "c AS (SELECT trimestre, orden, llamadas.*, hora_fin_seg < hora_inicio_seg AS inv FROM llamadas JOIN per ON fecha BETWEEN inicio AND fin)"


def s(*parts: str) -> str:
    return q(LLAMADAS, LOG_PERIODS, C, *parts)


def r(*parts: str) -> str:
    return q(CRUDAS, LOG_PERIODS, *parts)


def n(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) AS {name}"


def blank(c: str) -> str:
    return f"({c} IS NULL OR {c} = '')"


def full(c: str) -> str:
    return f"({c} IS NOT NULL AND {c} <> '')"


def lst(c: str, sep: str = ",") -> str:
    return f"string_agg(DISTINCT {c}, '{sep}' ORDER BY {c})"


FIELDS = ["numero_entrada", "numero_digitado", "menu", "opcion", "id_CTransferencia", "etiquetas", "division", "area", "cIdentifica"]
CRIT = ["numero_entrada", "menu", "numero_digitado", "etiquetas"]
NOTREF = f"{full('opcion')} AND opcion NOT IN ('DEFAULT', '21', '1', '5', '11') AND (etiquetas IS NULL OR etiquetas NOT LIKE concat('%', opcion, '%'))"
NOVSI = "menu LIKE 'RES-%' AND (etiquetas IS NULL OR etiquetas NOT LIKE '%VSI%')"
COMPLEX = f"menu LIKE 'comercial_%' AND {full('etiquetas')} AND strlen(etiquetas) > 10"
SCEN = """x AS (SELECT escenario, numero_entrada FROM c, LATERAL (SELECT unnest(list_filter(['CON_TODOS_LOS_DATOS', CASE WHEN {ok} THEN
 'SOLO_DATOS_LIMPIOS' END,
 CASE WHEN {ok} AND etiquetas <> '' AND menu NOT IN ('cte_colgo', 'SinOpcion_Cbc') THEN 'DATOS_ULTRA_LIMPIOS' END], lambda z: z IS NOT NULL)) AS
 escenario))"""
SCEN_OUT = f"SELECT escenario, count(DISTINCT numero_entrada) AS usuarios_unicos, count(*) AS total_interacciones, {ratio('count(*)', 'count(DISTINCT numero_entrada)', 2, 1)} AS promedio_por_usuario FROM x GROUP BY 1"
OK = "numero_entrada IS NOT NULL AND menu IS NOT NULL AND fecha IS NOT NULL"
USERS = "u AS (SELECT numero_entrada, count(*) AS v, count(DISTINCT id_8T) AS z, count(DISTINCT menu) AS m FROM c WHERE numero_entrada IS NOT NULL GROUP BY 1)"


def outliers(p: str, first: int | None = None) -> str:
    def one(name: str, col: str, factor: str) -> str:
        shown = "string_agg(numero_entrada, ',' ORDER BY numero_entrada)"
        shown = shown if first else f"left({shown}, 100)"
        return f"""SELECT '{name}' AS tipo_outlier, count(*) AS cantidad_outliers, min({col}) AS min_valor_outlier, max({col}) AS max_valor_outlier,
 (SELECT {shown} FROM (SELECT numero_entrada FROM u WHERE {col} > {p.format(c=col)} * {factor} ORDER BY 1 LIMIT {first or 101})) AS ejemplos_usuarios
 FROM u WHERE {col} > {p.format(c=col)} * {factor}"""
    return s(USERS, " UNION ALL ".join([one("usuarios_outliers_volumen", "v", "2"), one("usuarios_outliers_geograficos", "z", "1.5"), one("usuarios_outliers_diversidad", "m", "1.5")]))


def rules(src: str, names: tuple[str, str, str], items: list[tuple[str, str, str]], first: int | None = None) -> str:
    a, b, e = names
    parts = []
    for cond, name, value in items:
        shown = "string_agg(v, ',' ORDER BY v)" if first else "left(string_agg(v, ',' ORDER BY v), 100)"
        inner = f"(SELECT {shown} FROM (SELECT DISTINCT {value} AS v FROM {src} WHERE {cond} ORDER BY v LIMIT {first or 101}))"
        parts.append(f"SELECT '{name}' AS {a}, count(*) AS {b}, {inner} AS {e} FROM {src} WHERE {cond}")
    return " UNION ALL ".join(parts)


def odd(c: str, lo: int, ones: bool = False) -> str:
    return f"(strlen({c}) NOT BETWEEN {lo} AND 15 OR NOT regexp_matches({c}, '^[0-9]+$') OR regexp_matches({c}, '^0+$')" + (f" OR "
        f"regexp_matches({c}, '^1+$'))" if ones else ")")


def formats(lo: int, ones: bool, word: str, sample: str, first: int | None = None) -> str:
    return r(rules("crudas", ("problema", "casos_problematicos", sample), [
        (odd("numero_entrada", lo, ones), f"numero_entrada_formato_{word}", "numero_entrada"),
        (f"{full('numero_digitado')} AND {odd('numero_digitado', lo)}", f"numero_digitado_formato_{word}", "numero_digitado")], first))


SQL = {
    "c01_cardinality": s("SELECT trimestre AS tabla, count(*) AS total_registros, count(DISTINCT idRe) AS ids_unicos, count(DISTINCT "
        "numero_entrada) AS numeros_entrada_unicos, count(DISTINCT numero_digitado) AS numeros_digitado_unicos, count(DISTINCT menu) AS "
        "menus_diferentes, count(DISTINCT opcion) AS opciones_diferentes, count(DISTINCT id_CTransferencia) AS destinos_transferencia_unicos, "
        "count(DISTINCT id_8T) AS zonas_geograficas, count(DISTINCT division) AS divisiones, count(DISTINCT area) AS areas, count(DISTINCT "
        "cIdentifica) AS claves_cIdentifica, min(fecha) AS fecha_minima, max(fecha) AS fecha_maxima FROM c GROUP BY 1"),
    "c02_completeness": s(" UNION ALL ".join(f"SELECT '{f}' AS campo, {n(blank(f), 'nulos_vacios')}, count(*) AS total, {share(blank(f))} AS "
        f"porcentaje_nulos FROM c" for f in FIELDS)),
    "c02_field_domains": s(" UNION ALL ".join(f"SELECT '{f}' AS campo, count(DISTINCT {f}) AS valores_distintos, "
        f"{n(blank(f) if f == 'etiquetas' else f + ' IS NULL', 'valores_nulos')} FROM c" for f in ("etiquetas", "cIdentifica", "nidMQ"))),
    "c03_criticality": s("x AS (" + " UNION ALL ".join(f"SELECT '{f}' AS campo, trimestre AS tabla, {n(blank(f), 'registros_nulos')}, count(*) AS "
        f"total_registros FROM c GROUP BY 2" for f in CRIT) + ")",
        f"SELECT *, {ratio('registros_nulos', 'total_registros')} AS porcentaje_nulo, CASE WHEN registros_nulos * 100.0 / total_registros > 10 THEN "
        f"'CRITICO' WHEN registros_nulos * 100.0 / total_registros > 5 THEN 'ALTO' WHEN registros_nulos * 100.0 / total_registros > 1 THEN "
        f"'MODERADO' ELSE 'BAJO' END AS nivel_criticidad FROM x"),
    "c04_value_domains": s("t AS (SELECT count(*) AS t FROM c)", "f AS (" + " UNION ALL ".join(f"SELECT '{f}' AS tipo_campo, {f} AS valor, count(*) "
        f"AS frecuencia FROM c WHERE {full(f)} GROUP BY 2" for f in ("menu", "opcion", "division", "id_8T")) + ")",
        f"SELECT tipo_campo, valor, frecuencia, {ratio('frecuencia', 't')} AS porcentaje FROM f, t QUALIFY tipo_campo IN ('division', 'id_8T') OR "
        f"row_number() OVER (PARTITION BY tipo_campo ORDER BY frecuencia DESC, valor) <= 20"),
    "c05_division_areas": s(f"SELECT division, count(DISTINCT area) AS areas_por_division, {lst('area')} AS areas_listado FROM c WHERE division IS "
        f"NOT NULL AND area IS NOT NULL GROUP BY 1"),
    "c05_menu_options": s(f"SELECT menu, count(DISTINCT opcion) AS opciones_por_menu, count(*) AS total_usos, {lst('opcion')} AS "
        f"opciones_disponibles FROM c WHERE menu IS NOT NULL GROUP BY 1 ORDER BY total_usos DESC, menu LIMIT 15"),
    "c05_zone_locations": s("SELECT id_8T, count(DISTINCT division) AS divisiones_por_zona, count(DISTINCT area) AS areas_por_zona, "
        "string_agg(DISTINCT division || '-' || area, ',' ORDER BY division || '-' || area) AS ubicaciones FROM c WHERE id_8T IS NOT NULL AND "
        "division IS NOT NULL GROUP BY 1"),
    "c06_key_checks": r("""SELECT 'idRe_duplicados' AS analisis, trimestre, count(*) - count(DISTINCT idRe) AS n FROM crudas GROUP BY 2
UNION ALL SELECT 'idRe_entre_trimestres', 'Q01_24-Q02_24', count(*) FROM crudas a JOIN crudas b USING (idRe) WHERE a.trimestre = 'Q01_24' AND
 b.trimestre = 'Q02_24'
UNION ALL SELECT 'idRe_entre_trimestres', 'Q02_24-Q03_24', count(*) FROM crudas a JOIN crudas b USING (idRe) WHERE a.trimestre = 'Q02_24' AND
 b.trimestre = 'Q03_24'
UNION ALL SELECT 'numero_entrada_cardinalidad', trimestre, count(*) FILTER (WHERE d > 1) FROM (SELECT trimestre, numero_entrada, count(DISTINCT
 numero_digitado) AS d FROM crudas WHERE numero_entrada IS NOT NULL GROUP BY 1, 2) GROUP BY 2"""),
    "c07_repeated_ids": r("d AS (SELECT idRe, count(*) AS k, string_agg(DISTINCT trimestre, ',' ORDER BY trimestre) AS t FROM crudas GROUP BY 1 "
        "HAVING count(*) > 1)",
        "SELECT count(*) AS ids_duplicados_total, coalesce(sum(k), 0)::BIGINT AS registros_afectados, left(string_agg(idRe::VARCHAR, ',' ORDER BY k "
        "DESC, idRe), 100) AS ejemplos_ids_duplicados, string_agg(DISTINCT t, ';' ORDER BY t) AS combinaciones_trimestres FROM d"),
    "c08_daily_distribution": s("SELECT fecha, count(*) AS registros_por_dia, count(DISTINCT numero_entrada) AS usuarios_unicos_dia, "
        "min(hora_inicio_seg) AS primera_hora, max(hora_fin_seg) AS ultima_hora, count(DISTINCT menu) AS menus_activos_dia FROM c GROUP BY 1"),
    "c09_time_inconsistencies": r(f"SELECT 'timestamps_invertidos' AS problema, {n('invertido', 'casos')}, {share('invertido')} AS porcentaje FROM "
        f"crudas UNION ALL SELECT 'fecha_vs_fecha_inserta', {n('dia <> insertado', 'casos')}, {share('dia <> insertado')} FROM crudas"),
    "c10_reference_prefixes": s(f"SELECT 'cIdentifica_patron' AS analisis, left(cIdentifica, 10) AS patron_inicio, count(*) AS frecuencia, "
        f"count(DISTINCT numero_entrada) AS usuarios_con_patron FROM c WHERE {full('cIdentifica')} GROUP BY 2 ORDER BY frecuencia DESC, "
        f"patron_inicio LIMIT 10"),
    "c10_queue_vs_dialled": s(f"SELECT 'nidMQ_vs_numero_digitado' AS analisis, count(*) AS total_registros, {n(full('nidMQ'), 'con_nidMQ')}, "
        f"{n(full('numero_digitado'), 'con_numero_digitado')}, "
        f"{n('nidMQ IS NOT NULL AND numero_digitado IS NOT NULL AND contains(nidMQ, numero_digitado)', 'nidMQ_contiene_numero_digitado')} FROM c"),
    "c11_integral_quality": s(f"SELECT count(*) AS total_registros, {n('numero_entrada IS NULL', 'sin_numero_entrada')}, "
        f"{n('menu IS NULL', 'sin_menu')}, {n('inv', 'timestamps_invertidos')}, "
        f"{n('numero_digitado IS NULL AND nidMQ IS NOT NULL', 'inconsistencia_digitado_nidMQ')}, "
        f"{n('division IS NULL AND area IS NOT NULL', 'area_sin_division')}, {n(full('cIdentifica'), 'con_referencias_externas')}, "
        f"{ratio('count(*) - count(*) FILTER (WHERE inv) - count(*) FILTER (WHERE numero_entrada IS NULL) - count(*) FILTER (WHERE menu IS NULL)', 'count(*)')} AS score_calidad_pct FROM c"),
    "c12_inverted_times": s(f"SELECT trimestre AS tabla, count(*) AS total_registros, {n('inv', 'timestamps_invertidos')}, {share('inv')} AS "
        f"porcentaje_invertidos, left({lst('CASE WHEN inv THEN menu END')}, 100) AS menus_mas_afectados FROM c GROUP BY 1"),
    "c13_base_dates": r("SELECT 'Análisis_timestamps' AS analisis, count(*) AS total_registros, count(DISTINCT base_inicio) AS "
        "fechas_diferentes_hora_inicio, 1::BIGINT AS fechas_diferentes_hora_fin, count(*) FILTER (WHERE base_inicio = '01/01/1900') AS "
        "usa_fecha_base_inicio, count(*) AS usa_fecha_base_fin, left(string_agg(DISTINCT CASE WHEN base_inicio <> '01/01/1900' THEN hora_inicio "
        "END, ',' ORDER BY CASE WHEN base_inicio <> '01/01/1900' THEN hora_inicio END), 100) AS ejemplos_fechas_anomalas FROM crudas"),
    "c14_label_consistency": s(f"x AS (SELECT menu, opcion, count(*) AS frecuencia, count(DISTINCT etiquetas) AS variaciones_etiquetas, "
        f"{n(NOTREF, 'casos_opcion_no_reflejada')}, {n(NOVSI, 'casos_res_sin_vsi')}, {n(COMPLEX, 'casos_comercial_con_etiquetas_complejas')}, "
        f"left({lst('etiquetas', '|')}, 100) AS muestra_patrones FROM c WHERE menu IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5), y AS (SELECT *, "
        f"casos_opcion_no_reflejada + casos_res_sin_vsi + casos_comercial_con_etiquetas_complejas AS o FROM x)",
        "SELECT * EXCLUDE (o), CASE WHEN o * 10 > frecuencia * 3 THEN 'ALTA_INCONSISTENCIA' WHEN o * 10 > frecuencia THEN 'INCONSISTENCIA_MODERADA' "
        "ELSE 'CONSISTENTE' END AS nivel_consistencia FROM y"),
    "c15_outside_calendar": r("SELECT concat(per.trimestre, '_fuera_rango') AS problema, count(x.fecha) AS registros_erroneos, min(x.fecha) AS "
        "fecha_minima_erronea, max(x.fecha) AS fecha_maxima_erronea FROM per LEFT JOIN crudas x ON x.trimestre = per.trimestre AND x.dia NOT "
        "BETWEEN per.inicio AND per.fin GROUP BY 1"),
    "c16_malformed_references": r("x AS (" + rules("crudas", ("tipo_problema", "casos", "ejemplos"), [
        (f"{full('cIdentifica')} AND (strlen(cIdentifica) < 10 OR NOT regexp_matches(cIdentifica, "
        f"'^[0-9]+$'))", "cIdentifica_patron_anomalo", "cIdentifica"),
        (f"{full('nidMQ')} AND {blank('numero_digitado')}", "nidMQ_sin_numero_digitado", "nidMQ"),
        (f"{full('id_CTransferencia')} AND NOT regexp_matches(id_CTransferencia, "
        f"'^[0-9]+$')", "id_CTransferencia_invalido", "id_CTransferencia")]) + ")",
        "SELECT *, CASE tipo_problema WHEN 'cIdentifica_patron_anomalo' THEN 'Valores que no siguen patrón esperado' WHEN "
        "'nidMQ_sin_numero_digitado' THEN 'nidMQ poblado pero numero_digitado nulo' ELSE 'Valores de transferencia que no siguen patrón esperado' "
        "END AS descripcion FROM x"),
    "c17_number_formats": formats(4, True, "sospechoso", "ejemplos_sospechosos"),
    "c17_invalid_numbers": formats(7, False, "invalido", "ejemplos_invalidos", 10),
    "c18_invalid_dates": r("""x AS (SELECT trimestre AS tabla, fecha FROM crudas WHERE dia IS NULL OR dia < DATE '2020-01-01' OR dia > DATE
 '2030-12-31')""",
        """SELECT 'fechas_invalidas' AS problema, tabla, count(*) AS casos_problematicos,
 array_to_string(list_sort(list_distinct(list(fecha)))[:10], ',') AS ejemplos_fechas_problematicas FROM x GROUP BY 2"""),
    "c18_date_validation": r("x AS (SELECT trimestre AS tabla, fecha, CASE WHEN dia IS NULL THEN 'fechas_no_convertibles' WHEN dia < DATE "
        "'2020-01-01' OR dia > DATE '2030-12-31' THEN 'fechas_fuera_rango' END AS problema FROM crudas)",
        f"SELECT problema, tabla, count(*) AS casos_problematicos, left({lst('fecha')}, 100) AS ejemplos_fechas_problematicas FROM x WHERE problema "
        f"IS NOT NULL GROUP BY 1, 2"),
    "c19_user_outliers": outliers("(SELECT list({c} ORDER BY {c})[least(count(*) - 1, count(*) * 95 // 100)::INT + 1] FROM u)"),
    "c19_user_outliers_interpolated": outliers("(SELECT quantile_cont({c}, 0.95) FROM u)", 10),
    "c20_quality_scores": r(f"x AS (SELECT trimestre AS tabla, count(*) AS total_registros, {n('invertido', 'timestamps_invertidos')}, "
        f"{n('numero_entrada IS NULL OR menu IS NULL', 'campos_criticos_nulos')}, {n('dia IS NULL', 'fechas_invalidas')} FROM crudas GROUP BY 1), y "
        f"AS (SELECT *, {ratio('total_registros * 10 - timestamps_invertidos * 3 - campos_criticos_nulos * 4 - fechas_invalidas * 3', 'total_registros * 10')} AS score_calidad, total_registros - timestamps_invertidos - campos_criticos_nulos - fechas_invalidas AS registros_limpios FROM x)",
        f"SELECT *, {ratio('registros_limpios', 'total_registros')} AS porcentaje_utilizable, CASE WHEN score_calidad >= 90 THEN 'EXCELENTE' WHEN "
        f"score_calidad >= 75 THEN 'BUENA' WHEN score_calidad >= 60 THEN 'REGULAR' WHEN score_calidad >= 40 THEN 'MALA' ELSE 'CRITICA' END AS "
        f"clasificacion_calidad FROM y"),
    "c21_cleaning_impact": s(SCEN.format(ok=OK + " AND NOT inv"), SCEN_OUT),
    "c21_cleaning_impact_any_time": s(SCEN.format(ok=OK), SCEN_OUT),
    "c22_clean_calls": r(f"""SELECT idRe, numero_entrada, numero_digitado, menu, opcion, id_CTransferencia, dia AS fecha, division, area, least(ini,
 fin) AS hora_inicio_corregida, greatest(ini, fin) AS hora_fin_corregida,
 format('{{}} {{:02d}}:{{:02d}}:{{:02d}}', dia::VARCHAR, least(ini, fin) // 3600, least(ini, fin) // 60 % 60, least(ini, fin) % 60) AS
 timestamp_inicio_completo, id_8T, etiquetas, cIdentifica, nidMQ, CASE WHEN invertido THEN 'CORREGIDO' ELSE 'ORIGINAL' END AS flag_timestamp,
 CASE WHEN {blank('etiquetas')} THEN 'SIN_ETIQUETAS' ELSE 'CON_ETIQUETAS' END AS flag_procesamiento, trimestre AS trimestre_origen FROM crudas WHERE
 {full('numero_entrada')} AND {full('menu')} AND dia IS NOT NULL"""),
    "c23_problem_records": r(f"""x AS (SELECT *, list_filter([CASE WHEN invertido THEN 'TIMESTAMP_INVERTIDO' END, CASE WHEN {blank('numero_entrada')}
 THEN 'SIN_NUMERO_ENTRADA' END, CASE WHEN {blank('menu')} THEN 'SIN_MENU' END, CASE WHEN dia IS NULL THEN 'FECHA_INVALIDA' END,
 CASE WHEN strlen(numero_entrada) NOT BETWEEN 4 AND 15 THEN 'NUMERO_SOSPECHOSO' END, CASE WHEN {full('numero_digitado')} AND strlen(numero_digitado)
 NOT BETWEEN 4 AND 15 THEN 'DIGITADO_SOSPECHOSO' END], lambda z: z IS NOT NULL) AS p,
 CASE WHEN invertido OR numero_entrada IS NULL OR menu IS NULL THEN 1 WHEN dia IS NULL THEN 2 WHEN strlen(numero_entrada) < 4 THEN 3 ELSE 4 END AS o
 FROM crudas)""",
        "SELECT idRe, numero_entrada, numero_digitado, menu, dia AS fecha, ini AS hora_inicio_seg, fin AS hora_fin_seg, array_to_string(p, ',') AS "
        "problemas_detectados, CASE o WHEN 1 THEN 'CRITICO' WHEN 2 THEN 'ALTO' WHEN 3 THEN 'MEDIO' ELSE 'BAJO' END AS severidad FROM x WHERE len(p) "
        "> 0 ORDER BY o, idRe, trimestre, ini, x.fin LIMIT 100"),
    "c24_quality_dashboard": r(f"x AS (SELECT count(*) AS n, count(*) - count(*) FILTER (WHERE invertido) - count(*) FILTER (WHERE numero_entrada "
        f"IS NULL OR menu IS NULL) - count(*) FILTER (WHERE dia IS NULL) AS k FROM crudas)",
        f"SELECT DATE '2024-01-31' AS fecha_revision, 'RESUMEN_GENERAL' AS tipo_metrica, n AS total_registros_sistema, k AS "
        f"total_registros_limpios, {ratio('k', 'n')} AS porcentaje_calidad_global, CASE WHEN k * 100 >= n * 90 THEN 'SISTEMA_SALUDABLE' WHEN k * "
        f"100 >= n * 75 THEN 'REQUIERE_ATENCION' ELSE 'ESTADO_CRITICO' END AS estado_sistema FROM x"),
    "c25_sample_rows": s("SELECT idRe, numero_entrada, numero_digitado, menu, opcion, etiquetas, fecha, hora_inicio_seg, hora_fin_seg, division, "
        "area, id_8T, cIdentifica, nidMQ FROM c ORDER BY idRe LIMIT 20"),
    "c25_number_bounds": s("SELECT min(numero_entrada) AS min_numero_entrada, max(numero_entrada) AS max_numero_entrada, min(numero_digitado) AS "
        "min_numero_digitado, max(numero_digitado) AS max_numero_digitado, count(DISTINCT menu) AS menus_distintos, count(DISTINCT opcion) AS "
        "opciones_distintas FROM c"),
    "c26_quarter_quality": s(f"SELECT trimestre, count(*) AS total_registros, {n(blank('menu'), 'menu_faltante')}, "
        f"{n(blank('opcion'), 'opcion_faltante')}, {n(blank('etiquetas'), 'etiquetas_faltantes')}, "
        f"{n('''etiquetas LIKE '%,,' ''', 'etiquetas_doble_coma')}, {n('''etiquetas LIKE '%,' ''', 'etiquetas_coma_final')}, "
        f"{n('numero_entrada = numero_digitado', 'sin_transferencia')}, "
        f"{n('numero_entrada <> coalesce(numero_digitado, numero_entrada)', 'con_transferencia')}, "
        f"{ratio('count(*) * 10 - count(*) FILTER (WHERE ' + blank('menu') + ') * 2 - count(*) FILTER (WHERE ' + blank('etiquetas') + ''') * 3 - count(*) FILTER (WHERE etiquetas LIKE '%,')''', 'count(*) * 10')} AS score_calidad FROM c GROUP BY 1"),
}
SQL["c07_repeated_ids_first_ten"] = SQL["c07_repeated_ids"].replace(
    "left(string_agg(idRe::VARCHAR, ',' ORDER BY k DESC, idRe), 100)", "(SELECT string_agg(idRe::VARCHAR, ',' ORDER BY k DESC, idRe) FROM (FROM d "
        "ORDER BY k DESC, idRe LIMIT 10))")
SQL["c12_inverted_times_first_ten"] = SQL["c12_inverted_times"].replace(
    f"left({lst('CASE WHEN inv THEN menu END')}, 100)", "array_to_string(list_sort(list_distinct(list(menu) FILTER (WHERE inv AND menu IS NOT "
        "NULL)))[:10], ',')")
_OTHER = "CASE WHEN base_inicio <> '01/01/1900' THEN hora_inicio END"
SQL["c13_base_dates_first_three"] = SQL["c13_base_dates"].replace(
    f"left(string_agg(DISTINCT {_OTHER}, ',' ORDER BY {_OTHER}), 100)",
    "array_to_string(list_sort(list_distinct(list(hora_inicio) FILTER (WHERE base_inicio <> '01/01/1900')))[:3], ',')")
# The quarterly tables hold the rows of the raw log, so reading them as one gives the figures of the whole.
SQL["p02_scores_of_quarterly_tables"] = SQL["c20_quality_scores"]
SQL["p03_ids_of_quarterly_tables"] = SQL["c07_repeated_ids"]
