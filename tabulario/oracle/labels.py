"""Oracle statements of the menu, option and label reports."""

from tabulario.oracle.base import LLAMADAS, LOG_PERIODS, mean, mean_share, q, ratio, share
from tabulario.oracle.calls import C, blank, full, lst

MOV = "numero_entrada <> coalesce(numero_digitado, '')"
DIF = "numero_entrada <> numero_digitado"
LAB, NOL = full("etiquetas"), blank("etiquetas")
DUR = "(hora_fin_seg - hora_inicio_seg)"
USR = "count(DISTINCT numero_entrada)"
BAD = "menu IN ('cte_colgo', 'SinOpcion_Cbc')"
REF = "(etiquetas LIKE '%' || opcion || '%')"
NK = "menu NULLS FIRST, opcion NULLS FIRST"
LBL = """lb AS (SELECT * FROM (SELECT idRe, numero_entrada, menu, opcion, fecha, trim(unnest(string_split(rtrim(trim(etiquetas), ','), ','))) AS
 etiqueta_individual,
 unnest(range(1, len(string_split(rtrim(trim(etiquetas), ','), ',')) + 1))::INT AS posicion_etiqueta FROM c WHERE etiquetas <> '') WHERE
 etiqueta_individual <> '')"""


def s(*parts: str) -> str:
    return q(LLAMADAS, LOG_PERIODS, C, *parts)


def n(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) AS {name}"


def has(x: str) -> str:
    return f"coalesce(contains(etiquetas, '{x}'), false)"


def first_k(src: str, cond: str, value: str, k: int, sep: str = ",") -> str:
    """Correlated list of the first k distinct values."""
    return f"(SELECT string_agg(v, '{sep}' ORDER BY v) FROM (SELECT DISTINCT {value} AS v FROM {src} z WHERE {cond} AND {value} IS NOT NULL ORDER BY v LIMIT {k}))"


SAME = "z.menu IS NOT DISTINCT FROM g.menu AND z.opcion IS NOT DISTINCT FROM g.opcion"


def dominant(menu: str, option: str, name: str) -> str:
    return f"dp AS (SELECT {menu} AS menu, {option} AS opcion, rtrim(trim(etiquetas), ',') AS p, count(*) AS k FROM c WHERE etiquetas <> '' GROUP BY 1, 2, 3), dom AS (SELECT menu, opcion, first(p ORDER BY k DESC, p) AS {name} FROM dp GROUP BY 1, 2)"


ANOM = [(f"{blank('menu')} AND {full('opcion')}", "MENU_NULL_CON_OPCION"), (f"menu LIKE 'RES-%' AND {LAB} AND etiquetas NOT LIKE "
        f"'%VSI%'", "RES_SIN_VSI"),
        (f"opcion = '2L' AND {LAB} AND etiquetas NOT LIKE '%2L%'", "OPCION_2L_NO_REFLEJADA"), ("etiquetas LIKE '%,'", "ETIQUETAS_FORMATO_INCORRECTO")]
CODES = {"MIGRAFTTH": "MIGRACION_FIBRA", "PSB_FLL_DSLAM": "DSLAM_PROCESS", "FM_CFE": "FALLA_CFE", "BDEMANDA": "BAJO_DEMANDA", "TELECOB": "TELECOBRANZA", "QJA_": "PROCESO_QUEJA"}
CODES_TEST = {"TELCO": "TELECOM", "SOMC": "FUERA_MEXICO", "QJA_": "PROCESO_QUEJA"}


def codes(table: dict[str, str]) -> str:
    return s(" UNION ALL ".join(f"SELECT '{name}' AS tipo_codigo, count(*) AS casos, {USR} AS usuarios_afectados, "
        f"{first_k('c', 'z.etiquetas LIKE ' + chr(39) + '%' + part + '%' + chr(39), 'z.menu', 3)} AS menus_asociados FROM c WHERE etiquetas LIKE "
        f"'%{part}%'" for part, name in table.items()))


V1 = f"CASE WHEN {NOL} THEN 'SIN_ETIQUETAS' WHEN {has('VSI')} AND {has('ZMB')} THEN 'VALIDADO_COMPLETO' WHEN {has('NOBOT')} THEN 'INTERACCION_HUMANA' WHEN {has('NoTmx_SOMC')} THEN 'ERROR_SISTEMA' WHEN {has('VSI')} THEN 'VALIDADO_PARCIAL' WHEN {has('ZMB')} THEN 'SISTEMA_BASE' ELSE 'OTROS_ESTADOS' END"
V2 = f"CASE WHEN {has('VSI')} THEN 'CON_VSI' WHEN {has('NOBOT')} THEN 'INTERACCION_HUMANA' WHEN {has('ZMB')} THEN 'ZONA_BASE' WHEN {NOL} THEN 'SIN_ETIQUETAS' ELSE 'OTROS' END"
V3 = f"CASE WHEN {has('1L')} THEN '1L_PRIMER_NIVEL' WHEN {has('2L')} THEN '2L_SEGUNDO_NIVEL' WHEN {has('ML')} THEN 'ML_MULTI_NIVEL' ELSE 'SIN_NIVEL_DEFINIDO' END"
SERVED = "coalesce(menu NOT IN ('cte_colgo', 'SinOpcion_Cbc'), false)"
VAL = f"({has('VSI')} OR {has('ZMB')})"

SQL = {
    "l01_exploded_labels": s(LBL, "SELECT * FROM lb"),
    "l02_label_frequency": s(LBL, f"""SELECT etiqueta_individual AS etiqueta, count(*) AS frecuencia,
 {ratio('count(*)', '(SELECT count(etiquetas) FROM c)')} AS porcentaje, CASE WHEN etiqueta_individual LIKE '%VSI%' THEN 'Validación/Verificación'
 WHEN etiqueta_individual LIKE '%ZMB%' THEN 'Zona/Región' WHEN etiqueta_individual LIKE '%TELCO%' THEN 'Telecomunicaciones'
 WHEN etiqueta_individual LIKE '%WTS%' THEN 'Sistema Técnico' WHEN etiqueta_individual LIKE '%2L%' OR etiqueta_individual LIKE '%1L%' THEN
 'Línea/Nivel' WHEN etiqueta_individual LIKE '%NOBOT%' THEN 'Sin Robot/Manual' ELSE 'Otra categoría' END AS categoria_inferida FROM lb GROUP BY 1
 ORDER BY frecuencia DESC, etiqueta LIMIT 20"""),
    "l02_label_functions": s(LBL, f"""SELECT etiqueta_individual AS etiqueta, count(*) AS frecuencia,
 {ratio('count(*)', '(SELECT count(*) FROM lb)')} AS porcentaje, CASE WHEN etiqueta_individual = 'ZMB' THEN 'ZONA_METROPOLITANA' WHEN
 etiqueta_individual IN ('VSI', 'DG', 'WTS') THEN 'VALIDACION_TECNICA' WHEN etiqueta_individual IN ('2L', '1L', 'ML') THEN 'TIPO_LINEA'
 WHEN etiqueta_individual LIKE 'RES_%' OR etiqueta_individual LIKE 'TELCO%' THEN 'RESULTADO_OPERACION' WHEN etiqueta_individual LIKE 'SEG_%' OR
 etiqueta_individual LIKE 'PR_%' THEN 'SEGMENTO_CLIENTE' WHEN etiqueta_individual LIKE 'IN25%' OR etiqueta_individual LIKE 'VALS%' THEN
 'IDENTIFICADOR_SISTEMA'
 WHEN etiqueta_individual = 'NOBOT' THEN 'SIN_ROBOT' WHEN etiqueta_individual LIKE '%_MA%' OR etiqueta_individual LIKE '%_AB_%' THEN 'CODIGO_PROCESO'
 ELSE 'OTRO_CODIGO' END AS categoria_funcional FROM lb GROUP BY 1 ORDER BY frecuencia DESC, etiqueta LIMIT 25"""),
    "l03_label_indicators": s("SELECT idRe, numero_entrada, menu, opcion, fecha, etiquetas, " + ", ".join(f"{has(x)}::INT AS "
        f"tiene_{x}" for x in ("ZMB", "VSI", "2L", "1L", "WTS", "TELCO", "MGC", "NOBOT", "DEFAULT")) + " FROM c"),
    "l04_menu_usage": s(f"SELECT menu, count(*) AS total_usos, {USR} AS usuarios_unicos, {ratio('count(*)', USR, 2, 1)} AS promedio_por_usuario, "
        f"count(DISTINCT fecha) AS dias_activos, {ratio('count(*)', '(SELECT count(*) FROM c)')} AS porcentaje_total FROM c WHERE menu IS NOT NULL "
        f"GROUP BY 1 ORDER BY total_usos DESC, menu LIMIT 15"),
    "l04_menu_abandonment": s(f"SELECT menu, count(*) AS total, {n(NOL, 'sin_etiquetas')}, {share(NOL)} AS tasa_abandono FROM c WHERE menu IS NOT "
        f"NULL GROUP BY 1 HAVING count(*) >= 10"),
    "l05_option_usage": s(f"g AS (SELECT opcion, count(*) AS frecuencia, count(DISTINCT menu) AS menus_diferentes FROM c WHERE {full('opcion')} "
        f"GROUP BY 1)", f"SELECT *, {first_k('c', 'z.opcion = g.opcion', 'z.menu', 10)} AS menus_asociados FROM g"),
    "l05_option_transfers": s(f"SELECT opcion, count(*) AS total, {n(MOV, 'transferencias')}, {share(MOV)} AS tasa_transferencia FROM c WHERE "
        f"opcion IS NOT NULL GROUP BY 1 HAVING count(*) >= 5"),
    "l06_combination_success": s(f"SELECT menu, opcion, count(*) AS frecuencia, {n(LAB, 'con_etiquetas')}, {share(LAB)} AS tasa_completitud, "
        f"{n(MOV, 'transferencias')}, {share(MOV)} AS tasa_transferencia, avg({DUR}) AS segundos_promedio FROM c WHERE menu IS NOT NULL AND opcion "
        f"IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY frecuencia DESC, {NK} LIMIT 20"),
    "l07_menu_label_patterns": s(f"""SELECT menu, count(*) AS total_usos, count(DISTINCT etiquetas) AS patrones_diferentes,
 left({lst('etiquetas', ' | ')}, 200) AS patrones_etiquetas, CASE WHEN menu LIKE 'RES-%' AND count(*) FILTER (WHERE {has('VSI')}) * 10 > count(*) * 7
 THEN 'CONSISTENTE_RES'
 WHEN menu LIKE 'comercial_%' AND count(*) FILTER (WHERE {NOL}) * 10 > count(*) * 8 THEN 'CONSISTENTE_COMERCIAL' WHEN count(DISTINCT etiquetas) = 1
 THEN 'PATRON_UNICO' WHEN count(DISTINCT etiquetas) * 10 > count(*) * 8 THEN 'ALTAMENTE_VARIABLE' ELSE 'PATRON_MODERADO' END AS tipo_patron FROM c
 WHERE menu IS NOT NULL GROUP BY 1 HAVING count(*) >= 10"""),
    "l08_option_reflection": s(f"g AS (SELECT opcion, count(*) AS total, {n(REF, 'opcion_en_etiquetas')} FROM c WHERE {full('opcion')} GROUP BY 1 "
        f"HAVING count(*) >= 5)", f"""SELECT *, {ratio('opcion_en_etiquetas', 'total')} AS porcentaje_reflejo,
 {first_k('c', 'z.opcion = g.opcion', 'left(z.etiquetas, 50)', 5)} AS ejemplos_etiquetas,
 CASE WHEN opcion IN ('DEFAULT', '1', '2', '21') AND opcion_en_etiquetas * 10 < total THEN 'OPCION_GENERICA' WHEN opcion_en_etiquetas * 10 > total *
 7 THEN 'ALTA_CONSISTENCIA' WHEN opcion_en_etiquetas * 10 > total * 3 THEN 'CONSISTENCIA_MEDIA' ELSE 'BAJA_CONSISTENCIA' END AS nivel_consistencia
 FROM g"""),
    "l09_menu_option_flow": s(f"""g AS (SELECT menu, menu || ' → ' || coalesce(opcion, 'SIN_OPCION') AS flujo, count(*) AS frecuencia, count(DISTINCT
 etiquetas) AS variabilidad_etiquetas, avg(len(string_split(etiquetas, ','))) AS promedio_etiquetas_por_interaccion,
 {n(MOV, 'transferencias_exitosas')}, {n(has('VSI'), 'con_validacion')}, {n(NOL, 'sin_procesamiento')}, {n(LAB, 'done')},
 {share(LAB)} AS tasa_completitud, {share(MOV)} AS tasa_transferencia FROM c WHERE menu IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10),
k AS (SELECT *, CASE WHEN done * 10 > frecuencia * 9 AND transferencias_exitosas * 10 > frecuencia * 3 THEN 'FLUJO_OPTIMO' WHEN sin_procesamiento * 2
 > frecuencia THEN 'FLUJO_PROBLEMATICO' WHEN menu LIKE '%cte_colgo%' OR menu LIKE '%SinOpcion%' THEN 'FLUJO_ABANDONO' ELSE 'FLUJO_NORMAL' END AS
 clasificacion_flujo FROM g)""",
        "SELECT * EXCLUDE (menu, done) FROM k ORDER BY list_position(['FLUJO_OPTIMO', 'FLUJO_NORMAL', 'FLUJO_PROBLEMATICO', 'FLUJO_ABANDONO'], "
        "clasificacion_flujo), frecuencia DESC, flujo LIMIT 25"),
    "l10_rule_violations": s(f"""v AS (SELECT 'REGLA_VIOLADA' AS tipo_anomalia, 'RES sin VSI' AS descripcion, menu, opcion, etiquetas FROM c WHERE
 menu LIKE 'RES-%' AND etiquetas NOT LIKE '%VSI%'
 UNION ALL SELECT 'OPCION_NO_REFLEJADA', 'Opción no aparece en etiquetas', menu, opcion, etiquetas FROM c WHERE opcion NOT IN ('DEFAULT', '1', '21',
 '2') AND strlen(opcion) > 2 AND (etiquetas IS NULL OR NOT {REF})
 UNION ALL SELECT 'COMERCIAL_CON_ETIQUETAS_COMPLEJAS', 'Menu comercial con etiquetas inesperadas', menu, opcion, etiquetas FROM c WHERE menu LIKE
 'comercial_%' AND strlen(etiquetas) > 10 AND etiquetas NOT LIKE '%DEFAULT%')""",
        f"SELECT *, count(*) AS frecuencia_anomalia FROM v GROUP BY ALL ORDER BY frecuencia_anomalia DESC, tipo_anomalia, descripcion, {NK}, "
        f"etiquetas NULLS FIRST LIMIT 20"),
    "l10_rule_violation_counts": s(" UNION ALL ".join(f"SELECT '{name}' AS tipo_anomalia, count(*) AS casos_anomalos, "
        f"{first_k('c', cond, 'z.menu || chr(58) || z.opcion', 5)} AS ejemplos FROM c WHERE {cond}" for cond, name in [
        ("menu LIKE 'RES-%' AND (etiquetas IS NULL OR etiquetas NOT LIKE '%VSI%')", "MENU_RES_SIN_VSI"),
        (f"{full('opcion')} AND opcion NOT IN ('DEFAULT', '21', '1', '5', '11') AND (etiquetas IS NULL OR NOT "
        f"{REF})", "OPCION_NO_REFLEJADA_EN_ETIQUETAS"),
        (f"menu LIKE 'comercial_%' AND {LAB} AND strlen(etiquetas) > 10", "COMERCIAL_CON_ETIQUETAS_COMPLEJAS")])),
    "l11_pattern_evolution": s(f"SELECT trimestre, count(DISTINCT menu || '|' || coalesce(opcion, 'NULL')) AS combinaciones_menu_opcion, "
        f"count(DISTINCT etiquetas) AS patrones_etiquetas_unicos, "
        f"{n('menu LIKE ' + chr(39) + 'RES-%' + chr(39) + ' AND ' + has('VSI'), 'res_con_vsi')}, "
        f"{n('menu LIKE ' + chr(39) + 'RES-%' + chr(39), 'total_res')}, "
        f"{ratio('count(*) FILTER (WHERE menu LIKE ' + chr(39) + 'RES-%' + chr(39) + ' AND ' + has('VSI') + ')', 'count(*) FILTER (WHERE menu LIKE ' + chr(39) + 'RES-%' + chr(39) + ')')} AS consistencia_res_vsi, count(DISTINCT menu || ':' || etiquetas) AS patrones_completos FROM c WHERE menu IS NOT NULL GROUP BY 1"),
    "l12_menu_dashboard": s(f"""g AS (SELECT menu, count(*) AS volumen_total, {USR} AS usuarios_alcanzados, {ratio('count(*)', USR, 2, 1)} AS
 interacciones_por_usuario, {share(LAB)} AS tasa_procesamiento, {share(MOV)} AS tasa_transferencia, CASE WHEN count(*) FILTER (WHERE {LAB}) * 100 >=
 count(*) * 90 AND count(*) >= 100 THEN 'ALTO_RENDIMIENTO'
 WHEN count(*) FILTER (WHERE {NOL}) * 2 >= count(*) THEN 'RENDIMIENTO_CRITICO' ELSE 'RENDIMIENTO_MEDIO' END AS categoria_rendimiento FROM c WHERE
 menu IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)""",
        "SELECT *, (SELECT string_agg(o, ',' ORDER BY k DESC, o) FROM (SELECT opcion AS o, count(*) AS k FROM c z WHERE z.menu = g.menu AND opcion "
        "IS NOT NULL GROUP BY 1 ORDER BY k DESC, o LIMIT 3)) AS top_opciones FROM g"),
    "l13_combination_search": s(f"SELECT menu, opcion, etiquetas, count(*) AS frecuencia, {ratio('count(*)', '(SELECT count(*) FROM c)')} AS "
        f"porcentaje FROM c WHERE etiquetas LIKE '%ZMB%' GROUP BY 1, 2, 3 ORDER BY frecuencia DESC, {NK}, etiquetas LIMIT 20"),
    "l14_menu_classes": s(f"""SELECT CASE WHEN {blank('menu')} THEN 'MENU_FALTANTE' WHEN menu LIKE 'RES-%' THEN 'TIPO_RES' WHEN menu LIKE
 'comercial_%' THEN 'TIPO_COMERCIAL' WHEN {BAD} THEN 'ABANDONO_SISTEMA' WHEN menu = 'Numero tel' THEN 'CAPTURA_NUMERO' WHEN menu LIKE '%Desborde%'
 THEN 'DESBORDE' WHEN menu LIKE 'NOTMX-%' THEN 'NO_MEXICO' WHEN menu = 'SDO' THEN 'SALDO'
 WHEN menu LIKE 'PG_%' OR menu LIKE 'ZMB' THEN 'CODIGOS_ESPECIALES' ELSE 'OTROS_MENUS' END AS categoria_menu, count(*) AS total_registros, {USR} AS
 usuarios_unicos, {n(NOL, 'sin_etiquetas')}, {share(NOL)} AS porcentaje_sin_etiquetas, {n(DIF, 'con_transferencias')}, {share(DIF)} AS
 tasa_transferencia, left({lst('menu', ', ')}, 100) AS ejemplos_menus FROM c GROUP BY 1"""),
    "l15_option_types": s(f"""SELECT CASE WHEN {blank('opcion')} THEN 'OPCION_FALTANTE' WHEN opcion = 'DEFAULT' THEN 'DEFAULT' WHEN opcion IN ('1',
 '2', '5', '11', '21') THEN 'OPCION_NUMERICA' WHEN opcion IN ('2L', '1L', 'ML') THEN 'TIPO_LINEA' WHEN strlen(opcion) > 5 THEN 'OPCION_COMPLEJA' ELSE
 'OPCION_ESPECIFICA' END AS tipo_opcion,
 count(*) AS frecuencia, count(DISTINCT menu) AS menus_asociados, {n(LAB, 'con_resultado')}, {share(LAB)} AS tasa_efectividad,
 left({lst('opcion', ', ')}, 100) AS valores_opcion_reales FROM c GROUP BY 1"""),
    "l16_combination_profile": s(dominant("menu", "coalesce(opcion, "
        "'SIN_OPCION')", "patron_etiquetas_principal"), f"""g AS (SELECT menu, coalesce(opcion, 'SIN_OPCION') AS opcion, count(*) AS frecuencia,
 {n(NOL, 'registros_incompletos')}, {share(LAB)} AS tasa_completitud, {n(DIF, 'transferencias')}, {share(DIF)} AS tasa_transferencia FROM c WHERE
 menu IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY count(*) DESC, 1, 2 LIMIT 30)""",
        "SELECT g.*, patron_etiquetas_principal, CASE WHEN registros_incompletos * 100 > frecuencia * 70 THEN 'PROBLEMATICA' WHEN transferencias * "
        "100 > frecuencia * 50 THEN 'ALTA_TRANSFERENCIA' WHEN frecuencia < 5 THEN 'BAJA_FRECUENCIA' ELSE 'NORMAL' END AS clasificacion FROM g LEFT "
        "JOIN dom USING (menu, opcion)"),
    "l17_rule_compliance": s(f"g AS (SELECT CASE WHEN menu LIKE 'RES-%' THEN 'TIPO_RES' WHEN menu LIKE '%Desborde%' THEN 'DESBORDE' WHEN menu LIKE "
        f"'comercial_%' THEN 'COMERCIAL' WHEN {BAD} THEN 'ABANDONO' ELSE 'OTROS' END AS menu_categoria, count(*) AS total_casos, "
        f"{n(has('VSI'), 'casos_con_vsi')}, {n(has('ZMB'), 'casos_con_zmb')}, {n(NOL, 'casos_sin_etiquetas')} FROM c WHERE menu IS NOT NULL GROUP "
        f"BY 1)", f"""
SELECT *, {ratio('casos_con_vsi', 'total_casos')} AS porcentaje_vsi, {ratio('casos_con_zmb', 'total_casos')} AS porcentaje_zmb,
 {ratio('casos_sin_etiquetas', 'total_casos')} AS porcentaje_vacios, CASE WHEN menu_categoria = 'TIPO_RES' AND casos_con_vsi * 100 < total_casos * 30
 THEN 'REGLA_VSI_INCUMPLIDA'
 WHEN menu_categoria = 'DESBORDE' AND casos_con_zmb * 100 < total_casos * 50 THEN 'REGLA_ZMB_INCUMPLIDA' WHEN casos_sin_etiquetas * 100 > total_casos
 * 60 THEN 'ALTO_ABANDONO' ELSE 'CUMPLIMIENTO_ACEPTABLE' END AS evaluacion_reglas FROM g"""),
    "l18_option_label_consistency": s(f"""SELECT opcion, count(*) AS total_usos,
 {n(f"opcion = 'DEFAULT' OR strlen(opcion) <= 2 OR {REF}", 'reflexion_correcta')},
 {n("opcion = '2L' AND etiquetas NOT LIKE '%2L%'", 'opcion_2l_no_reflejada')},
 {n("opcion = 'CECOR' AND etiquetas NOT LIKE '%CECOR%'", 'opcion_cecor_no_reflejada')}, {n(LAB, 'con_procesamiento')}, {share(LAB)} AS
 tasa_procesamiento,
 left({lst('CASE WHEN ' + LAB + ' THEN left(etiquetas, 30) END', ' | ')}, 150) AS ejemplos_etiquetas FROM c WHERE {full('opcion')} GROUP BY 1 HAVING
 count(*) >= 3 ORDER BY total_usos DESC, opcion LIMIT 20"""),
    "l19_complete_flows": s(dominant("menu", "opcion", "patron_etiquetas_dominante"), f"""g AS (SELECT menu, opcion, coalesce(menu, 'NULL_MENU') ||
 ' → ' || coalesce(opcion, 'NULL_OPCION') AS flujo_navegacion, count(*) AS volumen, {USR} AS usuarios_unicos, {n(LAB, 'flujos_procesados')},
 {share(LAB)} AS tasa_completitud, {n(DIF, 'transferencias_exitosas')}, {share(DIF)} AS tasa_exito, {n(NOL, 'vac')} FROM c GROUP BY 1, 2 HAVING
 count(*) >= 5),
k AS (SELECT *, CASE WHEN {BAD} THEN 'FLUJO_ABANDONO' WHEN menu IS NULL AND opcion IS NOT NULL THEN 'FLUJO_INCONSISTENTE' WHEN flujos_procesados *
 100 >= volumen * 80 AND transferencias_exitosas * 100 >= volumen * 30 THEN 'FLUJO_OPTIMO' WHEN vac * 100 > volumen * 60 THEN 'FLUJO_PROBLEMATICO'
 ELSE 'FLUJO_NORMAL' END AS clasificacion_flujo FROM g
 ORDER BY list_position(['FLUJO_OPTIMO', 'FLUJO_NORMAL', 'FLUJO_PROBLEMATICO', 'FLUJO_INCONSISTENTE', 'FLUJO_ABANDONO'], clasificacion_flujo),
 volumen DESC, flujo_navegacion LIMIT 25)""",
        "SELECT k.* EXCLUDE (menu, opcion, vac), patron_etiquetas_dominante FROM k LEFT JOIN dom ON k.menu IS NOT DISTINCT FROM dom.menu AND "
        "k.opcion IS NOT DISTINCT FROM dom.opcion"),
    "l20_record_anomalies": s(" UNION ALL ".join(f"SELECT '{name}' AS tipo_anomalia, count(*) AS casos_detectados, left(string_agg(DISTINCT "
        f"concat('idRe:', idRe, ' Menu:', coalesce(menu, 'NULL'), ' Opc:', coalesce(opcion, 'NULL')), ' | ' ORDER BY concat('idRe:', idRe, ' "
        f"Menu:', coalesce(menu, 'NULL'), ' Opc:', coalesce(opcion, 'NULL'))), 200) AS ejemplos_casos FROM c WHERE {cond} HAVING count(*) > "
        f"0" for cond, name in ANOM)),
    "l21_routes": s(f"g AS (SELECT menu, opcion, count(*) AS volumen, {share(LAB)} AS tasa_procesamiento, {share(DIF)} AS tasa_transferencia FROM c "
        f"WHERE menu IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10)", f"SELECT 'RUTA_EXITOSA' AS tipo_ruta, * FROM g WHERE NOT ({BAD}) AND "
        f"tasa_procesamiento >= 60 AND tasa_transferencia >= 30 UNION ALL SELECT 'RUTA_PROBLEMATICA', * FROM g WHERE tasa_procesamiento < 30 OR "
        f"tasa_transferencia < 5"),
    "l22_label_validity": s(f"v AS (SELECT *, {V1} AS k FROM c), g AS (SELECT k, count(*) AS total_registros, {USR} AS usuarios_unicos, {mean(DUR)} "
        f"AS duracion_promedio_seg, {n(DIF, 'transferencias')}, {share(DIF, 1)} AS pct_transferencias FROM v GROUP BY 1)", f"SELECT * EXCLUDE (k), "
        f"k AS categoria_validacion, {first_k('v', 'z.k = g.k', 'z.menu', 5)} AS menus_frecuentes FROM g"),
    "l22_label_kinds": s(f"v AS (SELECT *, {V2} AS k FROM c), g AS (SELECT k, count(*) AS total_registros, {USR} AS usuarios_unicos, "
        f"{n('numero_entrada = numero_digitado', 'numeros_iguales')}, {n(DIF, 'numeros_diferentes')}, "
        f"{n('numero_digitado IS NULL', 'sin_numero_digitado')} FROM v GROUP BY 1)", f"SELECT * EXCLUDE (k), k AS tipo_por_etiqueta, "
        f"{first_k('v', 'z.k = g.k', 'z.menu', 5)} AS menus_frecuentes FROM g"),
    "l23_service_levels": s(f"v AS (SELECT *, {V3} AS k FROM c WHERE {LAB}), g AS (SELECT k, count(*) AS total_casos, {USR} AS usuarios_unicos, "
        f"{n(SERVED, 'interacciones_exitosas')}, {share(SERVED, 1)} AS tasa_exito_pct, {mean(DUR)} AS duracion_promedio_seg, count(DISTINCT id_8T) "
        f"AS zonas_geograficas, count(DISTINCT division) AS divisiones_activas FROM v GROUP BY 1)", f"SELECT * EXCLUDE (k), k AS nivel_servicio, "
        f"{first_k('v', 'z.k = g.k', 'z.menu', 5)} AS menus_por_nivel FROM g"),
    "l24_technical_codes": codes(CODES),
    "l24_technical_codes_custom": codes(CODES_TEST),
    "l25_label_segments": s(f"""u AS (SELECT numero_entrada, count(*) AS n, {n(has('VSI'), 'vsi')}, {n(has('NOBOT'), 'human')},
 {n(has('NoTmx_SOMC'), 'error')}, {n(has('2L'), 'l2')}, {n(has('ML'), 'ml')}, {n(has('TELCO') + ' OR ' + has('TELECOB'), 'telco')},
 {n("etiquetas LIKE '%QJA_%'", 'qja')}, {n(NOL, 'vac')} FROM c GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT *, CASE WHEN error * 2 > n THEN 'USUARIO_PROBLEMAS_SISTEMA' WHEN human > 0 AND vsi > 0 THEN 'USUARIO_MIXTO_HUMANO_SISTEMA' WHEN qja > 0
 THEN 'USUARIO_CON_QUEJAS' WHEN telco > 0 THEN 'USUARIO_SERVICIOS_TELCO' WHEN ml > 0 THEN 'USUARIO_MULTINIVEL' WHEN l2 > 0 THEN 'USUARIO_ESCALADO'
 WHEN vsi * 100 > n * 80 THEN 'USUARIO_VALIDADO_SISTEMA' WHEN vac * 100 > n * 70 THEN 'USUARIO_SIN_PROCESAMIENTO' ELSE 'USUARIO_ESTANDAR' END AS
 perfil_usuario FROM u)""",
        f"SELECT perfil_usuario, count(*) AS usuarios_en_perfil, {mean('n')} AS promedio_interacciones, {mean_share('vsi', 'n')} AS "
        f"promedio_pct_vsi, {mean_share('human', 'n')} AS promedio_pct_humanas, {mean_share('vac', 'n')} AS promedio_pct_sin_etiquetas FROM p GROUP "
        f"BY 1"),
    "l26_labels_and_behaviour": s(f"""SELECT menu, opcion, count(*) AS total_usos, {n(has('VSI'), 'con_vsi')}, {n(has('NOBOT'), 'con_nobot')},
 {n(has('NoTmx_SOMC'), 'con_error')}, {n(NOL, 'sin_etiquetas')}, {share(has('VSI'), 1)} AS tasa_vsi_pct, {share(has('NOBOT'), 1)} AS tasa_nobot_pct,
 {share(has('NoTmx_SOMC'), 1)} AS tasa_error_pct,
 {n(DIF + ' AND ' + has('VSI'), 'transferencias_vsi')}, {n(DIF + ' AND ' + NOL, 'transferencias_sin_etiqueta')},
 {mean('CASE WHEN ' + has('VSI') + ' THEN ' + DUR + ' END')} AS duracion_promedio_vsi, {mean('CASE WHEN ' + NOL + ' THEN ' + DUR + ' END')} AS
 duracion_promedio_sin_etiqueta FROM c WHERE menu IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY total_usos DESC, {NK} LIMIT 20"""),
    "l27_labels_by_hour": s(f"SELECT strftime(fecha, '%Y-%m-%d') AS fecha_formateada, (hora_inicio_seg // 3600)::INT AS hora_del_dia, count(*) AS "
        f"total_interacciones, {n(has('VSI'), 'con_vsi')}, {n(has('NOBOT'), 'con_nobot')}, {n(has('NoTmx_SOMC'), 'con_error')}, "
        f"{n(NOL, 'sin_etiquetas')}, {share(has('VSI'), 1)} AS tasa_vsi_pct, {share(has('NoTmx_SOMC'), 1)} AS tasa_error_pct, {share(NOL, 1)} AS "
        f"tasa_sin_etiquetas_pct FROM c GROUP BY 1, 2 HAVING count(*) >= 10"),
    "l28_label_correlation": s(f"g AS (SELECT menu, opcion, count(*) AS total_casos, count(DISTINCT etiquetas) AS etiquetas_diferentes, "
        f"{n(has('VSI'), 'casos_con_vsi')}, {n(has('TELCO'), 'casos_con_telco')}, {n(has('NoTmx_SOMC'), 'casos_con_error')}, "
        f"{n(has('NOBOT'), 'casos_con_nobot')}, {n(NOL, 'casos_sin_etiquetas')}, {share(has('VSI'), 1)} AS pct_vsi, {share(NOL, 1)} AS "
        f"pct_sin_etiquetas, {n(DIF, 'transferencias')} FROM c GROUP BY 1, 2 ORDER BY total_casos DESC, {NK} LIMIT 30)", f"SELECT *, "
        f"{first_k('c', SAME + ' AND z.etiquetas <> ' + chr(39) * 2, 'z.etiquetas', 3)} AS etiquetas_principales FROM g"),
    "l29_option_label_dependency": s(f"r AS (SELECT menu, opcion, etiquetas, coalesce({REF}, false) AS hit, coalesce({DIF}, false) AS moved, "
        f"count(*) AS f FROM c WHERE menu IS NOT NULL GROUP BY ALL HAVING count(*) >= "
        f"2)", f"""SELECT menu, opcion, coalesce(sum(f) FILTER (WHERE hit), 0)::BIGINT AS casos_opcion_reflejada, sum(f)::BIGINT AS total_casos,
 {ratio('coalesce(sum(f) FILTER (WHERE hit), 0)', 'sum(f)', 1)} AS pct_opcion_reflejada,
 {lst("CASE WHEN hit THEN 'REFLEJA:' || etiquetas END", ' | ')} AS ejemplos_reflexion
 FROM r GROUP BY 1, 2 HAVING sum(f) >= 5 ORDER BY pct_opcion_reflejada DESC, total_casos DESC, {NK} LIMIT 20"""),
    "l30_label_combinations": s(f"SELECT etiquetas, count(*) AS frecuencia, {USR} AS numeros_entrada_unicos, count(DISTINCT numero_digitado) AS "
        f"numeros_digitado_unicos, {n('numero_entrada = numero_digitado', 'iguales')}, {n(DIF, 'diferentes')}, count(DISTINCT menu || ':' || "
        f"opcion) AS combinaciones_menu_opcion FROM c WHERE {LAB} GROUP BY 1"),
    "l30_navigation_by_relation": s(f"v AS (SELECT *, CASE WHEN numero_entrada = numero_digitado THEN 'IGUALES' ELSE 'DIFERENTES' END AS "
        f"tipo_relacion FROM c), g AS (SELECT tipo_relacion, menu, opcion, count(*) AS frecuencia_uso, {USR} AS usuarios_unicos, {mean(DUR)} AS "
        f"duracion_promedio FROM v GROUP BY 1, 2, 3 ORDER BY tipo_relacion, frecuencia_uso DESC, {NK} LIMIT 20)", f"SELECT *, "
        f"{first_k('v', SAME + ' AND z.tipo_relacion = g.tipo_relacion', 'z.numero_digitado', 10)} AS numeros_digitados_muestra FROM g"),
    "l31_combination_usage": s(f"SELECT menu, opcion, count(*) AS frecuencia_total, {USR} AS usuarios_unicos, {mean(DUR)} AS duracion_promedio_seg, "
        f"{n('numero_entrada = numero_digitado', 'con_numeros_iguales')}, {n(DIF, 'con_numeros_diferentes')}, count(DISTINCT id_8T) AS "
        f"zonas_geograficas_activas, count(DISTINCT fecha) AS dias_activos FROM c GROUP BY 1, 2"),
    "l31_combination_usage_repaired": s(f"g AS (SELECT menu, opcion, count(*) AS frecuencia_uso, {USR} AS usuarios_unicos, "
        f"{share('numero_entrada = numero_digitado', 1)} AS pct_numeros_iguales, {mean('abs' + DUR)} AS duracion_promedio_seg, count(DISTINCT "
        f"id_8T) AS zonas_geograficas FROM c WHERE menu IS NOT NULL GROUP BY 1, 2 ORDER BY frecuencia_uso DESC, {NK} LIMIT 20)", f"SELECT *, "
        f"{first_k('c', SAME, 'z.division', 3)} AS divisiones_principales FROM g"),
    "l32_menu_efficiency": s(f"SELECT menu, opcion, count(*) AS total_usos, {USR} AS usuarios_unicos, {n(VAL, 'interacciones_validadas')}, "
        f"{n(BAD, 'interacciones_fallidas')}, {share(VAL)} AS tasa_validacion_pct, count(DISTINCT id_CTransferencia) AS "
        f"destinos_redireccion_diferentes, {n(full('id_CTransferencia'), 'casos_con_redireccion')}, {n(DIF, 'casos_procesamiento_diferente')}, "
        f"{mean(DUR)} AS duracion_promedio_seg FROM c WHERE menu IS NOT NULL GROUP BY 1, 2"),
    "l32_menu_efficiency_by_destination": s(f"g AS (SELECT menu, opcion, count(*) AS total_usos, {USR} AS usuarios_unicos, "
        f"{n(VAL, 'interacciones_exitosas')}, {n(BAD, 'interacciones_fallidas')}, {share(VAL)} AS tasa_exito_pct, count(DISTINCT numero_digitado) "
        f"AS destinos_diferentes, {n(DIF, 'transferencias')}, {mean(DUR)} AS duracion_promedio_seg, count(DISTINCT division) AS divisiones_activas "
        f"FROM c WHERE menu IS NOT NULL GROUP BY 1, 2)", f"SELECT *, {first_k('c', SAME, 'z.division', 3)} AS principales_divisiones FROM g"),
}
