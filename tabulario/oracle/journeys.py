"""Oracle statements of the caller and journey reports."""

from tabulario.oracle.base import LLAMADAS, LOG_PERIODS, deviation, mean, mean_of_rounded, mean_share, q, ratio, share
from tabulario.oracle.calls import C, blank, full, lst
from tabulario.oracle.labels import BAD, DIF, DUR, LAB, NOL, USR, first_k, has

EQ = "numero_entrada = numero_digitado"
ST, EN = "least(hora_inicio_seg, hora_fin_seg)", "greatest(hora_inicio_seg, hora_fin_seg)"
RES, COM, OVER = "menu LIKE 'RES-%'", "menu LIKE 'comercial_%'", "menu LIKE 'Desborde_%'"
KN = "numero_entrada IS NOT NULL"
PUD = ratio("count(*)", "(count(DISTINCT numero_entrada) * count(DISTINCT fecha))", 2, 1)


def s(*parts: str) -> str:
    return q(LLAMADAS, LOG_PERIODS, C, *parts)


def n(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) AS {name}"


def day(sec: str) -> str:
    return f"((({sec}) % 86400 + 86400) % 86400)"


def clock(sec: str, full_: bool = False) -> str:
    d = day(sec)
    text = f"lpad(({d} // 3600)::VARCHAR, 2, '0') || ':' || lpad(({d} // 60 % 60)::VARCHAR, 2, '0')"
    return f"({text}" + (f" || ':' || lpad(({d} % 60)::VARCHAR, 2, '0'))" if full_ else ")")


def journey(step: str, at: str, sep: str = " → ") -> str:
    return f"string_agg({step}, '{sep}' ORDER BY {at}, idRe)"


STEP = f"{clock(ST)} || ':[' || coalesce(menu, 'SIN_MENU') || '-' || coalesce(opcion, 'SIN_OPCION') || ']'"
DETAIL = f"""{clock(ST, True)} || ' [' || coalesce(menu, 'NULL') || ':' || coalesce(nullif(opcion, ''), 'NULL') || ']' || CASE WHEN {LAB} THEN ' {{'
 || left(etiquetas, 20) || '}}' ELSE ' {{SIN_ETIQ}}' END
 || CASE WHEN {full('id_CTransferencia')} THEN ' →' || id_CTransferencia ELSE '' END"""


def sample(k: int) -> str:
    return f"(SELECT string_agg(numero_entrada, ',' ORDER BY n DESC, numero_entrada) FROM (SELECT numero_entrada, n FROM k z WHERE z.cluster_comportamiento = g.cluster_comportamiento AND numero_entrada IS NOT NULL ORDER BY n DESC, numero_entrada LIMIT {k}))"


SQL = {
    "j01_daily_journeys": s(f"SELECT numero_entrada, fecha, count(*) AS total_interacciones, {journey(STEP, ST)} AS patron_navegacion, "
        f"count(DISTINCT id_CTransferencia) AS redirecciones_diferentes, {lst('id_CTransferencia')} AS destinos_redireccion, count(DISTINCT "
        f"numero_digitado) AS numeros_procesados_diferentes, {n(DIF, 'casos_procesamiento_interno')}, {lst('etiquetas', '|')} AS etiquetas_sesion "
        f"FROM c WHERE {KN} GROUP BY 1, 2"),
    "j01_daily_journeys_with_destinations": s(f"SELECT numero_entrada, fecha, count(*) AS total_interacciones, {journey(STEP, ST)} AS "
        f"patron_navegacion, {lst('numero_digitado')} AS numeros_destino, count(DISTINCT numero_digitado) AS destinos_diferentes, "
        f"{lst('etiquetas', '|')} AS etiquetas_sesion FROM c WHERE {KN} GROUP BY 1, 2"),
    "j01_detailed_journeys": s(f"""SELECT numero_entrada, fecha, count(*) AS total_interacciones_dia, {journey(DETAIL, ST, ' | ')} AS
 journey_detallado, max({EN}) - min({ST}) AS duracion_total_segundos, count(DISTINCT id_CTransferencia) AS destinos_redireccion_diferentes,
 {lst('id_CTransferencia')} AS lista_redirecciones, count(DISTINCT numero_digitado) AS numeros_procesados,
 {n(DIF, 'casos_procesamiento_interno')}, {n(has('VSI'), 'interacciones_validadas')}, {n(has('NOBOT'), 'interacciones_humanas')},
 {n(has('NoTmx_SOMC'), 'interacciones_error')}, count(DISTINCT id_8T) AS zonas_utilizadas, {lst("division || '-' || area")} AS
 ubicaciones_organizacionales FROM c WHERE {KN} GROUP BY 1, 2"""),
    "j01_recorded_journeys": s(f"SELECT numero_entrada, fecha AS dia, numero_digitado, count(*) AS total_interacciones, "
        f"{journey(clock('hora_inicio_seg') + " || ':[' || menu || '-' || opcion || ']'", 'hora_inicio_seg')} AS patron_navegacion_temporal, "
        f"count(DISTINCT menu) AS menus_visitados, count(DISTINCT opcion) AS opciones_diferentes, CASE WHEN {EQ} THEN 'MISMO' ELSE 'DIFERENTE' END "
        f"AS relacion_numeros, max(hora_fin_seg) - min(hora_inicio_seg) AS duracion_total_sesion FROM c GROUP BY 1, 2, 3"),
    "j01_validated_journeys": s(f"SELECT numero_entrada, fecha, count(*) AS total_interacciones_dia, "
        f"{journey(clock(ST) + " || ':[' || coalesce(menu, 'SIN_MENU') || CASE WHEN " + full('opcion') + " THEN '-' || opcion ELSE '' END || ']'", ST)} AS patron_navegacion, count(DISTINCT menu) AS menus_diferentes, {lst('menu')} AS menus_utilizados, count(DISTINCT id_CTransferencia) AS redirecciones_diferentes, {n(has('VSI'), 'interacciones_validadas')}, {n(BAD, 'interacciones_fallidas')}, max({EN}) - min({ST}) AS duracion_sesion_segundos FROM c WHERE {KN} GROUP BY 1, 2"),
    "j02_frequent_sequences": s(f"v AS (SELECT numero_entrada, fecha, {journey("menu || coalesce(':' || opcion, '')", 'hora_inicio_seg')} AS "
        f"secuencia_navegacion, count(*) AS pasos FROM c WHERE menu IS NOT NULL GROUP BY 1, 2), g AS (SELECT secuencia_navegacion, count(*) AS "
        f"frecuencia_secuencia, avg(pasos) AS promedio_pasos, {USR} AS usuarios_unicos FROM v GROUP BY 1 HAVING count(*) >= 2 ORDER BY "
        f"frecuencia_secuencia DESC, 1 LIMIT 20)", f"SELECT *, "
        f"{first_k('v', 'z.secuencia_navegacion = g.secuencia_navegacion', 'z.numero_entrada', 3)} AS usuarios_ejemplo FROM g"),
    "j03_transitions": s(f"t AS (SELECT *, lag(menu) OVER w AS pm, lag(opcion) OVER w AS po, {ST} - lag({EN}) OVER w AS gap FROM c WHERE {KN} AND "
        f"menu IS NOT NULL WINDOW w AS (PARTITION BY numero_entrada, fecha ORDER BY {ST}, idRe)), v AS (SELECT *, pm || ':' || coalesce(po, 'NULL') "
        f"AS desde, menu || ':' || coalesce(opcion, 'NULL') AS hacia FROM t WHERE pm IS NOT NULL), g AS (SELECT desde, hacia, count(*) AS "
        f"frecuencia_transicion, {USR} AS usuarios_unicos, {mean('gap')} AS tiempo_promedio_transicion, {n(has('VSI'), 'transiciones_validadas')}, "
        f"{n(full('id_CTransferencia'), 'transiciones_con_redireccion')} FROM v GROUP BY 1, 2 HAVING count(*) >= 5)", f"SELECT *, "
        f"{first_k('v', 'z.desde = g.desde AND z.hacia = g.hacia', 'z.numero_entrada', 5)} AS usuarios_ejemplo FROM g"),
    "j03_step_transitions": s(f"t AS (SELECT numero_entrada, menu || ':' || opcion AS paso_actual, lag(menu || ':' || opcion) OVER w AS "
        f"paso_anterior, hora_inicio_seg - lag(hora_inicio_seg) OVER w AS gap FROM c WINDOW w AS (PARTITION BY numero_entrada, fecha ORDER BY "
        f"hora_inicio_seg, idRe))", f"SELECT paso_anterior, paso_actual, count(*) AS frecuencia_transicion, {USR} AS usuarios_unicos, {mean('gap')} "
        f"AS tiempo_promedio_transicion FROM t WHERE paso_anterior IS NOT NULL GROUP BY 1, 2 ORDER BY frecuencia_transicion DESC, paso_anterior "
        f"NULLS FIRST, paso_actual NULLS FIRST LIMIT 20"),
    "j04_user_patterns": s(f"u AS (SELECT numero_entrada, count(*) AS total_interacciones, count(DISTINCT fecha) AS dias_activos, "
        f"{n(BAD, 'interacciones_fallidas')}, {n(RES, 'interacciones_servicio')}, {n(COM, 'com')}, "
        f"{n(chr(109) + 'enu = ' + chr(39) + 'SDO' + chr(39), 'sdo')}, count(DISTINCT numero_digitado) - 1 AS transferencias_realizadas, "
        f"{mean(DUR)} AS duracion_promedio_seg FROM c GROUP BY "
        f"1)", """SELECT * EXCLUDE (com, sdo), CASE WHEN interacciones_fallidas * 100 > total_interacciones * 70 THEN 'USUARIO_PROBLEMATICO' WHEN com
 > 0 THEN 'USUARIO_COMERCIAL' WHEN interacciones_servicio > interacciones_fallidas THEN 'USUARIO_SERVICIOS' WHEN sdo = total_interacciones THEN
 'USUARIO_CONSULTA_SIMPLE' WHEN transferencias_realizadas > 3 THEN 'USUARIO_MULTI_SERVICIO' WHEN total_interacciones > 10 AND dias_activos = 1 THEN
 'USUARIO_INTENSIVO' ELSE 'USUARIO_NORMAL' END AS patron_comportamiento FROM u"""),
    "j05_user_types": s(f"u AS (SELECT numero_entrada, count(*) AS n, count(DISTINCT fecha) AS d, "
        f"{ratio('count(*)', 'count(DISTINCT fecha)', 2, 1)} AS pd, count(DISTINCT menu) AS k, {n(RES, 'serv')}, {n(COM, 'com')}, {n(BAD, 'bad')}, "
        f"count(*) FILTER (WHERE menu = 'SDO') AS sdo FROM c WHERE {KN} GROUP BY 1), t AS (SELECT *, CASE WHEN pd >= 10 THEN 'USUARIO_INTENSIVO' "
        f"WHEN com > 0 THEN 'USUARIO_COMERCIAL' WHEN serv > bad THEN 'USUARIO_SERVICIOS' WHEN sdo = n THEN 'USUARIO_CONSULTA_SIMPLE' WHEN bad > n * "
        f"0.6 THEN 'USUARIO_PROBLEMATICO' WHEN k >= 5 THEN 'USUARIO_EXPLORADOR' WHEN d >= 10 THEN 'USUARIO_RECURRENTE' ELSE 'USUARIO_ESTANDAR' END "
        f"AS tipo_usuario FROM u)", f"SELECT tipo_usuario, count(*) AS cantidad_usuarios, {mean('n')} AS promedio_interacciones_tipo, "
        f"{mean_of_rounded('pd')} AS promedio_diario_tipo, {mean('k', 1)} AS promedio_diversidad_menus FROM t GROUP BY 1"),
    "j06_anomalous_users": s(f"u AS (SELECT numero_entrada, count(*) AS total_interacciones, count(DISTINCT fecha) AS dias_activos, "
        f"{ratio('count(*)', 'count(DISTINCT fecha)', 4, 1)} AS interacciones_por_dia, count(DISTINCT menu) AS menus_diferentes, count(DISTINCT "
        f"numero_digitado) AS numeros_destino, {lst('menu')} AS menus_usados, count(DISTINCT id_8T) AS zonas_geograficas, count(DISTINCT division) "
        f"AS divisiones_diferentes, avg({DUR}) AS a, {mean(DUR)} AS duracion_promedio_seg, min(fecha) AS primera_fecha, max(fecha) AS ultima_fecha "
        f"FROM c GROUP BY 1)", """SELECT * EXCLUDE (a), CASE WHEN total_interacciones > dias_activos * 50 THEN 'VOLUMEN_EXTREMO' WHEN
 menus_diferentes = 1 AND total_interacciones > 20 THEN 'MENU_UNICO_REPETITIVO' WHEN a < 2 THEN 'DURACION_SOSPECHOSA' WHEN zonas_geograficas > 5 THEN
 'MULTI_ZONA_ANOMALO' WHEN divisiones_diferentes > 3 THEN 'MULTI_DIVISION_ANOMALO' WHEN dias_activos > 25 THEN 'USO_CONTINUO_SOSPECHOSO' ELSE
 'NORMAL' END AS tipo_anomalia
 FROM u WHERE total_interacciones > dias_activos * 2 OR (menus_diferentes = 1 AND total_interacciones > 10) OR a < 5 OR zonas_geograficas > 3"""),
    "j07_behaviour_clusters": s(f"u AS (SELECT numero_entrada, count(*) AS n, count(DISTINCT fecha) AS d, {n(RES, 'serv')}, {n(BAD, 'bad')}, "
        f"{n(COM, 'com')}, {n(DIF, 'mov')}, round(avg({DUR}), 4) AS a FROM c GROUP BY 1), k AS (SELECT *, CASE WHEN n = 1 THEN 'SINGLE_TOUCH' WHEN "
        f"com * 100 > n * 50 THEN 'COMERCIAL_ORIENTED' WHEN serv * 100 > n * 60 THEN 'SERVICE_ORIENTED' WHEN bad * 100 > n * 50 THEN 'HIGH_DROPOUT' "
        f"WHEN mov * 100 > n * 40 THEN 'MULTI_SERVICE' WHEN n > 15 AND d = 1 THEN 'INTENSIVE_SINGLE_DAY' WHEN d > 5 THEN 'RECURRING_USER' ELSE "
        f"'STANDARD_USER' END AS cluster_comportamiento FROM u)", f"g AS (SELECT cluster_comportamiento, count(*) AS usuarios_en_cluster, "
        f"{mean('n')} AS promedio_interacciones, {mean('d')} AS promedio_dias_activos, {mean_share('serv', 'n')} AS promedio_pct_servicios, "
        f"{mean_share('bad', 'n')} AS promedio_pct_abandonos, {mean_of_rounded('a', 2, 4)} AS promedio_duracion_seg FROM k GROUP BY 1)", f"SELECT "
        f"*, {sample(3)} AS usuarios_ejemplo FROM g"),
    "j08_five_profiles": s(f"""u AS (SELECT numero_entrada, count(*) AS n, count(DISTINCT fecha) AS d,
 {ratio('count(*)', 'count(DISTINCT fecha)', 2, 1)} AS i, count(DISTINCT menu) AS m, {n(RES, 'serv')}, {n(COM, 'com')}, count(*) FILTER (WHERE menu =
 'SDO') AS sdo, {n(BAD, 'bad')}, {n(OVER, 'ov')}, {n(has('VSI'), 'vsi')}, {n(has('NOBOT'), 'human')}, {n(has('NoTmx_SOMC'), 'error')},
 {n(NOL, 'vac')}, count(DISTINCT id_CTransferencia) AS dest, count(DISTINCT id_8T) AS z, count(DISTINCT division) AS dv, count(DISTINCT area) AS ar
 FROM c WHERE {KN} GROUP BY 1 HAVING count(*) >= 2)""", f"""
SELECT numero_entrada, CASE WHEN i >= 20 THEN 'ULTRA_INTENSIVO' WHEN i >= 10 THEN 'MUY_INTENSIVO' WHEN i >= 5 THEN 'INTENSIVO' WHEN i >= 2 THEN
 'MODERADO' ELSE 'LIGERO' END AS perfil_intensidad, CASE WHEN m >= 8 THEN 'EXPLORADOR_AVANZADO' WHEN m >= 5 THEN 'EXPLORADOR_MODERADO' WHEN m >= 3
 THEN 'USUARIO_DIVERSO' WHEN m = 2 THEN 'USUARIO_DUAL' ELSE 'USUARIO_FOCALIZADO' END AS perfil_diversidad,
 CASE WHEN serv > n * 0.6 THEN 'ORIENTADO_SERVICIOS' WHEN com > 0 THEN 'PERFIL_COMERCIAL' WHEN sdo = n THEN 'SOLO_CONSULTAS' WHEN bad > n * 0.5 THEN
 'PROBLEMATICO' WHEN ov > n * 0.3 THEN 'AFECTADO_SOBRECARGA' ELSE 'MIXTO' END AS perfil_servicio,
 CASE WHEN vsi * 100 >= n * 80 THEN 'ALTAMENTE_VALIDADO' WHEN human > 0 THEN 'INTERACCION_HUMANA_CONFIRMADA' WHEN error > vsi THEN
 'AFECTADO_ERRORES_SISTEMA' WHEN vac * 100 >= n * 70 THEN 'BAJO_PROCESAMIENTO' ELSE 'VALIDACION_MIXTA' END AS perfil_validacion,
 CASE WHEN z >= 5 THEN 'MULTI_ZONA_EXTREMO' WHEN z >= 3 THEN 'MULTI_ZONA' WHEN dv >= 3 THEN 'MULTI_DIVISION' WHEN ar >= 3 THEN 'MULTI_AREA' ELSE
 'GEOGRAFICAMENTE_ESTABLE' END AS perfil_movilidad, n AS total_interacciones, d AS dias_activos, i AS intensidad_diaria, m AS diversidad_menus,
 {ratio('vsi', 'n', 1)} AS porcentaje_validado, {ratio('bad', 'n', 1)} AS porcentaje_fallidas, dest AS destinos_redireccion, z AS zonas_geograficas
 FROM u"""),
    "j09_score_clusters": s(f"""u AS (SELECT numero_entrada, count(*) AS n, count(DISTINCT menu) AS m, {n(has('VSI'), 'vsi')}, {n(COM, 'com')},
 {n(RES, 'serv')}, count(*) FILTER (WHERE menu = 'SDO') AS sdo FROM c WHERE {KN} GROUP BY 1 HAVING count(*) >= 2),
sc AS (SELECT *, CASE WHEN n <= 2 THEN 1 WHEN n <= 5 THEN 3 WHEN n <= 10 THEN 5 WHEN n <= 20 THEN 7 ELSE 9 END AS v, CASE WHEN m = 1 THEN 1 WHEN m <=
 3 THEN 3 WHEN m <= 5 THEN 5 WHEN m <= 8 THEN 7 ELSE 9 END AS dv, CASE WHEN vsi * 100 >= n * 80 THEN 9 WHEN vsi * 100 >= n * 60 THEN 7 WHEN vsi * 100
 >= n * 40 THEN 5 WHEN vsi * 100 >= n * 20 THEN 3 ELSE 1 END AS e, CASE WHEN com > 0 THEN 9 WHEN serv * 2 > n THEN 7 WHEN sdo = n THEN 3 ELSE 5 END
 AS x FROM u),
k AS (SELECT *, CASE WHEN v >= 7 AND dv >= 7 THEN 'POWER_USER_EXPLORADOR' WHEN v >= 7 AND e >= 7 THEN 'POWER_USER_EFICIENTE' WHEN x >= 7 AND e >= 7
 THEN 'USUARIO_COMERCIAL_EXITOSO' WHEN dv >= 7 AND e <= 3 THEN 'EXPLORADOR_PROBLEMATICO' WHEN v <= 3 AND x <= 3 THEN 'USUARIO_SIMPLE' WHEN e <= 3 AND
 v >= 5 THEN 'USUARIO_PROBLEMATICO_PERSISTENTE' WHEN dv <= 3 AND v >= 5 THEN 'USUARIO_REPETITIVO' ELSE 'USUARIO_ESTANDAR' END AS
 cluster_comportamiento FROM sc),
g AS (SELECT cluster_comportamiento, count(*) AS usuarios_en_cluster, {mean('n', 1)} AS promedio_interacciones, {mean('m', 1)} AS
 promedio_diversidad_menus, {mean_share('vsi', 'n')} AS promedio_pct_exito, min(n) AS min_interacciones, max(n) AS max_interacciones,
 min({ratio('vsi', 'n', 4)}) AS min_pct_exito, max({ratio('vsi', 'n', 4)}) AS max_pct_exito, {ratio('sum(v)', 'count(*) * 10', 2, 1)} AS
 score_promedio_volumen, {ratio('sum(dv)', 'count(*) * 10', 2, 1)} AS score_promedio_diversidad, {ratio('sum(e)', 'count(*) * 10', 2, 1)} AS
 score_promedio_exito, {ratio('sum(x)', 'count(*) * 10', 2, 1)} AS score_promedio_complejidad FROM k GROUP BY
 1)""", f"SELECT *, {sample(5)} AS usuarios_ejemplo_top FROM g"),
    "j10_circadian": s(f"SELECT ({day(ST)} // 3600)::INT AS hora_del_dia, (dayofweek(fecha) + 1)::INT AS dia_semana, dayname(fecha) AS nombre_dia, "
        f"count(*) AS total_interacciones, {USR} AS usuarios_unicos, {ratio('count(*)', USR, 2, 1)} AS promedio_interacciones_por_usuario, "
        f"{n(RES, 'servicios_resolucion')}, count(*) FILTER (WHERE menu = 'SDO') AS consultas_saldo, {n(COM, 'interacciones_comerciales')}, "
        f"{n(BAD, 'interacciones_fallidas')}, {n(OVER, 'experiencias_sobrecarga')}, {share(has('VSI'), 1)} AS tasa_validacion, {share(BAD, 1)} AS "
        f"tasa_abandono, {share(OVER, 1)} AS tasa_sobrecarga, {mean('abs' + DUR)} AS duracion_promedio_segundos FROM c WHERE {KN} GROUP BY 1, 2, 3"),
    "j11_user_evolution": s(f"se AS (SELECT numero_entrada, fecha, count(*) AS n, {n(has('VSI'), 'vsi')} FROM c WHERE {KN} GROUP BY 1, 2), u AS "
        f"(SELECT numero_entrada, count(*) AS total_sesiones, arg_min(n, fecha) AS interacciones_primera_sesion, arg_max(n, fecha) AS "
        f"interacciones_ultima_sesion, arg_min(vsi, fecha) AS validaciones_primera_sesion, arg_max(vsi, fecha) AS validaciones_ultima_sesion, "
        f"{mean('n')} AS promedio_interacciones_por_sesion, {mean_share('vsi', 'n')} AS promedio_tasa_validacion, avg(n) AS a, {deviation('n')} AS "
        f"d FROM se GROUP BY 1 HAVING count(*) >= 3)", """SELECT * EXCLUDE (a, d), interacciones_ultima_sesion - interacciones_primera_sesion AS
 cambio_interacciones, validaciones_ultima_sesion - validaciones_primera_sesion AS cambio_validaciones, round(d, 2) AS variabilidad_interacciones,
 CASE WHEN interacciones_ultima_sesion * 10 < interacciones_primera_sesion * 7 THEN 'MEJORO_EFICIENCIA' WHEN interacciones_ultima_sesion * 10 >
 interacciones_primera_sesion * 13 THEN 'AUMENTO_COMPLEJIDAD' WHEN validaciones_ultima_sesion > validaciones_primera_sesion THEN 'MEJORO_EXITO' WHEN
 d <= a * 0.3::DOUBLE THEN 'COMPORTAMIENTO_ESTABLE' ELSE 'SIN_PATRON_CLARO' END AS patron_evolucion,
 CASE WHEN d <= a * 0.2::DOUBLE THEN 'MUY_CONSISTENTE' WHEN d <= a * 0.5::DOUBLE THEN 'CONSISTENTE' WHEN d <= a * 0.8::DOUBLE THEN
 'MODERADAMENTE_VARIABLE' ELSE 'ALTAMENTE_VARIABLE' END AS nivel_consistencia FROM u"""),
    "j12_intensity_segments": s(f"u AS (SELECT numero_entrada, count(*) AS n, count(DISTINCT menu) AS m, avg({DUR}) / 60 AS a FROM c GROUP BY "
        f"1)", f"SELECT CASE WHEN n = 1 THEN '1_SINGLE_TOUCH' WHEN n <= 5 THEN '2-5_MODERATE' WHEN n <= 10 THEN '6-10_ACTIVE' ELSE '11+_POWER_USER' "
        f"END AS segmento_usuario, count(numero_entrada) AS cantidad_usuarios, {mean('n', 4)} AS promedio_interacciones, {mean('m', 4)} AS "
        f"promedio_menus, round(avg(a), 4) AS duracion_promedio_min FROM u GROUP BY 1"),
    "j13_number_behaviour": s(f"SELECT numero_entrada, numero_digitado, count(*) AS total_interacciones, count(DISTINCT fecha) AS dias_activos, "
        f"count(DISTINCT menu) AS menus_diferentes, count(DISTINCT opcion) AS opciones_diferentes, "
        f"{ratio('count(*)', 'count(DISTINCT fecha)', 2, 1)} AS interacciones_por_dia, min(fecha) AS primera_aparicion, max(fecha) AS "
        f"ultima_aparicion, {mean('abs' + DUR)} AS duracion_promedio_seg, CASE WHEN count(*) > count(DISTINCT fecha) * 20 THEN 'ALTO_VOLUMEN' WHEN "
        f"count(DISTINCT menu) = 1 AND count(*) > 10 THEN 'MENU_UNICO' WHEN avg(abs{DUR}) < 5 THEN 'DURACION_MUY_CORTA' WHEN count(DISTINCT fecha) "
        f"> 30 THEN 'USO_CONTINUO' ELSE 'NORMAL' END AS patron_comportamiento FROM c GROUP BY 1, 2"),
    "j14_time_direction": s(f"v AS (SELECT *, CASE WHEN inv THEN 'TIMESTAMPS_INVERTIDOS' ELSE 'TIMESTAMPS_NORMALES' END AS tipo_timestamp FROM c), "
        f"g AS (SELECT tipo_timestamp, count(*) AS cantidad, {mean('abs' + DUR)} AS duracion_promedio_seg, {USR} AS usuarios_afectados FROM v GROUP "
        f"BY 1)", f"SELECT *, {first_k('v', 'z.tipo_timestamp = g.tipo_timestamp', 'z.menu', 5)} AS menus_frecuentes FROM g"),
    "j14_anomaly_list": s(" UNION ALL ".join(f"SELECT '{name}' AS tipo_anomalia, count(*) AS casos, {USR} AS usuarios_afectados, "
        f"{"'N/A'" if name == 'SIN_MENU_NI_OPCION' else first_k('c', cond, 'z.menu', 3)} AS menus_frecuentes, "
        f"{ratio('count(*)', '(SELECT count(*) FROM c)')} AS porcentaje_total FROM c WHERE "
        f"{cond}" for cond, name in [("inv", "TIMESTAMPS_INVERTIDOS"), ("menu IS NULL AND opcion IS "
        "NULL", "SIN_MENU_NI_OPCION"), (blank("numero_digitado"), "SIN_NUMERO_DIGITADO")])),
    "j15_hourly_activity": s(f"SELECT (hora_inicio_seg // 3600)::INT AS hora_del_dia, count(*) AS total_interacciones, {USR} AS usuarios_unicos, "
        f"{mean(DUR)} AS duracion_promedio, {n(EQ, 'numeros_iguales')}, {n(DIF, 'numeros_diferentes')}, {lst('menu')} AS menus_activos FROM c GROUP "
        f"BY 1"),
    "j15_daily_hourly_activity": s(f"SELECT strftime(fecha, '%Y-%m-%d') AS fecha_formateada, (hora_inicio_seg // 3600)::INT AS hora_del_dia, "
        f"count(*) AS total_interacciones, {USR} AS usuarios_activos, {n(RES, 'servicios')}, count(*) FILTER (WHERE menu = 'SDO') AS "
        f"consultas_saldo, {n(COM, 'comerciales')}, {n(BAD, 'fallidas')}, {n(DIF, 'transferencias')}, {mean(DUR)} AS duracion_promedio_seg FROM c "
        f"GROUP BY 1, 2"),
    "j16_zone_behaviour": s(f"SELECT id_8T AS zona_geografica, count(*) AS total_interacciones, {USR} AS usuarios_unicos_zona, count(DISTINCT "
        f"fecha) AS dias_activos, {PUD} AS promedio_interacciones_usuario_dia, {share(EQ, 1)} AS porcentaje_numeros_iguales, count(DISTINCT menu || "
        f"':' || opcion) AS combinaciones_menu_opcion, {lst('menu')} AS menus_disponibles FROM c GROUP BY 1"),
    "j16_zone_division_area": s(f"g AS (SELECT id_8T AS zona_geografica, division, area, count(*) AS total_interacciones, {USR} AS usuarios_unicos, "
        f"count(DISTINCT fecha) AS dias_activos, {PUD} AS promedio_interacciones_usuario_dia, {share(EQ, 1)} AS pct_numeros_iguales, "
        f"{share('inv', 1)} AS pct_timestamps_invertidos FROM c WHERE id_8T IS NOT NULL GROUP BY 1, 2, 3)", f"SELECT *, "
        f"{first_k('c', 'z.id_8T = g.zona_geografica AND z.division = g.division AND z.area = g.area', 'z.menu', 3)} AS menus_principales FROM g"),
    "j16_zone_totals": s(f"SELECT id_8T AS zona, count(*) AS total_interacciones, {USR} AS usuarios_unicos, count(DISTINCT fecha) AS dias_activos, "
        f"{PUD} AS promedio_bruto_diario, {n(EQ, 'oficiales')}, {n(DIF, 'derivadas')}, {share(EQ, 1)} AS pct_oficiales FROM c GROUP BY 1"),
    "j17_division_area": s(f"SELECT division, area, count(*) AS total_interacciones, {USR} AS usuarios_unicos, count(*)::DOUBLE AS "
        f"promedio_por_area, {n(EQ, 'numeros_iguales')}, {n(DIF, 'numeros_diferentes')}, count(DISTINCT menu || ':' || opcion) AS "
        f"diversidad_navegacion, count(DISTINCT id_8T) AS zonas_geograficas FROM c WHERE division IS NOT NULL AND area IS NOT NULL GROUP BY 1, 2"),
}
SQL["j03_step_rows"] = s(f"""SELECT numero_entrada, fecha, idRe, row_number() OVER w AS paso, count(*) OVER (PARTITION BY numero_entrada, fecha) AS
 pasos, lag(idRe) OVER w AS anterior
 FROM c WHERE {KN} WINDOW w AS (PARTITION BY numero_entrada, fecha ORDER BY {ST}, idRe)""")
