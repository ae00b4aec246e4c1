"""Oracle statements of service, operations and digital-product reports."""

from tabulario.fixed import class_sql, points_sql
from tabulario.oracle.base import LLAMADAS, LOG_PERIODS, deviation, mean, mean_of_rounded, q, ratio
from tabulario.oracle.calls import C
from tabulario.oracle.labels import USR

OK = "(menu IN ('CONFIRMACION', 'EXITO', 'COMPLETADO'))"
MINS = "trunc((max(hora_fin_seg) - min(hora_inicio_seg)) / 60.0)::BIGINT"
O = "o AS (SELECT *, hora_fin_seg - hora_inicio_seg AS seg, (hora_inicio_seg // 3600)::INT AS hora, id_8T AS zona FROM c WHERE numero_entrada = numero_digitado)"
SES = f"""ses AS (SELECT numero_entrada, fecha, count(*) AS n, {MINS} AS mins, max(CASE WHEN {OK} THEN 1 ELSE 0 END)::INT AS e, string_agg(menu ||
 ':' || opcion, ' → ' ORDER BY hora_inicio_seg, idRe) AS j,
 first(menu ORDER BY hora_inicio_seg, idRe) FILTER (WHERE menu IS NOT NULL) AS primero, count(DISTINCT menu) AS m FROM o GROUP BY 1, 2)"""
WEEK = "strftime(fecha, '%U')::INT"
IDX = "(date_diff('day', DATE '1970-01-04', fecha) // 7)"
WON = f"won AS (SELECT numero_entrada, fecha, max(hora_inicio_seg) AS ult FROM c WHERE {OK} AND numero_entrada IS NOT NULL GROUP BY 1, 2)"
ZS = """zs AS (SELECT numero_entrada, fecha, zona, count(*) AS ops FROM o WHERE zona IS NOT NULL GROUP BY 1, 2, 3),
f AS (SELECT o.*, zs.ops, EXISTS (SELECT 1 FROM won WHERE won.numero_entrada = o.numero_entrada AND won.fecha = o.fecha) AS ok FROM o JOIN zs USING
 (numero_entrada, fecha, zona))"""
MD = f"md AS (SELECT numero_entrada, avg(n) AS n, avg(mins) AS mins, count(DISTINCT menu) AS m, count(DISTINCT fecha) AS d FROM (SELECT numero_entrada, fecha, menu, count(*) AS n, {MINS} AS mins FROM o GROUP BY 1, 2, 3) GROUP BY 1)"
DIA = "CASE dayofweek(fecha) WHEN 0 THEN 'Domingo' WHEN 1 THEN 'Lunes' WHEN 2 THEN 'Martes' WHEN 3 THEN 'Miércoles' WHEN 4 THEN 'Jueves' WHEN 5 THEN 'Viernes' ELSE 'Sábado' END"


def s(*parts: str) -> str:
    return q(LLAMADAS, LOG_PERIODS, C, O, SES, WON, *parts)


SQL = {
    "v01_abandoned_sequences": s(f"g AS (SELECT j AS secuencia_completa, count(*) AS frecuencia_journey, avg(n) AS promedio_pasos, avg(mins) AS "
        f"promedio_duracion_min, sum(e)::BIGINT AS completados_exitosos, (count(*) - sum(e))::BIGINT AS abandonados FROM ses WHERE n > 1 GROUP BY 1 "
        f"HAVING count(*) >= 2)", f"""SELECT *, {ratio('abandonados', 'frecuencia_journey', 1)} AS tasa_abandono_pct, {class_sql('nivel_problematico')} AS nivel_problematico
 FROM g ORDER BY tasa_abandono_pct DESC, frecuencia_journey DESC, secuencia_completa NULLS FIRST LIMIT 20"""),
    "v02_abandonment_points": s("p AS (SELECT *, row_number() OVER w AS paso, count(*) OVER (PARTITION BY numero_entrada, fecha) AS pasos FROM o "
        "WINDOW w AS (PARTITION BY numero_entrada, fecha ORDER BY hora_inicio_seg, idRe)), g AS (SELECT menu, opcion, paso AS numero_paso, count(*) "
        "FILTER (WHERE paso = pasos) AS veces_fue_punto_abandono, count(*) AS total_veces_visitado, avg(pasos) FILTER (WHERE paso = pasos) AS "
        "promedio_pasos_antes_abandono, avg(seg) FILTER (WHERE paso = pasos) AS tiempo_promedio_antes_abandono_seg FROM p GROUP BY 1, 2, 3 HAVING "
        "count(*) >= 20)",
        f"SELECT *, {ratio('veces_fue_punto_abandono', 'total_veces_visitado', 1)} AS tasa_abandono_pct, {class_sql('clasificacion_abandono')} AS clasificacion_abandono FROM g"),
    "v03_resolution_time": s("g AS (SELECT primero AS tipo_consulta_inicial, count(*) AS total_sesiones, sum(e)::BIGINT AS sesiones_exitosas, "
        "avg(mins) FILTER (WHERE e = 1) AS tiempo_promedio_exito_min, avg(mins) FILTER (WHERE e = 0) AS tiempo_promedio_abandono_min, avg(n) AS "
        "promedio_interacciones, avg(m) AS promedio_menus_visitados FROM ses GROUP BY 1)",
        f"SELECT *, {ratio('sesiones_exitosas', 'total_sesiones', 1)} AS tasa_exito_pct, {class_sql('recomendacion')} AS recomendacion FROM g"),
    "v04_frustration": s("u AS (SELECT numero_entrada, count(DISTINCT fecha) AS dias_intentos, count(*) AS total_sesiones, avg(n) AS "
        "promedio_interacciones_por_sesion, avg(mins) AS promedio_duracion_sesion, sum(e)::BIGINT AS sesiones_exitosas FROM ses GROUP BY 1 HAVING "
        "count(DISTINCT fecha) >= 2)", f"""SELECT *, {ratio('sesiones_exitosas', 'total_sesiones', 1)} AS tasa_exito_pct,
 {points_sql()}::INT AS score_frustracion,
 {class_sql('nivel_riesgo')} AS nivel_riesgo FROM u
 ORDER BY score_frustracion DESC, dias_intentos DESC, numero_entrada LIMIT 50"""),
    "v05_weekly_kpis": s(f"SELECT year(fecha)::INT AS año, {WEEK} AS semana, {USR} AS clientes_unicos, count(*) AS total_interacciones, avg(n) AS "
        f"promedio_interacciones_cliente, sum(e)::BIGINT AS total_exitosas, count(*) AS total_sesiones, {ratio('sum(e)', 'count(*)', 1)} AS "
        f"tasa_exito_semanal, avg(mins) AS tiempo_promedio_resolucion FROM ses GROUP BY 1, 2"),
    "o01_hourly_load": s(f"h AS (SELECT zona, fecha, hora, count(*) AS n, count(DISTINCT numero_entrada) AS u, {mean('seg', 4)} AS sg FROM o WHERE "
        f"zona IS NOT NULL GROUP BY 1, 2, 3), p AS (SELECT *, CASE WHEN n > avg(n) OVER (PARTITION BY zona) * 1.5::DOUBLE THEN 1 ELSE 0 END AS pico "
        f"FROM h)", f"g AS (SELECT zona, hora, avg(n) AS a, {mean('n', 0)} AS carga_promedio, max(n) AS carga_maxima, {mean('u', 0)} AS "
        f"usuarios_promedio, {mean_of_rounded('sg', 1, 4)} AS sg, {ratio('sum(pico)', 'count(*)', 1)} AS porcentaje_dias_pico FROM p GROUP BY 1, 2 "
        f"HAVING count(*) >= 5)", """
SELECT zona, hora, carga_promedio, carga_maxima, usuarios_promedio, sg AS tiempo_promedio_seg, porcentaje_dias_pico, CASE WHEN a >= avg(a) OVER
 (PARTITION BY zona) * 1.3::DOUBLE THEN 'HORA_PICO' WHEN a <= avg(a) OVER (PARTITION BY zona) * 0.7::DOUBLE THEN 'HORA_VALLE' ELSE 'HORA_NORMAL' END
 AS clasificacion_carga,
 CASE WHEN porcentaje_dias_pico > 60 AND a > 100 THEN 'AUMENTAR_CAPACIDAD' WHEN porcentaje_dias_pico < 10 AND a < 20 THEN 'REDUCIR_CAPACIDAD' WHEN sg
 > 120 THEN 'OPTIMIZAR_PERFORMANCE' ELSE 'CAPACIDAD_ADECUADA' END AS recomendacion_operativa FROM g"""),
    "o02_zone_efficiency": s(ZS, f"""g AS (SELECT zona, count(*) AS total_interacciones, {USR} AS usuarios_unicos,
 {ratio('count(*)', 'count(DISTINCT fecha)', 0, 1)} AS interacciones_promedio_dia, {ratio(USR, 'count(DISTINCT fecha)', 0, 1)} AS
 usuarios_promedio_dia, {mean('seg', 1)} AS tiempo_promedio_seg, {ratio('count(*)', USR, 1, 1)} AS interacciones_por_usuario, {mean('ops', 1)} AS
 complejidad_sesion,
 {ratio('count(*)', 'count(DISTINCT (fecha, hora))', 1, 1)} AS interacciones_promedio_hora, {ratio('count(*) FILTER (WHERE ok)', 'count(*)', 1)} AS
 tasa_exito_pct, round((100 - least(100.0::DOUBLE, avg(seg))) * 0.3::DOUBLE + least(100.0::DOUBLE, count(*) FILTER (WHERE ok) * 100.0::DOUBLE /
 count(*)) * 0.4::DOUBLE + (100 - least(100.0::DOUBLE, avg(ops) * 10)) * 0.3::DOUBLE, 1) AS score_eficiencia_operativa FROM f GROUP BY 1)""", """
SELECT *, rank() OVER (ORDER BY score_eficiencia_operativa DESC) AS ranking_eficiencia, CASE WHEN score_eficiencia_operativa >= 80 THEN 'ZONA_OPTIMA'
 WHEN score_eficiencia_operativa >= 65 THEN 'ZONA_EFICIENTE' WHEN score_eficiencia_operativa >= 50 THEN 'ZONA_PROMEDIO' ELSE 'ZONA_REQUIERE_MEJORA'
 END AS clasificacion_operativa,
 CASE WHEN tiempo_promedio_seg > 90 AND tasa_exito_pct < 60 THEN 'OPTIMIZAR_PROCESOS' WHEN interacciones_por_usuario > 5 AND tasa_exito_pct > 80 THEN
 'SIMPLIFICAR_FLUJOS' WHEN tasa_exito_pct > 85 AND tiempo_promedio_seg < 45 THEN 'MODELO_A_REPLICAR' WHEN usuarios_promedio_dia < 50 THEN
 'EVALUAR_RECURSOS' ELSE 'MANTENER_OPERACION' END AS recomendacion_especifica FROM g"""),
    "o03_capacity": s(f"h AS (SELECT zona, fecha, hora, count(*) AS n, avg(seg) AS sg FROM o WHERE zona IS NOT NULL GROUP BY 1, 2, 3), g AS (SELECT "
        f"zona, {DIA} AS dia_nombre, hora, avg(n) AS a, {deviation('n')} AS d, {mean('n', 0)} AS demanda_esperada, max(n) AS demanda_pico, "
        f"ceil(avg(n) * avg(sg) / 3600)::BIGINT AS horas_procesamiento_requeridas FROM h GROUP BY 1, 2, 3 HAVING count(*) >= 3)", """
SELECT zona, dia_nombre, hora, demanda_esperada, demanda_pico, horas_procesamiento_requeridas, CASE WHEN a >= 100 AND d > 30 THEN 'ALTO_ELASTICO'
 WHEN a >= 100 THEN 'ALTO_ESTABLE' WHEN a >= 50 AND d > 20 THEN 'MEDIO_ELASTICO' WHEN a >= 50 THEN 'MEDIO_ESTABLE' WHEN a >= 20 THEN 'BAJO_ESTABLE'
 ELSE 'MINIMO' END AS nivel_recursos_recomendado,
 CASE WHEN d > a * 0.5::DOUBLE THEN 'RECURSOS_DINAMICOS' WHEN horas_procesamiento_requeridas > 2 THEN 'RECURSOS_DEDICADOS' ELSE
 'RECURSOS_COMPARTIDOS' END AS estrategia_recursos, (horas_procesamiento_requeridas * 25)::DOUBLE AS costo_estimado_hora FROM g"""),
    "o04_load_distribution": s(f"z AS (SELECT zona, count(*) AS total_operaciones, {USR} AS usuarios_unicos, count(DISTINCT fecha) AS d, min(hora) "
        f"AS a, max(hora) AS b, count(DISTINCT hora) AS h, avg(seg) AS sg, {mean('seg', 1)} AS tiempo_promedio_seg FROM o WHERE zona IS NOT NULL "
        f"GROUP BY 1), g AS (SELECT zona, total_operaciones, usuarios_unicos, {ratio('total_operaciones', 'd', 4, 1)} AS operaciones_promedio_dia, "
        f"concat(a, ':00 - ', b, ':00') AS ventana_operativa, {ratio('total_operaciones', 'sum(total_operaciones) OVER ()', 1)} AS "
        f"porcentaje_carga_total, {ratio('total_operaciones', '(d * h)', 1, 1)} AS densidad_operaciones_hora, tiempo_promedio_seg, round(sg / "
        f"avg(sg) OVER () * 100, 1) AS eficiencia_relativa_pct FROM z)", """
SELECT *, CASE WHEN porcentaje_carga_total >= 25 THEN 'ZONA_CRITICA' WHEN porcentaje_carga_total >= 15 THEN 'ZONA_ALTA_DEMANDA' WHEN
 porcentaje_carga_total >= 8 THEN 'ZONA_DEMANDA_MEDIA' ELSE 'ZONA_BAJA_DEMANDA' END AS clasificacion_carga,
 CASE WHEN porcentaje_carga_total >= 25 AND eficiencia_relativa_pct > 110 THEN 'DISTRIBUIR_CARGA' WHEN porcentaje_carga_total >= 20 AND
 densidad_operaciones_hora > 50 THEN 'AMPLIAR_VENTANA_OPERATIVA' WHEN porcentaje_carga_total <= 5 THEN 'CONSOLIDAR_CON_OTRA_ZONA' WHEN
 eficiencia_relativa_pct <= 80 THEN 'OPTIMIZAR_PROCESOS' ELSE 'MANTENER_OPERACION_ACTUAL' END AS estrategia_balanceamiento FROM g"""),
    "o05_bottlenecks": s(f"z AS (SELECT zona, menu, opcion, count(*) AS frecuencia_uso, avg(seg) AS tiempo_promedio_seg, max(seg) AS "
        f"tiempo_maximo_seg, {deviation('seg')} AS d, {ratio('sum(seg) - count(*) * 30', '60', 0, 1)} AS minutos_impacto_diario FROM o WHERE zona "
        f"IS NOT NULL AND menu IS NOT NULL AND opcion IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10), g AS (SELECT *, round(d, 1) AS "
        f"desviacion_tiempo, round(CASE WHEN tiempo_promedio_seg > 60 THEN (tiempo_promedio_seg - 60) * 0.5::DOUBLE ELSE 0 END + CASE WHEN d > 30 "
        f"THEN d * 0.3::DOUBLE ELSE 0 END + CASE WHEN frecuencia_uso > 100 THEN ln(frecuencia_uso) * 5 ELSE 0 END, 1) AS score_cuello_botella, CASE "
        f"WHEN tiempo_promedio_seg > 120 AND frecuencia_uso > 50 THEN 'CRITICO' WHEN tiempo_promedio_seg > 90 OR (d > 45 AND frecuencia_uso > 30) "
        f"THEN 'ALTO_IMPACTO' WHEN tiempo_promedio_seg > 60 AND frecuencia_uso > 20 THEN 'MEDIO_IMPACTO' ELSE 'BAJO_IMPACTO' END AS nivel_problema "
        f"FROM z)", """
SELECT * EXCLUDE (d), CASE WHEN nivel_problema = 'CRITICO' THEN 1 WHEN nivel_problema = 'ALTO_IMPACTO' AND minutos_impacto_diario > 60 THEN 2 WHEN
 nivel_problema = 'ALTO_IMPACTO' THEN 3 WHEN nivel_problema = 'MEDIO_IMPACTO' AND frecuencia_uso > 100 THEN 4 ELSE 5 END AS prioridad_optimizacion,
 CASE WHEN tiempo_promedio_seg > 120 THEN 'REDISEÑAR_PROCESO_URGENTE' WHEN d > 60 THEN 'ESTANDARIZAR_PROCEDIMIENTO' WHEN tiempo_maximo_seg > 300 THEN
 'IMPLEMENTAR_TIMEOUT' WHEN minutos_impacto_diario > 120 THEN 'AUTOMATIZAR_PROCESO' ELSE 'OPTIMIZAR_PERFORMANCE' END AS recomendacion_accion FROM
 g"""),
    "o06_operating_cost": s(ZS, f"z AS (SELECT zona, count(*) AS n, {USR} AS u, sum(seg)::BIGINT AS sg, "
        f"{ratio('count(*) FILTER (WHERE ops = 1)', 'count(*)', 1)} AS pct_ops_simples, "
        f"{ratio('count(*) FILTER (WHERE ops BETWEEN 2 AND 5)', 'count(*)', 1)} AS pct_ops_medias, "
        f"{ratio('count(*) FILTER (WHERE ops > 5)', 'count(*)', 1)} AS pct_ops_complejas, {ratio('count(*) FILTER (WHERE ok)', 'count(*)', 1)} AS "
        f"tasa_exito_pct, {mean('seg', 1)} AS segundos_promedio_op FROM f GROUP BY 1), y AS (SELECT *, round({ratio('sg + 12 * n', '120', 2, 1)} * "
        f"100)::BIGINT AS ct, round({ratio('sg', '3600', 1, 1)} * 10)::BIGINT AS hd FROM z)", f"""
SELECT zona, n AS total_operaciones, hd::DOUBLE / 10 AS horas_procesamiento_total, segundos_promedio_op, pct_ops_simples, pct_ops_medias,
 pct_ops_complejas, tasa_exito_pct, ct::DOUBLE / 100 AS costo_total_estimado, {ratio('ct', 'n * 100', 3, 1)} AS costo_por_operacion,
 {ratio('ct', 'u * 100', 2, 1)} AS costo_por_usuario, {ratio('n * 10', 'hd', 1, 1)} AS operaciones_por_hora,
 rank() OVER (ORDER BY (ct::DOUBLE / 100) / n) AS ranking_eficiencia_costo, CASE WHEN pct_ops_complejas > 30 AND tasa_exito_pct < 70 THEN
 'SIMPLIFICAR_PROCESOS' WHEN segundos_promedio_op > 90 THEN 'OPTIMIZAR_PERFORMANCE' WHEN ct > u * 500 THEN 'REDUCIR_COMPLEJIDAD' WHEN
 {ratio('n * 10', 'hd', 1, 1)} < 20 THEN 'MEJORAR_THROUGHPUT' ELSE 'EFICIENCIA_ACEPTABLE' END AS oportunidad_optimizacion FROM y"""),
    "o07_daily_kpis": s(f"h AS (SELECT fecha, zona, hora, count(*) AS k FROM o WHERE zona IS NOT NULL GROUP BY 1, 2, 3), hh AS (SELECT fecha, zona, "
        f"count(*) AS horas_activas, max(k) AS pico_operaciones_hora, first(hora ORDER BY k DESC, hora) AS hora_pico FROM h GROUP BY 1, 2), g AS "
        f"(SELECT fecha, zona, count(*) AS operaciones_totales, {USR} AS usuarios_unicos, {mean('seg', 1)} AS tiempo_promedio_operacion_seg, "
        f"max(seg) AS tiempo_maximo_operacion_seg, count(*) FILTER (WHERE seg > 120) AS operaciones_lentas, "
        f"{ratio('count(*) FILTER (WHERE seg > 120)', 'count(*)', 1)} AS pct_operaciones_lentas FROM o WHERE zona IS NOT NULL GROUP BY 1, 2)",
        f"SELECT fecha AS dia, * EXCLUDE (fecha), {ratio('operaciones_totales', 'horas_activas', 1, 1)} AS operaciones_por_hora_activa FROM g JOIN "
        f"hh USING (fecha, zona)"),
    "d01_archetypes": s(f"mo AS (SELECT numero_entrada, count(DISTINCT menu) AS m, count(DISTINCT opcion) AS op FROM o GROUP BY 1), u AS (SELECT "
        f"numero_entrada, count(*) AS d, sum(n)::BIGINT AS n, avg(mins) AS a, {ratio('sum(mins)', 'count(*)', 4, 1)} AS a4, {deviation('mins')} AS "
        f"dv, max(e) AS e, date_diff('day', min(fecha), max(fecha)) + 1 AS sp FROM ses GROUP BY 1 HAVING count(*) >= 2), x AS (SELECT *, CASE WHEN "
        f"d * 10 > sp * 7 AND m >= 5 AND a <= 8 THEN 'POWER_USER' WHEN m >= 4 AND op >= 8 AND d * 2 <= sp THEN 'EXPLORADOR' WHEN m <= 2 AND n >= d "
        f"* 3 AND dv <= 2 THEN 'ESPECIALISTA' WHEN a > 12 AND n > d * 6 AND e = 0 THEN 'STRUGGLE_USER' WHEN d * 10 <= sp * 3 AND d <= 5 THEN "
        f"'OCASIONAL' WHEN sp > 7 AND d * 5 <= sp THEN 'EN_RIESGO_ABANDONO' ELSE 'REGULAR' END AS segmento_usuario FROM u JOIN mo USING "
        f"(numero_entrada))",
        f"SELECT segmento_usuario, count(*) AS cantidad_usuarios, {ratio('count(*)', 'sum(count(*)) OVER ()', 1)} AS porcentaje_base_usuarios, "
        f"{mean('d', 1)} AS promedio_dias_activos, {mean_of_rounded(ratio('n', 'd', 4, 1), 1, 4)} AS promedio_interacciones_dia, "
        f"{mean_of_rounded('a4', 1, 4)} AS promedio_duracion_sesion, {mean('m', 1)} AS promedio_menus_explorados, "
        f"{mean_of_rounded(ratio('d', 'sp', 4, 1), 2, 4)} AS promedio_frecuencia_uso, {ratio('sum(e)', 'count(*)', 1)} AS tasa_exito_pct FROM x "
        f"GROUP BY 1"),
    "d02_segment_journeys": s(MD, f"sg AS (SELECT numero_entrada, CASE WHEN n <= 3 AND m >= 4 THEN 'EXPLORADOR' WHEN n >= 5 AND m <= 2 THEN "
        f"'ESPECIALISTA' WHEN mins > 10 AND d >= 3 THEN 'STRUGGLE_USER' ELSE 'REGULAR' END AS segmento FROM md), g AS (SELECT segmento, j AS "
        f"journey_pattern, count(*) AS frecuencia_journey, {mean('mins', 1)} AS duracion_promedio_min FROM ses JOIN sg USING (numero_entrada) WHERE "
        f"n > 1 GROUP BY 1, 2 HAVING count(*) >= 2)", f"SELECT *, "
        f"{ratio('frecuencia_journey', 'sum(frecuencia_journey) OVER (PARTITION BY segmento)', 1)} AS porcentaje_dentro_segmento FROM g"),
    "d03_retention_cohorts": s(f"a AS (SELECT numero_entrada, min(fecha) AS f FROM o GROUP BY 1), b AS (SELECT a.numero_entrada, year(f)::INT AS "
        f"cohorte_año, strftime(f, '%U')::INT AS cohorte_semana, {IDX.replace('fecha', 'f')} AS i0, {IDX} AS i FROM a JOIN o USING "
        f"(numero_entrada)), g AS (SELECT cohorte_año, cohorte_semana, {USR} AS usuarios_cohorte, "
        f"{', '.join(f'count(DISTINCT CASE WHEN i = i0 + {k} THEN numero_entrada END) AS r{k}' for k in (1, 2, 3))} FROM b GROUP BY 1, 2 HAVING "
        f"{USR} >= 10)",
        f"SELECT cohorte_año, cohorte_semana, usuarios_cohorte, "
        f"{', '.join(ratio(f'r{k}', 'usuarios_cohorte', 1) + f' AS retencion_semana_{k}_pct' for k in (1, 2, 3))}, "
        f"{ratio('usuarios_cohorte - r1', 'usuarios_cohorte', 1)} AS churn_semana_1_pct FROM g"),
    "d04_churn_risk": s(f"r AS (SELECT *, row_number() OVER (PARTITION BY numero_entrada ORDER BY fecha DESC) AS rn, max(fecha) OVER (PARTITION BY "
        f"numero_entrada) AS ult FROM ses), u AS (SELECT numero_entrada, max(fecha) AS ultima_actividad, count(*) AS dias_activos_total, avg(n) "
        f"FILTER (WHERE rn <= 3) AS i, avg(mins) FILTER (WHERE rn <= 3) AS m, {mean('CASE WHEN rn <= 3 THEN n END', 1)} AS "
        f"interacciones_recientes_promedio, {mean('CASE WHEN rn <= 3 THEN mins END', 1)} AS duracion_reciente_promedio, count(*) FILTER (WHERE rn "
        f"<= 3 AND e = 1) AS exitos_recientes, count(*) FILTER (WHERE fecha >= ult - 7) AS dias_activos_ultima_semana, date_diff('day', max(fecha), "
        f"DATE '2024-01-31')::INT AS dias_sin_actividad FROM r GROUP BY 1 HAVING count(*) >= 3), k AS (SELECT *, least(100, CASE WHEN "
        f"dias_sin_actividad > 7 THEN 30 ELSE dias_sin_actividad * 4 END + CASE WHEN dias_activos_ultima_semana = 0 THEN 25 ELSE 0 END + CASE WHEN "
        f"m > 15 THEN 20 ELSE 0 END + CASE WHEN exitos_recientes = 0 THEN 20 ELSE 0 END + CASE WHEN i > 8 THEN 15 ELSE 0 END)::INT AS "
        f"score_riesgo_churn FROM u)",
        "SELECT * EXCLUDE (i, m), CASE WHEN score_riesgo_churn >= 70 THEN 'CHURN_INMINENTE' WHEN score_riesgo_churn >= 50 THEN 'ALTO_RIESGO' WHEN "
        "score_riesgo_churn >= 30 THEN 'MEDIO_RIESGO' ELSE 'BAJO_RIESGO' END AS categoria_riesgo FROM k ORDER BY score_riesgo_churn DESC, "
        "numero_entrada LIMIT 100"),
    "d05_funnel": s(f"p AS (SELECT CASE WHEN menu IN ('INICIO', 'LOGIN') THEN 1 WHEN menu IN ('DASHBOARD', 'PRINCIPAL') THEN 2 WHEN menu IN "
        f"('SELECCION', 'CATEGORIA') THEN 3 WHEN menu IN ('PROCESO', 'FORMULARIO') THEN 4 WHEN menu IN ('CONFIRMACION', 'EXITO') THEN 5 ELSE 0 END "
        f"AS paso, {USR} AS u FROM o WHERE menu IS NOT NULL GROUP BY 1), g AS (SELECT paso, u, lag(u) OVER (ORDER BY paso) AS pr, first_value(u) "
        f"OVER (ORDER BY paso) AS f FROM p WHERE paso > 0), k AS (SELECT paso, u AS usuarios_unicos_paso, u - pr AS usuarios_perdidos, "
        f"{ratio('u', 'f', 1)} AS conversion_desde_inicio_pct, {ratio('u', 'pr', 1)} AS conversion_paso_anterior_pct FROM g)",
        "SELECT * EXCLUDE (paso), ['Entrada/Login', 'Dashboard Principal', 'Selección/Categoría', 'Proceso/Formulario', 'Confirmación/Éxito'][paso] "
        "AS nombre_paso, CASE WHEN conversion_paso_anterior_pct < 60 THEN 'CUELLO_BOTELLA_CRITICO' WHEN conversion_paso_anterior_pct < 75 THEN "
        "'REQUIERE_OPTIMIZACION' ELSE 'PERFORMANCE_ACEPTABLE' END AS estado_paso FROM k"),
    "d06_journey_variants": s(f"g AS (SELECT j AS journey_completo, count(*) AS sesiones_totales, sum(e)::BIGINT AS conversiones, "
        f"{ratio('sum(e)', 'count(*)', 1)} AS tasa_conversion_pct, {mean('n', 1)} AS promedio_pasos, {mean('mins', 1)} AS promedio_tiempo_min, "
        f"{mean('CASE WHEN e = 1 THEN mins END', 1)} AS tiempo_promedio_conversion FROM ses WHERE n > 1 GROUP BY 1 HAVING count(*) >= 2)",
        f"SELECT *, {ratio('round(tasa_conversion_pct * 10)::BIGINT', 'round(promedio_pasos * 10)::BIGINT', 1, 1)} AS eficiencia_por_paso, CASE "
        f"WHEN tasa_conversion_pct >= 80 AND promedio_pasos <= 4 THEN 'JOURNEY_OPTIMO' WHEN tasa_conversion_pct >= 60 AND promedio_tiempo_min <= 6 "
        f"THEN 'JOURNEY_EFICIENTE' WHEN tasa_conversion_pct >= 40 THEN 'JOURNEY_MEJORABLE' ELSE 'JOURNEY_PROBLEMATICO' END AS clasificacion_journey "
        f"FROM g"),
    "d07_feature_preference": s(MD, f"sg AS (SELECT numero_entrada, CASE WHEN n >= 5 AND m <= 2 THEN 'POWER_USER' WHEN m >= 4 AND n <= 3 THEN "
        f"'EXPLORADOR' WHEN mins > 10 THEN 'STRUGGLE_USER' ELSE 'REGULAR' END AS segmento FROM md), l AS (SELECT o.*, segmento, EXISTS (SELECT 1 "
        f"FROM c z WHERE z.numero_entrada = o.numero_entrada AND z.fecha = o.fecha AND z.menu IN ('CONFIRMACION', 'EXITO', 'COMPLETADO') AND "
        f"z.hora_inicio_seg > o.hora_inicio_seg) AS later FROM o JOIN sg USING (numero_entrada)), g AS (SELECT segmento, menu, opcion, count(*) AS "
        f"frecuencia_uso, {USR} AS usuarios_unicos, {mean('seg', 1)} AS tiempo_promedio_seg, "
        f"{ratio('count(*) FILTER (WHERE later)', 'count(*)', 1)} AS tasa_exito_posterior_pct FROM l GROUP BY 1, 2, 3 HAVING count(*) >= 10), k AS "
        f"(SELECT *, {ratio('frecuencia_uso', 'sum(frecuencia_uso) OVER (PARTITION BY segmento)', 1)} AS preferencia_segmento_pct FROM g)",
        "SELECT *, CASE WHEN preferencia_segmento_pct >= 15 AND tasa_exito_posterior_pct >= 60 THEN 'DESTACAR_PARA_SEGMENTO' WHEN "
        "preferencia_segmento_pct >= 10 AND tiempo_promedio_seg <= 30 THEN 'ACCESO_RAPIDO' WHEN tasa_exito_posterior_pct >= 75 THEN 'PROMOVER_USO' "
        "WHEN preferencia_segmento_pct <= 3 THEN 'OCULTAR_PARA_SEGMENTO' ELSE 'MANTENER_ACTUAL' END AS recomendacion_personalizacion FROM k"),
    "d08_weekly_ux": s(f"act AS (SELECT DISTINCT numero_entrada, {IDX} + 1 AS i FROM c), k AS (SELECT s.*, {WEEK} AS semana, year(fecha)::INT AS "
        f"año, EXISTS (SELECT 1 FROM act WHERE act.numero_entrada = s.numero_entrada AND act.i = {IDX}) AS ret FROM ses s)",
        f"SELECT año, semana, {USR} AS usuarios_activos_semanales, avg(n) AS promedio_interacciones_usuario, count(DISTINCT CASE WHEN ret THEN "
        f"numero_entrada END) AS usuarios_retenidos, {ratio('count(DISTINCT CASE WHEN ret THEN numero_entrada END)', USR, 1)} AS "
        f"tasa_retencion_semanal, sum(e)::BIGINT AS conversiones_totales, {ratio('sum(e)', 'count(*)', 1)} AS tasa_conversion_general, avg(mins) AS "
        f"tiempo_promedio_sesion_min, {USR} - count(DISTINCT CASE WHEN e = 1 THEN numero_entrada END) AS usuarios_sin_exito FROM k GROUP BY 1, 2"),
}
