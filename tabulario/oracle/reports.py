"""Oracle statements of the periodic reports."""

from tabulario.oracle.base import LLAMADAS, LOG_PERIODS, deviation, mean, mean_of_rounded, q, ratio, share
from tabulario.oracle.calls import C

I = """i AS (SELECT idRe, numero_entrada, numero_digitado, fecha, menu, opcion, division, area, id_8T, trimestre, least(hora_inicio_seg,
 hora_fin_seg) AS hora_inicio_real, greatest(hora_inicio_seg, hora_fin_seg) AS hora_fin_real,
 CASE WHEN numero_entrada = numero_digitado THEN 'OFICIAL' ELSE 'DERIVADO' END AS tipo_llamada, CASE WHEN inv THEN 'TIMESTAMP_CORREGIDO' ELSE
 'TIMESTAMP_ORIGINAL' END AS calidad_dato FROM c)"""
SES = """ses AS (SELECT trimestre, numero_entrada, fecha, tipo_llamada, id_8T, division, area, count(*) AS total_interacciones, min(hora_inicio_real)
 AS primera_interaccion, max(hora_fin_real) AS ultima_interaccion,
 string_agg(menu || ':' || opcion, ' → ' ORDER BY hora_inicio_real, idRe) AS journey_navegacion, count(DISTINCT menu) AS menus_visitados,
 count(DISTINCT opcion) AS opciones_diferentes, max(hora_fin_real) - min(hora_inicio_real) AS duracion_sesion_seg
 FROM i GROUP BY 1, 2, 3, 4, 5, 6, 7)"""
D = f"""d AS (SELECT trimestre, fecha, tipo_llamada, id_8T AS grupo_zonas, count(DISTINCT numero_entrada) AS usuarios_activos,
 sum(total_interacciones)::BIGINT AS interacciones_totales, {mean('total_interacciones')} AS promedio_interacciones_por_usuario,
 min(total_interacciones) AS min_interacciones, max(total_interacciones) AS max_interacciones, round({deviation('total_interacciones')}, 2) AS
 desviacion_estandar, count(*) FILTER (WHERE total_interacciones = 1) AS usuarios_1_interaccion,
 count(*) FILTER (WHERE total_interacciones BETWEEN 2 AND 5) AS usuarios_2a5_interacciones, count(*) FILTER (WHERE total_interacciones > 5) AS
 usuarios_mas5_interacciones, {mean('duracion_sesion_seg')} AS duracion_promedio_sesion FROM ses GROUP BY 1, 2, 3, 4)"""
WEEK1 = "(CASE WHEN month(fecha) = 1 AND weekofyear(fecha) >= 52 THEN 0 WHEN month(fecha) = 12 AND weekofyear(fecha) = 1 THEN 53 ELSE weekofyear(fecha) END)::INT"
PU = ratio("count(*)", "count(DISTINCT numero_entrada)", 2, 1)
PD = ratio("count(*)", "(count(DISTINCT numero_entrada) * count(DISTINCT fecha))", 2, 1)
VSI = "etiquetas LIKE '%VSI%'"
BAD = "menu IN ('cte_colgo', 'SinOpcion_Cbc')"


# Every session once for each length of period.
GRAINS = f"""g AS (SELECT 'dia' AS grano, fecha::VARCHAR AS periodo, * FROM ses
UNION ALL SELECT 'semana', concat(year(fecha), '-S', lpad({WEEK1}::VARCHAR, 2, '0')), * FROM ses
UNION ALL SELECT 'mes', strftime(fecha, '%Y-%m'), * FROM ses
UNION ALL SELECT 'trimestre', trimestre, * FROM ses
UNION ALL SELECT 'año', year(fecha)::VARCHAR, * FROM ses)"""


def s(*parts: str) -> str:
    return q(LLAMADAS, LOG_PERIODS, C, I, SES, D, *parts)


def roll(keys: str, avg: str, total: str, more: str = "") -> str:
    return f"SELECT {keys}, tipo_llamada, grupo_zonas, count(DISTINCT fecha) AS dias_con_datos, {mean_of_rounded('promedio_interacciones_por_usuario')} AS {avg}, {mean('usuarios_activos', 0)} AS usuarios_promedio_dia, sum(interacciones_totales)::BIGINT AS {total}{more} FROM d GROUP BY ALL"


SQL = {
    "r01_daily_average": s(f"SELECT fecha, count(DISTINCT numero_entrada) AS usuarios_activos, count(*) AS total_interacciones, {PU} AS "
        f"promedio_interacciones_por_usuario, min(hora_inicio_seg) AS primera_interaccion_dia, max(hora_fin_seg) AS ultima_interaccion_dia, "
        f"count(DISTINCT menu) AS menus_utilizados, count(DISTINCT id_8T) AS zonas_activas FROM c WHERE numero_entrada IS NOT NULL GROUP BY 1"),
    "r01_daily_average_filtered": s(f"SELECT fecha, count(DISTINCT numero_entrada) AS usuarios_activos, count(*) AS interacciones_validas, {PU} AS "
        f"promedio_interacciones_por_usuario, count(*) FILTER (WHERE {VSI}) AS interacciones_validadas, count(*) FILTER (WHERE {BAD}) AS "
        f"interacciones_fallidas, {share(VSI, 1)} AS pct_validadas, {share(BAD, 1)} AS pct_fallidas FROM c WHERE numero_entrada IS NOT NULL AND "
        f"menu IS NOT NULL GROUP BY 1"),
    "r02_weekly_average": s(f"SELECT year(fecha)::INT AS año, {WEEK1} AS semana, count(DISTINCT fecha) AS dias_con_datos, count(DISTINCT "
        f"numero_entrada) AS usuarios_unicos_semana, count(*) AS total_interacciones_semana, {PU} AS promedio_interacciones_usuario_semana, {PD} AS "
        f"promedio_diario_en_semana, min(fecha) AS primer_dia_semana, max(fecha) AS ultimo_dia_semana FROM c WHERE numero_entrada IS NOT NULL GROUP "
        f"BY 1, 2"),
    "r02_monthly_average": s(f"SELECT year(fecha)::INT AS año, month(fecha)::INT AS mes, monthname(fecha) AS nombre_mes, count(DISTINCT fecha) AS "
        f"dias_con_datos, count(DISTINCT numero_entrada) AS usuarios_unicos_mes, count(*) AS total_interacciones_mes, {PU} AS "
        f"promedio_interacciones_usuario_mes, {PD} AS promedio_diario_en_mes FROM c WHERE numero_entrada IS NOT NULL GROUP BY 1, 2, 3"),
    "r02_annual_average": s(f"SELECT year(fecha)::INT AS año, count(DISTINCT fecha) AS dias_con_datos, count(DISTINCT numero_entrada) AS "
        f"usuarios_unicos_año, count(*) AS total_interacciones_año, {PU} AS promedio_interacciones_usuario_año, "
        f"{', '.join(f'count(*) FILTER (WHERE quarter(fecha) = {k}) AS interacciones_Q{k}' for k in (1, 2, 3, 4))} FROM c WHERE numero_entrada IS "
        f"NOT NULL GROUP BY 1"),
    "r03_clean_interactions": s("SELECT * FROM i"),
    "r04_daily_sessions": s("SELECT * FROM ses"),
    "r05_daily_report": s("SELECT * FROM d"),
    "r06_weekly_report": s(roll(f"trimestre, year(fecha)::INT AS año, {WEEK1} AS semana", "promedio_semanal", "interacciones_totales_semana")),
    "r06_monthly_report": s(roll("trimestre, year(fecha)::INT AS año, month(fecha)::INT AS mes", "promedio_mensual", "interacciones_totales_mes")),
    "r06_quarterly_report": s("u AS (SELECT trimestre, tipo_llamada, id_8T AS grupo_zonas, count(DISTINCT numero_entrada) AS "
        "usuarios_unicos_trimestre FROM i GROUP BY 1, 2, 3)", f"x AS "
        f"({roll('trimestre', 'promedio_trimestral', 'interacciones_totales_trimestre')})", "SELECT * FROM x JOIN u USING (trimestre, tipo_llamada, "
        "grupo_zonas)"),
    "r06_annual_report": s(roll("year(fecha)::INT AS año", "promedio_anual", "interacciones_totales_año", ", string_agg(DISTINCT trimestre, ',' "
        "ORDER BY trimestre) AS trimestres_incluidos")),
    "r06_period_callers": s(GRAINS, "SELECT grano, periodo, tipo_llamada, count(DISTINCT numero_entrada) AS usuarios_unicos FROM g GROUP BY ALL "
        "HAVING count(numero_entrada) > 0"),
    "r06_period_report": s(GRAINS, f"""SELECT grano, periodo, tipo_llamada, count(DISTINCT fecha) AS dias_con_datos, count(*) AS sesiones,
 sum(total_interacciones)::BIGINT AS interacciones_totales, {mean('total_interacciones')} AS promedio_por_sesion,
 count(DISTINCT numero_entrada) AS usuarios_unicos, TRUE AS estimacion_fiel FROM g GROUP BY ALL HAVING count(numero_entrada) > 0"""),
    "r07_official_beside_derived": s(f"k AS (SELECT fecha, tipo_llamada, {mean('total_interacciones')} AS p, count(DISTINCT numero_entrada) AS u "
        f"FROM ses GROUP BY 1, 2)", "SELECT a.fecha, a.p AS promedio_oficial, a.u AS usuarios_oficiales, b.p AS promedio_derivado, coalesce(b.u, 0) "
        "AS usuarios_derivados FROM k a LEFT JOIN k b ON a.fecha = b.fecha AND b.tipo_llamada = 'DERIVADO' WHERE a.tipo_llamada = 'OFICIAL'"),
    "r08_quarter_context": s(f"SELECT per.trimestre, per.inicio AS fecha_inicio, per.fin AS fecha_fin, count(c.idRe) AS total_registros, "
        f"count(DISTINCT numero_entrada) AS usuarios_unicos, count(DISTINCT fecha) AS dias_con_datos, count(DISTINCT id_8T) AS zonas_activas, "
        f"count(*) FILTER (WHERE inv) AS timestamps_invertidos, count(*) FILTER (WHERE numero_entrada <> numero_digitado) AS llamadas_derivadas, "
        f"{ratio('count(*) FILTER (WHERE inv)', 'count(c.idRe)')} AS pct_timestamps_mal, "
        f"{ratio('count(*) FILTER (WHERE numero_entrada <> numero_digitado)', 'count(c.idRe)')} AS pct_derivadas FROM per LEFT JOIN c USING "
        f"(trimestre) GROUP BY ALL"),
    "r09_usage_by_kind": s("SELECT tipo_llamada, menu, opcion, count(*) AS frecuencia_uso, count(DISTINCT numero_entrada) AS usuarios_unicos, "
        "avg(hora_fin_real - hora_inicio_real) AS duracion_promedio FROM i GROUP BY 1, 2, 3"),
    "r09_usage_by_kind_recorded": s("SELECT CASE WHEN numero_entrada = numero_digitado THEN 'OFICIAL' ELSE 'DERIVADO' END AS tipo_llamada, menu, "
        "opcion, count(*) AS frecuencia, count(DISTINCT numero_entrada) AS usuarios_unicos, avg(hora_fin_seg - hora_inicio_seg) AS "
        "duracion_promedio FROM c WHERE menu IS NOT NULL AND opcion IS NOT NULL GROUP BY 1, 2, 3"),
}
