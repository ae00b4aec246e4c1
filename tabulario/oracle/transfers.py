"""Oracle statements of the transfer reports."""

from tabulario.oracle.base import LLAMADAS, LOG_PERIODS, mean, mean_share, q, ratio
from tabulario.oracle.calls import C, full, lst
from tabulario.oracle.reports import I, SES

KEPT = "numero_entrada IS NOT NULL AND numero_entrada <> coalesce(numero_digitado, '')"
STRICT = "numero_entrada <> numero_digitado"
DET = f"""count(*) AS frecuencia_combinacion, {lst("menu || ':' || opcion", ', ')} AS menu_opciones_usadas, {lst('etiquetas', '|')} AS
 etiquetas_patron, {lst('id_8T')} AS zonas_afectadas,
 {lst("division || '-' || area", ', ')} AS divisiones_areas, count(DISTINCT fecha) AS dias_activos, min(fecha) AS primera_aparicion, max(fecha) AS
 ultima_aparicion"""
ORD = "ORDER BY count(*) DESC, numero_entrada NULLS FIRST, numero_digitado NULLS FIRST"


def s(*parts: str) -> str:
    return q(LLAMADAS, LOG_PERIODS, C, *parts)


def pairs(cond: str, k: int, more: str = "") -> str:
    return f"SELECT numero_entrada, numero_digitado, {DET}{more} FROM c WHERE {cond} GROUP BY 1, 2 {ORD} LIMIT {k}"


def usage(keys: str, src: str, dur: str, days: int, per: int) -> str:
    return f"""u AS (SELECT {keys}, count(*) AS frecuencia_uso, count(DISTINCT fecha) AS dias_activos, avg({dur}) AS duracion_promedio,
 {lst("menu || ':' || opcion")} AS opciones_usadas FROM {src} GROUP BY ALL),
b AS (SELECT *, CASE WHEN dias_activos > {days} THEN 'POSIBLE_INTERNO' WHEN duracion_promedio < 5 THEN 'AUTOMATICO' WHEN frecuencia_uso >
 dias_activos * {per} THEN 'ALTO_VOLUMEN' ELSE 'NORMAL' END AS patron_comportamiento FROM u)"""


def kinds(cond: str, name: str) -> str:
    return f"""SELECT '{name}' AS tipo_procesamiento, count(*) AS casos, count(DISTINCT numero_entrada) AS usuarios_unicos, (SELECT string_agg(menu,
 ',' ORDER BY menu) FROM (SELECT DISTINCT menu FROM c WHERE {cond} AND menu IS NOT NULL ORDER BY menu LIMIT 5)) AS menus_frecuentes,
 count(*) FILTER (WHERE {full('id_CTransferencia')}) AS con_redireccion_real FROM c WHERE {cond}"""


def refs(cond: str, name: str) -> str:
    return f"""SELECT '{name}' AS tipo_registro, count(*) AS total_registros, count(DISTINCT nullif(cIdentifica, '')) AS referencias_unicas,
 count(DISTINCT numero_entrada) AS usuarios, (SELECT string_agg(menu, ',' ORDER BY menu) FROM (SELECT DISTINCT menu FROM c WHERE {cond} AND menu IS
 NOT NULL ORDER BY menu LIMIT 5)) AS menus,
 count(*) FILTER (WHERE {full('id_CTransferencia')}) AS tambien_con_redireccion, count(*) FILTER (WHERE etiquetas LIKE '%VSI%') AS con_validacion_vsi
 FROM c WHERE {cond}"""


SQL = {
    "t01_transfer_pairs": s(pairs(KEPT, 15, f", {lst('trimestre')} AS trimestres_activos")),
    "t02_complete_pairs": s(pairs(STRICT, 15)),
    "t02_complete_pairs_of_quarter": s(pairs(STRICT + " AND trimestre = 'Q02_24'", 10)),
    "t03_first_of_pair": s(f"SELECT numero_entrada, numero_digitado, fecha, idRe, menu, opcion, etiquetas, id_8T, division, area FROM c WHERE "
        f"{KEPT} QUALIFY row_number() OVER (PARTITION BY numero_entrada, numero_digitado ORDER BY fecha, hora_inicio_seg, idRe) = 1 ORDER BY "
        f"numero_entrada, numero_digitado NULLS FIRST LIMIT 15"),
    "t04_pairs_joined_to_dates": s(pairs(KEPT, 15)),
    "t05_pairs_by_null": s(f"(SELECT numero_entrada, numero_digitado, 'NOT_NULL' AS tipo_digitado, {DET} FROM c WHERE {STRICT} GROUP BY 1, 2 {ORD} "
        f"LIMIT 10) UNION ALL (SELECT numero_entrada, numero_digitado, 'NULL', {DET} FROM c WHERE numero_entrada IS NOT NULL AND numero_digitado IS "
        f"NULL GROUP BY 1, 2 {ORD} LIMIT 5)"),
    "t06_pairs_by_quarter_totals": s(f"k AS (SELECT numero_entrada, numero_digitado, trimestre, {DET} FROM c WHERE {KEPT} GROUP BY 1, 2, "
        f"3)", f"""SELECT numero_entrada, numero_digitado, sum(frecuencia_combinacion)::BIGINT AS frecuencia_combinacion,
 {lst('menu_opciones_usadas', ' | ')} AS menu_opciones_usadas, {lst('etiquetas_patron', ' | ')} AS etiquetas_patron, {lst('zonas_afectadas')} AS
 zonas_afectadas,
 {lst('divisiones_areas', ' | ')} AS divisiones_areas, sum(dias_activos)::BIGINT AS total_dias_activos, min(primera_aparicion) AS primera_aparicion,
 max(ultima_aparicion) AS ultima_aparicion, {lst('trimestre')} AS trimestres_activos FROM k GROUP BY 1, 2 ORDER BY sum(k.frecuencia_combinacion)
 DESC, numero_entrada, numero_digitado NULLS FIRST LIMIT 15"""),
    "t07_top_pairs_per_quarter": s(f"SELECT trimestre, numero_entrada, numero_digitado, {DET} FROM c WHERE {KEPT} GROUP BY 1, 2, 3 QUALIFY "
        f"row_number() OVER (PARTITION BY trimestre {ORD}) <= 5"),
    "t08_appearance_dates": s(f"k AS (SELECT DISTINCT numero_entrada, numero_digitado FROM c WHERE {KEPT})", f"SELECT numero_entrada, "
        f"numero_digitado, min(fecha) AS primera_aparicion, max(fecha) AS ultima_aparicion FROM c WHERE {KEPT} AND EXISTS (SELECT 1 FROM k WHERE "
        f"k.numero_entrada = c.numero_entrada AND k.numero_digitado IS NOT DISTINCT FROM c.numero_digitado) GROUP BY 1, 2"),
    "t09_pair_summary": s(f"SELECT numero_entrada, numero_digitado, count(*) AS frecuencia_combinacion, {lst('menu')} || ':' || {lst('opcion')} AS "
        f"menu_opciones_usadas, count(DISTINCT fecha) AS dias_activos, min(fecha) AS primera_aparicion, max(fecha) AS ultima_aparicion FROM c WHERE "
        f"{KEPT} GROUP BY 1, 2 {ORD} LIMIT 15"),
    "t10_transfer_variants": s(f"k AS (SELECT idRe, numero_entrada, numero_digitado, coalesce({STRICT}, false) AS strict, coalesce({KEPT}, false) "
        f"AS null_kept, coalesce(numero_entrada IS NOT NULL AND (numero_digitado IS NULL OR {STRICT}), false) AS explicit_null, "
        f"coalesce(trim(numero_entrada) <> coalesce(trim(numero_digitado), '') AND trim(numero_entrada) <> '', false) AS trimmed FROM c)", "SELECT "
        "* FROM k WHERE strict OR null_kept OR explicit_null OR trimmed"),
    "t11_redirections": s(f"""SELECT id_CTransferencia, count(*) AS frecuencia_redireccion, count(DISTINCT numero_entrada) AS usuarios_redirigidos,
 {lst("menu || ':' || opcion", ', ')} AS menus_que_redirigen, {lst("division || '-' || area", ', ')} AS contexto_organizacional,
 {lst('etiquetas', ' | ')} AS patron_etiquetas,
 count(DISTINCT fecha) AS dias_activos, min(fecha) AS primera_redireccion, max(fecha) AS ultima_redireccion, count(*) FILTER (WHERE {STRICT}) AS
 casos_con_procesamiento_interno, count(DISTINCT cIdentifica) AS referencias_cIdentifica FROM c WHERE {full('id_CTransferencia')} GROUP BY 1 ORDER BY
 count(*) DESC, 1 LIMIT 20"""),
    "t12_processing_types": s(" UNION ALL ".join([kinds("numero_entrada = "
        "numero_digitado", "NUMEROS_IGUALES"), kinds(STRICT, "NUMEROS_DIFERENTES"), kinds("(numero_digitado IS NULL OR numero_digitado = "
        "'')", "NUMERO_DIGITADO_NULO")])),
    "t12_number_relation": s(f"SELECT CASE WHEN numero_entrada = numero_digitado THEN 'IGUALES' ELSE 'DIFERENTES' END AS relacion, count(*) AS "
        f"casos, count(DISTINCT numero_entrada) AS numeros_unicos, {mean('hora_fin_seg - hora_inicio_seg')} AS duracion_promedio FROM c WHERE "
        f"numero_entrada IS NOT NULL AND numero_digitado IS NOT NULL GROUP BY 1"),
    "t13_external_references": s(" UNION ALL ".join([refs(full("cIdentifica"), "CON_CIDENTIFICA"), refs("(cIdentifica IS NULL OR cIdentifica = "
        "'')", "SIN_CIDENTIFICA")])),
    "t14_redirection_profiles": s(f"""u AS (SELECT numero_entrada, count(*) AS n, count(DISTINCT id_CTransferencia) AS dest, count(*) FILTER (WHERE
 {full('id_CTransferencia')}) AS red, count(*) FILTER (WHERE {STRICT}) AS internal, count(*) FILTER (WHERE etiquetas LIKE '%VSI%') AS vsi,
 count(DISTINCT cIdentifica) AS refs, count(*) FILTER (WHERE menu IN ('cte_colgo', 'SinOpcion_Cbc')) AS bad FROM c GROUP BY 1),
p AS (SELECT *, CASE WHEN red > 0 AND dest > 2 THEN 'USUARIO_MULTI_REDIRECCION' WHEN red > 0 THEN 'USUARIO_CON_REDIRECCION' WHEN internal > n * 0.5
 THEN 'USUARIO_PROCESAMIENTO_INTERNO' WHEN vsi > n * 0.8 THEN 'USUARIO_VALIDADO_SISTEMA' WHEN bad > n * 0.5 THEN 'USUARIO_PROBLEMATICO' WHEN refs > 0
 THEN 'USUARIO_CON_REFERENCIAS_EXTERNAS' ELSE 'USUARIO_ESTANDAR' END AS perfil_usuario FROM u)""",
        f"SELECT perfil_usuario, count(*) AS usuarios_en_perfil, {mean('n')} AS promedio_interacciones, {mean_share('red', 'n')} AS "
        f"promedio_pct_con_redireccion, {mean_share('internal', 'n')} AS promedio_pct_procesamiento_interno FROM p GROUP BY 1"),
    "t15_transfer_network": s(f"""SELECT numero_entrada, numero_digitado, count(*) AS frecuencia_transferencia, {lst("menu || ':' || opcion", ', ')}
 AS menus_generadores, {lst("division || '-' || area", ', ')} AS contexto_organizacional, {lst('etiquetas', ' | ')} AS patron_etiquetas,
 count(DISTINCT fecha) AS dias_activos, min(fecha) AS primera_transferencia, max(fecha) AS ultima_transferencia,
 CASE WHEN EXISTS (SELECT 1 FROM c b WHERE b.numero_entrada = a.numero_digitado AND b.numero_digitado = a.numero_entrada) THEN 'SI' ELSE 'NO' END AS
 es_bidireccional FROM c a WHERE {STRICT} AND numero_digitado <> '' GROUP BY 1, 2 {ORD} LIMIT 25"""),
    "t16_redirection_edges": s(f"SELECT numero_entrada AS nodo_origen, id_CTransferencia AS nodo_destino, count(*) AS peso_conexion, count(DISTINCT "
        f"fecha) AS dias_conexion, {lst('menu')} AS menus_generadores, {lst(chr(100) + 'ivision || ' + chr(39) + '-' + chr(39) + ' || area')} AS "
        f"ubicaciones, avg(abs(hora_fin_seg - hora_inicio_seg)) AS duracion_promedio_antes_redireccion FROM c WHERE numero_entrada IS NOT NULL AND "
        f"{full('id_CTransferencia')} GROUP BY 1, 2"),
    "t16_redirection_nodes": s(f"e AS (SELECT numero_entrada AS a, id_CTransferencia AS b, count(*) AS w FROM c WHERE numero_entrada IS NOT NULL "
        f"AND {full('id_CTransferencia')} GROUP BY 1, 2)", "SELECT nodo, max(t) AS tipo_nodo, sum(gs)::BIGINT AS grado_salida, sum(ge)::BIGINT AS "
        "grado_entrada, sum(ps)::BIGINT AS peso_total_salida, sum(pe)::BIGINT AS peso_total_entrada FROM (SELECT a AS nodo, 'USUARIO' AS t, 1 AS "
        "gs, 0 AS ge, w AS ps, 0 AS pe FROM e UNION ALL SELECT b, 'DESTINO', 0, 1, 0, w FROM e) GROUP BY 1"),
    "t17_official_vs_derived": s(I, SES, "SELECT tipo_llamada AS tipo, count(DISTINCT numero_entrada) AS usuarios_unicos, avg(total_interacciones) "
        "AS promedio_interacciones, avg(menus_visitados) AS promedio_menus FROM ses GROUP BY 1"),
    "t17_official_vs_derived_by_zone": s("u AS (SELECT id_8T AS zona, CASE WHEN numero_entrada = numero_digitado THEN 'OFICIAL' ELSE 'DERIVADO' END "
        "AS tipo, numero_entrada, count(*) AS n FROM c WHERE numero_entrada IS NOT NULL AND numero_digitado IS NOT NULL GROUP BY 1, 2, "
        "3)", f"SELECT zona, tipo, count(*) AS usuarios_unicos, {mean('n')} AS promedio_interacciones FROM u GROUP BY 1, 2"),
    "t17_derived_share_by_quarter": s(f"SELECT trimestre, count(*) FILTER (WHERE numero_entrada = numero_digitado) AS oficiales, count(*) FILTER "
        f"(WHERE {STRICT}) AS derivadas, {ratio(f'count(*) FILTER (WHERE {STRICT})', 'count(*)')} AS pct_derivadas FROM c GROUP BY 1"),
    "t18_derived_pairs": s(I, "dv AS (SELECT * FROM i WHERE tipo_llamada = 'DERIVADO')", usage("numero_entrada, "
        "numero_digitado", "dv", "hora_fin_real - hora_inicio_real", 30, 20), "SELECT * FROM b"),
    "t18_derived_pairs_by_zone": s(f"dv AS (SELECT *, id_8T AS zona FROM c WHERE {STRICT})", usage("trimestre, numero_entrada, numero_digitado, "
        "zona", "dv", "hora_fin_seg - hora_inicio_seg", 20, 15), "SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY trimestre ORDER BY "
        "frecuencia_uso DESC, numero_entrada, numero_digitado, zona) <= 20"),
    "t18_suspicious_pairs": s(I, "dv AS (SELECT * FROM i WHERE tipo_llamada = 'DERIVADO')", usage("numero_entrada, "
        "numero_digitado", "dv", "hora_fin_real - hora_inicio_real", 25, 20), f"SELECT numero_entrada, numero_digitado, dias_activos, "
        f"{ratio('frecuencia_uso', 'dias_activos', 2, 1)} AS interacciones_promedio, patron_comportamiento, opciones_usadas FROM b WHERE "
        f"patron_comportamiento <> 'NORMAL'"),
}
SQL["t01_pair_values"] = s(" UNION ".join(
    f"SELECT numero_entrada, numero_digitado, '{name}' AS lista, {value} AS valor FROM c WHERE {KEPT} AND {value} IS NOT NULL"
    for name, value in (("menu_opciones_usadas", "menu || ':' || opcion"), ("etiquetas_patron", "etiquetas"), ("zonas_afectadas", "id_8T"),
                        ("divisiones_areas", "division || '-' || area"))))
SQL["t01_transfer_pairs_by_cells"] = SQL["t01_transfer_pairs"]
