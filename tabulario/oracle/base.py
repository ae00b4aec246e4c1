"""Text helpers of the DuckDB oracle statements."""


def q(*parts: str) -> str:
    """`WITH` list (all but the last part) and final SELECT."""
    *ctes, body = parts
    return ("WITH " + ",\n".join(c.strip() for c in ctes) + "\n" if ctes else "") + body.strip()


def ratio(num: str, den: str, digits: int = 2, scale: int = 100) -> str:
    """Integer form of a rounded quotient, half away from zero."""
    k = scale * 10**digits
    return (
        f"(sign({num}) * ((2 * abs(({num})::HUGEINT) * {k} + ({den})) // nullif(2 * ({den})::HUGEINT, 0))::DOUBLE / {10**digits}.0)"
    )


def mean(col: str, digits: int = 2) -> str:
    return ratio(f"sum({col})", f"count({col})", digits, 1)


def share(cond: str, digits: int = 2) -> str:
    return ratio(f"count(*) FILTER (WHERE {cond})", "count(*)", digits)


def variance(col: str) -> str:
    s = f"({col})::HUGEINT"
    return (
        f"((count({col})::HUGEINT * sum({s} * {s}) - sum({s}) * sum({s}))::DOUBLE"
        f" / nullif((count({col})::HUGEINT * count({col})::HUGEINT)::DOUBLE, 0))"
    )


def deviation(col: str) -> str:
    return f"sqrt({variance(col)})"


def figure(value: str) -> str:
    return f"CASE WHEN ({value}) IS NOT NULL THEN printf('%.11e', {value})::DOUBLE END"


def mean_of_rounded(col: str, digits: int = 2, places: int = 2) -> str:
    return ratio(f"sum(round(({col}) * {10**places})::BIGINT)", f"count({col}) * {10**places}", digits, 1)


def mean_share(part: str, whole: str, digits: int = 1) -> str:
    return mean_of_rounded(ratio(part, whole, 4), digits, 4)


def big(expr: str) -> str:
    return f"({expr})::BIGINT"


SALES_PERIODS = """per(trimestre, inicio, fin, orden) AS (VALUES
 ('Q01_95', DATE '1995-01-01', DATE '1995-03-31', 1), ('Q02_95', DATE '1995-04-01', DATE '1995-06-30', 2),
 ('Q03_95', DATE '1995-07-01', DATE '1995-09-30', 3))"""

LOG_PERIODS = """per(trimestre, inicio, fin, orden) AS (VALUES
 ('Q01_24', DATE '2024-01-01', DATE '2024-01-10', 1), ('Q02_24', DATE '2024-01-11', DATE '2024-01-20', 2),
 ('Q03_24', DATE '2024-01-21', DATE '2024-01-30', 3))"""

VENTAS = """ventas AS (SELECT cast(l.l_shipdate AS DATE) AS fechaTabla,
 CASE l.l_returnflag WHEN 'A' THEN 123 WHEN 'R' THEN 369 ELSE 999 END AS cIDR,
 CASE WHEN p.p_size % 10 = 0 THEN '' WHEN p.p_size % 10 = 7 THEN 'sin categoria' WHEN p.p_size % 10 = 3 THEN NULL
  WHEN p.p_size % 10 = 5 THEN '  ' ELSE concat(p.p_brand, '-', cast(p.p_size AS VARCHAR)) END AS categoria,
 cast(l.l_partkey AS VARCHAR) AS producto_id
 FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

EV = "ev AS (SELECT event_id, user_id, ts, event_type, value, cast(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events)"

PRODUCTOS = EV + """,
productos AS (SELECT CASE WHEN k % 25 = 0 THEN NULL WHEN k % 25 = 1 THEN -1 ELSE cast(floor(value * 150000) AS BIGINT) END AS cProducto,
 user_id AS cIDT,
 CASE WHEN k % 20 = 0 THEN NULL WHEN k % 20 = 1 THEN '' WHEN k % 20 = 2 THEN ' ' WHEN k % 20 = 3 THEN 'N/A' ELSE event_type END AS cCategoria,
 CASE WHEN k % 30 = 0 THEN NULL ELSE k % 2 END AS cSeleccion,
 CASE WHEN k % 30 = 1 THEN NULL WHEN k % 6 = 5 THEN 0 WHEN k % 6 = 4 THEN 1 ELSE k % 2 END AS cIOT,
 ts AS cFecha,
 cast(hour(ts)*3600 + minute(ts)*60 + second(ts) AS INT) AS cHInicio_seg,
 cast(hour(ts)*3600 + minute(ts)*60 + second(ts) + (CASE WHEN k % 9 = 0 THEN -1 ELSE 1 END) * cast(floor(value * 20) AS INT) AS INT) AS cHFin_seg
 FROM ev)"""

LLAMADAS = EV + """,
llamadas AS (SELECT event_id AS idRe,
 CASE WHEN k = 99 THEN NULL ELSE cast(2185000000 + user_id AS VARCHAR) END AS numero_entrada,
 CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 <= 3 THEN cast(2185000000 + user_id + k % 7 - 3 AS VARCHAR) ELSE cast(2185000000 + user_id AS VARCHAR)
 END AS numero_digitado,
 CASE event_type WHEN 'click' THEN (CASE WHEN k % 2 = 0 THEN 'RES-SP_2024' ELSE 'RES-ContratacionIfm_2024' END)
   WHEN 'view' THEN (CASE k % 4 WHEN 0 THEN 'SDO' WHEN 1 THEN 'DASHBOARD' WHEN 2 THEN 'SELECCION' ELSE 'PROCESO' END)
   WHEN 'purchase' THEN (CASE WHEN k % 3 = 0 THEN 'comercial_11' ELSE 'comercial_5' END)
   WHEN 'error' THEN (CASE k % 3 WHEN 0 THEN 'cte_colgo' WHEN 1 THEN 'SinOpcion_Cbc' ELSE 'Desborde_Cabecera' END)
   ELSE (CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN 'CONFIRMACION' ELSE 'INICIO' END) END AS menu,
 CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN 'DEFAULT' WHEN 2 THEN '2L' WHEN 3 THEN 'TELCO' WHEN 4 THEN '5' WHEN 5 THEN NULL ELSE 'NoTmx_SOMC' END AS
 opcion,
 CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN NULL WHEN event_type = 'click' THEN (CASE WHEN k % 7 = 2 THEN '2L,ZMB,VSI,NVS,' ELSE
 '1L,ZMB,NOBOT,VSI,' END)
   WHEN event_type = 'error' THEN (CASE WHEN k % 7 = 6 THEN 'NoTmx_SOMC,NoTmx_SOMC,' ELSE '' END)
   WHEN k % 7 = 3 THEN 'ZMB,WTS,TELCO,,' ELSE 'ZMB,MGC' END AS etiquetas,
 CASE WHEN k % 6 = 0 THEN cast(9000 + k % 4 AS VARCHAR) WHEN k % 6 = 1 THEN '' ELSE NULL END AS id_CTransferencia,
 cast(ts AS DATE) AS fecha,
 cast(hour(ts)*3600 + minute(ts)*60 + second(ts) AS INT) AS hora_inicio_seg,
 cast(hour(ts)*3600 + minute(ts)*60 + second(ts) + (CASE WHEN k % 9 = 0 THEN -1 ELSE 1 END) * cast(floor(value) AS INT) AS INT) AS hora_fin_seg,
 concat('Z', cast(user_id % 8 AS VARCHAR)) AS id_8T,
 CASE user_id % 3 WHEN 0 THEN 'NORTE' WHEN 1 THEN 'SUR' ELSE 'CENTRO' END AS division,
 concat('AREA_', cast(user_id % 7 AS VARCHAR)) AS area,
 CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN 'X12' ELSE cast(380000000000 + event_id AS VARCHAR) END AS cIdentifica,
 CASE WHEN k % 8 = 0 THEN NULL ELSE concat('MQ', cast(2185000000 + user_id AS VARCHAR)) END AS nidMQ
 FROM ev)"""

CRUDAS = EV + """,
cr AS (SELECT CASE WHEN dd < DATE '2024-01-11' THEN 'Q01_24' WHEN dd < DATE '2024-01-21' THEN 'Q02_24' ELSE 'Q03_24' END AS trimestre,
 CASE WHEN k % 50 = 21 THEN event_id % 1000 ELSE event_id END AS idRe,
 CASE k WHEN 99 THEN NULL WHEN 98 THEN '0000000' WHEN 97 THEN '123' WHEN 96 THEN 'ABC123' WHEN 95 THEN '' ELSE cast(2185000000 + user_id AS VARCHAR)
 END AS numero_entrada,
 CASE WHEN k % 10 = 0 THEN NULL WHEN k = 11 THEN '' WHEN k = 12 THEN '12' WHEN k = 13 THEN '12-34-56' ELSE cast(2185000000 + user_id + k % 7 - 3 AS
 VARCHAR) END AS numero_digitado,
 CASE k % 12 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'cte_colgo' WHEN 3 THEN 'SDO' ELSE event_type END AS menu,
 CASE WHEN k % 7 = 0 THEN '' ELSE cast(k % 7 AS VARCHAR) END AS opcion,
 CASE k % 6 WHEN 0 THEN cast(9000 + k % 4 AS VARCHAR) WHEN 1 THEN '' WHEN 2 THEN 'EXT-1' ELSE NULL END AS id_CTransferencia,
 CASE k WHEN 13 THEN '31/02/2024' WHEN 14 THEN 'sin fecha' WHEN 15 THEN '01/01/2031' ELSE strftime(ts, '%d/%m/%Y') END AS fecha,
 CASE user_id % 3 WHEN 0 THEN 'NORTE' WHEN 1 THEN 'SUR' ELSE 'CENTRO' END AS division, concat('AREA_', cast(user_id % 7 AS VARCHAR)) AS area,
 CASE WHEN k % 50 = 17 THEN strftime(ts, '%d/%m/%Y') ELSE '01/01/1900' END AS base_inicio, ini, fin,
 concat('Z', cast(user_id % 8 AS VARCHAR)) AS id_8T, CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN NULL ELSE 'ZMB,MGC' END AS etiquetas,
 CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'X12' ELSE cast(380000000000 + event_id AS VARCHAR) END AS cIdentifica,
 cast(ts AS DATE) + CASE WHEN k % 10 = 3 THEN 1 ELSE 0 END AS insertado,
 CASE WHEN k % 8 = 0 THEN NULL ELSE concat('MQ', cast(2185000000 + user_id AS VARCHAR)) END AS nidMQ
 FROM (SELECT *, cast(ts AS DATE) - CASE WHEN k = 22 THEN 10 ELSE 0 END AS dd, cast(hour(ts)*3600 + minute(ts)*60 + second(ts) AS INT) AS ini,
  cast(((hour(ts)*3600 + minute(ts)*60 + second(ts) + (CASE WHEN k % 9 = 0 THEN -1 ELSE 1 END) * cast(floor(value) AS INT)) % 86400 + 86400) % 86400
 AS INT) AS fin FROM ev)),
crudas AS (SELECT *, try_strptime(fecha, '%d/%m/%Y')::DATE AS dia, fin < ini AS invertido,
 format('{} {:02d}:{:02d}:{:02d}', base_inicio, ini // 3600, ini // 60 % 60, ini % 60) AS hora_inicio FROM cr)"""
