"""Parametric reports as SQL table functions over a call log in the catalog.

`register(spark, table)` makes temporary functions that return tables, so that
SQL users call a report with its parameters and can join or filter the result.
The bodies are plain SQL, planned with the calling query: a filter or a column
that the caller leaves out reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_KNOWN = "numero_entrada IS NOT NULL AND numero_digitado IS NOT NULL AND numero_entrada != numero_digitado"

# Name, parameters, result columns, body; {log} is the table. A NULL parameter does not restrict.
FUNCTIONS = {
    "transfer_pairs": (
        "cuantos INT, tabla STRING",
        "numero_entrada STRING, numero_digitado STRING, frecuencia_combinacion BIGINT, dias_activos BIGINT, primera_aparicion DATE, ultima_aparicion DATE",
        f"""SELECT numero_entrada, numero_digitado, n, d, a, b FROM (
 SELECT *, row_number() OVER (ORDER BY n DESC, numero_entrada, numero_digitado) AS lugar FROM (
  SELECT numero_entrada, numero_digitado, count(*) AS n, count(DISTINCT fecha) AS d, min(fecha) AS a, max(fecha) AS b FROM {{log}}
  WHERE {_KNOWN} AND (tabla IS NULL OR trimestre = tabla) GROUP BY numero_entrada, numero_digitado))
WHERE lugar <= cuantos""",
    ),
    "appearances": (
        "entrada STRING, digitado STRING", "primera DATE, ultima DATE, veces BIGINT",
        "SELECT min(fecha), max(fecha), count(*) FROM {log} WHERE numero_entrada = entrada AND numero_digitado <=> digitado",
    ),
    "label_search": (
        "un_menu STRING, una_opcion STRING, una_etiqueta STRING, cuantos INT",
        "menu STRING, opcion STRING, etiquetas STRING, frecuencia BIGINT",
        """SELECT menu, opcion, etiquetas, n FROM (
 SELECT *, row_number() OVER (ORDER BY n DESC, menu NULLS FIRST, opcion NULLS FIRST, etiquetas NULLS FIRST) AS lugar FROM (
  SELECT menu, opcion, etiquetas, count(*) AS n FROM {log}
  WHERE (un_menu IS NULL OR menu = un_menu) AND (una_opcion IS NULL OR opcion = una_opcion) AND (una_etiqueta IS NULL OR contains(etiquetas, una_etiqueta))
  GROUP BY menu, opcion, etiquetas))
WHERE lugar <= cuantos""",
    ),
    "quality_of": (
        "tabla STRING", "trimestre STRING, registros BIGINT, invertidos BIGINT, sin_numero BIGINT, sin_menu BIGINT",
        """SELECT trimestre, count(*), count_if(hora_fin_seg < hora_inicio_seg), count_if(numero_entrada IS NULL), count_if(menu IS NULL)
FROM {log} WHERE tabla IS NULL OR trimestre = tabla GROUP BY trimestre""",
    ),
}


def register(spark: SparkSession, table: str) -> list[str]:
    """Make the functions over a table or view of calls with their `trimestre`; returns their names."""
    for name, (parameters, columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body.format(log=table)}")
    return list(FUNCTIONS)
