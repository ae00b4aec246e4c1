"""Input schemas of the three table families."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(ddl: str) -> T.StructType:
    """Schema of simple columns; unlike `fromDDL` it needs no running session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in ddl.split(","))])


VENTAS = _schema("fechaTabla date, cIDR int, categoria string, producto_id string")
PRODUCTOS = _schema(
    "cProducto bigint, cIDT bigint, cCategoria string, cSeleccion int, cIOT int, "
    "cFecha timestamp_ntz, cHInicio_seg int, cHFin_seg int"
)
LLAMADAS = _schema(
    "idRe bigint, numero_entrada string, numero_digitado string, menu string, opcion string, "
    "id_CTransferencia string, cIdentifica string, nidMQ string, fecha date, "
    "hora_inicio_seg int, hora_fin_seg int, id_8T string, division string, area string, etiquetas string"
)
# Raw call log as delivered: dates and times are text.
LLAMADAS_CRUDAS = _schema(
    "idRe bigint, numero_entrada string, numero_digitado string, menu string, opcion string, "
    "id_CTransferencia string, fecha string, division string, area string, hora_inicio string, "
    "hora_fin string, id_8T string, etiquetas string, cIdentifica string, fecha_inserta string, nidMQ string"
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast the columns of `schema`; fail early when one is missing."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])
