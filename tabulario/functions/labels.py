"""The comma list of labels as an array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_list(col: Column) -> Column:
    """Label text without surrounding blanks and trailing commas; NULL when there is none."""
    return F.nullif(F.rtrim(F.trim(col), F.lit(",")), F.lit(""))


def entries(col: Column) -> Column:
    """Array of (etiqueta, posicion) with blank entries removed; positions count them."""
    parts = F.split(clean_list(col), ",")
    numbered = F.transform(parts, lambda x, i: F.struct(F.trim(x).alias("etiqueta"), (i + 1).alias("posicion")))
    return F.filter(numbered, lambda e: e["etiqueta"] != "")


def comma_count(col: Column) -> Column:
    """Entries of the raw list, the empty one after a trailing comma included."""
    return F.size(F.split(col, ","))
