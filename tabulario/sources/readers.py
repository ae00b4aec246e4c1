"""Reading quarterly tables from files, the catalog or a database."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabulario.sources.calls import union_quarters
from tabulario.sources.schemas import conform

FILE_FORMATS = ("parquet", "orc", "csv", "json")


def read_table(spark: SparkSession, source: str, schema: StructType | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """A file set (`fmt` of FILE_FORMATS) or a catalog table (`fmt="table"`), conformed to `schema`.

    Text formats need the schema: it is never inferred, which would read the data twice.
    """
    if fmt == "table":
        df = spark.table(source)
    elif fmt not in FILE_FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    elif fmt in ("csv", "json"):
        if schema is None:
            raise ValueError(f"{fmt} needs a schema")
        if fmt == "csv":
            options = {"header": "true", **options}
        return spark.read.format(fmt).schema(schema).options(**options).load(source)
    else:
        df = spark.read.format(fmt).options(**options).load(source)
    return df if schema is None else conform(df, schema)


def read_jdbc(
    spark: SparkSession, url: str, table: str, schema: StructType, split: tuple[str, int, int], partitions: int, properties: Mapping[str, str]
) -> DataFrame:
    """A live database table, read in parallel ranges of a numeric column (name, lower, upper)."""
    column, lower, upper = split
    df = spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=dict(properties))
    return conform(df, schema)


def read_quarters(spark: SparkSession, sources: Mapping[str, str], schema: StructType, fmt: str = "parquet", **options) -> DataFrame:
    """Several structurally equal tables as one dataset with a `trimestre` column.

    The label is a constant per branch, so a filter on `trimestre` skips the
    other tables altogether.
    """
    return union_quarters({label: read_table(spark, source, schema, fmt, **options) for label, source in sources.items()})


def read_partitioned(spark: SparkSession, path: str, trimestres: list[str] | None = None) -> DataFrame:
    """A dataset written by `write_partitioned`; only the wanted quarters are listed and read."""
    df = spark.read.parquet(path)
    return df if trimestres is None else df.where(F.col("trimestre").isin(*trimestres))
