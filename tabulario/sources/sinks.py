"""Writing results and named derived datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("trimestre",), mode: str = "overwrite") -> None:
    """Parquet files in one folder per key.

    Rows are not moved to one task per key: every task writes its share of each
    folder, so a dominating quarter stays spread over the cluster.
    """
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_bucketed(
    df: DataFrame, table: str, buckets: int, by: Sequence[str] = ("numero_entrada", "fecha"), path: str | None = None, mode: str = "overwrite"
) -> None:
    """Catalog table bucketed by session, so that later session groupings on it need no shuffle."""
    writer = df.write.mode(mode).bucketBy(buckets, *by).sortBy(*by)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Register a derived dataset under a name for SQL users."""
    df.createOrReplaceTempView(name)
    return df


class TableStore:
    """Named Parquet tables in a folder that all machines see, for scripts whose statements share a derived table.

    A table is written once and read by every later statement, so nothing
    upstream of it runs again, neither for the next report nor after a lost
    executor.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def replace(self, name: str, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """Write the rows as the whole table and read them back."""
        df.write.mode("overwrite").partitionBy(*by).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def replace_parts(self, name: str, df: DataFrame, by: Sequence[str]) -> DataFrame:
        """Write the rows in place of the partitions that they belong to; other partitions keep their files."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))
