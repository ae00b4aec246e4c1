"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a single-process session without the setting gets one of its own."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="shared-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


class Workspace:
    """Tables of one call of an operator, removed when the driver's file systems close.

    A table is written once and read by every later step, so a lost executor
    costs only the tasks that it was running.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/tabulario-{uuid.uuid4().hex}"
        self._files(self.folder).deleteOnExit(self._path(self.folder))

    def _path(self, place: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)

    def _files(self, place: str):
        return self._path(place).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write the rows and read them back."""
        place = f"{self.folder}/{name}"
        df.write.parquet(place)
        return self.spark.read.schema(df.schema).parquet(place)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            place = f"{self.folder}/{name}"
            self._files(place).delete(self._path(place), True)
