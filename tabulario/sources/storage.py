"""Where derived tables of a session are stored."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from tabulario.sources.sinks import TableStore

CHECKPOINT_DIR = "spark.checkpoint.dir"


def session_store(spark: SparkSession) -> TableStore:
    """A store of its own in the folder that the cluster shares, removed when the driver ends.

    A single-process session without that setting gets a temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tables-")
    place = f"{folder.rstrip('/')}/tables-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return TableStore(spark, place)
