"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution does the run-time part: it merges small shuffle partitions,
# splits skewed join partitions and turns a join into a broadcast once a side has
# proved to be small. Many initial partitions keep each one within task memory.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
}


def cluster_session(name: str = "tabulario", checkpoint_dir: str | None = None, **more: str) -> SparkSession:
    """Session with CLUSTER_CONF for a master given by the submission; `more` overrides single settings (dots as __)."""
    builder = SparkSession.builder.appName(name).config(map=CLUSTER_CONF | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.config("spark.checkpoint.dir", checkpoint_dir) if checkpoint_dir else builder).getOrCreate()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", name: str = "tabulario") -> SparkSession:
    """Single-process session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
