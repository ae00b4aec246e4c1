"""The driver's tables for tests."""

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")
