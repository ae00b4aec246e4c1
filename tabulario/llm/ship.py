"""What the operators need of an application: the package on its workers, and batches of a modest size."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
DEFAULT_ROWS, OWN_ROWS = "10000", "1000"


def send_package(spark: SparkSession) -> None:
    """Send the library's modules to the workers, once per application; they import functions by name.

    Rows are whole texts, so batches of Arrow's default number of rows would be
    tens of megabytes on both sides; where that is not set, a tenth is taken.
    """
    if spark.conf.get(BATCH_ROWS) == DEFAULT_ROWS:
        spark.conf.set(BATCH_ROWS, OWN_ROWS)
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    place = os.path.join(tempfile.mkdtemp(prefix="modules-"), "tabulario_modules.zip")
    with zipfile.ZipFile(place, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(place)
    _SENT.add(context.applicationId)
