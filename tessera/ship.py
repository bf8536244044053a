"""Prepares a session: sends this package to the executors, and keeps Arrow batches of texts small."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows of an Arrow batch where the session has Spark's default: texts may have 100 KB and more.
BATCH_ROWS, DEFAULT_ROWS = "2500", "10000"


def ship(spark: SparkSession) -> None:
    """Add the package once to the Python files of this application."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == DEFAULT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tessera-ship-")) / "tessera_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, Path(package.name) / path.relative_to(package))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
