"""The folder that the driver and all executors see, and tables written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder that serves where the session names none; made at most once in a driver.
_OWN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset, on one machine, a folder of our own, removed at the end."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="tessera-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        root = f"file://{_OWN[0]}"
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path, below one folder an application, which may be deleted as a whole after it."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: the lineage ends in files that outlive executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
