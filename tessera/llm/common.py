"""Session, storage and column helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which alone separates words in the contracts.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


#: Spark's switch to delete the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The folder that serves where the session names none; made at most once in a driver.
_OWN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is read from ``spark.checkpoint.dir``; only where that is unset (one
    machine, as in tests) a folder of our own is made, remembered, and removed at
    the end.
    """
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
    """A fresh path in the shared folder, below one folder an application, which may be deleted as a whole after it."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    It cuts the lineage in a way that outlives lost executors: the files are
    committed by Spark's output protocol in storage that all machines share.
    The shuffle files of the write go with its end, not when the driver happens to
    collect its garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for frame in frames:
        spark, files = frame.sparkSession, frame.inputFiles()
        folders = {f.rpartition("/")[0] for f in files}
        for folder in folders:
            if f"/{spark.sparkContext.applicationId}/" in folder:
                at = spark._jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def rows_of(frame: DataFrame, bound: int) -> bool:
    """Whether ``frame`` has at most ``bound`` rows, counted up to the bound only."""
    return frame.limit(bound + 1).count() <= bound


def small(frame: DataFrame, bound: int) -> DataFrame:
    """``frame`` with a broadcast hint if it has at most ``bound`` rows, else as it is."""
    return F.broadcast(frame) if rows_of(frame, bound) else frame


def within_bytes(rows: DataFrame, turn: Column, text: Column, most: int) -> DataFrame:
    """Of sampled ``rows`` those that come first by ``turn`` (a hash of the id) and take at most ``most`` bytes in all.

    Rows of one turn go together; where they take more than a sixteenth of that, as a
    very long text or an id that many rows share, they are not sampled. Turns must be few
    enough for the driver.
    """
    sizes = rows.where(turn.isNotNull()).groupBy(turn.alias("turn")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64).alias("size"))
    left, end, large = most, None, []
    for at, size in sorted(tuple(r) for r in sizes.collect()):
        if 16 * size > most:
            large.append(at)
            continue
        left -= size
        if left < 0:
            end = at
            break
    kept = rows.where(turn.isNotNull())
    kept = kept.where(~turn.isin(large)) if large else kept
    return kept if end is None else kept.where(turn < end)
