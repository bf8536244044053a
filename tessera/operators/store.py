"""The chunk table: deduplication, upsert, deletion, inventory.

Plain Parquet has no merge: an upsert is the old rows without the new keys and the
new rows, written beside the old files of the touched buckets and swapped in by a manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import STRATEGIES
from tessera.functions.text import content_hash
from tessera.operators.commits import Commits, ConflictError, Manifest

RETRIES = 20
KEY = ["doc_id", "strategy", "page", "chunk_idx"]


def with_hash(documents: DataFrame, data_col: str = "text") -> DataFrame:
    return documents.withColumn("content_hash", content_hash(F.col(data_col)))


def first_of_each_content(documents: DataFrame, order_col: str = "doc_id") -> DataFrame:
    """One document of each content, the first; as small an aggregate as possible is shuffled."""
    first = documents.groupBy("content_hash").agg(F.min(order_col).alias("first_id"), F.count("*").alias("copies"))
    return first


def new_documents(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose content is not stored yet, whatever the strategy it was stored with."""
    return documents.join(stored.select("content_hash").distinct(), "content_hash", "left_anti")


def duplicates(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents that are refused, with the document that has their content."""
    held = stored.groupBy("content_hash").agg(F.min("doc_id").alias("existing_id"))
    return documents.join(held, "content_hash")


def upsert(old: DataFrame, new: DataFrame, key: list[str] | None = None) -> DataFrame:
    """All rows after the new ones replaced those of the same key.

    Of new rows of one key the one with the largest ``version`` wins, and without such a
    column, or among equal versions, the one whose other columns sort last.
    """
    key = key or KEY
    rest = [c for c in new.columns if c not in key and c != "version"]
    order = ([F.desc("version")] if "version" in new.columns else []) + [F.desc(c) for c in rest]
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(last)


def without_document(chunks: DataFrame, doc_id) -> DataFrame:
    return chunks.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id)))


def inventory(chunks: DataFrame) -> DataFrame:
    """(doc_id, source, strategies, total_chunks)."""
    return chunks.groupBy("doc_id").agg(F.max("source").alias("source"), F.sort_array(F.collect_set("strategy")).alias("strategies"), F.count("*").alias("total_chunks"))


def counts_by_strategy(chunks: DataFrame) -> DataFrame:
    """(strategy, chunks) with zeros for strategies that have none."""
    every = chunks.sparkSession.createDataFrame([(s,) for s in STRATEGIES], "strategy string")
    return every.join(chunks.groupBy("strategy").agg(F.count("*").alias("chunks")), "strategy", "left").fillna(0, ["chunks"])


def length_stats(chunks: DataFrame, by: str = "strategy") -> DataFrame:
    n = F.length("text")
    return chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.avg(n).alias("avg_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"))


class ChunkStore:
    """Versions of the table under one path; a reader sees the last complete version.

    Chunks are dealt into ``buckets`` by a hash of their document. A version writes only
    the buckets that it changes; its manifest, created last, names the folder that
    holds each bucket, so that an upsert costs what it touches and not the whole table.
    Several writers may work at the same time: one that finds that a bucket it has
    read was changed meanwhile reads it again, others are committed one on top of the other.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.buckets, self.commits = spark, buckets, Commits(spark, path)
        self.path = self.commits.path

    def versions(self) -> list[int]:
        """Numbers of complete versions: those that have a manifest."""
        return self.commits.versions()

    def manifest(self) -> dict[int, str]:
        """Which folder holds each bucket that has chunks."""
        return held_by(self.commits.read()[1])

    def _read(self, manifest: dict[int, str]) -> DataFrame | None:
        out = None
        for folder in sorted(set(manifest.values())):
            paths = [f"{self.path}/{folder}/bucket={b}" for b, f in sorted(manifest.items()) if f == folder]
            part = self.spark.read.option("basePath", f"{self.path}/{folder}").parquet(*paths).drop("bucket")
            out = part if out is None else out.unionByName(part)
        return out

    def read(self) -> DataFrame | None:
        return self._read(self.manifest())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def _replace(self, touched: list[int], make: Callable[[DataFrame | None], DataFrame | None]) -> int:
        """A new version in which the touched buckets hold what ``make`` gives for what they held; 0 if it gives None."""
        for _ in range(RETRIES):
            base, manifest = self.commits.read()
            own = {b: f for b, f in held_by(manifest).items() if b in touched}
            chunks = make(self._read(own))
            if chunks is None:
                return 0
            folder = f"v-{uuid.uuid4().hex}"
            chunks.withColumn("bucket", self._bucket()).write.partitionBy("bucket", "strategy").parquet(f"{self.path}/{folder}")
            made = self.commits.file_system()
            full = {b: folder for b in touched if made.exists(self.commits.hadoop_path(f"{folder}/bucket={b}"))}

            def conflicts(now: Manifest, own=own) -> str | None:
                return None if {b: f for b, f in held_by(now).items() if b in touched} == own else "a bucket was changed by another writer"

            try:
                return self.commits.change(base, lambda now, full=full: {"buckets": {b: f for b, f in held_by(now).items() if b not in touched} | full}, conflicts)
            except ConflictError:
                self.commits.remove(folder)
        raise ConflictError(f"other writers were first {RETRIES} times")

    def add(self, new: DataFrame) -> int:
        """Upsert; returns the new version."""
        touched = [r[0] for r in new.select(self._bucket()).distinct().collect()]  # at most ``buckets``
        return self._replace(touched, lambda old: upsert(new.limit(0) if old is None else old.select(*new.columns), new))

    def delete(self, doc_id) -> int:
        """Remove a document from all strategies; returns how many chunks went."""
        bucket = self.spark.createDataFrame([(doc_id,)], "doc_id long").select(self._bucket()).first()[0]
        gone = 0

        def without(old: DataFrame | None) -> DataFrame | None:
            nonlocal gone
            gone = 0 if old is None else old.where(F.col("doc_id").eqNullSafe(F.lit(doc_id))).count()
            return without_document(old, doc_id) if gone else None

        self._replace([bucket], without)
        return gone

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove folders that none of the last ``keep`` versions names, and older manifests; readers and writers of these must have ended."""
        versions = self.versions()
        used = {f for v in versions[-keep:] for f in held_by(self.commits.read(v)[1]).values()}
        gone = [f for f in self.commits.folders() if f not in used]
        for name in [*gone, *(f"m{v}.json" for v in versions[:-keep])]:
            self.commits.remove(name)
        return gone

    def strategy(self, name: str) -> DataFrame | None:
        """All chunks of one strategy, by partition pruning."""
        if name not in STRATEGIES:
            raise ValueError(f"unknown strategy: {name}")
        held = self.read()
        return None if held is None else held.where(F.col("strategy") == name)


def held_by(manifest: Manifest) -> dict[int, str]:
    return {int(b): folder for b, folder in manifest.get("buckets", {}).items()}
