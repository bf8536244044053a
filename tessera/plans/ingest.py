"""Ingest: files to pages, deduplicated by content, redacted, chunked, embedded, stored."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.pii import recognizers, redacted
from tessera.operators.chunking import Embedder, chunk_pages, hashed_embedder
from tessera.operators.store import ChunkStore
from tessera.sources.readers import read_files


def embedded(rows: DataFrame, text_col: str = "text", embed: Embedder = hashed_embedder, prefix: str = "") -> DataFrame:
    """The rows with their unit vector ``v``, made in batches of at most 64 texts.

    Models that were trained so want ``config.QUERY_PREFIX`` before queries.
    """
    names = rows.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 64):
                batch = whole.slice(low, 64)
                vectors = embed([prefix + (t or "") for t in batch.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))], names=[*names, "v"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, v array<double>")


def document_id(content_hash):
    """A document's number from its content: deterministic, so that a replay gives the same."""
    return F.conv(F.substring(content_hash, 1, 15), 16, 10).cast("long")


def ingest(spark: SparkSession, path: str, store: ChunkStore, *, strategies: list[str] | None = None, redact: bool = True, codenames: list[str] | None = None, embed: Embedder = hashed_embedder) -> dict[str, int]:
    """Add all new files under ``path``; returns how many were added, refused as known, and failed.

    A file whose content is stored is refused, also for other strategies. Of equal
    files in one call the first path is taken.
    """
    pages = read_files(spark, path)
    failed = pages.where("error is not null").select("path").distinct().count()
    good = pages.where("error is null")
    first = good.groupBy("content_hash").agg(F.min("path").alias("path"), F.count_distinct("path").alias("copies"))
    held = store.read()
    new = first if held is None else first.join(held.select("content_hash").distinct(), "content_hash", "left_anti")
    text = redacted(F.col("text"), recognizers(codenames)) if redact else F.col("text")
    chosen = good.join(new.select("content_hash", "path"), ["content_hash", "path"], "left_semi").withColumns({"doc_id": document_id(F.col("content_hash")), "text": text})
    added = new.count()
    if added:
        chunks = embedded(chunk_pages(chosen, strategies, embed=embed), embed=embed)
        hashes = chosen.select("doc_id", "content_hash").distinct()
        store.add(chunks.join(hashes, "doc_id"))
    return {"added": added, "refused": good.select("path").distinct().count() - added, "failed": failed}
