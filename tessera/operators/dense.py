"""Exact dense retrieval: cosine of every query with every vector, best k of each.

The query side is broadcast in blocks of a checked size, one scan of the vectors a
block, and compared by an Arrow function, so that no pair of rows is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.bm25 import top_k
from tessera.operators.posting_blocks import EQUAL

#: Bytes of query vectors that are handed to every task at once.
QUERY_BYTES = 64_000_000
#: Pairs that a task gathers, at least, before it keeps the best of each query: sorting them at every batch would cost queries x batches.
PAIRS_HELD = 1_000_000


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "vec_id", query_vector: str = "embedding", allowed: DataFrame | None = None, skip_self: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): scores are cosines, not below 0.

    ``allowed`` (chunk_id) restricts the candidates before the best are taken.
    Vectors of another length than the query's are no candidates.
    """
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where(F.col("q").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    out = None
    for (dim,), n in sorted(((r[0],), r[1]) for r in asked.groupBy(F.size("v")).count().collect()):  # vectors of one length meet their like
        blocks = -(-n * dim * 8 // QUERY_BYTES)
        for b in range(blocks):
            some = asked.where((F.size("v") == dim) & (F.pmod(F.xxhash64("q"), F.lit(blocks)) == b))
            found = _top_of_block(vectors, some.toArrow().combine_chunks(), dim, k, id_col, vector_col, allowed, skip_self)
            out = found if out is None else out.union(found)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double, rank int")


def _top_of_block(vectors: DataFrame, rows: pa.Table, dim: int, k: int, id_col: str, vector_col: str, allowed: DataFrame | None, skip_self: bool) -> DataFrame:
    ids = rows.column(0).to_numpy()
    matrix = unit(rows.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)) if len(ids) else np.zeros((0, dim))
    base = vectors.select(F.col(id_col).alias("chunk_id"), F.col(vector_col).alias("v")).where(F.col("chunk_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") == matrix.shape[1]))
    if allowed is not None:
        base = base.join(allowed, "chunk_id", "left_semi")
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = nearest(batches, *shared.value, k, skip_self)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names=["query_id", "chunk_id", "score"])

    found = base.mapInArrow(score, "query_id long, chunk_id long, score double") if len(ids) else vectors.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double")
    return top_k(found, k)


def nearest(batches: Iterable[pa.RecordBatch], own: np.ndarray, asked: np.ndarray, k: int, skip_self: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(query ids, chunk ids, scores): the k best vectors of the batches (id, vector) for each of the unit rows ``asked``."""
    best: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    need, rows, held = np.full(len(own), -np.inf), [], 0  # what a further vector must reach; pairs since ``best`` was made

    def kept() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = keep(tuple(np.concatenate(c) for c in zip(*rows, strict=True)), best, k)
        rows.clear()
        last = np.flatnonzero(np.diff(found[0], append=-1))
        full = last[np.diff(last, prepend=-1) == k]
        need[found[0][full]] = found[2][full]
        return found

    for batch in batches:
        chunk = batch.column(0).to_numpy()
        v = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(chunk), -1))
        for low in range(0, len(own), 1024):
            s = np.maximum(0.0, asked[low : low + 1024] @ v.T)
            if skip_self:
                s[own[low : low + 1024, None] == chunk[None, :]] = -1.0
            least = need[low : low + 1024] - EQUAL
            if s.shape[1] > k and np.isinf(least).any():
                least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k] - EQUAL)
            q, c = np.nonzero(s >= np.maximum(least, 0)[:, None])
            rows.append((low + q, chunk[c], s[q, c]))
            held += len(q)
            if held > max(PAIRS_HELD, 2 * k * len(own)):
                best, held = kept(), 0
        if best is None and rows:  # bounds for all further batches
            best, held = kept(), 0
    if rows:
        best = kept()
    return None if best is None else (own[best[0]], best[1], best[2])


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def keep(new: tuple, old: tuple | None, k: int) -> tuple:
    """The k best of each query among both, ties to the smaller id."""
    q, c, s = new if old is None else tuple(np.concatenate(p) for p in zip(old, new, strict=True))
    order = np.lexsort((c, -np.round(s, 9), q))
    q, c, s = q[order], c[order], s[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return q[place < k], c[place < k], s[place < k]
