"""Approximate dense retrieval: coarse cells, codes of residuals, and exact scores for what is left.

K-means over a bounded sample gives cells; what a vector differs from its cell's centre
is coded by the nearest of a few centres in each of several parts (a product quantiser, of
the same sample). Every vector is indexed. A search scores the codes of each query's
nearest cells by table look-up in the tasks, keeps the best few of them for each query, and
scores those again with their vectors in double precision, so that returned scores are exact.

How many cells are probed and how many candidates are scored again is found on a bounded
number of trial queries, whose true neighbours come from one exact scan, for a recall
that is a parameter. Where fewer cells than all cannot reach it, all are probed.

Defined results: vectors that are null, empty, zero, of another length than most, or
that hold a null or non-finite component are not indexed, nor asked with; null ids take
no part; of rows with one id each is a candidate; equal scores go to the smaller id;
cosines below zero count as zero; a query has at most ``k`` rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.bm25 import top_k
from tessera.operators.dense import dense_top_k, keep, unit
from tessera.shared import written

#: Rows of the sample, and queries that trials are made with, at most.
SAMPLE = 16_384
TRIALS = 64
#: Bytes of a part's code: one of 256 centres. Components of a part.
CENTRES = 256
PART = 4
RECALL = 0.95
#: Bytes of query vectors that are handed to every task at once.
QUERY_BYTES = 16_000_000
#: Queries that a task scores at once, each with tables of 2 KB a part; pairs that it holds before it keeps the best of them.
SLICE = 256
PAIRS_HELD = 1_000_000
#: What scores that are kept to nine digits may differ by and be equal.
EQUAL = 1e-8
#: Candidates that are broadcast at most, to be scored again.
BROADCAST_CANDIDATES = 2_000_000
SEED = 7


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Centres by Lloyd's rounds from ``k`` distinct rows; an empty cell takes the row farthest from its centre."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        cell, far = nearest_centres(x, centres)
        counts = np.bincount(cell, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        for empty, row in zip(np.flatnonzero(counts == 0), np.argsort(-far), strict=False):
            centres[empty] = x[row]
    return centres


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, squared distance) of each row, in blocks."""
    cell, far, sizes = np.empty(len(x), np.int64), np.empty(len(x)), (centres**2).sum(axis=1)
    for low in range(0, len(x), 4096):
        d = sizes - 2 * x[low : low + 4096] @ centres.T
        cell[low : low + 4096] = d.argmin(axis=1)
        far[low : low + 4096] = d.min(axis=1) + (x[low : low + 4096] ** 2).sum(axis=1)
    return cell, far


@dataclass(frozen=True)
class Quantiser:
    """Unit vectors to (cell, code): ``centres`` of cells, and for each part of a residual its ``books`` (parts, centres, width)."""

    centres: np.ndarray
    books: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, cells: int) -> Quantiser:
        centres = kmeans(sample, cells)
        residuals = Quantiser._parts(sample - centres[nearest_centres(sample, centres)[0]])
        books = [kmeans(residuals[:, p], CENTRES, seed=SEED + p) for p in range(residuals.shape[1])]
        most = max(map(len, books))
        return Quantiser(centres, np.stack([np.pad(b, ((0, most - len(b)), (0, 0)), constant_values=1e9) for b in books]))

    @staticmethod
    def _parts(x: np.ndarray) -> np.ndarray:
        parts = -(-x.shape[1] // PART)
        return np.pad(x, ((0, 0), (0, parts * PART - x.shape[1]))).reshape(len(x), parts, PART)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, _ = nearest_centres(x, self.centres)
        residuals = self._parts(x - self.centres[cell])
        codes = [nearest_centres(residuals[:, p], book)[0] for p, book in enumerate(self.books)]
        return cell, np.stack(codes, axis=1).astype(np.uint8)

    def probes(self, queries: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` cells of largest inner product with each query, the best first."""
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")[:, :n]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(query, part, centre): inner products of each query's parts with the centres of residuals."""
        books = np.where(np.abs(self.books) < 1e8, self.books, 0.0)
        return np.einsum("qpw,pcw->qpc", self._parts(queries), books)


def matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    return unit(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


class DenseIndex:
    """Codes and vectors of a table, written to the shared folder."""

    def __init__(self, spark: SparkSession, quantiser: Quantiser | None, codes: DataFrame, count: int, dim: int) -> None:
        self.spark, self.quantiser, self.codes, self.count, self.dim = spark, quantiser, codes, count, dim
        self.cells = 0 if quantiser is None else len(quantiser.centres)
        self.sizes = np.zeros(self.cells, np.int64)
        for cell, n in codes.groupBy("cell").count().collect() if quantiser is not None else ():  # one row a cell
            self.sizes[cell] = n

    @staticmethod
    def build(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None) -> DenseIndex:
        spark = vectors.sparkSession
        rows = vectors.select(F.col(id_col).cast("long").alias("chunk_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("chunk_id").isNotNull() & usable(F.col("v")))
        sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        if sizes is None:
            return DenseIndex(spark, None, spark.createDataFrame([], "chunk_id long, v array<double>, cell int, code binary"), 0, 0)
        dim, count = sizes
        rows = rows.where(F.size("v") == dim)
        chance = min(1.0, 2 * SAMPLE / count)
        drawn = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "chunk_id"), 2) <= int((1 << 62) * chance)).orderBy(F.xxhash64(F.lit(SEED), "chunk_id"), "chunk_id").limit(SAMPLE)
        sample = matrix(drawn.select("v").toArrow().combine_chunks()["v"].combine_chunks(), dim)
        wanted = cells or max(1, min(len(sample) // 32, int(4 * np.sqrt(count))))
        shared = spark.sparkContext.broadcast(Quantiser.fit(sample, wanted))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, code = shared.value.encode(matrix(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=["chunk_id", "v", "cell", "code"])

        made = rows.mapInArrow(encode, "chunk_id long, v array<double>, cell int, code binary")
        return DenseIndex(spark, shared.value, written(made.sortWithinPartitions("cell"), "dense-index"), count, dim)

    def search(self, queries: DataFrame, k: int, *, query_id: str = "vec_id", query_vector: str = "embedding", probes: int | None = None, candidates: int | None = None, recall: float = RECALL, skip_self: bool = False) -> DataFrame:
        """(query_id, chunk_id, score, rank) as ``dense_top_k`` gives, of what the probed cells hold; unset numbers are fitted."""
        asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where(F.col("q").isNotNull() & usable(F.col("v")) & (F.size("v") == self.dim))
        if self.quantiser is None:
            return self._none()
        if probes is None or candidates is None:
            probes, candidates = self.fitted(asked, k, recall, skip_self)
        blocks, out = max(1, -(-asked.count() * self.dim * 8 // QUERY_BYTES)), None
        for b in range(blocks):
            some = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow().combine_chunks()
            if some.num_rows:
                found = self._block(some["q"].to_numpy(), matrix(some["v"].combine_chunks(), self.dim), k, probes, candidates, skip_self)
                out = found if out is None else out.union(found)
        return top_k(out, k) if out is not None else self._none()

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")

    def _block(self, ids: np.ndarray, asked: np.ndarray, k: int, probes: int, candidates: int, skip_self: bool) -> DataFrame:
        wanted = self.quantiser.probes(asked, probes).astype(np.int32)
        shared = self.spark.sparkContext.broadcast((ids, asked, wanted, self.quantiser))

        def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, asked, wanted, quantiser = shared.value
            asking = np.argsort(wanted, axis=None, kind="stable")
            ends = np.cumsum(np.bincount(wanted.ravel(), minlength=len(quantiser.centres)))
            asking, best, need = (asking // max(1, wanted.shape[1])).astype(np.int32), None, np.full(len(own), -np.inf)
            rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def kept() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                found = keep(tuple(np.concatenate(c) for c in zip(*rows, strict=True)), best, candidates)
                rows.clear()
                last = np.flatnonzero(np.diff(found[0], append=-1))
                full = last[np.diff(last, prepend=-1) == candidates]
                need[found[0][full]] = found[2][full]
                return found

            for batch in batches:
                chunk, cells = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(chunk), -1)
                for cell in np.unique(cells):
                    at, q = np.flatnonzero(cells == cell), asking[ends[cell - 1] if cell else 0 : ends[cell]]
                    for low in range(0, len(q), SLICE):
                        part = q[low : low + SLICE]
                        tables = quantiser.tables(asked[part])
                        s = (asked[part] @ quantiser.centres[cell])[:, None] + sum(tables[:, p][:, codes[at, p]] for p in range(tables.shape[1]))
                        if skip_self:
                            s[own[part][:, None] == chunk[at][None, :]] = -np.inf
                        least = need[part] - EQUAL
                        if s.shape[1] > candidates:
                            least = np.maximum(least, np.partition(s, -candidates, axis=1)[:, -candidates])
                        r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                        rows.append((part[r], chunk[at[c]], s[r, c]))
                        if sum(len(x[0]) for x in rows) > PAIRS_HELD:
                            best = kept()
            if rows:
                best = kept()
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(best[0].astype(np.int64)), pa.array(best[1]), pa.array(best[2])], names=["query_id", "chunk_id", "score"])

        cells = [int(c) for c in np.unique(wanted)]
        held = self.codes if len(cells) == self.cells else self.codes.where(F.col("cell").isin(cells))
        rough = top_k(held.select("chunk_id", "cell", "code").mapInArrow(approximate, "query_id long, chunk_id long, score double"), candidates)
        pairs = written(rough.select("query_id", "chunk_id"), "candidates")
        if len(ids) * candidates <= BROADCAST_CANDIDATES:
            pairs = F.broadcast(pairs)

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, asked, *_ = shared.value
            for batch in batches:
                q = batch.column(0).to_numpy()
                score = np.maximum(0.0, np.einsum("ij,ij->i", asked[q], matrix(batch.column(2), asked.shape[1]))) if len(q) else np.empty(0)
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), batch.column(1), pa.array(score)], names=["query_id", "chunk_id", "score"])

        scored = held.select("chunk_id", "v").join(pairs, "chunk_id").select("query_id", "chunk_id", "v")
        return scored.mapInArrow(exact, "query_id long, chunk_id long, score double").distinct()

    def fitted(self, asked: DataFrame, k: int, recall: float, skip_self: bool) -> tuple[int, int]:
        """(probes, candidates): the fewest of a growing series with which trial queries find ``recall`` of their true neighbours."""
        trials = written(asked.orderBy(F.xxhash64(F.lit(SEED), "q"), "q").limit(TRIALS), "trials")
        true = {(r[0], r[1]) for r in dense_top_k(self.codes, trials, k, id_col="chunk_id", vector_col="v", query_id="q", query_vector="v", skip_self=skip_self).select("query_id", "chunk_id").collect()}
        if not true:
            return self.cells, 4 * k
        # one search of all cells with many candidates says at which probe each neighbour comes, and at which place
        some = trials.toArrow().combine_chunks()
        ids, vectors = some["q"].to_numpy(), matrix(some["v"].combine_chunks(), self.dim)
        order = self.quantiser.probes(vectors, self.cells)
        place = {int(i): np.argsort(order[row]) for row, i in enumerate(ids)}
        members = {i: c for i, c in self.codes.join(F.broadcast(self.spark.createDataFrame(sorted({(c,) for _, c in true}), "chunk_id long")), "chunk_id").select("chunk_id", "cell").collect()}
        at = np.sort([place[q][members[c]] for q, c in true])
        probes = int(at[min(len(at) - 1, int(np.ceil((1 + recall) / 2 * len(at))) - 1)]) + 1
        candidates = 4 * k
        while True:
            found = self._block(ids, vectors, k, probes, candidates, skip_self)
            hits = sum((r[0], r[1]) in true for r in top_k(found, k).select("query_id", "chunk_id").collect())
            if hits >= recall * len(true) or (probes >= self.cells and candidates >= self.count):
                return probes, candidates
            probes, candidates = min(self.cells, probes + max(1, self.cells // 16)), min(self.count, 2 * candidates)

    def share_read(self, queries: np.ndarray, probes: int) -> float:
        """Which share of all vectors the codes of the probed cells are, on average over unit ``queries``."""
        return float(self.sizes[self.quantiser.probes(queries, probes)].sum(axis=1).mean() / max(1, self.sizes.sum()))


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda c: c != 0)
