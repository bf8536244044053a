"""Whitening of embeddings with eigenvectors by cyclic Jacobi rotations.

Entries become integers, equal vectors are taken once, and each task adds up what it
holds of them: first their exact sums, then, with the mean known, the centred scatter.
The covariance is small (dimensions squared) and goes to the driver, which turns it by
symmetric Jacobi rotations, half the dimensions at once in the order of a tournament,
until all off-diagonals vanish. That keeps small eigenvalues accurate. The sorted and
scaled eigenvectors are broadcast (dimensions x components numbers), every row is
projected on them, and one more pass over the distinct vectors gives the covariance of
the result.

Defined results: vectors that are null or hold a null or non-finite entry give no rows;
shorter vectors end in zeros; an entry beyond 2**40 steps is set to that; repeated rows
and rows with equal or null ids are each whitened; a component without variance (an
eigenvalue of at most 1e-12 of the largest) has null for ``whitened`` and no part in
``identity_error``, which is null if no component has variance; ``explained`` is null
where the trace is zero; ``deviation`` is null beyond 64 bits; with fewer dimensions
than components, there are as many components as dimensions; equal eigenvalues and signs
of components are fixed by the rotations, alike for all rows; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.vectors import floors, longest, pack, padded, rows_of_lists, unpack

STEPS = 64
#: Integers beyond it are set to it, so that sums of many stay exact in 64 bits.
MOST = 2**40
COMPONENTS = 16
#: Rows that are multiplied at once.
BLOCK = 8192
FIELDS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def tournament(dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs that together hold every pair of 0 .. dim - 1 once."""
    players = list(range(dim + dim % 2))
    for _ in range(len(players) - 1):
        left, right = np.array(players[: len(players) // 2]), np.array(players[: len(players) // 2 - 1 : -1])
        real = (left < dim) & (right < dim)
        yield np.minimum(left, right)[real], np.maximum(left, right)[real]
        players = [players[0], players[-1], *players[1:-1]]


def jacobi(symmetric: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, by falling eigenvalue."""
    a, v = symmetric.astype(np.float64).copy(), np.eye(len(symmetric))
    tiny = np.finfo(np.float64).eps
    for _ in range(sweeps):
        turned = False
        for p, q in tournament(len(a)):
            off, low, high = a[p, q], a[p, p], a[q, q]
            turn = np.abs(off) > tiny * np.sqrt(np.abs(low * high)) / 4
            turn &= np.abs(off) > np.finfo(np.float64).tiny
            if not turn.any():
                continue
            turned = True
            p, q, off, low, high = p[turn], q[turn], off[turn], low[turn], high[turn]
            half = (high - low) / (2 * off)
            t = np.where(half < 0, -1.0, 1.0) / (np.abs(half) + np.hypot(1.0, half))
            c = 1 / np.sqrt(1 + t * t)
            s = t * c
            rows_p, rows_q = a[p], a[q]
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            for m in (a, v):
                columns_p, columns_q = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * columns_p - s * columns_q, s * columns_p + c * columns_q
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    order = np.argsort(-a.diagonal(), kind="stable")
    return a.diagonal()[order], v[:, order]


def summed(rows: DataFrame, of: Callable[[pa.Array], np.ndarray], size: int, kind: str) -> np.ndarray:
    """Entry-wise sum over all tasks of what ``of`` gives for each batch of packed vectors: an array of ``size`` numbers.

    Each task gives one row an entry, which Spark adds up before and after its shuffle.
    """
    dtype = np.int64 if kind == "long" else np.float64

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                total += of(batch.column(0).slice(at, BLOCK))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "amount"])

    out = np.zeros(size, dtype)
    for at, amount in rows.select("x").mapInArrow(add, f"at long, amount {kind}").groupBy("at").agg(F.sum("amount")).collect():
        out[at] = amount
    return out


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, steps: int = STEPS) -> DataFrame:
    """One row a vector and component: its number, ``n``, ``deviation``, the whitened value, the share explained and the error.

    Entries are counted in ``steps`` to one. A shift that is the same for all entries, to make them positive, would
    cancel from every result, so there is none.
    """
    spark = vectors.sparkSession
    chosen = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    dim = longest(chosen, F.col("v"))
    if not dim:
        return spark.createDataFrame([], FIELDS)

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, lengths, values = rows_of_lists(batch.column(1))
            x = padded(floors(values, steps, MOST), lengths, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(usable)), pa.array(pack(x), pa.binary())], names=["vec_id", "x"])

    rows = chosen.mapInArrow(integers, "vec_id long, x binary")
    fit = written(rows.select("x").distinct(), "distinct-vectors")
    n = fit.count()
    if not n:
        return spark.createDataFrame([], FIELDS)
    sums = summed(fit, lambda x: unpack(x, dim).sum(axis=0), dim, "long")
    mean = sums / n

    def scatter(x: pa.Array) -> np.ndarray:
        y = unpack(x, dim) - mean
        return (y.T @ y).ravel()

    covariance = summed(fit, scatter, dim * dim, "double").reshape(dim, dim) / n
    values, turned = jacobi((covariance + covariance.T) / 2)
    shown = min(components, dim)
    varied = int((values[:shown] > 1e-12 * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    matrix = spark.sparkContext.broadcast(turned[:, :varied] / np.sqrt(values[:varied]))
    trace = float(covariance.trace())

    def spread(x: pa.Array) -> np.ndarray:
        w = (unpack(x, dim) - mean) @ matrix.value
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    error = None
    if varied:
        found = summed(fit, spread, varied * (varied + 1), "double") / n
        error = float(np.abs(found[varied:].reshape(varied, varied) - np.outer(found[:varied], found[:varied]) - np.eye(varied)).max())
    shares = [float(e) / trace if trace > 0 else None for e in values[:shown]]
    total = [int(s) for s in sums]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = unpack(batch.column(1).slice(at, BLOCK), dim)
                ids = batch.column(0).slice(at, BLOCK)
                w = (x - mean) @ matrix.value
                out = [pa.array(np.repeat(np.arange(len(x)), shown))]
                white = np.zeros((len(x), shown))
                white[:, :varied] = w
                empty = np.zeros((len(x), shown), bool)
                empty[:, varied:] = True
                columns = [
                    ids.take(out[0]),
                    pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * shown, n)),
                    pa.array(deviations(x, n, total), pa.int64()).take(out[0]),
                    pa.array(white.ravel(), mask=empty.ravel()),
                    pa.array(shares * len(x), pa.float64()),
                    pa.array([error] * (len(x) * shown), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FIELDS.split(", ")])

    return rows.mapInArrow(project, FIELDS)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Of each row, the exact sum of (n * x - S) ** 2 over the dimensions; null beyond 64 bits."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) < 2**63:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(d) if d < 2**63 else None for d in exact]
