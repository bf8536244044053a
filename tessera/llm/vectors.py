"""Vectors of whole tables as integers: reading them from Arrow, and packing equal ones into equal bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTHS = tuple(np.dtype(f"<i{w}") for w in (2, 4, 8))


def rows_of_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(usable, lengths, values): which rows are neither null nor hold a null or non-finite entry; their lengths; their entries in a row."""
    lists = column.cast(pa.list_(pa.float64()))
    usable = lists.is_valid().to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
    row = np.repeat(np.arange(len(lengths)), lengths)
    usable = usable & (np.bincount(row, ~np.isfinite(values), len(lengths)) == 0)
    return usable, lengths[usable], values[usable[row]]


def floors(values: np.ndarray, times: int, most: int) -> np.ndarray:
    """floor(times * value) as 64-bit integers; what lies beyond ``most`` is set to it."""
    return np.clip(np.floor(values * float(times)), -most, most).astype(np.int64)


def padded(values: np.ndarray, lengths: np.ndarray, dim: int, fill: int = 0) -> np.ndarray:
    """A matrix of ``dim`` columns; shorter rows end in ``fill``."""
    if len(lengths) and (lengths == dim).all():
        return values.reshape(-1, dim)
    out = np.full((len(lengths), dim), fill, values.dtype)
    out[np.arange(dim) < lengths[:, None]] = values
    return out


def pack(rows: np.ndarray) -> list[bytes]:
    """Bytes of each row: the integers in the least of the widths that holds them all, after one byte that names it. Equal rows have equal bytes."""
    most = np.abs(rows).max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(rows)
    for name, width in enumerate(WIDTHS):
        bits = 8 * width.itemsize - 1
        at = np.flatnonzero((most < 2**bits) & (most >= (2 ** (4 * width.itemsize - 1) if name else 0)))
        block = np.ascontiguousarray(rows[at].astype(width))
        raw, step, head = block.tobytes(), block.shape[1] * width.itemsize, bytes([name])
        for place, i in enumerate(at):
            out[i] = head + raw[place * step : (place + 1) * step]
    return out


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """The matrix of 64-bit integers behind a column of ``pack``."""
    out = np.empty((len(column), dim), np.int64)
    raw = column.to_pylist()
    names = np.fromiter((r[0] for r in raw), np.int64, len(raw))
    for name in np.unique(names):
        at = np.flatnonzero(names == name)
        out[at] = np.frombuffer(b"".join(raw[i][1:] for i in at), WIDTHS[name]).reshape(len(at), dim)
    return out


def longest(vectors: DataFrame, vector: Column) -> int:
    """How many entries the longest vector of finite entries has; 0 if there is none."""
    finite = ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(finite).agg(F.max(F.size(vector))).first()[0] or 0
