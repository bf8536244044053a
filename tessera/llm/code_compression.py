"""Vector codes from k-means over the distinct integer parts of vectors.

A vector becomes integers and is cut into equal parts. Of each position, equal parts
are one row with a weight, counted before and after the shuffle. Lloyd's rounds run over
these rows alone: a codebook (positions x entries parts) goes to the tasks, which assign
each distinct part to its nearest entry and add up weighted sums for each entry, so
that a round returns one row an entry. All of it is integer arithmetic, so neither the
order of rows nor their number in a task changes a result. At last codes and errors of
the distinct parts are joined back to the vectors; parts that many vectors share are
broadcast (they are few: each has at least 1 / ``HEAVY`` of all rows), the others are
shuffled.

Defined results: vectors that are null or hold a null or non-finite component give no
rows; shorter vectors end in zeros, and zeros fill the last part where the length is no
multiple of the number of parts; an integer beyond 2**26 is set to that; repeated rows and
rows with equal or null ids are each coded (null ids come last, equal ids are ordered by
their parts, where the first codebook is taken); with fewer rows than entries the codebook
is shorter; equal distances go to the lower entry; an entry without parts stays; null
labels are one label; sums of errors beyond 64 bits are null; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.vectors import floors, longest, pack, padded, rows_of_lists, unpack

STEPS = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Integers beyond it are set to it, so that squared distances stay exact in 64 bits.
MOST = 2**26
#: A key is heavy if it has at least this share of all rows; there are at most so many for each position.
HEAVY = 1000
#: Parts that are compared with a codebook at once.
BLOCK = 4096


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of each part, exact; ties go to the lower entry."""
    most = 4 * (float(np.abs(parts).max(initial=0)) ** 2 + float(np.abs(book).max(initial=0)) ** 2) * parts.shape[1]
    if most >= 2**53:  # products of floating-point numbers would be rounded
        found, least = np.zeros(len(parts), np.int64), ((parts - book[0]) ** 2).sum(axis=1)
        for entry in range(1, len(book)):
            distance = ((parts - book[entry]) ** 2).sum(axis=1)
            closer = distance < least
            found[closer], least[closer] = entry, distance[closer]
        return found, least
    kind = np.float64
    sizes, own = (book * book).sum(axis=1), (parts * parts).sum(axis=1)
    if 4 * max(int(sizes.max()), int(own.max(initial=0))) < 2**24:
        kind = np.float32  # whole numbers below 2**24 are exact in it
    far = parts.astype(kind) @ (-2 * book.T).astype(kind)
    far += sizes.astype(kind)
    found = far.argmin(axis=1)
    return found, far[np.arange(len(parts)), found].astype(np.int64) + own


def by_position(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, places in the batch, parts) in blocks, of a batch with columns position and part."""
    position = batch.column(0).to_numpy()
    for p in np.unique(position):
        at = np.flatnonzero(position == p)
        for block in np.split(at, range(BLOCK, len(at), BLOCK)):
            yield int(p), block, unpack(batch.column(1).take(pa.array(block)), width)


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: entries with parts become the floor of their weighted mean."""
    positions, entries, width = books.shape
    shared = distinct.sparkSession.sparkContext.broadcast(books)
    names = [f"s{i}" for i in range(width)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((positions, entries, width), np.int64), np.zeros((positions, entries), np.int64)
        for batch in batches:
            weights = batch.column(2).to_numpy()
            for p, at, parts in by_position(batch, width):
                found, _ = nearest_entries(parts, shared.value[p])
                weight = weights[at]
                np.add.at(counts[p], found, weight)
                np.add.at(sums[p], found, parts * weight[:, None])
        p, e = np.nonzero(counts)
        columns = [p, e, counts[p, e], *sums[p, e].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["position", "entry", "n", *names])

    partial = distinct.mapInArrow(assign, ", ".join(f"{c} long" for c in ["position", "entry", "n", *names]))
    books = books.copy()
    for row in partial.groupBy("position", "entry").agg(F.sum("n"), *[F.sum(s) for s in names]).collect():
        books[row[0], row[1]] = [s // row[2] for s in row[3:]]
    shared.unpersist()
    return books


def join_counted(rows: DataFrame, keyed: DataFrame, on: Column, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key and in ``weight`` how many of about ``total`` rows have it.

    The heavy keys, a bounded number, are broadcast, so that no task gets all rows of a hot key.
    """
    heavy = F.broadcast(keyed.where(F.col(weight) * HEAVY >= total))
    light = keyed.where(F.col(weight) * HEAVY < total)
    return rows.join(heavy, on).union(rows.join(heavy, on, "left_anti").join(light, on))


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, steps: int = STEPS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, codes, error, label_error), codebooks of shape (parts, entries, width)).

    ``codes`` is an array of entry numbers in the order of the parts.
    """
    spark = vectors.sparkSession
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    chosen = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = chosen.schema["label"].dataType.simpleString()
    dim = longest(chosen, F.col("v"))
    width = -(-dim // parts)
    names = [f"p{i}" for i in range(parts)]

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, lengths, values = rows_of_lists(batch.column(2))
            x = padded(floors(values, steps, MOST), lengths, parts * width)
            cuts = [pa.array(pack(x[:, i * width : (i + 1) * width]), pa.binary()) for i in range(parts)]
            keep = pa.array(usable)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), *cuts], names=["vec_id", "label", *names])

    empty = spark.createDataFrame([], f"vec_id long, label {kind}, codes array<int>, error long, label_error long"), np.zeros((parts, 0, width), np.int64)
    if not dim:
        return empty
    made = chosen.mapInArrow(integers, f"vec_id long, label {kind}, " + ", ".join(f"{p} binary" for p in names))
    rows = written(made.withColumn("row", F.monotonically_increasing_id()), "parts")
    n = rows.count()
    if not n:
        return empty
    each = rows.select("row", "vec_id", "label", F.posexplode(F.array(*names)).alias("position", "part"))
    distinct = written(each.groupBy(F.col("position").cast("long").alias("position"), "part").agg(F.count("*").alias("weight")), "distinct-parts")

    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), *names).limit(entries).select(*names).toArrow().combine_chunks()
    books = np.stack([unpack(first[p].combine_chunks(), width) for p in names])
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    shared = spark.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, at, block in by_position(batch, width):
                found[at], error[at] = nearest_entries(block, shared.value[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(error)], names=["at", "of", "weight", "code", "error"])

    coded = written(distinct.mapInArrow(code, "at long, of binary, weight long, code int, error long"), "coded-parts")
    joined = join_counted(each, coded, (F.col("position") == F.col("at")) & (F.col("part") == F.col("of")), "weight", n)
    codes = F.array(*[F.max(F.when(F.col("position") == i, F.col("code"))) for i in range(parts)])
    back = joined.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), codes.alias("codes"), F.try_sum("error").alias("error"))
    back = written(back.drop("row"), "coded")
    labels = written(back.groupBy(F.col("label").alias("of_label")).agg(F.try_sum("error").alias("label_error"), F.count("*").alias("rows_of_label")), "label-errors")
    out = join_counted(back, labels, F.col("label").eqNullSafe(F.col("of_label")), "rows_of_label", n)
    return out.select("vec_id", "label", "codes", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimal numbers by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
