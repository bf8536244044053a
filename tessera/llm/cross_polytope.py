"""Nearest neighbours by inner product with cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform,
and hashed to the signed axis nearest to the result. A table's bucket concatenates such
hashes, the last of them over a part of the axes, so that there are as many buckets as
the number of vectors asks for. A query probes the buckets of all tables in the order
of their penalty: how much farther their axes are than its own. Candidates of a bucket
are scored exactly in double precision.

For vectors of different lengths, a further coordinate makes all candidates equally
long, which turns the largest inner product into the smallest angle. Vectors of
fewer components than the longest are taken as ending in zeros.

How fine the buckets are and how many are probed is found on about ``TRIALS`` queries:
their true neighbours come from a scan of all vectors, and of all finenesses the one
is taken with which ``RECALL`` of them are found by scoring least (``SAMPLE`` vectors
say how full the buckets are). The trials answer no query; every vector is indexed.
A query that finds too few candidates asks again in coarser buckets.

Equal vectors are searched once: of each, the ``k`` + 1 smallest ids stand for all, as
no others can be among the ``k`` nearest. Cells of buckets are cut into parts of about
``PART`` vectors, the queries of a cell likewise.

Defined results: vectors that are null, empty, zero, or that hold a null or a
non-finite component take no part; equal scores go to the smaller id; repeated rows
count once, and of rows with one id and several vectors each is a candidate, while the
smallest is the query; a null id takes no part; with fewer candidates than k, all are
returned; an empty table gives no rows; very long vectors are padded to a power of two;
columns other than the id and the vector are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import small, written

SAMPLE = 4096
TRIALS = 128
RECALL = 0.95
TABLES = 6
#: Vectors, and queries, that a part of a cell holds at most, on average.
PART = 4096
QUERY_PART = 4096
#: Probes of a table at most; finer buckets than these can cover are not used.
MOST_PROBES = 1024
#: This share of the probes comes first, for a bound on what the others return.
FIRST = 8
#: What a probe costs beside its candidates, in candidates.
PROBE_COST = 4
#: Cells that are broadcast at most.
BROADCAST_CELLS = 200_000
SEED = 11


@dataclass(frozen=True)
class Hashing:
    """Rotations for vectors of ``dim`` components, padded to ``width``, with 2 ** ``bits`` buckets in a table.

    ``scale`` is the longest vector's length, or 0 without the further coordinate.
    """

    dim: int
    width: int
    scale: float
    tables: int
    bits: int = 1
    seed: int = SEED

    def axes_used(self) -> list[int]:
        """Of each hash of a table, over how many axes it goes: all, and in the last what the bits leave."""
        whole = self.width.bit_length()  # bits of a hash over all signed axes
        full, rest = divmod(self.bits, whole)
        return [self.width] * full + ([1 << (rest - 1)] if rest else [])

    def padded(self, x: np.ndarray, candidates: bool) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        if self.scale and candidates:
            out[:, : self.dim] = x / self.scale
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (out[:, : self.dim] ** 2).sum(axis=1)))
        else:
            out[:, : self.dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
        return out

    def closeness(self, x: np.ndarray, candidates: bool) -> Iterator[list[np.ndarray]]:
        """Of each table, for each of its hashes: closeness of every row to each signed axis."""
        y = self.padded(x, candidates)
        for t in range(self.tables):
            hashes = []
            for i, used in enumerate(self.axes_used()):
                z = y
                for s in np.random.default_rng((self.seed, t, i)).integers(0, 2, (3, self.width)) * 2.0 - 1.0:
                    z = hadamard(z * s)
                hashes.append(np.concatenate([z[:, :used], -z[:, :used]], axis=1))
            yield hashes

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of every candidate in each table: (tables, rows)."""
        out = np.zeros((self.tables, len(x)), np.int64)
        for t, hashes in enumerate(self.closeness(x, True)):
            for h in hashes:
                out[t] = out[t] * h.shape[1] + h.argmax(axis=1)
        return out

    def probes(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(table, bucket) that each query probes, at most ``most``, in the order of their penalty."""
        buckets, penalties, tables = [], [], []
        for t, hashes in enumerate(self.closeness(x, False)):
            bucket, penalty = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
            for h in hashes:
                far = h.max(axis=1, keepdims=True) - h
                order = np.argsort(far, axis=1, kind="stable")
                far = np.take_along_axis(far, order, axis=1) ** 2
                a, b = pairs_within(penalty.shape[1], far.shape[1], min(most, MOST_PROBES))
                penalty = penalty[:, a] + far[:, b]
                bucket = bucket[:, a] * h.shape[1] + order[:, b]
                keep = np.argsort(penalty, axis=1, kind="stable")[:, : min(most, MOST_PROBES)]
                penalty, bucket = np.take_along_axis(penalty, keep, axis=1), np.take_along_axis(bucket, keep, axis=1)
            buckets.append(bucket)
            penalties.append(penalty)
            tables.append(np.full(bucket.shape, t, np.int64))
        order = np.argsort(np.concatenate(penalties, axis=1), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(np.concatenate(tables, axis=1), order, axis=1), np.take_along_axis(np.concatenate(buckets, axis=1), order, axis=1)


def pairs_within(n: int, m: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in two ascending lists whose sums can be among the ``most`` smallest: (i + 1) * (j + 1) <= most."""
    each = np.minimum(n, most // np.arange(1, m + 1))
    b = np.repeat(np.arange(m), each)
    return np.arange(len(b)) - np.repeat(np.cumsum(each) - each, each), b


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of every row, in n log n steps."""
    rows, n = x.shape
    step = 1
    while step < n:
        y = x.reshape(rows, n // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, n)
        step *= 2
    return x / np.sqrt(n)


def best(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each row, ties to the smaller id."""
    order = np.lexsort((ids, -scores, row))
    sorted_rows = row[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows) < k]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The lists as rows of ``dim`` doubles, shorter ones ending in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def stacked(lists: pd.Series, dim: int) -> np.ndarray:
    return matrix(pa.array(lists, pa.list_(pa.float64())), dim) if len(lists) else np.zeros((0, dim))


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, the same for a pair wherever it is computed."""
    return (a * b).sum(axis=1)


def keys_of(table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (table.astype(np.int64) << 56) + bucket


def fitted(hashing: Hashing, trials: np.ndarray, near: list[np.ndarray], sample: np.ndarray, n: int, recall: float) -> tuple[Hashing, int]:
    """Fineness and number of probes that find the trials' true neighbours by scoring least.

    The finest has four vectors a bucket; of the first four finenesses whose probes
    suffice the cheapest is taken. Two buckets a table always suffice.
    """
    costs: list[tuple[float, int, Hashing]] = []
    begins = np.cumsum([0, *map(len, near)])
    tables = np.arange(hashing.tables)[:, None]
    for bits in range(max(1, (n // 4).bit_length() - 1), 0, -1):
        h = replace(hashing, bits=bits)
        probed = keys_of(*h.probes(trials, h.tables * min(MOST_PROBES, 1 << bits)))
        own = keys_of(tables, h.buckets(np.concatenate(near)))
        needed = np.full(own.shape[1], probed.shape[1])
        for i, keys in enumerate(probed):
            order = np.argsort(keys)
            mine = own[:, begins[i] : begins[i + 1]]
            place = order[np.minimum(np.searchsorted(keys, mine, sorter=order), len(keys) - 1)]
            needed[begins[i] : begins[i + 1]] = np.where(keys[place] == mine, place, probed.shape[1]).min(axis=0)
        rank = int(np.quantile(needed, recall, method="higher")) if len(needed) else 0
        if rank < probed.shape[1]:
            held, counts = np.unique(keys_of(tables, h.buckets(sample)), return_counts=True)
            place = np.minimum(np.searchsorted(held, probed[:, : rank + 1]), len(held) - 1)
            load = np.where(held[place] == probed[:, : rank + 1], counts[place], 0).sum(axis=1).mean() / len(sample)
            costs.append((load * n + PROBE_COST * (rank + 1), rank + 1, h))
            if len(costs) == 4:
                break
    _, probes, chosen = min(costs, key=lambda c: c[:2])
    return chosen, probes


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows that take part."""
    v = F.col("v")
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    good = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where(good)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(rep, ids, v): every vector once, with its k + 1 smallest ids; a hot vector is cut to them before the shuffle."""
    first = rows.withColumn("at", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    return first.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v")


def true_nearest(vectors: DataFrame, trials: np.ndarray, k: int) -> list[np.ndarray]:
    """The k nearest other vectors of each trial, by a scan of all; only as many rows as trials * k leave each task."""
    dim = trials.shape[1]
    squares = dot(trials, trials)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, score, held = np.empty(0, np.int64), np.empty(0), np.empty((0, dim))
        for batch in batches:
            x = matrix(batch.column(0), dim)
            s = trials @ x.T
            s[np.isclose(s, squares[:, None], rtol=1e-9)] = -np.inf  # the trial itself
            r = np.repeat(np.arange(len(trials)), min(k, len(x)))
            c = np.argpartition(-s, min(k, len(x)) - 1, axis=1)[:, :k].ravel()
            c, r = c[s[r, c] > -np.inf], r[s[r, c] > -np.inf]
            row, score, held = np.concatenate([row, r]), np.concatenate([score, s[r, c]]), np.concatenate([held, x[c]])
            keep = best(row, np.arange(len(row)), score, k)
            row, score, held = row[keep], score[keep], held[keep]
        yield pa.RecordBatch.from_pydict({"trial": row, "score": score, "v": pa.array(list(held), pa.list_(pa.float64()))})

    found = vectors.select("v").mapInArrow(scan, "trial long, score double, v array<double>")
    order = Window.partitionBy("trial").orderBy(F.desc("score"), "v")
    got = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).select("trial", "v").toArrow().combine_chunks()
    trial, v = np.asarray(got["trial"]), matrix(got["v"].combine_chunks(), dim) if got.num_rows else np.empty((0, dim))
    return [v[trial == i] for i in range(len(trials))]


def search(queries: DataFrame, vectors: DataFrame, hashing: Hashing, probes: int, n: int, k: int) -> DataFrame:
    """(query, rep, score): for each of ``queries`` (query, v) its k best among what its probes find."""
    spark = queries.sparkSession
    dim = hashing.dim
    shift = max(0, hashing.bits - max(0, (n // PART).bit_length()))  # a cell holds neighbouring buckets
    first = -(-probes // FIRST)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = hashing.buckets(matrix(batch.column(1), dim))
            for t in range(hashing.tables if batch.num_rows else 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t)), pa.array(own[t] >> shift), pa.array(own[t]), *batch.columns], names=["table", "cell", "bucket", "rep", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                table, bucket = (x.ravel() for x in hashing.probes(matrix(batch.column(1), dim), probes))
                query = np.repeat(np.arange(batch.num_rows), len(table) // batch.num_rows)
                late = np.tile(np.arange(len(table) // batch.num_rows) >= first, batch.num_rows)
                order = np.lexsort((bucket, table, late, query))
                query, late, table, bucket = query[order], late[order], table[order], bucket[order]
                cell = bucket >> shift
                new = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (late[1:] != late[:-1]) | (table[1:] != table[:-1]) | (cell[1:] != cell[:-1])])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(bucket)].astype(np.int32)), pa.array(bucket))
                own = pa.array(query[new])
                yield pa.RecordBatch.from_arrays([pa.array(late[new]), pa.array(table[new]), pa.array(cell[new]), lists, batch.column(0).take(own), batch.column(1).take(own)], names=["late", "table", "cell", "buckets", "query", "v"])

    kind = dict(vectors.dtypes)["v"]
    asking = written(queries.select("query", "v").mapInArrow(probe, f"late boolean, table long, cell long, buckets array<long>, query long, v {kind}"), "probes")
    indexed = vectors.select("rep", "v").mapInArrow(index, f"table long, cell long, bucket long, rep long, v {kind}")
    counts = indexed.groupBy("table", "cell").agg(F.count("*").alias("held")).join(asking.groupBy("table", "cell").agg(F.count("*").alias("asked")), ["table", "cell"])
    parts = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    cells = small(written(counts.select("table", "cell", parts("held", PART).alias("parts"), parts("asked", QUERY_PART).alias("asks")), "cells"), BROADCAST_CELLS)
    spread = lambda c, by: F.pmod(F.xxhash64(F.lit("part"), c), F.col(by)).cast("int")
    series = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    part = F.struct("table", "cell", "p", "q").alias("part")
    right = indexed.join(cells, ["table", "cell"]).withColumn("p", spread("rep", "parts")).withColumn("q", series("asks")).select(part, "bucket", "rep", F.col("v").alias("w"))

    def match(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows, reps, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(q) and len(c):
            c = c.sort_values("bucket", kind="stable")
            bucket, rep = c["bucket"].to_numpy(), c["rep"].to_numpy()
            x, w = stacked(q["v"], dim), stacked(c["w"], dim)
            least = q["bound"].to_numpy() - 1e-9
            asked = np.concatenate(q["buckets"].to_list())
            row = np.repeat(np.arange(len(q)), q["buckets"].map(len).to_numpy())
            order = np.argsort(asked, kind="stable")
            asked, row = asked[order], row[order]
            for b in np.unique(asked):
                lo, hi = np.searchsorted(bucket, [b, b + 1])
                if lo < hi:
                    r = row[slice(*np.searchsorted(asked, [b, b + 1]))]
                    at, near = np.nonzero(x[r] @ w[lo:hi].T >= least[r][:, None])
                    rows.append(r[at])
                    reps.append(near + lo)
        row, near = np.concatenate(rows), np.concatenate(reps)
        if not len(row):
            return pd.DataFrame({"query": row, "rep": near, "score": scores[0]})
        score = np.concatenate([dot(x[row[i : i + 65_536]], w[near[i : i + 65_536]]) for i in range(0, len(row), 65_536)])
        keep = best(row, rep[near], score, k)
        return pd.DataFrame({"query": q["query"].to_numpy()[row[keep]], "rep": rep[near[keep]], "score": score[keep]})

    def matches(some: DataFrame) -> DataFrame:
        left = some.join(cells, ["table", "cell"]).withColumn("q", spread("query", "asks")).withColumn("p", series("parts")).select(part, "buckets", "query", "bound", "v")
        return left.groupBy("part").cogroup(right.groupBy("part")).applyInPandas(match, "query long, rep long, score double")

    # The nearest buckets first: they give each query a bound that lets little through from the others.
    none = F.lit(float("-inf"))
    early = written(top(matches(asking.where("not late").withColumn("bound", none)), k), "first-found")
    bounds = early.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(none).alias("bound"))
    late = asking.where("late").join(bounds, "query", "left").withColumn("bound", F.coalesce("bound", none))
    return top(early.union(matches(late)), k)


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, each once."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.withColumn("at", F.dense_rank().over(order)).where(F.col("at") <= k).select("query", "rep", "score").distinct()


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each id divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    distinct = written(distinct_vectors(rows, k), "vectors")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, dim, low, high = distinct.agg(F.count("*"), F.max(F.size("v")), F.min(length), F.max(length)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    uneven = high - low > 1e-4 * high
    hashing = Hashing(dim, 1 << max(1, (dim + uneven - 1).bit_length()), high if uneven else 0.0, tables)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    queries = written(asked.groupBy("v").agg(F.min("query_id").alias("query")), "queries")

    def some(df: DataFrame, key: str, wanted: int, of: int, salt: str) -> np.ndarray:
        chance = 1 << 62 if of <= wanted else int((1 << 62) * wanted / of)
        got = df.where(F.shiftrightunsigned(F.xxhash64(F.lit(salt), key), 2) < chance).orderBy(key).limit(2 * wanted).select("v").toArrow().combine_chunks()
        return matrix(got["v"].combine_chunks(), dim) if got.num_rows else np.empty((0, dim))

    trials = some(queries, "query", TRIALS, queries.count(), "trial")
    sample = some(distinct, "rep", SAMPLE, n, "sample")
    chosen, probes = fitted(hashing, trials, true_nearest(distinct, trials, k), sample, n, recall) if len(trials) and len(sample) else (hashing, 2 * tables)

    # Equal vectors: one may be the query's own, so k + 1 are found.
    found = written(search(queries, distinct, chosen, probes, n, k + 1), "found")
    while True:
        short = found.groupBy("query").count().where(F.col("count") >= min(k + 1, n)).select("query")
        left = queries.join(short, "query", "left_anti")
        if chosen.bits == 1 and probes >= 2 * tables or left.isEmpty():
            break
        chosen = replace(chosen, bits=max(1, chosen.bits - 6))
        probes = 2 * tables if chosen.bits == 1 else probes
        found = written(found.join(left, "query", "left_anti").unionByName(search(written(left, "left"), distinct, chosen, probes, n, k + 1)), "found")
    each = found.join(distinct.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    each = each.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = each.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("near"))
    answers = asked.join(queries, "v").select("query_id", "query").join(lists, "query")
    ranked = answers.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("place", "x"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
