"""An embedder that learns from the corpus: word vectors of co-occurrence counts, and weighted sums of them.

Words are counted over all texts, and the most frequent ones are the vocabulary. Each task
adds up how often two of them stand within a few places of each other; Spark sums the
counts. Their positive pointwise mutual information is a sparse symmetric matrix, whose
leading part is found by a randomised range finder: the matrix meets a few random
vectors in tasks, one row a word, and only the product (words x vectors) comes to the
driver. A text's vector is the sum of its words' vectors, frequent words weighing less.
Words outside the vocabulary, most of which are rare, have pseudo-random vectors of their
own from a hash, so that texts which share them are alike.

Defined results: null and empty texts, and texts without a word, have the zero vector;
a corpus without words gives an embedder of hashed words alone; results depend on
``seed`` and the counts, not on partitions (but for the last digits of sums).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.bm25 import split_tokens
from tessera.shared import written

#: Words that get learned vectors at most, components of a vector, places between two that count, and further random vectors.
VOCABULARY = 4096
DIM = 384
REACH = 4
SPARE = 16
#: Times that the range finder multiplies anew.
POWER = 2
#: How fast the weight of a word falls with its share of all words.
FADE = 1e-4
SEED = 5
#: Words whose vectors are made at once: few enough for a core's own memory.
HASHED = 128
_WORD = re.compile(r"\w+").findall


@dataclass(frozen=True)
class LearnedEmbedder:
    """``embed(texts)`` gives unit vectors; use it wherever an embedder is taken."""

    place: dict[str, int]
    vectors: np.ndarray
    weights: np.ndarray
    rare: float
    seed: int = SEED

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.vectors.shape[1]))
        words = [_WORD((text or "").lower()) for text in texts]
        others = sorted({w for own in words for w in own if w not in self.place})
        hashed, at = hashed_vectors(others, out.shape[1], self.seed), {w: i for i, w in enumerate(others)}
        for i, own in enumerate(words):
            known = [self.place[w] for w in own if w in self.place]
            out[i] = self.weights[known] @ self.vectors[known] + self.rare * hashed[[at[w] for w in own if w in at]].sum(axis=0)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def hashed_vectors(words: list[str], dim: int, seed: int) -> np.ndarray:
    """A pseudo-random vector of length 1 for each word: signs from the bits of mixed hashes."""
    base = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    steps, side = np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1 / np.sqrt(dim)
    out = np.empty((len(words), dim))
    for low in range(0, len(words), HASHED):
        x = base[low : low + HASHED, None] + steps
        spare = x >> np.uint64(31)
        x ^= spare
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.right_shift(x, np.uint64(32), out=spare)
        x ^= spare
        x *= np.uint64(0xD6E8FEB86659FD93)
        own = out[low : low + HASHED]
        np.multiply(x.view(np.int64) < 0, 2 * side, out=own)
        own -= side
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of lower-cased texts (text); each batch adds up what it has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = pc.value_counts(split_tokens(batch.column(0)).flatten()).flatten()
            yield pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame, words: list[str], reach: int) -> DataFrame:
    """(i, j, n) of one column, lower-cased texts or their tokens: how often words i and j stand at most ``reach`` places apart, both ways; places of other words count too."""
    known, size = pa.array(words, pa.string()), len(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            column = column if pa.types.is_list(column.type) else split_tokens(column)
            at = pc.index_in(column.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            keys = []
            for apart in range(1, reach + 1):
                near = (row[apart:] == row[:-apart]) & (at[apart:] >= 0) & (at[:-apart] >= 0)
                a, b = at[:-apart][near], at[apart:][near]
                keys += [a * size + b, b * size + a]
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // size), pa.array(key % size), pa.array(n.astype(np.int64))], names=["i", "j", "n"])

    return texts.mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def times(matrix: DataFrame, dense: np.ndarray) -> np.ndarray:
    """The product of a sparse matrix (i, columns, values: one row each) with a dense one; a row of the product for each row."""
    shared = matrix.sparkSession.sparkContext.broadcast(dense)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(v.as_py()) @ shared.value[np.asarray(c.as_py(), np.int64)] for c, v in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["i", "y"])

    out = np.zeros_like(dense)
    for i, y in matrix.mapInArrow(multiply, "i long, y array<double>").collect():  # vocabulary x vectors numbers, both bounded
        out[i] = y
    shared.unpersist()
    return out


def leading(matrix: DataFrame, size: int, rank: int, seed: int = SEED) -> np.ndarray:
    """Eigenvectors of a sparse symmetric matrix, scaled by the roots of their eigenvalues' sizes, from a randomised range."""
    start = np.random.default_rng(seed).standard_normal((size, min(size, rank + SPARE)))
    basis, _ = np.linalg.qr(times(matrix, start))
    for _ in range(POWER):
        basis, _ = np.linalg.qr(times(matrix, basis))
    inner = basis.T @ times(matrix, basis)
    values, turned = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:rank]
    vectors = basis @ turned[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])  # either sign would do; this one is the same each time
    return vectors * np.where(signs == 0, 1, signs) * np.sqrt(np.abs(values[order]))


def fit_embedder(texts: DataFrame, *, text_col: str = "text", dim: int = DIM, vocabulary: int = VOCABULARY, reach: int = REACH, seed: int = SEED) -> LearnedEmbedder:
    """An embedder of ``dim`` components from all texts."""
    low = texts.select(F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    counts = written(word_counts(low), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    words = [r.word for r in top]
    if not words:
        return LearnedEmbedder({}, np.zeros((0, dim)), np.zeros(0), 1.0, seed)
    pairs = written(pair_counts(low, words, reach), "pairs")
    sums = pairs.groupBy("i").agg(F.sum("n").alias("own"))
    whole = float(sums.agg(F.sum("own")).first()[0] or 1)
    given = pairs.join(F.broadcast(sums), "i").join(F.broadcast(sums.select(F.col("i").alias("j"), F.col("own").alias("other"))), "j")  # one row a word of the vocabulary
    ppmi = given.select("i", "j", F.log(F.col("n") * F.lit(whole) / (F.col("own").cast("double") * F.col("other"))).alias("v")).where("v > 0")
    lines = ppmi.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("x")).select("i", F.transform("x", lambda e: e["j"]).alias("columns"), F.transform("x", lambda e: e["v"]).alias("values"))
    vectors = leading(written(lines, "ppmi"), len(words), dim, seed)
    vectors = np.pad(vectors, ((0, 0), (0, dim - vectors.shape[1])))
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
    weights = np.array([FADE / (FADE + r.n / total) for r in top])
    return LearnedEmbedder({w: i for i, w in enumerate(words)}, vectors, weights, 1.0, seed)
