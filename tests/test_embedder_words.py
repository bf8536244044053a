"""Words are counted in tasks and hashed in small pieces, with the same results."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.operators import embedder


def test_hashed_vectors_hold_one_piece_at_a_time(monkeypatch):
    words, dim = [f"wé{i}" for i in range(500)], 24
    base = np.array([xxhash.xxh64_intdigest(w, 3) for w in words], np.uint64)
    x = base[:, None] + np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift in (31, 32):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    want = np.where(x >> np.uint64(63), 1.0, -1.0) / np.sqrt(dim)
    assert np.array_equal(embedder.hashed_vectors(words, dim, 3), want)
    monkeypatch.setattr(embedder, "HASHED", 7)
    assert np.array_equal(embedder.hashed_vectors(words, dim, 3), want)
    assert embedder.hashed_vectors([], dim, 3).shape == (0, dim)


def test_words_and_pairs_are_those_of_the_tokens(spark):
    rows = [("Été a-b A b_1 x9 ß",), ("",), ("a b a b c",), ("İ ﬁ 字 字",)]
    low = spark.createDataFrame(rows, "text string").repartition(3).select(F.lower("text").alias("text"))
    tokens = low.select(tokenize(F.col("text")).alias("tokens"))
    plain = tokens.select(F.explode("tokens").alias("word")).groupBy("word").count()
    assert {tuple(r) for r in embedder.word_counts(low).collect()} == {tuple(r) for r in plain.collect()}
    pairs = lambda df: {tuple(r) for r in embedder.pair_counts(df, ["a", "b", "字"], 2).collect()}
    assert pairs(low) == pairs(tokens) != set()
