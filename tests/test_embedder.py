"""The learned embedder against dense linear algebra and plain counts, and in the operators that take an embedder."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.operators import embedder as E
from tessera.operators.chunking import chunk_pages


def topics(seed: int, count: int) -> list[str]:
    """Texts of one of three topics, each with its own forty words, and a few common ones."""
    rng = random.Random(seed)
    words = {t: [f"{t}{i}" for i in range(40)] for t in "abc"}
    return [" ".join(rng.choice(words["abc"[n % 3]] if rng.random() < 0.8 else ["the", "of", "and"]) for _ in range(40)) for n in range(count)]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, word string").repartition(4)


def test_pairs_are_counted_within_reach(spark):
    texts = ["a b c a", "b", "", None, "x a x x b a"]
    got = {(r.i, r.j): r.n for r in E.pair_counts(table(spark, texts).select(tokenize(F.col("text")).alias("tokens")), ["a", "b", "c"], 2).collect()}
    want: Counter = Counter()
    for t in texts:
        w = (t or "").split()
        for i in range(len(w)):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if i != j and w[i] in "abc" and w[j] in "abc":
                    want["abc".index(w[i]), "abc".index(w[j])] += 1
    assert got == want


def test_leading_part_of_a_sparse_matrix(spark):
    rng = np.random.default_rng(1)
    turn, _ = np.linalg.qr(rng.normal(size=(50, 50)))
    values = np.r_[[9.0, -7.0, 5.0, 3.0], 0.01 * rng.normal(size=46)]
    whole = turn @ np.diag(values) @ turn.T
    rows = spark.createDataFrame([(i, list(range(50)), [float(x) for x in whole[i]]) for i in range(50)], "i long, columns array<long>, values array<double>")
    found = E.leading(rows, 50, 4)
    for i, value in enumerate(values[:4]):
        want = turn[:, i] * np.sqrt(abs(value))
        assert min(np.abs(found[:, i] - want).max(), np.abs(found[:, i] + want).max()) < 1e-3


def test_words_of_one_topic_are_alike(spark):
    texts = topics(1, 300)
    learned = E.fit_embedder(table(spark, [*texts, "", None]), dim=16)
    assert np.allclose(learned(["a1 a2"])[0], E.fit_embedder(table(spark, [*texts, "", None]).repartition(2), dim=16)(["a1 a2"])[0], atol=1e-6)
    v = learned(["a1 a2 a3 the", "a30 a31 a32 of", "b1 b2 b3 the", "", "zz yy", "yy zz", "the"])
    near = v @ v.T
    assert near[0, 1] > 0.6 > 0.3 > near[0, 2] and near[4, 5] > 0.99 and not v[3].any()
    assert np.allclose(np.linalg.norm(v[[0, 1, 2, 4, 6]], axis=1), 1)
    bare = E.fit_embedder(table(spark, ["", None]), dim=16)
    assert bare(["a b", "a b", ""]).shape == (3, 16) and np.allclose(bare(["a b"]), bare(["b a"]))


def test_semantic_chunks_break_between_topics(spark):
    learned = E.fit_embedder(table(spark, topics(2, 200)), dim=16)
    rng = random.Random(3)
    said = lambda t: " ".join(f"{t}{rng.randrange(40)}" for _ in range(14)).capitalize() + "."
    page = " ".join([said("a") for _ in range(8)] + [said("b") for _ in range(8)])
    pages = spark.createDataFrame([(1, "s", 1, page)], "doc_id long, source string, page int, text string")
    chunks = [r.text for r in chunk_pages(pages, ["semantic"], embed=learned).orderBy("chunk_idx").collect()]
    assert len(chunks) == 2 and "b" not in chunks[0].lower().split(".")[0] and chunks[1].lower().startswith("b")
