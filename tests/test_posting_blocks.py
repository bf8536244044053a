"""Top-k from posting blocks against scores of all pairs."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25
from tessera.operators.bm25 import bm25_scores, bm25_top_k, top_k
from tessera.operators.posting_blocks import Best, Questions, combined, shard_of


def zipf_texts(seed: int, count: int, most: int = 60) -> list[list[str]]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [rng.choices(words, weights, k=rng.randrange(most)) for _ in range(count)]


def plain(texts: list[list[str]], asked: list[list[str]], k: int) -> list[list[tuple[float, int]]]:
    n, average = len(texts), sum(map(len, texts)) / len(texts)
    counts = [Counter(t) for t in texts]
    df = Counter(w for c in counts for w in c)
    out = []
    for words in asked:
        scores = []
        for i, c in enumerate(counts):
            s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(texts[i]) / average)) for w in words if c[w])
            if s > 0:
                scores.append((-round(s, 9), i))
        out.append(sorted(scores)[:k])
    return out


def asked_of(asked: list[list[str]]) -> Questions:
    terms = sorted({w for words in asked for w in words})
    pairs = [(i, terms.index(w), n) for i, words in enumerate(asked) for w, n in Counter(words).items()]
    start = np.searchsorted([p[0] for p in pairs], np.arange(len(asked) + 1))
    return Questions(np.arange(len(asked)), terms, start, np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs]))


@pytest.mark.parametrize("seed", range(6))
def test_blocks_give_the_same_best_and_skip_what_cannot_matter(seed, monkeypatch):
    from tessera.operators import posting_blocks

    monkeypatch.setattr(posting_blocks, "BLOCK", 16)
    texts, asked, k = zipf_texts(seed, 4000), [w for w in zipf_texts(seed + 50, 30, 8) if w], 5
    q = asked_of(asked)
    q.weigh(np.array([sum(w in t for t in map(set, texts)) for w in q.terms], float), len(texts), sum(map(len, texts)))
    best = Best(q, k)
    for low in range(0, len(texts), 500):
        best.add(shard_of(np.arange(low, low + 500), pa.array(texts[low : low + 500]), pa.array(q.terms))[0])
    found: dict[int, list] = {i: [] for i in range(len(asked))}
    for query, chunk, score in zip(*best.rows, strict=True):
        found[int(query)].append((-round(float(score), 9), int(chunk)))
    assert [[c for _, c in found[i]] for i in found] == [[c for _, c in p] for p in plain(texts, asked, k)]
    assert all(abs(a[0] - b[0]) < 1e-7 for i, p in enumerate(plain(texts, asked, k)) for a, b in zip(found[i], p, strict=True))
    assert best.read < 0.8 * best.blocks  # a share of all blocks is never read


def test_shards_without_terms_or_chunks_are_empty():
    for tokens in ([["x", "y"], []], [[], None], []):
        shard, _ = shard_of(np.arange(len(tokens)), pa.array(tokens, pa.list_(pa.string())), pa.array(["a"]))
        assert shard.postings == {} and len(shard.lengths) == len(tokens)
        best = Best(asked_of([["a"]]), 3)
        best.q.weigh(np.array([1.0]), 5, 9)
        best.add(shard)
        assert best.rows is None


def test_combined_shards_hold_the_living_chunks():
    texts = zipf_texts(3, 60)
    parts = []
    for low in (0, 20, 40):
        shard, terms = shard_of(np.arange(low, low + 20), pa.array(texts[low : low + 20]), None)
        shard.alive = np.arange(20) % 3 > 0
        parts.append((shard, dict(enumerate(terms.to_pylist()))))
    whole, names = combined(parts)
    alive = [i for i in range(60) if (i % 20) % 3 > 0]
    assert whole.ids.tolist() == alive and whole.lengths.tolist() == [len(texts[i]) for i in alive]
    got = {(int(whole.ids[r]), t): int(f) for t, number in names.items() for r, f in zip(whole.postings[number].rows, whole.postings[number].tfs, strict=True)}
    assert got == {(i, t): n for i in alive for t, n in Counter(texts[i]).items()}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_top_k_equals_all_pairs_ranked(spark, kind, monkeypatch):
    monkeypatch.setattr(bm25, "TERMS_AT_ONCE", 40)  # several blocks of questions
    texts = [" ".join(t) for t in zipf_texts(9, 300)] + ["", None, "w1 w1"]
    chunks = spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(texts)], "doc_id string, text string, score string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(5)
    asked = spark.createDataFrame([(str(i), " ".join(t)) for i, t in enumerate(zipf_texts(10, 25, 9))] + [("90", "unknown words"), ("91", None), ("92", "")], "query_id string, query string").withColumn("query_id", F.col("query_id").cast(kind))
    for allowed in (None, chunks.where("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"))):
        got = bm25_top_k(chunks, asked, 4, allowed=allowed)
        want = top_k(bm25_scores(chunks, asked, allowed=allowed), 4)
        assert [f.dataType.simpleString() for f in got.schema] == [f.dataType.simpleString() for f in want.schema]
        rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())
        assert rows(got) == rows(want)
    assert bm25_top_k(chunks.limit(0), asked, 4).count() == 0 and bm25_top_k(chunks, asked.limit(0), 4).count() == 0
    assert bm25_top_k(chunks.withColumn("doc_id", F.lit(None).cast(kind)), asked, 4).count() == 0


def test_a_task_gives_at_most_k_rows_a_query(spark, monkeypatch):
    """What the ranking shuffles is what the tasks give: tasks x queries x k rows at most, whatever the number of pairs."""
    texts, tasks, k = [" ".join(t) for t in zipf_texts(11, 900)], 3, 2
    chunks = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(tasks)
    asked = spark.createDataFrame([(i, "w0 w1 w2") for i in range(6)], "query_id long, query string")
    assert bm25_top_k(chunks, asked, k).count() == 12
    monkeypatch.setattr(bm25, "top_k", lambda given, k: given)
    given = bm25_top_k(chunks, asked, k)
    pairs = bm25_scores(chunks, asked).count()
    assert 12 <= given.count() <= tasks * 6 * k < pairs / 4
