"""Products of frequent terms: few postings are added up one by one, and single precision changes no result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.operators import term_sums
from tests.test_posting_blocks import asked_of, plain, zipf_texts


def _best(texts, asked, k, need):
    q = asked_of(asked)
    q.weigh(np.array([sum(w in t for t in map(set, texts)) for w in q.terms], float), len(texts), sum(map(len, texts)))
    best = term_sums.Sums(q, k, need)
    best.take(pa.array(range(len(texts))), pa.array(texts))
    best.finish()
    found: list[list[tuple[float, int]]] = [[] for _ in asked]
    for query, chunk, score in zip(*best.rows, strict=True):
        found[int(query)].append((-round(float(score), 9), int(chunk)))
    return best, found


def test_few_postings_are_added_one_by_one_without_any_bound():
    texts, asked = zipf_texts(21, 4000), [w for w in zipf_texts(71, 60, 8) if w]
    best, found = _best(texts, asked, 5, None)
    assert best.added < 0.5 * best.held
    assert [[c for _, c in f] for f in found] == [[c for _, c in p] for p in plain(texts, asked, 5)]


def test_scores_apart_by_less_than_single_precision_keep_their_order():
    """Long queries over nearly equal chunks: the last chunk that counts differs in the ninth digit or not at all."""
    base = [f"w{i}" for i in range(300)]
    texts = [base[: 200 + i % 3] + ["x"] * (i % 2) for i in range(400)] + zipf_texts(22, 200)
    asked = [base, base[:250] + base[:40], ["w1"], ["unknown"], base[100:]]
    _, found = _best(texts, asked, 7, None)
    want = plain(texts, asked, 7)
    assert [[c for _, c in f] for f in found] == [[c for _, c in p] for p in want]
    known = np.array([-p[6][0] if len(p) == 7 else -np.inf for p in want])
    assert [[c for _, c in f] for f in _best(texts, asked, 7, known)[1]] == [[c for _, c in p] for p in want]


def test_any_order_of_queries_and_any_matrix_give_the_same(monkeypatch):
    texts, asked = zipf_texts(23, 1500), [w for w in zipf_texts(73, 40, 9) if w]
    want = [[c for _, c in p] for p in plain(texts, asked, 4)]
    for changes in ({"MATRIX_BYTES": 0}, {"MATRIX_BYTES": 12 * 1500 * 3}, {"BLOCK_SUMS": 1}, {"BLOCK_SUMS": 9000, "GROUPS": 3}, {"FREQUENT": 10_000}):
        with monkeypatch.context() as m:
            for name, value in changes.items():
                m.setattr(term_sums, name, value)
            assert [[c for _, c in f] for f in _best(texts, asked, 4, None)[1]] == want
