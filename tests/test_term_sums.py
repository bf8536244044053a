"""Sums over large shards against scores of all pairs, and how much of the postings they read."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.config import TRIM_MARKER
from tessera.functions import text as functions
from tessera.operators import answers, bm25, term_sums
from tessera.operators.bm25 import bm25_scores, bm25_top_k, split_tokens, top_k
from tessera.operators.rerank import lexical_overlap
from tests.test_posting_blocks import asked_of, plain, zipf_texts


@pytest.mark.parametrize("seed", range(4))
def test_sums_give_the_same_best_and_leave_terms_out(seed, monkeypatch):
    monkeypatch.setattr(term_sums, "POSTINGS", 6000)  # several shards
    texts, asked, k = zipf_texts(seed, 4000), [w for w in zipf_texts(seed + 50, 30, 8) if w], 5
    q = asked_of(asked)
    q.weigh(np.array([sum(w in t for t in map(set, texts)) for w in q.terms], float), len(texts), sum(map(len, texts)))
    want = plain(texts, asked, k)
    known = np.array([-p[k - 1][0] if len(p) == k else -np.inf for p in want])
    for need in (None, known):
        best = term_sums.Sums(q, k, need)
        for low in range(0, len(texts), 500):
            best.take(pa.array(range(low, low + 500)), pa.array(texts[low : low + 500]))
        best.finish()
        found: dict[int, list] = {i: [] for i in range(len(asked))}
        for query, chunk, score in zip(*best.rows, strict=True):
            found[int(query)].append((-round(float(score), 9), int(chunk)))
        assert [[c for _, c in found[i]] for i in found] == [[c for _, c in p] for p in want]
        assert all(abs(a[0] - b[0]) < 1e-7 for i, p in enumerate(want) for a, b in zip(found[i], p, strict=True))
    assert best.added < 0.7 * best.held


def test_frequent_terms_are_read_and_not_searched(monkeypatch):
    texts, asked, k = zipf_texts(3, 4000), [w for w in zipf_texts(53, 30, 8) if w], 5
    q = asked_of(asked)
    q.weigh(np.array([sum(w in t for t in map(set, texts)) for w in q.terms], float), len(texts), sum(map(len, texts)))
    want = plain(texts, asked, k)
    known = np.array([-p[k - 1][0] if len(p) == k else -np.inf for p in want])
    searches, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **b: (searches.append(1), search(*a, **b))[1])
    best = term_sums.Sums(q, k, known)
    best.take(pa.array(range(len(texts))), pa.array(texts))
    best.finish()
    assert len(searches) == 1 and best.added < 0.7 * best.held  # the starts of the shard's terms, and no search a term left out
    found = {(int(a), int(b)) for a, b, _ in zip(*best.rows, strict=True)}
    assert found == {(i, c) for i, p in enumerate(want) for _, c in p}


def test_a_pilot_part_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(bm25, "PILOT_QUERIES", 1)
    monkeypatch.setattr(bm25, "PILOT_PART", 3)
    texts = [" ".join(t) for t in zipf_texts(9, 300)] + ["", None, "w1 w1"] + ["w1 w2 w3"] * 40
    chunks = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(zipf_texts(10, 25, 9))] + [(90, "unknown words"), (91, None), (92, ""), (93, "w1 w2 w3")], "query_id long, query string")
    for allowed in (None, chunks.where("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"))):
        got, want = bm25_top_k(chunks, asked, 4, allowed=allowed), top_k(bm25_scores(chunks, asked, allowed=allowed), 4)
        rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())
        assert rows(got) == rows(want)


def test_tasks_give_no_chunk_that_k_chunks_exceed(spark, monkeypatch):
    """After the pilot, tasks give about ``PILOT_PART`` x k rows a query at most, however many tasks there are."""
    monkeypatch.setattr(bm25, "PILOT_QUERIES", 1)
    monkeypatch.setattr(bm25, "PILOT_PART", 2)
    texts, tasks, k = [" ".join(t) for t in zipf_texts(11, 2000)], 12, 5
    chunks = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(tasks)
    asked = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(zipf_texts(12, 20, 9)) if t], "query_id long, query string")
    given = []
    monkeypatch.setattr(bm25, "top_k", lambda found, k: given.append(found) or top_k(found, k))
    n = bm25_top_k(chunks, asked, k).count()
    assert given[-1].count() < tasks * n / 2


def test_trimming_counts_each_piece_once():
    def plainly(head: str, text: str, room: int) -> str:
        kept = ""
        for piece in re.findall(r"\S+|\s+", text.strip()):
            if max(1, len(answers._MARKS.findall(f"{head}{kept}{piece}{TRIM_MARKER}"))) > room:
                break
            kept += piece
        return kept + TRIM_MARKER

    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(["a", "é1", " ", "\n", ".", "--", "_", "\u00a0", "x y"]) for _ in range(rng.randrange(40)))
        head, room = rng.choice(["[1] Source: a (Page 1)\n", "", "head", "x: "]), rng.randrange(30)
        assert answers.trimmed_to(head, text, room) == plainly(head, text, room)
    begin = time.perf_counter()
    answers.trimmed_to("[1]\n", "word, " * 20_000, 30_000)
    assert time.perf_counter() - begin < 2


def test_tokens_cut_in_tasks_are_those_of_the_column(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("aB9_ É,.ßİ-\n字ñΣ") for _ in range(rng.randrange(30))) for _ in range(200)] + ["", " ", None]
    rows = spark.createDataFrame([(i, t, texts[-i - 1]) for i, t in enumerate(texts)], "id long, text string, query string")
    cut = bm25.lowered(rows, "id", "text").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([b.column(0), split_tokens(b.column(1))], names=["id", "t"]) for b in bs), "id long, t array<string>")
    assert {r.id: r.t for r in cut.collect()} == {r.id: r.t or [] for r in rows.select("id", functions.tokenize(F.col("text")).alias("t")).collect()}
    asked = F.array_distinct(functions.tokenize(F.col("query")))
    plain_score = F.coalesce(F.try_divide(F.size(F.array_intersect(asked, functions.tokenize(F.col("text")))).cast("double"), F.size(asked)), F.lit(0.0))
    for r in rows.select(lexical_overlap(F.col("query"), F.col("text")).alias("a"), plain_score.alias("b")).collect():
        assert r.a == r.b


def test_queries_of_the_same_terms_are_asked_once(spark, monkeypatch):
    texts = [" ".join(t) for t in zipf_texts(13, 200)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["w1 w2 w9", "W9, w2 w1", "w1 w2 w9 w9", "w40", "w40", "none", "", None])], "query_id long, query string")
    scored, weighed = [], bm25.weighed
    monkeypatch.setattr(bm25, "weighed", lambda rows, questions: scored.append(questions.ids.tolist()) or weighed(rows, questions))
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())
    assert rows(bm25_top_k(chunks, asked, 4)) == rows(top_k(bm25_scores(chunks, asked), 4))
    assert scored == [[0, 2, 3, 5]]


def test_tokens_by_bytes_are_those_of_the_pattern():
    def plainly(texts: list[str]) -> list[list[str]]:
        parts = pa.compute.split_pattern_regex(pa.array(texts, pa.string()), pattern=r"[^\p{L}\p{N}_]+").to_pylist()
        return [[w for w in p if w] for p in parts]

    rng = random.Random(8)
    some = lambda: chr(rng.choice([rng.randrange(128), rng.randrange(0x80, 0x800), rng.randrange(0x800, 0xD800), rng.randrange(0xE000, 0x110000)]))
    texts = ["".join(some() for _ in range(rng.randrange(12))) for _ in range(3000)] + ["", "a", "b", "", "é", "-"]
    assert split_tokens(pa.array(texts, pa.string())).to_pylist() == plainly(texts)
    assert split_tokens(pa.array(texts, pa.string()).slice(7, 50)).to_pylist() == plainly(texts[7:57])
    assert split_tokens(pa.array([], pa.string())).to_pylist() == []
    long, took = pa.array(["some words, été " * 20_000] * 8), []
    for cut in (split_tokens, lambda t: pa.compute.split_pattern_regex(t, pattern=r"[^\p{L}\p{N}_]+")):
        begin = time.perf_counter()
        cut(long)
        took.append(time.perf_counter() - begin)
    assert took[0] < took[1]
