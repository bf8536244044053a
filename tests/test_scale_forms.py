"""Operators whose groups are split: percentiles, lags, running gauges, containment and the chunk store, against plain readings."""

from __future__ import annotations

import math
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, router, store
from tessera.operators.rerank import rerank_by_interaction, term_weights
from tessera.sources import readers
from tessera.streaming.live import requests_in_flight


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_percentiles_are_exact_with_few_values_at_a_time(spark, share):
    rng = random.Random(1)
    groups = {"a": [rng.gauss(0, 1) for _ in range(700)], "b": [5.0] * 400 + [rng.random() * 10 for _ in range(300)], "c": [1.5], "d": [float(2**i) for i in range(60)], None: [3.0, 1.0]}
    rows = [(g, x, "k0") for g, xs in groups.items() for x in xs] + [("a", None, "x"), ("e", None, "x")]
    df = spark.createDataFrame(rows, "g string, v double, x string").repartition(4)
    got = {r.g: r.percentile for r in evaluation.exact_percentile(df, ["g"], "v", share, bracket=20).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert abs(got[g] - float(np.percentile(xs, 100 * share))) <= 1e-12 * max(1.0, abs(got[g]))
    assert evaluation.exact_percentile(df.limit(0), ["g"], "v", share).count() == 0


def test_one_group_is_compared_over_many_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "one" if i < 300 else None, [float(c) for c in rng.normal(size=3)] if i % 50 else None, 7) for i in range(320)]
    df = spark.createDataFrame(rows, "n long, g string, v array<double>, _x int").repartition(5)
    got = {r.n: r.similarity for r in router.adjacent_similarity(df, ["g"], "n").collect()}
    want = {}
    for (i, g, v, _), (_, h, w, _) in zip(rows[1:], rows[:-1], strict=True):
        if g == h and w is not None:
            want[i] = float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) if v is not None else 0.0
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert router.adjacent_similarity(df.limit(0), ["g"], "n").count() == 0


def test_gauge_equals_a_plain_sweep(spark):
    rng, zero = random.Random(3), datetime(2024, 5, 1, tzinfo=timezone.utc)
    rows = [(zero + timedelta(seconds=rng.choice([rng.random() * 5, rng.randrange(8000)])), rng.choice([0.0, 0.000001, 1.0, rng.random() * 400]), "x") for _ in range(600)]
    df = spark.createDataFrame([*rows, (None, 1.0, "x"), (zero, None, "x"), (zero, -1.0, "x")], "ts timestamp, value double, second string").repartition(4)
    changes: Counter[int] = Counter()
    for ts, seconds, _ in rows:
        at = round((ts - zero) / timedelta(microseconds=1))
        end = at + int(np.floor(seconds * 1_000_000))
        changes[at] += 1
        changes[end] -= 1
    flying, want = 0, {}
    for at in sorted(changes):
        minute = at // 60_000_000
        peak, _ = want.get(minute, (flying, 0))
        flying += changes[at]
        want[minute] = (max(peak, flying), flying)
    got = {round((r.unit_start.replace(tzinfo=timezone.utc) - zero) / timedelta(minutes=1)): (r.peak, r.current) for r in requests_in_flight(df).withColumn("unit_start", F.date_format("unit_start", "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz")).collect()}
    assert got == want and flying == 0 and max(p for p, _ in got.values()) > 50
    assert requests_in_flight(df.limit(0)).count() == 0


def test_containment_by_the_rarest_token_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "the", "the", "red", "fox", "é1", "Run", "a", "b.", "x,", "12"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(25))) for _ in range(80)] + ["", None, "thefoxes", "redthefoxy 12x"]
    parts = [t[i : i + rng.randrange(1, 18)] for t in texts[:40] if t for i in [rng.randrange(len(t))]] + ["fox", "", None, "the the", "no such words here"]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "chunk_id long, text string, token string").repartition(3)
    items = spark.createDataFrame([(i, t, "q") for i, t in enumerate(parts)], "query_id long, text string, df string")
    got = {(r.query_id, r.chunk_id) for r in evaluation.containment_pairs(docs, items).collect()}
    assert got == {(q, c) for q, p in enumerate(parts) for c, t in enumerate(texts) if p and t and p in t}
    assert evaluation.containment_pairs(docs.limit(0), items).count() == 0


def test_two_writers_of_the_store_lose_nothing(spark, tmp_path):
    schema = "doc_id long, source string, strategy string, page int, chunk_idx int, text string"
    rows = lambda ids, t: spark.createDataFrame([(i, "f", "structure", 1, 0, t) for i in ids], schema)
    one, two = (store.ChunkStore(spark, f"file://{tmp_path}/store", buckets=4) for _ in range(2))
    one.add(rows(range(12), "old"))
    create, done = one.commits.create, []

    def late(version, manifest):
        """While the first writer commits, the other one changes the same bucket and others."""
        if not done:
            done.append(True)
            two.add(rows([3, 50, 51, 52], "two"))
            assert two.delete(5) == 1
        return create(version, manifest)

    one.commits.create = late
    one.add(rows([3, 60, 7], "one"))
    held = {r.doc_id: r.text for r in one.read().collect()}
    assert held == {i: "old" for i in range(12) if i != 5} | {50: "two", 51: "two", 52: "two", 3: "one", 60: "one", 7: "one"}
    assert one.versions() == [1, 2, 3, 4]
    assert one.vacuum() and {r.doc_id for r in two.read().collect()} == set(held) and two.versions() == [4]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = ["" if i % 11 == 3 else "not json" if i % 17 == 5 else '{"a": %d, "b": "%s"}' % (i, "x" * (i % 40)) for i in range(900)]
    (tmp_path / "one.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "two.jsonl").write_text('{"a": 1}\r\n\r\n{"a": "oops"}\r\n{"a": 4}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        path = f"file://{tmp_path}/*.jsonl"
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        numbered = {(r.file.rsplit("/", 1)[1], r.line_num): r.line for r in readers.numbered_lines(spark, path).collect()}
        assert numbered == {("one.jsonl", i + 1): x for i, x in enumerate(lines)} | {("two.jsonl", i + 1): x for i, x in enumerate(['{"a": 1}\r', "\r", '{"a": "oops"}\r', '{"a": 4}'])}
        found = sorted((r.line_num, r.a) for r in readers.read_numbered_jsonl(spark, f"file://{tmp_path}/one.jsonl", "a long, b string").collect())
        assert found == [(i + 1, i) for i, x in enumerate(lines) if x.startswith("{")]
        counts = {r.file.rsplit("/", 1)[1]: (r.lines, r.malformed) for r in readers.malformed_lines(spark, path, "a long, b string").collect()}
        assert counts == {"one.jsonl": (sum(x != "" for x in lines), lines.count("not json")), "two.jsonl": (3, 1)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_interaction_weighs_tokens_and_their_neighbours(spark):
    texts = ["The red fox runs", "fox red the", "runs the red fox home", "", None, "nothing alike", "fox"]
    asked = ["the red fox", "fox", "runs home fox", "", None, "zebra"]
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    words = [(t or "").lower().split() for t in texts]

    def plain(query: str | None, own: list[str]) -> float:
        q = (query or "").lower().split()
        idf = [math.log((len(texts) - (n := sum(t in w for w in words)) + 0.5) / (n + 0.5) + 1) for t in q]
        pairs = set(zip(own, own[1:], strict=False))
        got = 0.0
        for i, t in enumerate(q):
            around = [(q[i - 1], t)] * (i > 0) + ([(t, q[i + 1])] if i + 1 < len(q) else [])
            got += idf[i] * (2 * (t in own) + sum(p in pairs for p in around)) / (2 + len(around))
        return got / sum(idf) if q else 0.0

    pool = chunks.crossJoin(queries).withColumn("rank", F.col("chunk_id") + 1)
    found = rerank_by_interaction(pool, term_weights(chunks, queries), 99).collect()
    assert len(found) == len(texts) * len(asked)
    assert all(abs(r.rerank_score - plain(asked[r.query_id], words[r.chunk_id])) < 1e-9 for r in found)
    assert {r.chunk_id for r in found if r.query_id == 0 and r.final_rank <= 2} == {0, 2}
