"""The stored index against ranking from scratch, after additions, replacements, deletions, merges and two writers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import posting_index
from tessera.operators.bm25 import bm25_top_k
from tessera.operators.commits import Commits, ConflictError
from tessera.operators.posting_index import PostingIndex
from tests.test_posting_blocks import zipf_texts


def table(spark, rows, kind="long"):
    return spark.createDataFrame([(str(i), t, "x") for i, t in rows], "chunk_id string, text string, term string").withColumn("chunk_id", F.col("chunk_id").cast(kind)).repartition(3)


def same(index, spark, alive, asked, k=4, kind="long"):
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())
    want = bm25_top_k(table(spark, alive.items(), kind), asked, k, id_col="chunk_id")
    assert index.statistics() == (len(alive), sum(len((t or "").split()) for t in alive.values()))
    assert rows(index.top_k(asked, k)) == rows(want)


def test_three_upserts_and_a_delete_equal_a_rebuild(spark, tmp_path):
    texts = [" ".join(t) for t in zipf_texts(21, 240, 30)]
    asked = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(zipf_texts(22, 12, 7))] + [(90, "zzz"), (91, None)], "query_id long, query string")
    index, alive = PostingIndex(spark, f"file://{tmp_path}/index", parts=2), {}
    assert index.top_k(asked, 3).count() == 0 and index.statistics() == (0, 0)
    batches = [{i: texts[i] for i in range(120)}, {i: texts[i + 100] for i in range(100, 140)} | {500: "", 501: None}, {i: texts[i + 60] for i in range(0, 180, 9)}]
    written = []
    for batch in batches:
        index.add(table(spark, batch.items()))
        alive |= batch
        written.append({f.name: [p.stat().st_mtime_ns for p in sorted(f.rglob("*.parquet"))] for f in (tmp_path / "index").iterdir() if f.name.startswith("s-")})
    assert all(older.items() <= newer.items() for older, newer in zip(written, written[1:], strict=False))  # no segment is written again
    index.delete(table(spark, [(i, "") for i in [*range(0, 90, 4), 9999]]))
    alive = {i: t for i, t in alive.items() if i not in range(0, 90, 4)}
    same(index, spark, alive, asked)
    version = index.commits.read()[0]
    assert index.delete(table(spark, [(7777, "")])) == version  # nothing to remove
    before = {s["name"] for s in index.commits.read()[1]["segments"]}
    for n in (1000, 2000, 3000):
        index.add(table(spark, [(n + i, t) for i, t in enumerate(texts[:3])]))
    index.add(table(spark, [(0, "w1 w2"), (9, "w1"), (3002, "w3")]))  # one comes back, others are replaced again
    alive |= {n + i: t for n in (1000, 2000, 3000) for i, t in enumerate(texts[:3])} | {0: "w1 w2", 9: "w1", 3002: "w3"}
    same(index, spark, alive, asked)
    assert index.compact() >= 4 and any(s["name"] in before for s in index.commits.read()[1]["segments"])  # the small ones alone
    same(index, spark, alive, asked)
    kept = {s["name"] for s in index.commits.read()[1]["segments"]}
    assert not kept & set(index.vacuum()) and not index.vacuum()
    same(index, spark, alive, asked)


def test_ids_may_be_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(posting_index, "PUSHED_TERMS", 2)  # terms are joined
    texts = [" ".join(t) for t in zipf_texts(23, 60, 12)]
    asked = spark.createDataFrame([("a", "w0 w1 w4"), ("b", "w3 w5")], "query_id string, query string")
    index = PostingIndex(spark, f"file://{tmp_path}/index", parts=2)
    index.add(table(spark, enumerate(texts), "string"))
    index.delete(table(spark, [(3, ""), (44, "")], "string"))
    same(index, spark, {i: t for i, t in enumerate(texts) if i not in (3, 44)}, asked, kind="string")


def test_shards_are_bounded_and_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(posting_index, "SHARD_TOKENS", 1)  # a shard a batch
    texts = [" ".join(t) for t in zipf_texts(31, 90, 20)]
    index = PostingIndex(spark, f"file://{tmp_path}/index", parts=2)
    for low in range(0, 80, 20):
        index.add(table(spark, list(enumerate(texts))[low : low + 20]))
    index.delete(table(spark, [(i, "") for i in range(20, 40)]))  # one segment is all dead
    assert index.compact() == 0 and len(index.tiers(index.commits.read()[1])) == 2
    index.add(table(spark, list(enumerate(texts))[80:]))
    index.delete(table(spark, [(i, "") for i in range(41, 80)]))
    alive = {i: t for i, t in enumerate(texts) if i < 20 or i == 40 or i >= 80}
    asked = spark.createDataFrame([(1, "w0 w1"), (2, "w3 w3 w17")], "query_id long, query string")
    same(index, spark, alive, asked)
    while index.compact():
        pass
    same(index, spark, alive, asked)


def test_two_writers_lose_nothing(spark, tmp_path):
    texts = dict(enumerate(" ".join(t) for t in zipf_texts(41, 60, 12)))
    asked = spark.createDataFrame([(1, "w0 w1"), (2, "w3 w5")], "query_id long, query string")
    one = PostingIndex(spark, f"file://{tmp_path}/index", parts=2)
    one.add(table(spark, texts.items()))
    two = PostingIndex(spark, f"file://{tmp_path}/index", parts=2)
    create, before = one.commits.create, []

    def late(version, manifest):
        """While the first writer commits, the second one replaces one of its chunks and adds others."""
        if not before:
            before.append(two.add(table(spark, [(5, "w0 w0"), (300, "w1 w3")])))
        return create(version, manifest)

    one.commits.create = late
    one.add(table(spark, [(5, "w5 w5"), (6, "w1"), (400, "w0")]))
    same(one, spark, texts | {300: "w1 w3", 5: "w5 w5", 6: "w1", 400: "w0"}, asked)
    assert two.commits.versions() == [1, 2, 3]


def test_versions_are_created_once(spark, tmp_path):
    commits = Commits(spark, f"file://{tmp_path}/c")
    assert commits.read() == (0, {}) and commits.folders() == []
    assert commits.create(1, {"a": 1}) and not commits.create(1, {"a": 2}) and commits.read() == (1, {"a": 1})
    assert [p.name for p in (tmp_path / "c").glob(".m1*part")] == []
    assert commits.change(1, lambda m: m | {"b": 2}) == 2 and commits.read() == (2, {"a": 1, "b": 2})
    with pytest.raises(ConflictError, match="both"):
        commits.change(1, lambda m: m, lambda now: "both")


def test_a_scope_restricts_what_is_scored_and_no_statistics(spark, tmp_path):
    texts = dict(enumerate(" ".join(t) for t in zipf_texts(51, 80, 12)))
    asked = spark.createDataFrame([(1, "w0 w1"), (2, "w3 w5")], "query_id long, query string")
    index = PostingIndex(spark, f"file://{tmp_path}/index", parts=2)
    index.add(table(spark, texts.items()))
    index.delete(table(spark, [(3, "")]))
    del texts[3]
    only = spark.createDataFrame([(i,) for i in range(0, 80, 3)], "chunk_id long")
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())
    assert rows(index.top_k(asked, 5, allowed=only)) == rows(bm25_top_k(table(spark, texts.items()), asked, 5, id_col="chunk_id", allowed=only))
