"""Sequences of many short rows need no padding."""

from __future__ import annotations

from collections import Counter

import public_tokenizers

from tessera.llm.packing import pack_documents


def test_sequences_of_short_rows_have_lengths_of_powers_of_two(spark):
    docs = spark.createDataFrame([(i, "a" if i % 9 else "a b c") for i in range(6_000)], "doc_id long, text string").coalesce(1)
    rows = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    length, segments = Counter(), Counter()
    for r in rows:
        length[r.sequence_id] += r.length
        segments[r.sequence_id] += 1
    assert all(n & (n - 1) == 0 for n in length.values()) and max(segments.values()) <= 512
    done = Counter()
    for r in rows:
        done[r.doc_id] += r.length
    assert len(done) == 6_000 and all(done[r.doc_id] == r.doc_tokens for r in rows)


def test_loss_is_a_demand_of_its_own(spark):
    texts = ["question words here " * (5 + i % 20) + "\n" + "answer words here " * (20 + i % 50) for i in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), loss=3_200).collect()
    loss, length = Counter(), Counter()
    for r in rows:
        loss[r.sequence_id] += r.loss_tokens
        length[r.sequence_id] += r.length
    assert max(loss.values()) <= 3_200 < max(length.values()) == 4096
    assert sum(loss.values()) == sum(length.values()) - sum(3 * (5 + i % 20) for i in range(900))


def test_sequences_of_one_to_five_ids(spark):
    docs = spark.createDataFrame([(i, " ".join("a" * (i % 5))) for i in range(9_000)], "doc_id long, text string").coalesce(1)
    rows = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    length = Counter()
    for r in rows:
        length[r.sequence_id] += r.length
    assert sum(length.values()) == 9_000 * 3 and all(n & (n - 1) == 0 for n in length.values())
