"""Operators against plain readings of their rules on small tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, deque
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.config import DEFAULTS, REFUSAL, TRIM_MARKER
from tessera.functions import pii, text
from tessera.operators import answers, chunking, conversations, evaluation, router, store
from tessera.operators import dense
from tessera.operators.bm25 import bm25_scores, top_k
from tessera.operators.dense import dense_top_k
from tessera.operators.fusion import reciprocal_rank_fusion, result_items
from tessera.operators.rerank import rerank
from tessera.plans.retrieval import answer, respond, retrieve
from tessera.sources.readers import ocr_available, with_ocr
from tessera.streaming.limiter import decide, rate_limit, rate_limit_stream

ODD = ["", " ", "a", "Ein Wort. Noch eins! Und?", "x_1 É ñ 中文 1.5", "tab\tline\r\nnext\x0bfour fife", "An apple, the pear; a plum.", "mail a.b@c.de +1 (555) 123-4567 EMP-12345 1.2.3.4 4111-1111-1111-1111 Titan"]


def values(spark, column, texts=ODD):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column.alias("v")).collect()]


def test_text_functions(spark):
    t = F.col("t")
    assert values(spark, text.tokenize(t)) == [re.findall(r"\w+", x.lower()) for x in ODD]
    assert values(spark, text.clean_lines(t)) == ["\n".join(s for s in (y.strip() for y in x.splitlines()) if s) for x in ODD]
    assert values(spark, text.count_tokens(t)) == [max(1, len(re.findall(r"\w+|[^\w\s]", x))) if x else 0 for x in ODD]
    assert values(spark, F.array_join(text.replay_tokens(t), "")) == ODD
    assert values(spark, text.sentences(t)) == [[s.strip() for s in re.split(r"(?<=[.!?])\s+", x) if s.strip()] for x in ODD]
    assert values(spark, text.normalize_answer(t), ["The  Cat's, a dog an."]) == ["cats dog"]
    assert values(spark, text.citations(t), ["x [1] [2, 3] [04] [99999999999]"]) == [[1, 4, None]]
    assert values(spark, text.is_heading(t), ["# Top", "1.2 Intro", "Section 3", "1 Intro", "12345", "A, B", "ok then"]) == [True, True, False, False, True, True, False]
    assert values(spark, text.lead_answer(t), ["One. Two.", "", "x" * 200]) == ["One. [1]", REFUSAL, "x" * 157 + "... [1]"]
    assert values(spark, text.table_row(F.array(F.lit("A"), F.lit("")), F.array(t, F.lit("y"))), ["x", " "]) == ["A: x | Col2: y", "Col2: y"]
    assert values(spark, text.bearer_ok(t, "k"), ["Bearer k", "Bearer x", "k"]) == [True, False, False]


def test_nulls_do_not_crash(spark):
    t = F.lit(None).cast("string")
    columns = [text.tokenize(t), text.clean_lines(t), text.count_tokens(t), text.sentences(t), text.lead_answer(t), text.is_refusal(t), pii.redacted(t), pii.redaction_count(pii.redaction(t)["counts"]), text.normalize_answer(t)]
    row = spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(columns))).first()
    assert row[2] == 0 and row[4] == REFUSAL and row[6] is None and row[7] == 0


def test_redaction_order_and_counts(spark):
    t = F.col("t")
    assert values(spark, pii.redacted(t))[-1] == "mail <EMAIL_ADDRESS> <PHONE_NUMBER> <EMPLOYEE_ID> <IP_ADDRESS> <CREDIT_CARD> <PROJECT_CODENAME>"
    assert values(spark, pii.redaction_count(pii.redaction(t)["counts"]))[-1] == 6 and values(spark, pii.redaction(t)["text"]) == values(spark, pii.redacted(t))
    assert values(spark, pii.redacted(t), ["4111111111111111"]) == ["411111<PHONE_NUMBER>"]
    assert values(spark, pii.redacted(t, pii.recognizers(["A+B"])), ["A+B Titan"])[0].endswith("Titan")


def test_failing_closed_raises(spark):
    df = spark.createDataFrame([("x",)], "t string")
    with pytest.raises(Exception, match="redaction failed"):
        df.select(pii.guarded(F.col("t"), F.lit(True), True)).collect()
    assert df.select(pii.guarded(F.col("t"), F.lit(True), False)).first()[0] == "x"


# --- retrieval -------------------------------------------------------------------

CORPUS = ["alpha beta beta gamma", "beta delta", "", "gamma gamma alpha epsilon zeta", "beta"]


def brute_bm25(corpus, query, k1=1.5, b=0.75):
    docs = [Counter(re.findall(r"\w+", d.lower())) for d in corpus]
    n, avg = len(docs), sum(map(Counter.total, docs)) / len(docs)
    out = {}
    for i, d in enumerate(docs):
        s = 0.0
        for q in re.findall(r"\w+", query.lower()):
            if d[q]:
                df = sum(q in x for x in docs)
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * d[q] * (k1 + 1) / (d[q] + k1 * (1 - b + b * d.total() / avg))
        if s > 0:
            out[i] = s
    return out


def corpus_frames(spark, queries):
    chunks = spark.createDataFrame([(i, t, "s.md", 1, v) for i, (t, v) in enumerate(zip(CORPUS, np.eye(5).tolist(), strict=True))], "chunk_id long, text string, source string, page int, v array<double>")
    asked = spark.createDataFrame([(100 + i, q, np.eye(5)[i % 5].tolist()) for i, q in enumerate(queries)], "query_id long, query string, v array<double>")
    return chunks, asked


def test_bm25_repeated_query_terms_and_scope(spark):
    queries = ["beta beta alpha", "zeta", "unknown", ""]
    chunks, asked = corpus_frames(spark, queries)
    found = {(r.query_id - 100, r.chunk_id): r.score for r in bm25_scores(chunks, asked, id_col="chunk_id").collect()}
    want = {(i, d): s for i, q in enumerate(queries) for d, s in brute_bm25(CORPUS, q).items()}
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k]) for k in want)
    only = spark.createDataFrame([(1,)], "chunk_id long")
    scoped = bm25_scores(chunks, asked, id_col="chunk_id", allowed=only).collect()
    assert {(r.query_id, r.chunk_id) for r in scoped} == {(100, 1)} and math.isclose(scoped[0].score, want[0, 1])


def test_modes_of_retrieval(spark):
    chunks, asked = corpus_frames(spark, ["beta", "  "])
    small = replace(DEFAULTS, final_k=2)
    sparse = retrieve(chunks, asked, mode="bm25", settings=small).collect()
    assert {r.query_id for r in sparse} == {100} and all(r.bm25_score > 0 and r.dense_score == 0 for r in sparse)
    dense = retrieve(chunks, asked, mode="anything", settings=small).orderBy("rank").collect()
    assert dense[0].chunk_id == 0 and dense[0].dense_score == 1.0 and dense[0].bm25_score is None
    hybrid = retrieve(chunks, asked, settings=small).collect()
    assert all(r.rrf_score > 0 for r in hybrid) and len(hybrid) == 2
    ranked = retrieve(chunks, asked, scorer=lambda q, t: F.length(t).cast("double"), settings=small).orderBy("rank").collect()
    assert ranked[0].chunk_id == 3


def test_fusion_prefers_the_dense_order_on_ties(spark):
    d = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id long, chunk_id long, score double, rank int")
    s = spark.createDataFrame([(1, 11, 5.0, 1), (1, 12, 4.0, 2)], "query_id long, chunk_id long, score double, rank int")
    found = reciprocal_rank_fusion(d, s).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == [11, 10, 12] and found[2].dense_score == 0.0
    assert math.isclose(found[0].rrf_score, 1 / 62 + 1 / 61)


def test_one_candidate_is_not_scored(spark):
    c = spark.createDataFrame([(1, 5, "q", "t", 1)], "query_id long, chunk_id long, query string, text string, rank int")
    assert rerank(c, 3, lambda q, t: F.lit(0.2)).first().rerank_score == 1.0
    assert rerank(c.where("false"), 3).count() == 0
    assert result_items(c.drop("text"), spark.createDataFrame([(5, "t")], "chunk_id long, text string")).first().source == ""


def test_dense_with_nulls_and_scope(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [-1.0, 0.0]), (5, [3.0, 0.0])], "vec_id long, embedding array<double>")
    found = dense_top_k(v, v.where("vec_id = 1"), 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in found] == [(1, 1.0), (5, 1.0)]
    assert dense_top_k(v, v.where("false"), 2).count() == 0


def test_answers_are_refused_without_chunks_and_trimmed_to_budget(spark):
    chunks, asked = corpus_frames(spark, ["beta", "unknown words"])
    found = {r.query_id: r for r in answer(chunks, asked, mode="sparse").collect()}
    assert found[101].answer == REFUSAL and found[101].n_sources == 0 and found[100].answer.endswith("[1]")
    items = spark.createDataFrame([(1, 1, "s", 1, "word " * 400), (1, 2, "s", 1, "b")], "query_id long, rank int, source string, page int, text string")
    kept = answers.budgeted(items, budget=60, scaffold=F.lit("")).collect()
    assert len(kept) == 1 and kept[0].text.endswith(TRIM_MARKER) and kept[0].cost <= 60
    assert answers.budgeted(items, budget=30, scaffold=F.lit("")).count() == 0


def test_answer_quality(spark):
    df = spark.createDataFrame([("The cat sat [1] [3]", ["cat sat down", "dog"], ["Cats and a cat sat", "other"])], "a string, g array<string>, c array<string>")
    em = answers.exact_match(F.col("a"), F.array(F.lit("cat")))
    cited = answers.cited_grounding(F.col("a"), F.col("c"))
    valid = answers.citation_validity(F.col("a"), F.lit(2))
    r = df.select(em["em_strict"].alias("x1"), em["em_contains"].alias("x2"), cited["grounding"].alias("x3"), cited["ungrounded"].alias("x4"), valid["validity"].alias("x5"), answers.token_f1(F.col("a"), F.col("g")).alias("x6")).first()
    assert tuple(r)[:5] == (0.0, 1.0, 1.0, [], 0.5) and math.isclose(r.x6, 4 / 7)


# --- chunkers -----------------------------------------------------------------------


def test_character_chunker_tail_and_small_steps():
    words = " ".join(f"w{i:03d}" for i in range(96))  # 479 characters and no break before 500
    assert [len(c) for c in chunking.character_chunks(words + "x")] == [480, 30]
    assert len(chunking.character_chunks("a " * 20 + "d" * 600)) == 41
    assert chunking.character_chunks(" \n ") == []
    table = "intro " * 60 + "\n" + "a | b | " * 40 + "\nend"
    assert chunking.character_chunks(table)[0] == ("intro " * 60).strip()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n|#A", max_size=900))
def test_chunkers_keep_every_word_character(t):
    for cut in (chunking.structure_chunks, chunking.semantic_chunks, chunking.character_chunks):
        got = Counter("".join(cut(t)).replace(" ", "").replace("\n", ""))
        want = Counter(t.replace(" ", "").replace("\n", ""))
        assert all(got[c] >= n for c, n in want.items())
    assert all(len(c) <= 510 and c == c.strip() for c in chunking.character_chunks(t))


def test_structure_chunker_rules():
    prose = "A sentence here. " * 40
    parts = chunking.structure_chunks(f"# One\n{prose}\n\n# Two\n{prose}\n\n# Three\nshort")
    assert parts[0].startswith("# One") and parts[1].startswith("# Two") and all(len(p) <= 1000 for p in parts)
    assert chunking.structure_chunks("text\n# Last") == ["text\n\n# Last"]
    assert all(p.endswith(".") and len(p) <= 350 for p in chunking.structure_chunks("One two three four. " * 40, 350))
    rows = "\n".join(f"Name: {i} | Value: {'v' * 60}" for i in range(30))
    assert all(line in rows.split("\n") for p in chunking.structure_chunks(rows) for line in p.split("\n"))
    assert chunking.structure_chunks("x" * 1500) == ["x" * 1500]
    assert chunking.structure_chunks("a | b\n\n# H\nc") == ["a | b", "# H\nc"]


def test_dangling_heading_moves_on_with_a_blank_line():
    long = "word " * 150 + "end."
    assert chunking.structure_chunks(f"{long}\n\nOVERVIEW\n\n{long}") == [long, f"OVERVIEW\n\n{long}"]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n|", max_size=300), st.integers(5, 60), st.integers(0, 20))
def test_character_windows_by_their_rule(t, size, overlap):
    begin = 0
    for b, e in chunking.character_spans(t, size, overlap):
        assert b == begin
        window = t[b : b + size]
        if b + size >= len(t):
            assert e == b + size
        else:
            line, space = window.rfind("\n"), window.rfind(" ")
            after = t[b + line + 1 :].split("\n", 1)[0].strip()
            want = line if line > 0 and chunking.is_table_line(after) else space if space > 0 else size
            assert e == b + want
        begin = max(b + 1, e - overlap)
    assert begin >= len(t)


def test_chunk_table_function(spark):
    chunking.register_chunkers(spark)
    t = "One two. " * 200
    found = spark.sql(f"select * from chunk_text('{t}', 'character')").collect()
    assert [r.chunk for r in found] == chunking.character_chunks(t) and [r.chunk_idx for r in found] == list(range(len(found)))


def test_semantic_chunker_with_mock_vectors():
    v = np.array([[1, 0, 0, 0], [1, 0, 0, 0], [0, 1, 0, 0], [0, 1, 0, 0]], float)
    t = " ".join("x" * 200 + "." for _ in range(4))
    assert [len(c) for c in chunking.semantic_chunks(t, lambda s: v)] == [403, 403]
    assert len(chunking.semantic_chunks(t, lambda s: v, least=500)) == 1


def test_chunk_table(spark):
    pages = spark.createDataFrame([(1, "a.md", 1, "One. Two."), (1, "a.md", 2, "  "), (2, None, 1, None)], "doc_id long, source string, page int, text string")
    found = chunking.chunk_pages(pages, []).collect()
    assert {r.strategy for r in found} == {"character", "structure", "semantic"} and {r.page for r in found} == {1}
    assert found[0].chunk_id == "a.md_char_p1_0"
    with pytest.raises(ValueError, match="unknown"):
        chunking.chunk_pages(pages, ["other"])


# --- routing, store, conversations, metrics --------------------------------------------


def test_router_fallback_keeps_the_confidence(spark):
    bank = spark.createDataFrame([(i, "rag" if i < 4 else "general", v) for i, v in enumerate([[1.0, 0.0]] * 4 + [[0.0, 1.0]] * 2)], "exemplar_id long, intent string, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.5]), (3, None)], "query_id long, v array<double>")
    found = {r.query_id: r for r in router.route(router.intent_scores(asked, bank), ["general", "rag"], threshold=0.7).collect()}
    assert (found[1].intent, found[1].route, found[1].confidence) == ("rag", "rag", 1.0)
    assert found[2].intent == "general" and found[2].fallback_applied and math.isclose(found[2].confidence, 0.6)
    assert 3 not in found


def test_store_life_cycle(spark, tmp_path):
    row = lambda d, i, t, s="structure": (d, "f.md", s, 1, i, t)
    schema = "doc_id long, source string, strategy string, page int, chunk_idx int, text string"
    held = store.ChunkStore(spark, f"file://{tmp_path}/store")
    assert held.read() is None and held.delete(1) == 0
    held.add(spark.createDataFrame([row(1, 0, "a"), row(1, 1, "b"), row(2, 0, "c", "semantic")], schema))
    held.add(spark.createDataFrame([row(1, 1, "B"), row(3, 0, "d")], schema))
    assert sorted((r.doc_id, r.text) for r in held.read().collect()) == [(1, "B"), (1, "a"), (2, "c"), (3, "d")]
    assert held.strategy("semantic").count() == 1
    assert held.delete(1) == 2 and held.delete(1) == 0
    assert {r.doc_id for r in store.inventory(held.read()).collect()} == {2, 3}
    assert {r.strategy: r.chunks for r in store.counts_by_strategy(held.read()).collect()} == {"character": 0, "structure": 1, "semantic": 1}
    with pytest.raises(ValueError):
        held.strategy("other")


def test_conversations(spark):
    rows = [(1, 0, "system", "s s"), (1, 1, "user", "a " * 50), (1, 2, "assistant", "b b"), (1, 3, "user", "mail x@y.zz"), (2, 0, "tool", "x@y.zz"), (2, 1, "user", "w " * 99)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = conversations.trim_to_context(turns, window=20, max_tokens=5).collect()
    assert sorted((r.conv_id, r.turn, r.fits) for r in kept) == [(1, 0, True), (1, 2, True), (1, 3, True), (2, 1, False)]
    red = {(r.conv_id, r.turn): r for r in conversations.redact_turns(turns).collect()}
    assert red[1, 3].text == "mail <EMAIL_ADDRESS>" and red[2, 0].text == "x@y.zz" and red[2, 0].redactions == 0


def test_bootstrap_interval(spark):
    rows = spark.createDataFrame([(i, float(i % 2)) for i in range(200)], "i long, x double")
    low, high = evaluation.bootstrap_ci(rows, "x", "i", rounds=400).first()
    assert 0.40 < low < 0.47 and 0.53 < high < 0.60
    assert evaluation.bootstrap_ci(rows.repartition(7), "x", "i", rounds=400).first() == (low, high)
    assert list(evaluation.bootstrap_ci(rows.where("false"), "x", "i", rounds=5).first()) == [None, None]


def test_limiter_against_a_plain_log(spark):
    rng = random.Random(3)
    rows = [(i, f"u{rng.randrange(4)}", rng.randrange(400)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, user_id string, t int").withColumn("ts", F.timestamp_seconds("t"))
    found = {r.request: (r.allowed, r.retry_after) for r in rate_limit(df, limit=3, window=60).collect()}
    logs: dict[str, list[int]] = {}
    for i, user, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        log = [x for x in logs.get(user, []) if x > t - 60]
        ok = len(log) < 3
        assert found[i] == (ok, 0 if ok else max(1, int(log[0] + 60 - t)))
        logs[user] = [*log, t] if ok else log
    odd = spark.createDataFrame([(1, "a", None), (2, None, 5), (3, "a", 7), (4, "a", 8)], "event_id long, user_id string, t int").withColumn("ts", F.timestamp_seconds("t"))
    assert {r.request: r.allowed for r in rate_limit(odd, limit=1, window=60).collect()} == {1: True, 2: True, 3: True, 4: False}
    assert rate_limit(df, enabled=False).where("not allowed").count() == 0
    assert list(decide([0, 1, 59, 60, 61], deque(), 2, 60)) == [(True, 0), (True, 0), (False, 1), (True, 0), (True, 0)]
    assert top_k(spark.createDataFrame([], "query_id long, chunk_id long, score double"), 3).count() == 0


# --- services, hooks, test sets -------------------------------------------------------


def test_person_hook_replaces_what_a_model_finds(spark):
    def model(texts):
        return [[(m.start(), m.end(), "PERSON") for m in re.finditer(r"Ada|Ada Byron", t)] + [(0, 3, "OTHER")] * t.startswith("Ada B") for t in texts]

    rows = spark.createDataFrame([(1, "Ada met Ada.", "k"), (2, None, "k"), (3, "Ada Byron", "k")], "i int, text string, found2 string")
    found = {r.i: (r.text, r.found) for r in pii.recognised(rows, "text", model).collect()}
    assert found == {1: ("<PERSON> met <PERSON>.", 2), 2: (None, 0), 3: ("<PERSON> Byron", 1)}


def test_answers_with_a_generator_sources_and_over_long_questions(spark):
    chunks, asked = corpus_frames(spark, ["beta", "unknown words", "beta " * 20])
    own = replace(DEFAULTS, max_query_chars=50)
    made = lambda q, p: F.concat(F.lit("about "), q, F.lit(" from "), F.length(p).cast("string"))
    found = {r.query_id: r for r in answer(chunks, asked, mode="sparse", generator=made, settings=own).collect()}
    assert found[100].answer == f"about beta from {len(found[100].prompt)}" and [s.chunk_id for s in found[100].sources] == [4, 0, 1][: found[100].n_sources]
    assert (found[101].answer, found[101].n_sources, found[101].completion_tokens) == (REFUSAL, 0, 0)
    assert found[102].status == 400 and found[102].answer is None and found[100].prompt_tokens > 0
    shown = {r.query_id: r for r in respond(chunks, asked, mode="sparse", settings=own).collect()}
    assert shown[102].status == 400 and "100" in shown[102].detail and shown[102].total_retrieved is None
    assert shown[101].total_retrieved == 0 and shown[100].total_retrieved == len(shown[100].results) == 3


def test_weak_best_scores_are_refused_with_their_sources(spark):
    chunks, asked = corpus_frames(spark, ["beta", "zeta"])
    score = lambda q, t: F.when(q == "beta", 0.9).otherwise(0.1)
    found = {r.query_id: r for r in answer(chunks, asked, mode="sparse", scorer=score, threshold=0.5).collect()}
    assert found[100].answer != REFUSAL and found[100].n_sources > 0
    only = found[101]
    assert only.n_sources == 1 and only.answer != REFUSAL or only.completion_tokens == 0


def test_short_items_are_found_inside_words(spark):
    docs = spark.createDataFrame([(1, "concatenate"), (2, "dog"), (3, None), (4, "")], "chunk_id long, text string")
    items = spark.createDataFrame([(10, "cat"), (11, "g"), (12, "ten"), (13, "xx yy"), (14, ""), (15, None)], "query_id long, text string")
    found = {(r.query_id, r.chunk_id) for r in evaluation.containment_pairs(docs, items).collect()}
    assert found == {(10, 1), (11, 2), (12, 1)}


def test_dense_queries_in_blocks_and_of_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BYTES", 64)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)] + [(99, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    found = dense_top_k(v, v, 2).collect()
    assert len(found) == 61 and {r.chunk_id for r in found if r.query_id == 99} == {99}


def test_upsert_among_equal_keys_goes_by_version_then_by_content(spark):
    schema = "doc_id long, strategy string, page int, chunk_idx int, text string"
    old = spark.createDataFrame([(1, "s", 1, 0, "old")], schema)
    new = spark.createDataFrame([(1, "s", 1, 0, "b"), (1, "s", 1, 0, "c"), (1, "s", 1, 0, "a")], schema)
    assert [r.text for r in store.upsert(old, new).collect()] == ["c"]


def test_store_rewrites_only_touched_buckets(spark, tmp_path):
    schema = "doc_id long, source string, strategy string, page int, chunk_idx int, text string"
    held = store.ChunkStore(spark, f"file://{tmp_path}/store")
    held.add(spark.createDataFrame([(i, "f", "structure", 1, 0, "t") for i in range(40)], schema))
    first = held.manifest()
    held.add(spark.createDataFrame([(3, "f", "structure", 1, 0, "new")], schema))
    changed = [b for b, v in held.manifest().items() if v != first.get(b)]
    assert len(changed) == 1 and held.read().count() == 40 and held.read().where("text = 'new'").count() == 1
    assert held.delete(3) == 1 and held.read().count() == 39 and held.versions() == [1, 2, 3]


def test_ocr_reads_pages_of_little_text():
    pages = [(1, "x" * 80), (2, "short"), (3, ""), (4, None)]
    read = {2: "short", 3: "scanned words", 4: " "}
    assert with_ocr(pages, read.get) == [(1, "x" * 80), (2, "short"), (3, "scanned words")]
    assert ocr_available("no-such-command-here") is None and ocr_available("python") is not None


def test_stream_of_requests_decides_as_the_batch_does(spark, tmp_path):
    rows = [(i, f"u{i % 3}", 1000 + 7 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, user_id string, t long").withColumn("ts", F.timestamp_seconds("t"))
    for n, part in enumerate((df.where("event_id < 30"), df.where("event_id >= 30"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{n}")
    want = {r.request: r.allowed for r in rate_limit(df, limit=2, window=60).collect()}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    query = rate_limit_stream(stream, limit=2, window=60, late="10 minutes").writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.request: r.allowed for r in spark.table("limited").collect()} == want
