"""Quality rules, mixing, packing, token files, wrappers and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import mixing, packing, queries as Q, token_files, tokens, wrappers
from tessera.llm.mixing import Mix, leaf_quotas, mix_sources
from tessera.llm.quality_rules import LEAST_CHARS, divergence_rules, distance
from tests.conftest import SF
from tests.test_oracles import rows

BIG = SF.replace("sf0.001", "sf0.01")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, words string, tokens long"
ODD = [(3, None), (4, ""), (5, " \n\t"), (6, "a"), (7, "x " * 60_000), (None, "é ü 中"), (8, "a b c d e\na b c d e\n\n"), (8, "a b c d e\na b c d e\n\n"), (9, "<|endoftext|> it's\x1c 12.5  end")]


def odd(spark):
    return spark.createDataFrame([(i, t, None if i == 6 else "en", None if i == 7 else "src1", "w", 5) for i, t in ODD], SCHEMA)


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_base_rules_equal_brute_force(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    found = {r.doc_id: r for r in divergence_rules(docs).collect()}
    for d in docs.collect():
        r, want = found[d.doc_id], base_counts(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_rules_keep_clean_texts_and_drop_junk(spark):
    found = Q.op1_divergence_rules(spark, BIG).toPandas().merge(spark.read.parquet(f"{BIG}/labels.parquet").toPandas(), on="doc_id")
    judged = found[~found.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.99 and judged[judged.quality == 0].kept.mean() < 0.25


def test_rules_edge_cases_and_guards(spark):
    found = divergence_rules(odd(spark)).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == sorted(base_counts(t) for _, t in ODD)
    assert divergence_rules(odd(spark).where("false")).count() == 0
    short = spark.createDataFrame([(i, "one two three four five six seven eight nine ten eleven", "en") for i in range(30)] + [(99, "### " * 12, "en")], "doc_id long, text string, lang string")
    assert LEAST_CHARS > 48 and all(r.char_distance is None for r in divergence_rules(short).collect())


def test_jensen_shannon_distance(spark):
    p, q = np.array([3.0, 1, 0, 0]), np.array([1.0, 1, 2, 4])
    a, b = p / p.sum(), q / q.sum()
    kl = lambda x, y: sum(u * math.log2(u / v) for u, v in zip(x, y, strict=True) if u)
    want = math.sqrt((kl(a, (a + b) / 2) + kl(b, (a + b) / 2)) / 2)
    df = spark.createDataFrame([([3, 1, 0, 0], [1, 1, 2, 4]), ([0, 0], [0, 0])], "p array<long>, q array<long>")
    found = [r[0] for r in df.select(distance(F.col("p"), F.col("q"))).collect()]
    assert math.isclose(found[0], want) and found[1] is None


# --- mixing ------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    ours, theirs = Q.queries()[name](spark, SF), con.execute(Q.oracle_sql()[name])
    assert rows(ours.columns, [tuple(r) for r in ours.collect()]) == rows([d[0] for d in theirs.description], theirs.fetchall())


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "fr", "c", 1000), ("books", "en", "d", 1000)], "domain string, language string, source string, tokens long")
    mix = Mix(domains={"web": 50, "books": 50}, languages={"en": 50, "fr": 50}, epochs=1, percent=40)
    got = {r.source: r.quota for r in leaf_quotas(leaves, mix).collect()}
    assert got == {"a": 10, "b": 291, "c": 301, "d": 602}


def test_mixing_edge_cases(spark):
    found = mix_sources(odd(spark)).collect()
    assert len(found) == len(ODD) and sum(r.tokens_taken for r in found) <= sum(r.n_tokens for r in found)
    assert all(r.n_tokens * max(0, r.copies - 1) <= r.tokens_taken <= r.n_tokens * r.copies for r in found)
    assert mix_sources(odd(spark).where("false")).count() == 0


def test_hot_and_null_ids_are_taken_like_a_plain_running_sum(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 4)
    table = [(None, "a b c")] * 30 + [(7, "a b")] * 9 + [(7, "a")] * 5 + [(i, "w " * (i % 4)) for i in range(100, 140)]
    docs = spark.createDataFrame([(i, t, "en", "src1") for i, t in table], "doc_id long, text string, lang string, source string")
    mix = Mix(percent=130)
    got = sorted((r.doc_id or -1, r.n_tokens, r.copies, r.tokens_taken) for r in mix_sources(docs, mix).collect())
    total = sum(len(t.split()) for _, t in table)
    rest, before, want = total * 130 // 100 - total, 0, []
    place = lambda i: hashlib.md5(f"7:1:{'' if i is None else i}".encode()).hexdigest()
    for i, t in sorted(table, key=lambda x: (place(x[0]), x[0] or -1, len(x[1].split()))):
        n = len(t.split())
        want.append((i or -1, n, 1 + (before < rest), n + max(0, min(n, rest - before))))
        before += n
    assert got == sorted(want)


def test_a_table_names_the_domains(spark):
    domains = spark.createDataFrame([("src1", "books"), ("src1", "books"), ("other", "web")], "source string, domain string")
    found = mix_sources(odd(spark), domains=domains).collect()
    assert len(found) == len(ODD) and all((r.domain == "books") == (r.source == "src1") for r in found)


# --- tokens, packing, files ------------------------------------------------------------------


def reference_ids(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name, style", [("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "word")])
def test_pieces_encode_like_whole_texts(spark, name, style):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [t or "" for _, t in ODD] + ["  a  b\n\n c\t\td ", "a b　c\x1c!", "é İ ΑΣ ς ½ ² ٣", "can't 'S 'tis", "a\x7fb \x01! \x00 !\x02  ", "ſ ŉ Ǆ"]
    coder = tokens.Encoder(public_tokenizers.path(name), style)
    assert [np.frombuffer(coder.ids(t), "<u4").tolist() for t in texts] == reference_ids(name, texts)
    small = tokens.Encoder(public_tokenizers.path(name), style)
    limit, tokens.CACHE = tokens.CACHE, 50
    try:
        assert [small.ids(t) for t in texts] == [coder.ids(t) for t in texts]
    finally:
        tokens.CACHE = limit


def check_packing(found, texts):
    ids = {k: [*i, 2] for k, i in zip(texts, reference_ids("word_bpe_49k.json", list(texts.values())), strict=True)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == ids.keys()
    for k, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[k])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[k][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[k])
    padding = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.01 * total


def test_packing_of_the_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_packing(Q.op3_packing(spark, SF).collect(), texts)


def test_packing_edge_cases(spark):
    once = odd(spark).dropDuplicates(["doc_id"])
    check_packing(packing.pack_documents(once, public_tokenizers.path("word_bpe_49k.json")).collect(), {i: t or "" for i, t in ODD})
    assert packing.pack_documents(once.where("false"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("cut", [True, False])
def test_all_limits_hold(cut):
    rng, packer, want = random.Random(1), packing.Packer(1000, 6, 300, cut), Counter()
    for k in range(400):
        n = rng.randrange(1, 900)
        begin = rng.randrange(max(0, n - 300), n + 1)
        want[k] = n
        packer.add(k, 0, n, begin)
    bears = {int(k): int(b) for k, b in zip(packer.key[: packer.n], packer.loss_from[: packer.n], strict=True)}
    got, sequences = Counter(), 0
    while packer.n:
        pieces = packer.sequence()
        sequences += 1
        assert sum(p[2] for p in pieces) <= 1000 and 0 < len(pieces) <= 6
        assert sum(max(0, s + n - max(s, bears[k])) for k, s, n in pieces) <= 300
        for k, _, n in pieces:
            got[k] += n
        assert cut or all(n == want[k] for k, _, n in pieces)
    assert got == want and sequences < 0.75 * 400


def test_token_files_round_trip(spark, tmp_path):
    docs = odd(spark)
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/files", public_tokenizers.path("byte_bpe_50k.json"))
    found = token_files.read_token_files(spark, manifest).orderBy("start").collect()
    ids = reference_ids("byte_bpe_50k.json", [t or "" for _, t in ODD])
    want = Counter((i, tuple([*x, 0])) for (i, _), x in zip(ODD, ids, strict=True))
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == want
    keys = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert keys == sorted(keys)
    at = 0
    for r in found:
        assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.n_tokens
        at += r.n_tokens
    assert token_files.read_token_files(spark, token_files.write_token_files(docs.where("false"), f"file://{tmp_path}/none", public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_one_document_is_read_alone_and_a_wrong_dictionary_refused(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/files", public_tokenizers.path("byte_bpe_50k.json"))
    all_ids = {r.doc_id: r.ids for r in token_files.read_token_files(spark, manifest).collect()}
    path, dictionary = manifest[0]["path"], (tmp_path / "files/dictionary.zdict").read_bytes()
    with token_files.reading(path) as source:
        shard = token_files.Shard(source, dictionary)
        for i in (0, len(shard.index) // 2, len(shard.index) - 1):
            assert np.frombuffer(shard.ids(i), "<u4").tolist() == all_ids[int(shard.index[i]["doc_id"])]
    with token_files.reading(path) as source, pytest.raises(ValueError):
        token_files.Shard(source, dictionary + b"x")
    raw = sum(4 * len(i) for i in all_ids.values())
    assert sum(m["bytes"] for m in manifest) < 0.5 * raw


# --- pages ------------------------------------------------------------------------------------


def plain_article(html):
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = (" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"<(?:/?p|br|/?h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_pages_equal_a_plain_reading(spark):
    found = Q.op5_wrappers(spark, BIG).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{BIG}/pages.parquet").collect()}
    assert len(found) == len(pages) and all(r.text == plain_article(pages[r.page_id]) and r.n_chars == len(r.text) for r in found)
    assert sum(r.matched for r in found) > 0.8 * len(found)


PAGE = """<html><head><title>t</title><script>if (a<b) "</p>"</script></head><body><header><h2>Site</h2></header><nav><a href=x>menu</a></nav>
<div class="cookie-notice">accept</div><main><div class="story"><h1>Head &amp; line</h1><p>First   para<b>graph</b>.</p><div class='ad'>buy</div>{more}<ul><li>one<li>two</ul></div></main>
<aside>side</aside><section id="comments"><p>reader says a long thing about it</p></section><form><p>mail</p></form><footer>foot</footer></body></html>"""


def test_other_layouts(spark):
    html = [(i, "https://a.example/x", PAGE.format(more="<p>More &#233;t&eacute; text.</p>" * (i % 4))) for i in range(12)]
    odd_pages = [(20, None, None), (21, "https://a.example/", ""), (22, "nonsense", "<p>open <b>bold"), (23, "https://b.example/", "a < b & c"), (24, "https://b.example", "<!-- x"), (25, "https://a.example/y", PAGE.format(more="")[:300])]
    df = spark.createDataFrame(html + odd_pages, "page_id long, url string, html string").withColumns({"host": F.lit("h"), "wrapper": F.lit("w"), "text": F.lit("t")})
    found = {r.page_id: r for r in wrappers.extract_pages(df).collect()}
    for i in range(12):
        assert found[i].text == "\n".join(["Head & line", "First paragraph.", *["More été text."] * (i % 4), "one", "two"])
    assert [found[i].text for i in (20, 21, 22, 23, 24)] == ["", "", "open bold", "a < b & c", ""]
    assert wrappers.extract_pages(df.where("false")).count() == 0


def test_folding_and_alignment():
    p, b = ("p", "#", "/p"), ("b", "#", "/b")
    assert wrappers.fold(["x", *p * 3, "y"]) == ("x", ("+", p), "y")
    assert wrappers.fold(["li", *p * 2, "/li"] * 2) == (("+", ("li", ("+", p), "/li")),)
    assert wrappers.align(("x", "y"), ("x", *b, "y")) == ("x", ("?", b), "y")
    known = wrappers.unified({wrappers.fold(["x", *p]), wrappers.fold(["x", *p * 4]), ("x",)})
    assert known == ("x", ("*", p))
    one, two = (wrappers.pack(w) for w in (("x", *b), ("x",)))
    assert wrappers.combine([one, two]) == wrappers.combine([two, one])


# --- the pipeline ---------------------------------------------------------------------------------


def test_pipeline_equals_its_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "ngram_jaccard_join", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, docs, SF)
        if frame.columns == seen[0][0].__fields__:
            docs = spark.createDataFrame(frame.collect(), frame.schema)
            seen.append(docs.collect())
    language, quality, near, mixed = ({r.doc_id for r in rows_} for rows_ in seen[1:])
    clean = {r.doc_id for r in seen[0] if labels.get(r.doc_id) == 1}
    assert len(clean & language) == len(clean) and len(clean & quality) >= 0.97 * len(clean)
    assert mixed <= near <= quality <= language
    from tests.llm.test_near_and_search import N, brute_components

    texts = [(r.doc_id, r.text) for r in seen[2]]
    assert near == {i for i, _, c in brute_components(texts, N.Join()) if i == c}
    packed = Counter()
    for r in frame.collect():
        packed[r.doc_id] += r.length
    own = {r.doc_id: r.text for r in seen[4]}
    times = Counter(r.doc_id for r in seen[4])
    ids = dict(zip(own, reference_ids("word_bpe_49k.json", list(own.values())), strict=True))
    assert packed == {k: times[k] * (len(ids[k]) + 1) for k in own}


def test_pipeline_stages_with_odd_rows(spark):
    docs = odd(spark).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    for empty in (False, True):
        frame = docs.where("false") if empty else docs
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SF)
            frame = spark.createDataFrame(frame.collect(), frame.schema)


def test_rows_that_share_an_id_are_decided_by_their_own_texts(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, "other text of that id here"), (2, " ".join(words)), (None, " ".join(words)), (None, "a text without an id at all"), (3, ""), (3, None), (1, " ".join(words))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == sorted([(2, " ".join(words)), (1, "other text of that id here"), (None, "a text without an id at all"), (3, ""), (3, None)], key=repr)
