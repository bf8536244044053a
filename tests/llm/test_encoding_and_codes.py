"""Byte-pair encoding against the library, whitening against an eigensolver, codes against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import code_compression as C
from tessera.llm import whitening as W
from tessera.llm.rank_array import SHORT, RankArray, decode_documents, encode_documents
from tessera.llm.tokens import Encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<float>, label int, row long, position string, x string, v string"


def library(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def numbers(ids: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def random_texts(seed: int, count: int) -> list[str]:
    rng = random.Random(seed)
    everything = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    pools = [[chr(c) for c in range(128)], [chr(c) for c in range(0xC0, 0x250)], [chr(c) for c in range(0x300, 0x370)], [chr(c) for c in range(0x370, 0x700)]]
    pools += [everything, list(" \t\n\x0b\x0c\r\x1c\x85'.,-0123"), list("'stremvlldSTREMVLLD "), list("İıſKΣςσẞßªºŉǅ.,;)"), ["<|endoftext|>", "</w>", " ", "it's", "DON'T"]]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.choice([1, 3, 8, 20, 60, 300]))) for _ in range(count)]


def test_random_texts_encode_and_decode_as_the_library_does():
    own, plain, lib = RankArray(WORDS), Encoder(WORDS, "word"), library(WORDS)
    for text in ["GEÇTİ.", "İ;", "(Dİ)", "PARTİSİ-2", "ΣΑΣ", "Ɗ.Ɗ", *random_texts(5, 3000)]:
        want = lib.encode(text, add_special_tokens=False).ids
        assert numbers(own.encode(text)) == want, repr(text)
        assert numbers(plain.ids(text)) == want, repr(text)
        assert own.decode(own.encode(text)) == lib.decode(want, skip_special_tokens=False)


def test_random_texts_of_the_byte_level_file():
    plain, lib = Encoder(BYTES, "byte_level"), library(BYTES)
    for text in random_texts(6, 3000):
        assert numbers(plain.ids(text)) == lib.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdehtnioaé", "!?.", "theinq"])
def test_long_words_merge_alike(alphabet):
    own, lib, rng = RankArray(WORDS), library(WORDS), random.Random(len(alphabet))
    for length in (SHORT - 1, SHORT, SHORT + 1, 2 * SHORT, 5000):
        word = "".join(rng.choice(alphabet) for _ in range(length))
        assert numbers(own.encode(word)) == lib.encode(word, add_special_tokens=False).ids


def test_special_tokens_only_when_asked():
    text = "a <|endoftext|> b<|startoftext|><|ENDOFTEXT|>"
    assert numbers(RankArray(WORDS, special_tokens=True).encode(text)) == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    assert numbers(RankArray(WORDS).encode(text)) == library(WORDS).encode(text, add_special_tokens=False).ids


def test_a_file_without_word_ends_is_refused():
    with pytest.raises(ValueError, match="end-of-word"):
        RankArray(BYTES)


def test_encoding_of_documents(spark):
    long = "wort " * 30_000 + "x" * 50_000
    rows = [(1, "Hello world", "a"), (1, "Hello world", "b"), (None, None, None), (2, "", "c"), (3, long, "d"), (None, "é \U0001f600", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    lib = library(WORDS)
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in decode_documents(encode_documents(docs, WORDS), WORDS).collect()), key=repr)
    want = []
    for i, text, _ in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), struct.pack(f"<{len(ids)}I", *ids), lib.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert encode_documents(docs.limit(0), WORDS).count() == 0


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(4)
    turn, _ = np.linalg.qr(rng.normal(size=(31, 31)))
    values = np.logspace(3, -6, 31)
    found, vectors = W.jacobi(turn @ np.diag(values) @ turn.T)
    assert np.allclose(found, values, rtol=1e-6, atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(31), atol=1e-12)
    pairs = [tuple(p) for round_ in W.tournament(7) for p in zip(*round_, strict=True)]
    assert sorted(pairs) == [(a, b) for a in range(7) for b in range(a + 1, 7)]
    scaled = np.diag([1e8, 1.0, 1e-8])  # graded: the small one has to keep its digits
    rotated = scaled + 0.1 * np.sqrt(np.outer(scaled.diagonal(), scaled.diagonal())) * (1 - np.eye(3))
    assert math.isclose(W.jacobi(rotated)[0].prod(), np.linalg.det(rotated), rel_tol=1e-9)


def plain_whitening(rows, components):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max(len(v) for _, v in kept)
    x = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v + [0.0] * (dim - len(v))]) for i, v in kept]
    fit = sorted({tuple(r) for _, r in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, np.float64) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, r in x:
        white = (np.array(r) - np.array(sums) / n) @ vectors[:, :components] / np.sqrt(values[:components])
        out[i] = (n, sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)), white, values[:components] / values.sum())
    return out


def vector_rows(seed: int, count: int, dim: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(count, dim)) * np.linspace(2, 0.1, dim)
    rows = [(i, [float(np.float32(c)) for c in v], i % 3 if i % 7 else None, 9, "p", "x", "v") for i, v in enumerate(base)]
    same = rows[5][1]
    rows += [(count + i, same, 1, 9, "p", "x", "v") for i in range(count // 2)]  # a third of all rows are copies
    rows += [(900, None, 0, 9, "", "", ""), (901, [1.0, None] * (dim // 2), 0, 9, "", "", ""), (902, [float("nan")] * dim, 0, 9, "", "", ""), (903, [float("-inf")] * dim, 0, 9, "", "", "")]
    return rows


def test_whitening_equals_a_plain_reading(spark):
    rows = vector_rows(1, 300, 12) + [(904, [0.5] * 7, 0, 9, "", "", ""), (905, [], None, 9, "", "", "")]
    got = W.whiten(spark.createDataFrame(rows, VECTORS).repartition(5), components=8).collect()
    want = plain_whitening([r[:2] for r in rows], 8)
    assert len(got) == 8 * len(want) and {r.vec_id for r in got} == set(want)
    signs = {}
    for r in sorted(got, key=lambda r: (r.vec_id, r.component)):
        n, deviation, white, shares = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        assert math.isclose(r.explained, shares[r.component - 1], rel_tol=1e-9)
        assert 0 <= r.identity_error < 1e-9
        expected = white[r.component - 1]
        if abs(expected) > 1e-6:
            assert signs.setdefault(r.component, math.copysign(1, expected * r.whitened)) == math.copysign(1, expected * r.whitened)
        assert math.isclose(abs(r.whitened), abs(expected), rel_tol=1e-7, abs_tol=1e-7)


def test_whitening_of_degenerate_tables(spark):
    one = W.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, 0, "", "", ""), (1, [1.0, 2.0], 0, 0, "", "", "")], VECTORS)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(1, 1, 1, 0, None, None, None)] * 2 + [(1, 2, 1, 0, None, None, None)] * 2
    line = W.whiten(spark.createDataFrame([(i, [float(i), 0.0, 0.0], 0, 0, "", "", "") for i in range(4)], VECTORS)).collect()
    assert len(line) == 12 and all((r.whitened is None) == (r.component > 1) for r in line) and line[0].identity_error < 1e-12
    assert W.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None, 0, 0, "", "", ""), (2, [], 0, 0, "", "", "")], VECTORS)).count() == 0
    assert W.deviations(np.array([[2**39, 1]]), 3, [2**40, 5]) == [(3 * 2**39 - 2**40) ** 2 + 4] if (3 * 2**39 - 2**40) ** 2 + 4 < 2**63 else [None]


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, v, lab) for i, v, lab, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max(len(v) for _, v, _ in kept)
    width = -(-dim // parts)
    cut = []
    for i, v, lab in kept:
        x = [max(-C.MOST, min(C.MOST, math.floor(1024 * float(c)))) for c in v] + [0] * (parts * width - len(v))
        cut.append((i, lab, [tuple(x[p * width : (p + 1) * width]) for p in range(parts)]))
    cut.sort(key=lambda r: (r[0] is None, r[0]))
    books = [[r[2][p] for r in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups: dict[int, list] = {}
            for r in cut:
                groups.setdefault(nearest(r[2][p], books[p])[1], []).append(r[2][p])
            books[p] = [tuple(sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)) if e in groups else c for e, c in enumerate(books[p])]
    out, labels = [], {}
    for i, lab, own in cut:
        found = [nearest(part, books[p]) for p, part in enumerate(own)]
        out.append((i, lab, [e for _, e in found], sum(d for d, _ in found)))
        labels[lab] = labels.get(lab, 0) + out[-1][3]
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return sorted(((*r, labels[r[1]]) for r in out), key=repr), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("entries", [6, 400])
def test_codes_equal_plain_loops(spark, entries):
    rows = vector_rows(2, 120, 12) + [(904, [0.5] * 7, 0, 9, "", "", ""), (905, [], None, 9, "", "", ""), (906, [3000.0] + [0.25] * 10, 2, 9, "", "", ""), (None, [0.1] * 11, 2, 9, "", "", "")]
    got, books = C.compress(spark.createDataFrame(rows, VECTORS).repartition(5), entries=entries)
    found = sorted(((r.vec_id, r.label, r.codes, r.error, r.label_error) for r in got.collect()), key=repr)
    want, digest = plain_codes(rows, 4, entries, 4)
    assert found == want and C.digest(books) == digest


def test_codes_of_empty_tables_and_huge_components(spark):
    got, books = C.compress(spark.createDataFrame([], VECTORS))
    assert got.count() == 0 and books.size == 0
    assert C.compress(spark.createDataFrame([(1, None, 0, 9, "", "", "")], VECTORS))[0].count() == 0
    rows = [(i, [1e30 if i % 2 else -5e4, float(i), 0.0, 1.0], None, 9, "", "", "") for i in range(6)]
    found = sorted((r.vec_id, r.label, r.codes, r.error, r.label_error) for r in C.compress(spark.createDataFrame(rows, VECTORS), entries=2)[0].collect())
    assert found == plain_codes(rows, 4, 2, 4)[0]


def test_heavy_keys_are_joined_by_broadcast_and_light_ones_by_shuffle(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then -1 else id end as k")
    keyed = rows.groupBy(rows.k.alias("of")).count()
    got = C.join_counted(rows, keyed, rows.k == keyed.of, "count", 5000).where("k = of").selectExpr("count(*) n", "sum(count) s").first()
    assert (got.n, got.s) == (5000, 1667**2 + 3333)
