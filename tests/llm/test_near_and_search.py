"""N-gram join, components and vector search against brute force."""

from __future__ import annotations

import itertools
import random
import re
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import cross_polytope as C
from tessera.llm import ngram_join as N
from tessera.llm.components import connected_components
from tessera.llm.cross_polytope import hadamard, nearest
from tessera.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, lang string, key long, token string"


def shingles(text: str | None, width: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(rows, join):
    sets = [(i, shingles(t, join.width)) for i, t in rows]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for (a, (_, s)), (b, (_, t)) in itertools.combinations(enumerate(sets), 2):
        if s and t and 100 * len(s & t) >= join.percent * len(s | t):
            root[find(a)] = find(b)
    groups: dict[int, list] = {}
    for a, (i, _) in enumerate(sets):
        groups.setdefault(find(a), []).append(i)
    low = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, len(s), low[find(a)]) for a, (i, s) in enumerate(sets)), key=repr)


def corpus(seed: int, groups: int, copies: int, edits: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 60, 150]))]
        if g % 3 == 0:
            base = base + passage
        for _ in range(rng.randrange(1, copies)):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own) if rng.random() < 0.8 else "\n".join(own).upper())
    rng.shuffle(rows)
    return list(enumerate(rows))


def run(spark, rows, join):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.ngram_jaccard_join(df, join).collect()), key=repr)


@pytest.mark.parametrize("join", [N.Join(4, 85), N.Join()])
def test_join_equals_brute_force(spark, join):
    rows = corpus(1, 40, 6, 5)
    assert run(spark, rows, join) == brute_components(rows, join)


def test_large_groups_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            own[rng.randrange(90)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    assert run(spark, rows, N.Join(4, 85)) == brute_components(rows, N.Join(4, 85))


def test_edges_of_a_group_do_not_grow_with_its_lists(spark, monkeypatch):
    rng = random.Random(7)
    rows = []
    for i in range(200):
        own = [f"b{i}" for i in range(90)]
        own[rng.randrange(90)] = f"x{i}"
        rows.append((i, " ".join(own)))
    made, plain = [], N.connected_components

    def counted(edges):
        made.append(edges.count())
        return plain(edges)

    monkeypatch.setattr(N, "connected_components", counted)
    assert {c for _, _, c in run(spark, rows, N.Join(4, 85))} == {0}
    assert len(made) == 3 and max(made) <= 2 * len(rows)  # each set with each of its tokens made ten times as many


def test_join_edge_cases(spark):
    join = N.Join(4, 85)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (9, "ONE  two"), (5, "one two three"), (6, "a b c d e f"), (6, "a b c d e f"), (None, "a b c d e f"), (7, "é É"), (8, "é É")]
    assert run(spark, rows, join) == brute_components(rows, join)
    assert run(spark, [], join) == []


def test_null_ids_link_and_long_texts_are_whole(spark):
    words = [f"w{i}" for i in range(400)]
    a, b, c = (words[:n] for n in (300, 330, 360))
    long = [f"x{i}" for i in range(30_000)]
    rows = [(5, " ".join(a)), (None, " ".join(b)), (9, " ".join(c)), (None, "alone here now it is"), (2, " ".join(long)), (3, " ".join(long[:-3000])), (4, " ".join(reversed(long)))]
    assert run(spark, rows, N.Join(4, 85)) == brute_components(rows, N.Join(4, 85))
    assert {(i, c) for i, _, c in run(spark, rows, N.Join(4, 85))} >= {(9, 5), (3, 2), (4, 4)}


def test_shingles_ignore_batches_and_offsets():
    texts = ["a b c d e", None, "", "Ünï a b", "a b c d e", " ", "x y"]
    column = pa.array(["skip this one please now", *texts]).slice(1)
    sizes, sets = [], []
    for hashes, at in shingle_sets(column, 4):
        sizes += np.diff(at).tolist()
        sets += [tuple(hashes[b:e]) for b, e in itertools.pairwise(at)]
    assert sizes == [2, 0, 0, 1, 2, 0, 1] and sets[0] == sets[4] and list(sets[0]) == sorted(sets[0])


def test_levels_only_change_the_work(spark):
    assert N.choose_level(np.full(40, 0.1), 400, 20, 8) > 1
    assert N.choose_level(np.full(40, 0.1), 4, 1, 4) == 1
    assert N.choose_level(np.full(40, 50.0), 400, 20, 8) > 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (None, 4), (30, 3)]
    found = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.vertex: r.label for r in found} == {1: 1, 2: 1, 3: 1, 30: 1, 7: 7, 8: 7, 9: 7, 5: 5}
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert {r.label for r in connected_components(path).collect()} == {0}


# --- vectors --------------------------------------------------------------------------


def brute_nearest(ids, v, k, every):
    out = {}
    for a, i in enumerate(ids):
        if i % every == 0:
            s = v @ v[a]
            order = [b for b in np.lexsort((ids, -np.round(s, 12))) if ids[b] != i][:k]
            out[i] = [ids[b] for b in order]
    return out


def recall(spark, ids, v, k=10, every=10, **more):
    df = spark.createDataFrame([(int(i), x.tolist(), "q") for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>, query_id string")
    found: dict[int, list] = {}
    for r in nearest(df, every=every, k=k, **more).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(found[r.query_id])
        assert abs(r.score - float(v[ids == r.query_id][0] @ v[ids == r.vec_id][0])) < 1e-12
    want = brute_nearest(ids, v, k, every)
    assert found.keys() == want.keys()
    return sum(len(set(found[i]) & set(want[i])) for i in want) / sum(map(len, want.values()))


def units(n, dim, seed=1):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_recall_on_unit_vectors_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(C, "SAMPLE", 500)
    monkeypatch.setattr(C, "TRIALS", 60)
    assert recall(spark, np.arange(6000), units(6000, 24)) >= 0.9


def test_recall_on_vectors_of_uneven_length(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(2000, 16)) * rng.uniform(0.2, 3, (2000, 1))
    assert recall(spark, np.arange(2000), v) >= 0.9


def test_answers_come_from_probed_buckets_only(spark, monkeypatch):
    """With one probe a query, what is found shares a bucket with it: the trials and the sample answer nothing."""
    monkeypatch.setattr(C, "fitted", lambda h, *_: (replace(h, bits=6), 1))
    v = units(1500, 16)
    found = nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), every=10, k=3).collect()
    h = C.Hashing(16, 16, 0.0, C.TABLES, bits=6)
    bucket = h.buckets(v)
    table, probed = h.probes(v, 1)
    coarse = h.__class__(16, 16, 0.0, C.TABLES, bits=1)
    own = [r for r in found if bucket[table[r.query_id, 0], r.vec_id] == probed[r.query_id, 0]]
    assert len(found) == 450 and len(own) > 400 and coarse.buckets(v).max() == 1


def test_share_of_candidates_falls_as_tables_grow():
    shares = []
    for n in (2000, 8000, 32000):
        v, q = units(n, 24), units(60, 24, seed=9)
        near = [v[np.argsort(-(v @ x))[:10]] for x in q]
        h, probes = C.fitted(C.Hashing(24, 32, 0.0, C.TABLES), q, near, v[:2000], n, 0.95)
        probed, held = C.keys_of(*h.probes(q, probes)), C.keys_of(np.arange(C.TABLES)[:, None], h.buckets(v))
        shares.append(np.mean([np.isin(held, keys).any(axis=0).mean() for keys in probed]))
    assert shares[0] > shares[1] > shares[2]


def test_copies_and_few_candidates(spark):
    v = np.vstack([np.tile([1.0, 0.0, 0.0], (60, 1)), np.eye(3)])
    assert recall(spark, np.arange(63), v, k=5) == 1.0
    assert recall(spark, np.array([0, 7, 20]), np.eye(3) + 0.1, k=20) == 1.0


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.25]), (7, [1.0, None]), (8, []), (None, [1.0, 1.0]), (1, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.rank, r.score) for r in nearest(df).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 6, 2, 0.25)]
    assert nearest(df.where("false")).count() == 0


def test_one_longer_vector_changes_nothing_else(spark):
    v = units(100, 2)
    rows = [(i, x.tolist(), "q", 1) for i, x in enumerate(v)]
    fields = "vec_id long, embedding array<double>, query string, v int"
    plain = nearest(spark.createDataFrame(rows, fields), every=10, k=5).collect()
    more = nearest(spark.createDataFrame([*rows, (1001, [1e-9, 0.0, 1.0], "q", 1)], fields), every=10, k=5).collect()
    assert {(r.query_id, r.vec_id) for r in plain} == {(r.query_id, r.vec_id) for r in more} and len(plain) == 50


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)


def test_sets_that_share_a_key_are_told_apart_by_all_128_bits(spark, monkeypatch):
    whole = N.key_of
    monkeypatch.setattr(N, "key_of", lambda s: (whole(s)[0] % 5 if len(s) != 3 else whole(s)[0], whole(s)[1]))  # nearly all keys clash
    rows = corpus(3, 25, 5, 4)
    assert run(spark, rows, N.Join(4, 85)) == brute_components(rows, N.Join(4, 85))
