"""Rows of a new shard and of the dead: whole arrays, as one term after another gives them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import posting_blocks, posting_index
from tests.test_posting_blocks import zipf_texts


@pytest.mark.parametrize("texts", [zipf_texts(21, 900), [["a"], [], ["b", "a", "a"]], [[], []]])
def test_a_new_shard_is_sorted_at_once(texts, monkeypatch):
    for module in (posting_blocks, posting_index):
        monkeypatch.setattr(module, "BLOCK", 16)
    ids, tokens = pa.array(range(5, 5 + len(texts)), pa.int64()), pa.array(texts, pa.list_(pa.string()))
    shard, terms = posting_blocks.shard_of(ids.to_numpy(), tokens, None)
    want = posting_index.rows_of(7, shard, dict(enumerate(terms.to_pylist())), pa.int64(), 4).to_pylist()
    monkeypatch.setattr(posting_blocks, "ordered", None)  # no work a term
    got = [r for b in posting_index.shard_rows(7, ids, tokens, 4) for r in b.to_pylist()]
    assert got[0] == want[0] and sorted(got[1:], key=lambda r: r["term"]) == want[1:]


def test_the_dead_of_each_term_are_counted_in_one_pass_over_a_shard():
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for segment, number in (("s", 0), ("s", 1), ("t", 1), ("u", 3)):
        dead = sorted(rng.choice(60, 20, replace=False).tolist()) if segment != "u" else []
        if dead:
            rows.append((segment, number, None, dead))
        for term in ("a", "b", "c"):
            own = rng.choice(80, 30, replace=False).tolist()
            rows.append((segment, number, term, own))
            lost = len(set(own) & set(dead))
            want[segment, term] = want.get((segment, term), 0) + lost
    types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32())]
    whole = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["segment", "shard", "term", "rows"])
    for size in (1, 3, 100):
        got: dict = {}
        for batch in posting_index.lost_by(iter(whole.to_batches(max_chunksize=size))):
            for r in batch.to_pylist():
                got[r["segment"], r["term"]] = got.get((r["segment"], r["term"]), 0) + r["df"]
        assert got == {k: n for k, n in want.items() if n}
