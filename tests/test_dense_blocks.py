"""The best vectors of a task: results, and how often they are sorted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.operators import dense


def test_pairs_are_sorted_a_few_times_a_task(monkeypatch):
    rng, k, dim = np.random.default_rng(1), 3, 4
    asked, vectors = dense.unit(rng.standard_normal((2500, dim))), rng.standard_normal((4000, dim))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(low, low + 100)), pa.array(vectors[low : low + 100].tolist())], names=["chunk_id", "v"]) for low in range(0, 4000, 100)]
    sorts, keep = [], dense.keep
    monkeypatch.setattr(dense, "keep", lambda *a: sorts.append(1) or keep(*a))
    own, chunk, score = dense.nearest(batches, np.arange(2500), asked, k, skip_self=True)
    assert len(sorts) < 5
    s = np.maximum(0.0, asked @ dense.unit(vectors).T)
    s[np.arange(2500), np.arange(2500)] = -1.0
    want = np.lexsort((np.broadcast_to(np.arange(4000), s.shape), -np.round(s, 9)), axis=1)[:, :k]
    assert own.tolist() == np.repeat(np.arange(2500), k).tolist() and chunk.tolist() == want.ravel().tolist()
    assert np.allclose(score, np.take_along_axis(s, want, 1).ravel())
