"""The approximate dense index against the exact scan."""

from __future__ import annotations

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.dense import dense_top_k, unit
from tessera.operators.dense_index import DenseIndex, Quantiser, kmeans, nearest_centres

SCHEMA = "vec_id long, embedding array<float>, cell string, v string"


def clustered(seed: int, count: int, dim: int = 24, centres: int = 30) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return unit(rng.normal(size=(centres, dim))[rng.integers(0, centres, count)] + 0.25 * rng.normal(size=(count, dim)))


def table(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v], "x", "y") for i, v in enumerate(x)], SCHEMA).repartition(4)


def test_quantiser_rebuilds_vectors_from_codes():
    x = clustered(1, 3000)
    q = Quantiser.fit(x, 30)
    cell, code = q.encode(x)
    rebuilt = q.centres[cell] + np.concatenate([q.books[p][code[:, p]] for p in range(code.shape[1])], axis=1)[:, : x.shape[1]]
    assert np.abs(((x - rebuilt) ** 2).sum(axis=1)).mean() < 0.3 * ((x - q.centres[cell]) ** 2).sum(axis=1).mean()
    scores = (x[:5] @ q.centres.T)[:, cell] + sum(q.tables(x[:5])[:, p][:, code[:, p]] for p in range(code.shape[1]))
    assert np.allclose(scores, x[:5] @ rebuilt.T)
    few = kmeans(np.ones((10, 3)), 4)
    assert len(few) == 1 and nearest_centres(np.ones((2, 3)), few)[1].max() < 1e-12


def test_recall_and_share_read(spark):
    x = clustered(2, 3000)
    v = table(spark, x)
    index = DenseIndex.build(v, cells=60)
    asked = v.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.chunk_id): r.score for r in dense_top_k(v, asked, 10, skip_self=True).collect()}
    probes, candidates = index.fitted(asked.select(F.col("vec_id").alias("q"), F.col("embedding").cast("array<double>").alias("v")), 10, 0.95, True)
    found = index.search(asked, 10, probes=probes, candidates=candidates, skip_self=True).collect()
    got = {(r.query_id, r.chunk_id): r.score for r in found}
    assert len(got) == len(found) == 10 * 150 and len(set(got) & set(exact)) >= 0.9 * len(exact)
    assert all(abs(got[p] - exact[p]) < 1e-9 for p in set(got) & set(exact))  # scores are of the vectors, not of their codes
    assert index.share_read(x[::20], probes) < 0.35 and index.sizes.sum() == 3000


def test_all_cells_and_candidates_are_exact(spark):
    x = clustered(3, 200)
    x[7] = x[8] = x[9]  # ties go to the smaller id
    v = table(spark, x)
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    index = DenseIndex.build(v)
    assert rows(index.search(v, 3, probes=index.cells, candidates=200)) == rows(dense_top_k(v, v, 3))


def test_tasks_are_handed_queries_and_no_tables(spark, monkeypatch):
    v = table(spark, clustered(6, 2000))
    index, sent = DenseIndex.build(v, cells=20), []
    plain = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: (sent.append(len(pickle.dumps(x))), plain(x))[1])
    assert index.search(v, 5, probes=4, candidates=20).count() == 10_000
    asked, quantiser = 2000 * index.dim * 8, len(pickle.dumps(index.quantiser))
    assert max(sent) < 2 * asked + quantiser + 2000 * 20 * 8  # a query's tables took 2 KB a part


def test_odd_rows(spark):
    odd = [(1, None, "", ""), (2, [], "", ""), (3, [0.0, 0.0], "", ""), (4, [float("nan"), 1.0], "", ""), (None, [1.0, 0.0], "", ""), (5, [1.0], "", "")]
    assert DenseIndex.build(spark.createDataFrame(odd[:4], SCHEMA)).search(spark.createDataFrame(odd, SCHEMA), 3).count() == 0
    index = DenseIndex.build(spark.createDataFrame([*odd, (6, [1.0, 1.0], "", ""), (7, [1.0, 0.0], "", ""), (7, [0.0, 1.0], "", ""), (8, [-1.0, 0.0], "", "")], SCHEMA))
    found = index.search(spark.createDataFrame([(6, [2.0, 0.0], "", ""), (9, [1.0], "", ""), (10, None, "", "")], SCHEMA), 5)
    assert [(r.query_id, r.chunk_id, round(r.score, 6)) for r in found.orderBy("rank").collect()] == [(6, 7, 1.0), (6, 6, 0.707107), (6, 7, 0.0), (6, 8, 0.0)]
    assert index.search(spark.createDataFrame([], SCHEMA), 5).count() == 0


@pytest.mark.parametrize("recall", [0.9])
def test_fitted_numbers_reach_the_recall(spark, recall):
    rng = np.random.default_rng(5)
    v = table(spark, unit(rng.normal(size=(1200, 16))))  # no clusters at all
    asked = v.where("vec_id % 30 = 0")
    exact = {(r.query_id, r.chunk_id) for r in dense_top_k(v, asked, 5).collect()}
    found = {(r.query_id, r.chunk_id) for r in DenseIndex.build(v).search(asked, 5, recall=recall).collect()}
    assert len(found & exact) >= 0.88 * len(exact)
