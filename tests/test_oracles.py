"""Every query that SQL can express gives what DuckDB gives on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from tests.conftest import SF

from tessera.oracles import ORACLES
from tessera.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(v[i]) for i in order]) for v in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.execute(ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows(ours.columns, [tuple(r) for r in ours.collect()]) == rows(columns, theirs.fetchall())


def test_every_query_has_sql_or_a_test_of_its_own():
    learned = {"dense_ivf_topk", "dense_ivf_recall", "embedder_gold_ranks", "chat_counters"}
    assert set(QUERIES) - set(ORACLES) == {"chunk_structure", "chunk_semantic", "chunk_table_function", "bootstrap_ci"} | learned


def test_queries_that_learn_or_embed(spark):
    """The approximate index against the exact query, the embedders against each other, chat against the number of conversations."""
    exact = {(r.query_id, r.chunk_id): r.score for r in QUERIES["dense_topk"](spark, SF).collect()}
    found = {(r.query_id, r.chunk_id): r.score for r in QUERIES["dense_ivf_topk"](spark, SF).collect()}
    assert len(found) == len(exact) and len(set(found) & set(exact)) >= 0.9 * len(exact)
    assert all(found[p] == exact[p] for p in set(found) & set(exact))
    report = QUERIES["dense_ivf_recall"](spark, SF).first()
    assert report.neighbours == len(exact) and report.recall >= 0.9
    hits = {r.embedder: r.mrr for r in QUERIES["embedder_gold_ranks"](spark, SF).collect()}
    assert hits["learned"] >= hits["trigrams"]
    requests = sum(r.requests for r in QUERIES["chat_counters"](spark, SF).collect())
    assert requests == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
