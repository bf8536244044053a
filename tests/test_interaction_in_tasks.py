"""Late interaction cut and compared inside tasks, against a plain reading; and no row a token of a chunk."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from tessera.operators import rerank
from tessera.operators.rerank import interaction, term_weights


def _plain(asked: list[tuple[str, float]], text: str) -> float:
    words = re.findall(r"\w+", text.lower())
    held, pairs, tokens, met = set(words), set(zip(words, words[1:])), [t for t, _ in asked], 0.0
    for i, (token, idf) in enumerate(asked):
        before = i > 0 and (tokens[i - 1], token) in pairs
        after = i + 1 < len(asked) and (token, tokens[i + 1]) in pairs
        met += idf * (2 * (token in held) + before + after) / (2 + (i > 0) + (i + 1 < len(asked)))
    whole = sum(idf for _, idf in asked)
    return met / whole if whole else 0.0


def test_interaction_equals_a_plain_reading_and_makes_no_row_a_token(spark, monkeypatch):
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(["a", "b", "é", "w_1", "d", "E", "7"]) for _ in range(n))
    texts = [some(rng.randrange(9)) for _ in range(60)] + ["", "a", None, "b, b"]
    asked = [some(rng.randrange(1, 6)) for _ in range(12)] + ["", None, "unknown", "a", "a a"]
    chunks = spark.createDataFrame([(t,) for t in texts], "text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    for most in (500_000, 3):  # one pass, and several
        monkeypatch.setattr(rerank, "BROADCAST_TERMS", most)
        weights = term_weights(chunks, queries)
        assert "Generate explode(" not in weights._jdf.queryExecution().toString()
        found = {r.query_id: [(a.token, a.idf) for a in r.asked] for r in weights.collect()}
        for i, query in enumerate(asked):
            tokens = re.findall(r"\w+", (query or "").lower())
            df = [sum(t in re.findall(r"\w+", (x or "").lower()) for x in texts) for t in tokens]
            assert [t for t, _ in found.get(i, [])] == tokens
            assert all(abs(idf - math.log((len(texts) - n + 0.5) / (n + 0.5) + 1)) < 1e-12 for (_, idf), n in zip(found.get(i, []), df, strict=True))
    none = F.array().cast(weights.schema["asked"].dataType)
    scored = queries.join(weights, "query_id", "left").crossJoin(chunks).select("query_id", "text", interaction(F.coalesce("asked", none), F.col("text")).alias("score")).collect()
    assert len(scored) == len(texts) * len(asked)
    assert all(abs(r.score - _plain(found.get(r.query_id, []), r.text or "")) < 1e-12 for r in scored)
