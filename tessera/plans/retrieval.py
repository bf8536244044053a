"""Retrieval as one plan over a table of queries: sparse, dense or hybrid, then the final cut."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULTS, REFUSAL, TOO_LONG, Settings
from tessera.functions.text import count_tokens
from tessera.operators.answers import budgeted, prompts, sources_of, stub_answers
from tessera.operators.bm25 import bm25_top_k
from tessera.operators.dense import dense_top_k
from tessera.operators.dense_index import DenseIndex
from tessera.operators.fusion import final_cut, reciprocal_rank_fusion, result_items
from tessera.operators.posting_index import PostingIndex
from tessera.operators.rerank import Scorer, alone, rerank
from tessera.shared import written

MODES = {"sparse": "sparse", "bm25": "sparse", "hybrid": "hybrid"}


def askable(queries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Queries that are neither blank nor too long; ``respond`` and ``answer`` report the others."""
    return queries.where((F.trim(F.coalesce("query", F.lit(""))) != "") & (F.length("query") <= settings.max_query_chars))


def ranked_list(kind: str, chunks: DataFrame, asked: DataFrame, allowed: DataFrame | None, settings: Settings, index: PostingIndex | None = None, dense: DenseIndex | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``retrieve_k`` best of one kind, sparse or dense; ``vectors`` (chunk_id, v) are those of the chunks, if not in them."""
    if kind == "dense" and dense is not None and allowed is None:
        return dense.search(asked, settings.retrieve_k, query_id="query_id", query_vector="v")
    if kind == "sparse" and index is not None:
        return index.top_k(asked, settings.retrieve_k, allowed=allowed)
    if kind == "sparse":
        return bm25_top_k(chunks, asked, settings.retrieve_k, id_col="chunk_id", text_col="text", allowed=allowed, settings=settings)
    return dense_top_k(chunks if vectors is None else vectors, asked, settings.retrieve_k, id_col="chunk_id", vector_col="v", query_id="query_id", query_vector="v", allowed=allowed)


def candidates(mode: str, lists: dict[str, DataFrame], settings: Settings) -> tuple[DataFrame, str, int]:
    """Candidates of a mode from the ranked lists, the score that orders them, and its digits."""
    if mode == "hybrid":
        return reciprocal_rank_fusion(lists["dense"], lists["sparse"], top=settings.retrieve_k, settings=settings), "rrf_score", 6
    name = "bm25_score" if mode == "sparse" else "dense_score"
    return lists[mode].withColumnRenamed("score", name), name, 4


def kinds_of(mode: str) -> list[str]:
    return ["dense", "sparse"] if mode == "hybrid" else [mode]


def retrieve(chunks: DataFrame, queries: DataFrame, *, mode: str = "hybrid", scorer: Scorer | None = None, allowed: DataFrame | None = None, index: PostingIndex | None = None, dense: DenseIndex | None = None, vectors: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Result items (query_id, chunk_id, text, source, page, scores, rank).

    Chunks have chunk_id, text, source, page and, for dense parts, v, or ``vectors`` have
    chunk_id and v; queries have query_id, query and v. An unknown mode is dense; blank queries give nothing. With an
    ``index`` of these chunks, sparse parts read its postings and not the texts; with a
    ``dense`` index, dense parts are approximate, unless ``allowed`` restricts them.
    """
    asked, mode = askable(queries, settings), MODES.get(mode, "dense")
    lists = {kind: ranked_list(kind, chunks, asked, allowed, settings, index, dense, vectors) for kind in kinds_of(mode)}
    found, by, digits = candidates(mode, lists, settings)
    if scorer is None:
        return result_items(final_cut(found, by, settings.final_k, digits), chunks)
    texts = alone(found).join(chunks.select("chunk_id", "text"), "chunk_id").join(asked.select("query_id", "query"), "query_id")
    return result_items(rerank(texts, settings.final_k, scorer).drop("text", "query"), chunks)


def respond(chunks: DataFrame, queries: DataFrame, *, mode: str = "hybrid", scorer: Scorer | None = None, allowed: DataFrame | None = None, index: PostingIndex | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, status, detail, total_retrieved, results) of every query.

    A query over the longest length has status 400 and the reason; results are the
    retrieved items in rank order, none for a blank query.
    """
    items = retrieve(chunks, queries, mode=mode, scorer=scorer, allowed=allowed, index=index, settings=settings)
    found = sources_of(items).select("query_id", F.col("sources").alias("results"))
    n = F.length("query")
    long = F.coalesce(n > settings.max_query_chars, F.lit(False))
    detail = F.when(long, F.format_string(TOO_LONG, n, F.lit(settings.max_query_chars)))
    total = F.when(~long, F.coalesce(F.size("results"), F.lit(0)))
    return queries.select("query_id", "query").join(found, "query_id", "left").select("query_id", F.when(long, 400).otherwise(200).alias("status"), detail.alias("detail"), F.when(F.col("results").isNull() & ~long, 0).otherwise(total).alias("total_retrieved"), "results")


#: A generator makes an answer from (query, prompt) columns; None is the lead sentence.
Generator = Callable[[Column, Column], Column]


def answer(chunks: DataFrame, queries: DataFrame, *, mode: str = "hybrid", scorer: Scorer | None = None, system: str = "", threshold: float | None = None, generator: Generator | None = None, vectors: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, query, status, prompt, answer, n_sources, sources, prompt_tokens, completion_tokens) of every query.

    Retrieval, token budget, prompt and generator. A query without any chunk is refused
    without the generator, as is, with a threshold and a scorer, one whose best score is
    below it (its chunks stay its sources). Refusals use no tokens. An over-long query has
    status 400 and no answer.
    """
    items = written(retrieve(chunks, queries, mode=mode, scorer=scorer, vectors=vectors, settings=settings), "items")  # retrieved once, read by each part
    good = items
    if threshold is not None and scorer is not None:
        best = items.groupBy("query_id").agg(F.max("rerank_score").alias("best")).where(F.col("best") >= threshold).select("query_id")
        good = items.join(best, "query_id", "left_semi")
    asked = good.join(queries.select("query_id", "query"), "query_id")
    scaffold = F.concat(F.lit(system), F.lit("\nQuestion: "), F.col("query"), F.lit("\n\nContext:\n\n\nAnswer:"))
    accepted = budgeted(asked, budget=settings.token_budget, scaffold=scaffold, settings=settings)
    cited = accepted.select(*items.columns)
    if threshold is not None and scorer is not None:
        cited = cited.union(items.join(best, "query_id", "left_anti").select(*items.columns))
    cited = sources_of(cited)
    if generator is None:
        answers = stub_answers(accepted, queries)
        out = queries.select("query_id", "query").join(answers, "query_id").join(prompts(accepted).select("query_id", "prompt"), "query_id", "left")
    else:
        made = prompts(accepted).select("query_id", "prompt")
        out = queries.select("query_id", "query").join(made, "query_id", "left").withColumn("answer", F.when(F.col("prompt").isNull(), REFUSAL).otherwise(generator(F.col("query"), F.concat(F.lit(system), F.col("prompt")))))
    long = F.coalesce(F.length("query") > settings.max_query_chars, F.lit(False))
    used = lambda c: F.when(F.col("prompt").isNull(), 0).otherwise(c)
    out = out.join(cited, "query_id", "left")
    return out.select("query_id", "query", F.when(long, 400).otherwise(200).alias("status"), "prompt", F.when(~long, F.col("answer")).alias("answer"), F.coalesce(F.when(F.col("sources").isNotNull(), F.size("sources")), F.lit(0)).alias("n_sources"), "sources", used(count_tokens(F.concat(F.lit(system), F.col("prompt")))).alias("prompt_tokens"), used(count_tokens(F.col("answer"))).alias("completion_tokens"))


def sweep(chunks: DataFrame, queries: DataFrame, configurations: dict[str, tuple[str, dict]], vectors: DataFrame | None = None) -> DataFrame:
    """(configuration, query_id, chunk_id, rank) of every configuration (mode, changed settings).

    Ranked lists that configurations share are made once and written; texts are not carried along.
    """
    lists: dict[tuple, DataFrame] = {}
    out = None
    for name, (mode, changes) in configurations.items():
        settings, mode = replace(DEFAULTS, **changes), MODES.get(mode, "dense")
        for kind in kinds_of(mode):
            key = (kind, settings.retrieve_k, settings.k1, settings.b)
            if key not in lists:
                lists[key] = written(ranked_list(kind, chunks, askable(queries, settings), None, settings, vectors=vectors), f"{kind}-list")
        found, by, digits = candidates(mode, {k: lists[k, settings.retrieve_k, settings.k1, settings.b] for k in kinds_of(mode)}, settings)
        own = final_cut(found, by, settings.final_k, digits).select(F.lit(name).alias("configuration"), "query_id", "chunk_id", F.col("final_rank").alias("rank"))
        out = own if out is None else out.union(own)
    return out


#: The configurations of the retrieval benchmark.
BENCHMARK = {
    "bm25": ("sparse", {"final_k": 10}),
    "dense": ("dense", {"final_k": 10}),
    "hybrid_k60": ("hybrid", {"final_k": 10}),
    "hybrid_k20": ("hybrid", {"final_k": 10, "rrf_k": 20}),
    "hybrid_k100": ("hybrid", {"final_k": 10, "rrf_k": 100}),
    "weighted_70_30": ("hybrid", {"final_k": 10, "dense_weight": 0.7, "sparse_weight": 0.3}),
    "weighted_30_70": ("hybrid", {"final_k": 10, "dense_weight": 0.3, "sparse_weight": 0.7}),
}
