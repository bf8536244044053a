"""Reciprocal-rank fusion and the final cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULTS, Settings


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, *, top: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, chunk_id, dense_score, dense_rank, bm25_score, bm25_rank, rrf_score, rank).

    A full outer join of two ranked lists; a chunk only the sparse list has keeps a
    dense score of 0. Ties follow the dense list, then the sparse one.
    """
    d = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "chunk_id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    part = lambda rank, weight: F.coalesce(F.lit(weight) / (settings.rrf_k + F.col(rank)), F.lit(0.0))
    both = d.join(s, ["query_id", "chunk_id"], "full").withColumn("rrf_score", part("dense_rank", settings.dense_weight) + part("bm25_rank", settings.sparse_weight)).withColumn("dense_score", F.coalesce("dense_score", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last())
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (top or settings.retrieve_k))


def final_cut(candidates: DataFrame, by: str, k: int, digits: int) -> DataFrame:
    """The k best by the rounded score; equal ones keep their order before."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(by, digits)), "rank")
    return candidates.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k)


def result_items(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Result rows with text and origin; scores that a mode lacks are 0 or null."""
    has = set(candidates.columns)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in has else F.lit(0.0)
    null = lambda c: F.col(c) if c in has else F.lit(None).cast("double")
    joined = candidates.join(chunks, "chunk_id")
    origin = set(chunks.columns)
    return joined.select(
        "query_id",
        "chunk_id",
        "text",
        (F.coalesce("source", F.lit("")) if "source" in origin else F.lit("")).alias("source"),
        (F.coalesce("page", F.lit(1)) if "page" in origin else F.lit(1)).alias("page"),
        zero("dense_score").alias("dense_score"),
        zero("rerank_score").alias("rerank_score"),
        null("bm25_score").alias("bm25_score"),
        null("rrf_score").alias("rrf_score"),
        F.col("final_rank" if "final_rank" in has else "rank").alias("rank"),
    )
