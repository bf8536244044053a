"""Re-ranking of candidates, whole or to a depth, and blends with the fused score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions.text import sigmoid, tokenize
from tessera.operators.bm25 import frequencies, split_tokens
from tessera.shared import written

#: Distinct query tokens that are broadcast at once.
BROADCAST_TERMS = 500_000
#: A scorer of (query, text); a pandas function over a model fits as well.
Scorer = Callable[[Column, Column], Column]


def lexical_overlap(query: Column, text: Column) -> Column:
    """The default scorer: the share of the query's distinct tokens that the text has."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return _overlap(low(query), low(text))


@F.arrow_udf(DoubleType())
def _overlap(query: pa.Array, text: pa.Array) -> pa.Array:
    asked, held = split_tokens(query), split_tokens(text)
    words = asked.flatten().unique()
    number = lambda found: pc.index_in(found.flatten(), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = lambda found: np.repeat(np.arange(len(found)), found.value_lengths().to_numpy(zero_copy_only=False))
    width, known = max(1, len(words)), number(held)
    wanted = np.sort(row(asked) * width + number(asked))
    wanted = wanted[np.diff(wanted, prepend=-1) > 0]
    found = np.append(np.sort(row(held)[known >= 0] * width + known[known >= 0]), -1)
    met = found[np.searchsorted(found[:-1], wanted)] == wanted
    size = np.bincount(wanted // width, minlength=len(query))
    return pa.array(np.bincount(wanted // width, met, len(query)) / np.maximum(size, 1))


def term_weights(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, asked): each query's tokens in order as (place, token, idf), with IDF over all ``chunks`` (text).

    Only tokens of queries are counted, as numbers inside tasks; one row a task and token leaves them. Each
    ``BROADCAST_TERMS`` distinct tokens take one pass over the chunks.
    """
    words = queries.select("query_id", F.posexplode(tokenize(F.coalesce("query", F.lit("")))).alias("place", "token"))
    wanted = written(words.select("token").distinct(), "query-tokens")
    blocks, df = max(1, -(-wanted.count() // BROADCAST_TERMS)), None
    for block in range(blocks):
        some = wanted.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == block).toArrow()["token"].combine_chunks()
        own = _document_frequencies(chunks, chunks.sparkSession.sparkContext.broadcast(some.cast(pa.string())))
        df = own if df is None else df.union(own)
    total = chunks.agg(F.count("*").alias("n_chunks"))
    idf = F.log((F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    known = words.join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(0))).crossJoin(F.broadcast(total))
    return known.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "token", idf.alias("idf")))).alias("asked"))


def _document_frequencies(chunks: DataFrame, terms: Broadcast[pa.Array]) -> DataFrame:
    """(token, df) of those of the terms that a chunk has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, _, _ = frequencies(batches, terms.value)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([terms.value.take(pa.array(at)), pa.array(df[at])], names=["token", "df"])

    texts = chunks.select(F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return texts.mapInArrow(count, "token string, df long").groupBy("token").agg(F.sum("df").alias("df"))


def interaction(asked: Column, text: Column) -> Column:
    """Late interaction: how well each query token is met by its best place in the text, weighted by IDF; 0 to 1.

    A place is as good as what it shares with the query's: half for the token, a quarter for
    each neighbour that follows or precedes it there as in the query; a query's first
    and last token have fewer neighbours to share. A query without tokens scores 0.
    """
    return _interaction(F.transform(asked, lambda a: a["token"]), F.transform(asked, lambda a: a["idf"]), F.lower(F.coalesce(text, F.lit(""))))


@F.arrow_udf(DoubleType())
def _interaction(asked: pa.Array, idf: pa.Array, text: pa.Array) -> pa.Array:
    held = split_tokens(text)
    words = asked.flatten().unique()
    width = max(1, len(words))

    def coded(found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token its row, its number or -1, and whether another of its row follows."""
        lengths = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(found)), lengths)
        number = pc.index_in(found.flatten(), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return row, number, np.append(row[1:] == row[:-1], np.zeros(min(1, len(row)), bool))

    row, number, followed = coded(asked)
    own, known, goes_on = coded(held)
    before = np.append(np.zeros(min(1, len(row)), bool), followed[:-1])
    one = _among(row * width + number, (own * width + known)[known >= 0])
    pairs = np.flatnonzero(goes_on)
    pairs = pairs[(known[pairs] >= 0) & (known[pairs + 1] >= 0)]
    at = np.flatnonzero(followed)
    both = _among((row[at] * width + number[at]) * width + number[at + 1], (own[pairs] * width + known[pairs]) * width + known[pairs + 1])
    shared = 2.0 * one
    shared[at + 1] += both
    shared[at] += both
    weight = idf.flatten().to_numpy(zero_copy_only=False)
    met = np.bincount(row, weight * shared / (2 + before.astype(np.int64) + followed), len(asked))
    whole = np.bincount(row, weight, len(asked))
    return pa.array(np.divide(met, whole, out=np.zeros(len(asked)), where=whole != 0))


def _among(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which keys are held."""
    held = np.append(np.sort(held), -1)
    return held[np.searchsorted(held[:-1], keys)] == keys


def rerank_by_interaction(candidates: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """``rerank`` by ``interaction``; ``weights`` are of ``term_weights``."""
    known = candidates.join(weights, "query_id", "left").withColumn("asked", F.coalesce("asked", F.array().cast(weights.schema["asked"].dataType)))
    return rerank(known, k, lambda _, text: interaction(F.col("asked"), text)).drop("asked")


def alone(candidates: DataFrame) -> DataFrame:
    """Marks a query's only candidate; before texts are joined, so that they are not shuffled by query."""
    return candidates.withColumn("alone", F.count("*").over(Window.partitionBy("query_id")) == 1)


def rerank(candidates: DataFrame, k: int, scorer: Scorer = lexical_overlap) -> DataFrame:
    """The k best by the scorer; a query's only candidate gets 1.0 without being scored. ``alone`` may have marked it."""
    marked = candidates if "alone" in candidates.columns else alone(candidates)
    scored = marked.withColumn("rerank_score", F.when(F.col("alone"), 1.0).otherwise(scorer(F.col("query"), F.col("text")))).drop("alone")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 4)), "rank")
    return scored.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k)


def partial_rerank(candidates: DataFrame, depth: Column | int) -> DataFrame:
    """The first ``depth`` re-ordered by rerank_score, all others as they were."""
    deep = F.lit(depth) if isinstance(depth, int) else depth
    inside = F.col("rank") <= deep
    key = [c for c in ("query_id", "depth") if c in candidates.columns]
    order = Window.partitionBy(*key).orderBy(~inside, F.when(inside, -F.round("rerank_score", 9)), "rank")
    return candidates.withColumn("new_rank", F.row_number().over(order))


def blended(candidates: DataFrame, alpha: Column) -> DataFrame:
    """``alpha`` times the fused score, scaled to 0..1 within its query, and the rest of the sigmoid of the re-ranker's."""
    own = Window.partitionBy(*[c for c in ("query_id", "alpha") if c in candidates.columns])
    low, high = F.min("rrf_score").over(own), F.max("rrf_score").over(own)
    span = F.when(high - low > 1e-9, high - low).otherwise(1.0)
    scored = candidates.withColumn("blend", alpha * ((F.col("rrf_score") - low) / span) + (1 - alpha) * sigmoid(F.col("rerank_score")))
    return scored.withColumn("new_rank", F.row_number().over(own.orderBy(F.desc(F.round("blend", 9)), "rank")))
