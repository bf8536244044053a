"""The chat path over a table of conversations: limits, redaction, routing, answers, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULTS, Settings
from tessera.functions.text import count_tokens, downgrade_reason
from tessera.operators.conversations import check_limits, last_user_turn, redact_turns
from tessera.operators.router import intent_scores, route
from tessera.plans.ingest import embedded
from tessera.plans.retrieval import Generator, answer
from tessera.shared import written


def chat(turns: DataFrame, exemplars: DataFrame, chunks: DataFrame | None, *, intents: list[str], service: tuple[int, str | None] = (200, None), generator: Generator | None = None, vectors: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(conv_id, status, intent, confidence, route, warning, answer, redactions, tokens).

    Requests over a limit have status 400 and nothing else. The last user message is
    routed; a request for documents that cannot be served downgrades to the local route
    with the reason as its warning: ``service`` is the document service's status and its
    error (offline, timeout or an exception's name). The local route has no model here
    and gives no answer. ``vectors`` (chunk_id, v) are those of the chunks, if not in them.
    """
    limits = check_limits(turns, settings)
    clean = written(redact_turns(turns), "turns")
    asked = written(embedded(last_user_turn(clean).select(F.col("conv_id").alias("query_id"), F.col("text").alias("query")), "query"), "asked")
    routed = written(route(intent_scores(asked, exemplars, settings), intents, settings), "routed")
    status, error = service
    empty = chunks is None or chunks.isEmpty() or status != 200 or error is not None
    reason = downgrade_reason(F.lit(status), F.lit(0 if chunks is None or chunks.isEmpty() else 1), F.lit(error).cast("string"))
    found = None if empty else answer(chunks, asked.join(routed.where("route = 'rag'").select("query_id"), "query_id", "left_semi"), generator=generator, vectors=vectors, settings=settings).select("query_id", "answer")
    sums = clean.groupBy(F.col("conv_id").alias("query_id")).agg(F.sum("redactions").alias("redactions"), F.sum(count_tokens(F.col("text"))).alias("tokens"))
    out = limits.withColumnRenamed("conv_id", "query_id").join(routed, "query_id", "left").join(sums, "query_id", "left")
    out = out.withColumn("answer", F.lit(None).cast("string")) if found is None else out.join(found, "query_id", "left")
    bad = F.col("too_many") | F.col("first_too_long").isNotNull()
    down = (F.col("route") == "rag") & F.lit(empty)
    hide = lambda c: F.when(~bad, c)
    return out.select(F.col("query_id").alias("conv_id"), F.when(bad, 400).otherwise(200).alias("status"), hide(F.col("intent")).alias("intent"), hide(F.col("confidence")).alias("confidence"), hide(F.when(down, "hf_local").otherwise(F.col("route"))).alias("route"), hide(F.when(down, reason)).alias("warning"), hide(F.col("answer")).alias("answer"), hide(F.col("redactions")).alias("redactions"), hide(F.col("tokens")).alias("tokens"))
