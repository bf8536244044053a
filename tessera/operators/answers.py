"""From ranked chunks to a prompt and an answer, and the quality of answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULTS, REFUSAL, TRIM_MARKER, Settings
from tessera.functions.text import (
    STOPWORDS,
    answer_tokens,
    citations,
    context_block,
    count_tokens,
    factual_tokens,
    lead_answer,
    normalize_answer,
    prompt,
    safe_ratio,
    strip_ws,
)

_MARKS = re.compile(r"\w+|[^\w\s]")


def trimmed_to(block_head: str, text: str, room: int) -> str:
    """The longest prefix of words and spaces whose block, with the trim marker, fits."""
    whole, end = text.strip(), 0
    glued = len(block_head) - len(block_head.rstrip()) == 0  # a head without white space at its end grows into the first piece
    used = len(_MARKS.findall(TRIM_MARKER)) + (0 if glued else len(_MARKS.findall(block_head)))
    for piece in re.finditer(r"\S+|\s+", whole):  # white space parts tokens, so those of pieces add up
        used += len(_MARKS.findall(block_head + piece[0] if glued and not end else piece[0]))
        if max(1, used) > room:
            break
        end = piece.end()
    return whole[:end] + TRIM_MARKER


def budgeted(items: DataFrame, *, budget: int, scaffold: Column, settings: Settings = DEFAULTS, trim: bool = True) -> DataFrame:
    """Items (query_id, rank, source, page, text) that fit, in rank order, with their block and cost.

    The first that does not fit ends the list. If that is the very first and enough
    room is left, it is trimmed to the room instead (``trim``).
    """
    block = context_block(F.col("rank"), F.col("source"), F.col("page"), strip_ws(F.col("text")))
    room = F.greatest(F.lit(0), F.lit(budget) - count_tokens(scaffold))
    costed = items.withColumns({"block": block, "room": room}).withColumn("cost", count_tokens(F.col("block")))
    running = F.sum("cost").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    placed = costed.withColumn("used", running)
    fits = F.col("used") <= F.col("room")
    if not trim:
        return placed.where(fits).drop("room")
    cut = (F.col("rank") == 1) & ~fits & (F.col("room") >= settings.trim_floor)
    head = F.format_string("[%d] Source: %s (Page %d)\n", F.col("rank"), F.col("source"), F.col("page"))
    trim_udf = F.udf(trimmed_to, "string", useArrow=True)  # only for first items that overflow
    kept = placed.where(fits | cut)
    shorter = F.when(cut, trim_udf(head, F.when(cut, F.col("text")).otherwise(""), F.col("room"))).otherwise(F.col("text"))
    return kept.withColumn("text", shorter).withColumn("block", context_block(F.col("rank"), F.col("source"), F.col("page"), strip_ws(F.col("text")))).withColumn("cost", count_tokens(F.col("block"))).drop("room")


def prompts(accepted: DataFrame) -> DataFrame:
    """(query_id, query, context, prompt) from accepted items that carry their query."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"])
    return accepted.groupBy("query_id").agg(F.first("query").alias("query"), F.array_join(ordered, "\n\n").alias("context")).withColumn("prompt", prompt(F.col("query"), F.col("context")))


def stub_answers(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, answer): the lead sentence of each query's first item, a refusal without one."""
    top = items.where("rank = 1").select("query_id", lead_answer(F.col("text")).alias("answer"))
    return queries.select("query_id").join(top, "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit(REFUSAL)))


def sources_of(accepted: DataFrame) -> DataFrame:
    """(query_id, sources): the accepted items as citations, in rank order; what an item lacks is null."""
    fields = ["chunk_id", "source", "page", "strategy", "dense_score", "rerank_score", "bm25_score", "rrf_score", "text"]
    held = [F.col(f) if f in accepted.columns else F.lit(None).alias(f) for f in fields]
    listed = F.sort_array(F.collect_list(F.struct("rank", F.struct(*held).alias("item"))))
    return accepted.groupBy("query_id").agg(F.transform(listed, lambda x: x["item"]).alias("sources"))


def exact_match(prediction: Column, golds: Column) -> dict[str, Column]:
    """Strict equality, and equality or containment, with any gold answer."""
    p = normalize_answer(prediction)
    norms = F.filter(F.transform(golds, normalize_answer), lambda g: g != "")
    return {"em_strict": F.exists(norms, lambda g: g == p).cast("double"), "em_contains": F.exists(norms, lambda g: F.contains(p, g)).cast("double")}


def token_f1(prediction: Column, golds: Column) -> Column:
    """The best F1 of token multisets over the gold answers."""
    mine = answer_tokens(prediction)

    def of(gold: Column) -> Column:
        own = answer_tokens(gold)
        times = lambda values, t: F.size(F.filter(values, lambda x: x == t))
        same = F.aggregate(F.transform(F.array_intersect(mine, own), lambda t: F.least(times(mine, t), times(own, t))), F.lit(0), lambda s, x: s + x)
        p, r = safe_ratio(same, F.size(mine)), safe_ratio(same, F.size(own))
        return safe_ratio(2 * p * r, p + r)

    return F.coalesce(F.array_max(F.transform(golds, of)), F.lit(0.0))


def citation_validity(answer: Column, n_chunks: Column) -> dict[str, Column]:
    found = citations(answer)
    valid = F.size(F.filter(found, lambda c: (c >= 1) & (c <= n_chunks)))
    return {"has_citation": F.size(found) > 0, "validity": safe_ratio(valid, F.size(found))}


def grounding(answer: Column, chunks: Column) -> Column:
    """Share of the answer's factual tokens that any chunk has; 1 without such tokens."""
    mine = factual_tokens(answer)
    theirs = factual_tokens(F.array_join(chunks, "\n"))
    return F.when(F.size(mine) == 0, 1.0).otherwise(safe_ratio(F.size(F.array_intersect(mine, theirs)), F.size(mine)))


def cited_grounding(answer: Column, chunks: Column) -> dict[str, Column]:
    """Grounding in the cited chunks only (in all, without a citation), to 4 digits, and what lacks ground."""
    valid = F.filter(citations(answer), lambda c: (c >= 1) & (c <= F.size(chunks)))
    base = F.when(F.size(citations(answer)) > 0, F.transform(valid, lambda c: F.get(chunks, c - 1))).otherwise(chunks)
    mine = factual_tokens(answer, STOPWORDS)
    theirs = factual_tokens(F.array_join(base, "\n"), [])
    lost = F.array_except(mine, theirs)
    return {"grounding": F.when(F.size(mine) == 0, 1.0).otherwise(F.round(1 - safe_ratio(F.size(lost), F.size(mine)), 4)), "ungrounded": F.sort_array(lost)}
