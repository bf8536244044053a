"""Retrieval, classification and redaction metrics as aggregations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import citations, is_full_refusal, normalize_match, safe_ratio, tokenize
from tessera.operators.answers import citation_validity, cited_grounding
from tessera.shared import written

#: Items that are broadcast at most, and bytes of their texts.
BROADCAST_ITEMS = 20_000
BROADCAST_BYTES = 64_000_000
#: (item, token) rows that are broadcast at most.
BROADCAST_TOKENS = 500_000
#: Different values of a group that are gathered to find a percentile, and pieces that more of them are cut into.
BRACKET = 10_000
GRID = 32


def gain(rank: Column, k: int = 10) -> Column:
    """1 / log2(rank + 1) within the first k, else 0."""
    return F.when(rank <= k, 1 / F.log2(rank + 1)).otherwise(0.0)


def reciprocal(rank: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(1.0), rank), F.lit(0.0))


def hit(rank: Column, k: int) -> Column:
    return F.coalesce((rank <= k).cast("double"), F.lit(0.0))


def gold_ranks(ranked: DataFrame, golds: DataFrame) -> DataFrame:
    """(query_id, gold_rank): the best rank of any gold chunk; null if none was retrieved."""
    found = ranked.join(golds, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("gold_rank"))
    return golds.select("query_id").distinct().join(found, "query_id", "left")


def contained(chunk: Column, expected: Column, both_ways: bool = False, normalized: bool = True) -> Column:
    c, e = (normalize_match(chunk), normalize_match(expected)) if normalized else (chunk, expected)
    return (F.contains(c, e) | F.contains(e, c)) if both_ways else F.contains(c, e)


def retrieval_metrics(ranks: DataFrame, by: list[str], rank: str = "gold_rank") -> DataFrame:
    """Hit@1, 3, 10 in percent, MRR and nDCG@10 of each group."""
    r = F.col(rank)
    return ranks.groupBy(*by).agg(F.count("*").alias("queries"), *(F.avg(hit(r, k) * 100).alias(f"hit_at_{k}") for k in (1, 3, 10)), F.avg(reciprocal(r)).alias("mrr"), F.avg(F.coalesce(gain(r), F.lit(0.0))).alias("ndcg_at_10"))


def bootstrap_ci(values: DataFrame, column: str, key: str, *, rounds: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(low, high): percentiles of the means of Poisson-weighted resamples.

    Every row draws its weight in every round from a hash of its ``key`` and the round, so
    the result does not depend on partitions; rows of one key draw alike. Each task
    gives one row a round, of sums over all its rows.
    """
    steps = [0.36787944117144233]  # cumulative Poisson(1)
    p = steps[0]
    for k in range(1, 8):
        p /= k
        steps.append(steps[-1] + p)
    rows = values.select(F.xxhash64(key, F.lit(seed)).alias("row"), F.col(column).cast("double").alias("x")).where("x is not null")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(rounds), np.zeros(rounds)
        turn = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            own, x = batch.column(0).to_numpy().astype(np.int64).view(np.uint64), batch.column(1).to_numpy()
            for low in range(0, len(x), 256):
                h = own[low : low + 256, None] + turn
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                weight = np.searchsorted(steps, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), side="right")
                total += x[low : low + 256] @ weight
                count += weight.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"round": np.arange(rounds), "total": total, "n": count})

    sums = rows.mapInArrow(draw, "round long, total double, n double")
    means = sums.groupBy("round").agg(F.round(F.try_divide(F.sum("total"), F.sum("n")), 12).alias("mean"))
    edge = (1 - level) / 2
    return means.agg(F.percentile("mean", edge).alias("low"), F.percentile("mean", 1 - edge).alias("high"))


def pii_scores(cases: DataFrame) -> DataFrame:
    """Recall, false positives and passes of redaction cases.

    Cases have category, expected_entity, expected_placeholder, text, redacted and redactions.
    """
    has = F.contains("redacted", "expected_placeholder")
    passed = F.when(F.col("category") == "recall", (F.col("redactions") >= 1) & has).when(F.col("category") == "false_positive", (F.col("redactions") == 0) & (F.col("redacted") == F.col("text"))).otherwise(F.col("redactions") >= 2)
    scored = cases.withColumn("passed", F.coalesce(passed, F.lit(False)).cast("int"))
    return scored.groupBy("category", "expected_entity").agg(F.count("*").alias("cases"), F.sum("passed").alias("passed"), safe_ratio(F.sum("passed"), F.count("*")).alias("rate"))


def demotions(ranks: DataFrame) -> DataFrame:
    """Counts of gold chunks that re-ranking moved from or to the first place, and of the pool's coverage."""
    pre, post = F.col("pre_rank"), F.col("post_rank")
    return ranks.agg(
        F.count("*").alias("queries"),
        F.sum(pre.isNotNull().cast("int")).alias("in_pool"),
        F.sum(F.coalesce(((pre == 1) & (F.coalesce(post, F.lit(1 << 30)) > 1)).cast("int"), F.lit(0))).alias("demoted"),
        F.sum(F.coalesce(((F.coalesce(pre, F.lit(1 << 30)) > 1) & (post == 1)).cast("int"), F.lit(0))).alias("promoted"),
    )


def containment_pairs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, chunk_id) where a document (chunk_id, text) contains an item's text (query_id, text) verbatim.

    A document that contains an item has all of the item's inner tokens (those at its ends may
    be parts of longer ones). Of these the rarest by document frequency stands for the item,
    the longer and then the smaller one of equals; documents are matched by (id, token) rows
    without their texts, then by the other inner tokens, and only what is left is read as
    text. Items of fewer than three tokens meet the documents that have their first characters,
    three at most, in a row.
    """
    own = items.where(F.coalesce("text", F.lit("")) != "").select("query_id", F.col("text").alias("expected"), tokenize(F.col("text")).alias("tokens"))
    inner = own.where(F.size("tokens") > 2).select("query_id", "expected", F.array_distinct(F.slice("tokens", 2, F.size("tokens") - 2)).alias("inner"))
    asked = inner.select("query_id", F.explode("inner").alias("token"))
    held = documents.where(F.col("chunk_id").isNotNull()).select("chunk_id", F.explode(F.array_distinct(tokenize(F.coalesce("text", F.lit(""))))).alias("token"))
    met = written(held.join(small(asked.select("token").distinct(), BROADCAST_TOKENS), "token", "left_semi"), "met-tokens")  # ids and tokens of items alone
    df = met.groupBy("token").agg(F.count("*").alias("df"))
    counted = asked.join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = counted.groupBy("query_id").agg(F.min(F.struct("df", (-F.length("token")).alias("n"), "token")).alias("r"), F.count("*").alias("needed")).where(F.col("r.df") > 0)
    keyed = written(rarest.select("query_id", F.col("r.token").alias("token"), "needed"), "rarest-tokens")
    near = met.join(small(keyed, BROADCAST_ITEMS), "token").select("query_id", "chunk_id", "needed")
    others = near.join(small(asked, BROADCAST_TOKENS), "query_id").join(met, ["chunk_id", "token"])
    likely = written(others.groupBy("query_id", "chunk_id", "needed").agg(F.count("*").alias("has")).where(F.col("has") >= F.col("needed")).select("query_id", "chunk_id"), "likely")
    texts = documents.join(small(likely.select("chunk_id").distinct(), BROADCAST_ITEMS), "chunk_id", "left_semi").select("chunk_id", "text")
    found = likely.join(texts, "chunk_id").join(inner.select("query_id", "expected"), "query_id").where(F.contains("text", "expected")).select("query_id", "chunk_id")
    short = own.where(F.size("tokens") <= 2).select("query_id", "expected", F.substring("expected", 1, 3).alias("key"))
    for r in short.select(F.length("key").alias("n")).distinct().collect():  # 1, 2 or 3
        some = small(short.where(F.length("key") == r.n), BROADCAST_ITEMS)
        begins = documents.select("chunk_id", F.explode(F.array_distinct(grams(F.col("text"), r.n))).alias("key"))
        pairs = begins.join(some.select("query_id", "key"), "key").select("query_id", "chunk_id")
        found = found.union(pairs.join(documents.select("chunk_id", "text"), "chunk_id").join(some.select("query_id", "expected"), "query_id").where(F.contains("text", "expected")).select("query_id", "chunk_id"))
    return found.distinct()


def grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters of a text, null for a shorter one."""
    letters = F.split(text, "")
    runs = F.transform(F.sequence(F.lit(1), F.size(letters) - n + 1), lambda i: F.array_join(F.slice(letters, i, n), ""))
    return F.when(F.size(letters) >= n, runs)


def demotion_causes(pairs: DataFrame) -> DataFrame:
    """Why gold chunks lost the first place: (gold_title, gold_text, preferred_title, preferred_text) a demotion.

    Counts of demotions, of those to the same article (one title within the other) with
    their percentage, and of those to a longer and to a text that is not longer.
    """
    gold, other = F.lower("gold_title"), F.lower("preferred_title")
    same = F.contains(gold, other) | F.contains(other, gold)
    longer = F.length("preferred_text") > F.length("gold_text")
    many = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return pairs.agg(F.count("*").alias("demotions"), many(same).alias("same_article"), F.round(safe_ratio(many(same) * 100, F.count("*")), 1).alias("same_article_percent"), many(longer).alias("longer_preferred"), many(~longer).alias("shorter_preferred"))


def hits_by_category(ranks: DataFrame, categories: list[str], by: list[str], rank: str = "gold_rank") -> DataFrame:
    """Hit@1 in percent of each category, a column each, and the MRR of ranks up to 3."""
    r = F.col(rank)
    columns = [F.avg(F.when(F.col("category") == c, hit(r, 1) * 100)).alias(f"{c}_hit_at_1") for c in categories]
    return ranks.groupBy(*by).agg(*columns, F.avg(F.when(r <= 3, reciprocal(r)).otherwise(0.0)).alias("mrr_at_3"))


def latency(timed: DataFrame, by: str, seconds: str) -> DataFrame:
    """Mean and 95th percentile of the milliseconds of each group."""
    ms = timed.select(by, (F.col(seconds) * 1000).alias("ms"))
    means = ms.groupBy(by).agg(F.avg("ms").alias("mean_ms"))
    tails = exact_percentile(ms, [by], "ms", 0.95).withColumnRenamed("percentile", "p95_ms")
    return means.join(tails, means[by].eqNullSafe(tails[by]), "left").select(means[by], "mean_ms", "p95_ms")


def exact_percentile(rows: DataFrame, by: list[str], value: str, share: float, bracket: int = BRACKET) -> DataFrame:
    """(by, percentile): exact and interpolated as ``percentile`` is, from buffers of a bounded size; nulls are not counted.

    Equal values are one row with a count. In groups of more than ``bracket`` different values,
    a mergeable quantile sketch cuts them into pieces, the pieces are counted exactly, and
    the piece (or two) with the wanted ranks is what the next round looks at.
    """
    names = [f"k{i}" for i in range(len(by))]
    keys = [F.col(c).alias(n) for c, n in zip(by, names, strict=True)]
    values = written(rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n")), "counted")
    whole = values.groupBy(*names).agg(F.sum("n").alias("total"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("inside"), F.lit(0).cast("long").alias("below"))
    found = written(whole, "brackets")
    first, last = F.floor((F.col("total") - 1) * F.lit(share)), F.ceil((F.col("total") - 1) * F.lit(share))
    grid = F.array(*[F.lit(i / GRID) for i in range(1, GRID)])

    def among(state: DataFrame) -> DataFrame:
        """The values between a group's low and high, with what is known of the group."""
        renamed = small(state.select(*[F.col(n).alias(f"of_{n}") for n in names], *[c for c in state.columns if c not in names]), BROADCAST_ITEMS)
        on = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"of_{n}")) for n in names], F.lit(True))
        return values.join(renamed, on).where(F.col("x").between(F.col("low"), F.col("high"))).drop(*[f"of_{n}" for n in names])

    while not (wide := found.where((F.col("inside") > bracket) & (F.col("low") < F.col("high")))).isEmpty():
        cuts = among(wide).groupBy(*names).agg(F.approx_percentile("x", grid, F.lit(100 * GRID)).alias("cuts"), *[F.first(c).alias(c) for c in ("total", "low", "high", "below")])
        piece = F.size(F.filter("cuts", lambda c: c < F.col("x")))
        pieces = among(cuts).withColumn("piece", piece).groupBy(*names, "piece").agg(F.sum("n").alias("n"), F.count("*").alias("inside"), F.min("x").alias("low"), F.max("x").alias("high"), F.first("total").alias("total"), F.first("below").alias("below"))
        ends = F.col("below") + F.sum("n").over(Window.partitionBy(*names).orderBy("piece"))  # at most GRID rows a group
        placed = pieces.withColumn("upto", ends).withColumn("from", F.col("upto") - F.col("n"))
        wanted = placed.where((F.col("from") <= last) & (F.col("upto") > first))
        again = wanted.groupBy(*names).agg(F.first("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("inside").alias("inside"), F.min("from").alias("below"))
        found = written(found.where((F.col("inside") <= bracket) | (F.col("low") >= F.col("high"))).unionByName(again), "brackets")

    lists = among(found).groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("x", "n"))).alias("values"), F.first("total").alias("total"), F.first("below").alias("below"))
    # of the values in order, the one with which the count passes a rank
    passed = lambda rank: F.aggregate("values", F.struct(F.col("below").alias("upto"), F.lit(None).cast("double").alias("x")), lambda a, v: F.struct((a["upto"] + v["n"]).alias("upto"), F.when(a["x"].isNull() & (a["upto"] + v["n"] > rank), v["x"]).otherwise(a["x"]).alias("x")))["x"]
    low, high = passed(first), passed(last)
    return lists.select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], (low + (high - low) * ((F.col("total") - 1) * F.lit(share) - first)).alias("percentile"))


def small(frame: DataFrame, bound: int) -> DataFrame:
    """``frame`` with a broadcast hint if it has at most ``bound`` rows."""
    return F.broadcast(frame) if frame.limit(bound + 1).count() <= bound else frame


def faithfulness(cases: DataFrame) -> DataFrame:
    """Each case (id, category, contexts, answer, expected_refusal) with its marks.

    A refusal is grounded. Citations count in answers that should not be refusals.
    """
    cited = cited_grounding(F.col("answer"), F.col("contexts"))
    valid = citation_validity(F.col("answer"), F.size("contexts"))
    refused = is_full_refusal(F.col("answer"))
    n = F.size(citations(F.col("answer")))
    return cases.select("id", "category", "expected_refusal", refused.alias("refused"), F.when(refused, 1.0).otherwise(cited["grounding"]).alias("grounding"), (~refused & (F.size(cited["ungrounded"]) > 0)).alias("flagged"), n.alias("citations"), F.round(valid["validity"] * n).cast("int").alias("valid"))


def faithfulness_summary(marked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Citation presence and precision, mean grounding, refusal accuracy and hallucination sensitivity, in percent."""
    answered, refusing = ~F.col("expected_refusal"), F.col("expected_refusal")
    share = lambda what, of: F.round(F.avg(F.when(of, what.cast("double"))) * 100, 2)
    cited = F.sum(F.when(answered, F.col("citations")))
    return marked.groupBy(*(by or [])).agg(
        F.count("*").alias("cases"),
        share(F.col("citations") > 0, answered).alias("citation_presence"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(answered, F.col("valid"))) * 100.0, cited), F.lit(100.0)), 2).alias("citation_precision"),
        F.round(F.avg("grounding") * 100, 2).alias("grounding"),
        share(F.col("refused"), refusing).alias("refusal_accuracy"),
        F.coalesce(share(F.col("flagged"), F.col("category") == "hallucination"), F.lit(100.0)).alias("hallucination_sensitivity"),
    )
