"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens goes down a tree of domain, language and source. A node splits
what it got among its children by weight; a child whose whole subtree cannot use its
share (its tokens times ``epochs``) takes what it can, and the shortage goes to its
siblings by their weights. Only a node that is short as a whole passes anything to
its own siblings. So shortages are settled among siblings before ancestors.

A leaf with ``q`` tokens to give and ``t`` tokens of its own gives each document
``q // t`` whole epochs and, of one more epoch in a seeded order, the prefix of
``q % t`` tokens; the document at its end is cut.

All is native. Order within a leaf is that of an MD5 of seed, epoch and id; running
sums go over hash ranges of a leaf first and then within each range, so that a leaf
with a third of all rows is not one task's work. Rows that are alike (leaf, id and
length) are counted before that and dealt out again after it, in pieces, so that a null
or repeated id is not one task's work either.

Defined results: null or wordless texts have 0 tokens and count as taken where the
running sum before them is below the prefix; null languages and sources are the
empty string; a leaf without a weight of its own has ``other``; a null id is ordered
like an empty one; a very long text has as many tokens as it has words; equal places in
the order go by id, then by length; repeated rows count each for itself; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, small, written

#: Rows of a leaf that one range of hashes holds, about.
RANGE_ROWS = 20_000
#: Alike rows that are dealt out together.
PIECE = 65_536
#: Sources whose domain is broadcast at most.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Mix:
    """Integer weights of domains and languages (sources of a language weigh alike), epochs at most, and the budget as hundredths of all tokens."""

    domains: dict[str, int] = field(default_factory=lambda: {"web": 50, "books": 30, "forum": 20})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 40, "fr": 20, "de": 20, "es": 20})
    other: int = 10
    epochs: int = 2
    percent: int = 100
    seed: int = 7


def domain_of(source: Column) -> Column:
    """The domain of a source by the number in its name: a stand-in where no table names the domains."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]+)", 1).try_cast("long"), F.lit(0)) % 3
    return F.when(number == 0, "web").when(number == 1, "books").otherwise("forum")


def count_words(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0)).cast("long")


def _weight(name: str, weights: dict[str, int], other: int) -> Column:
    out = F.lit(None).cast("long")
    for key, weight in weights.items():
        out = F.when(F.col(name) == key, weight).otherwise(out)
    return F.coalesce(out, F.lit(other)).cast("long")


def split_budget(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (parent, name, budget of the parent, weight, room) with their own ``share``.

    Filling to a common level: in order of room by weight, the level after each
    child is what is left by the weight that is left, and the largest of these
    levels is the one at which the budget is used up.
    """
    ratio = F.col("room").cast("double") / F.col("weight")
    everyone = Window.partitionBy(*parent)
    before = everyone.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = children.withColumn("ratio", ratio).withColumn("level", F.greatest(left, F.lit(0)).cast("double") / weight_left)
    share = F.least(F.col("room"), F.floor(F.col("weight") * F.max("level").over(everyone)).cast("long"))
    return levels.withColumn("share", share).drop("ratio", "level", "budget", "weight", "room")


def leaf_quotas(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, language, source, tokens) of all leaves with their quota."""
    sized = leaves.withColumn("room", F.col("tokens") * mix.epochs)
    languages = sized.groupBy("domain", "language").agg(F.sum("room").alias("room"))
    domains = sized.groupBy("domain").agg(F.sum("room").alias("room"), F.sum("tokens").alias("own"))
    whole = Window.partitionBy()  # one row a domain
    total = F.floor(F.sum("own").over(whole) * mix.percent / 100).cast("long")
    top = domains.select("domain", "room", total.alias("budget"), _weight("domain", mix.domains, mix.other).alias("weight"))
    top = split_budget(top, [], "domain").withColumnRenamed("share", "budget")
    middle = languages.withColumn("weight", _weight("language", mix.languages, mix.other)).join(top, "domain")
    middle = split_budget(middle, ["domain"], "language").withColumnRenamed("share", "budget")
    bottom = sized.withColumn("weight", F.lit(1).cast("long")).join(middle, ["domain", "language"])
    return split_budget(bottom, ["domain", "language"], "source").withColumnRenamed("share", "quota")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domains: DataFrame | None = None) -> DataFrame:
    """Every row's (doc_id, domain, language, source, n_tokens, copies, tokens_taken).

    ``domains`` (source, domain) names the domains of sources, one row a source; those
    that it lacks, or all without it, go by ``domain_of``.
    """
    source = F.coalesce(F.col(source_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), domain_of(source).alias("domain"), F.coalesce(F.col(lang_col), F.lit("")).alias("language"), source.alias("source"), count_words(F.col(text_col)).alias("n_tokens"))
    if domains is not None:
        named = domains.groupBy("source").agg(F.min("domain").alias("named"))
        rows = rows.join(small(named, BROADCAST_SOURCES), "source", "left").withColumn("domain", F.coalesce("named", "domain")).drop("named")
    rows = written(rows.select("doc_id", "domain", "language", "source", "n_tokens"), "mix-rows")
    leaf = ["domain", "language", "source"]
    quotas = leaf_quotas(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), mix)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens")).cast("long")).otherwise(0).cast("long")
    plans = quotas.withColumn("whole", whole).withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens")).select(*leaf, "whole", "rest")
    digits, ranges, total = 1, 16, rows.count()
    while ranges * RANGE_ROWS < total and digits < 8:
        digits, ranges = digits + 1, ranges * 16
    order = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    alike = rows.groupBy("doc_id", *leaf, "n_tokens").agg(F.count("*").alias("same"))
    planned = alike.join(plans, leaf).withColumn("order", order).withColumn("range", F.substring("order", 1, digits))
    held = F.col("n_tokens") * F.col("same")
    by_range = Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = planned.groupBy(*leaf, "range").agg(F.sum(held).alias("in_range")).select(*leaf, "range", F.coalesce(F.sum("in_range").over(by_range), F.lit(0)).alias("begin"))
    within = Window.partitionBy(*leaf, "range").orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("begin") + F.coalesce(F.sum(held).over(within), F.lit(0))
    placed = planned.join(begins, [*leaf, "range"]).withColumn("before", before)
    pieces = placed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("same") - 1, F.lit(PIECE).cast("long")))).repartition("doc_id", "n_tokens", "at")
    each = pieces.withColumn("at", F.explode(F.sequence("at", F.least(F.col("at") + PIECE, F.col("same")) - 1))).withColumn("before", F.col("before") + F.col("at") * F.col("n_tokens"))
    part = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("before")))
    return each.select("doc_id", *leaf, "n_tokens", (F.col("whole") + (F.col("before") < F.col("rest")).cast("long")).alias("copies"), (F.col("whole") * F.col("n_tokens") + part).cast("long").alias("tokens_taken"))
