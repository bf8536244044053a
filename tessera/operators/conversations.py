"""Chat requests as rows (conv_id, turn, role, text): limits, redaction, trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULTS, Settings
from tessera.functions.pii import redaction, redaction_count
from tessera.functions.text import count_tokens

REDACTED_ROLES = ["user", "system", "assistant"]


def check_limits(turns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(conv_id, n_messages, too_many, first_too_long): the index of the first message over its limit."""
    over = F.length("text") > settings.max_message_chars
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_messages"), (F.count("*") > settings.max_messages).alias("too_many"), F.min(F.when(over, F.col("turn"))).alias("first_too_long"))


def redact_turns(turns: DataFrame) -> DataFrame:
    """Texts of user, system and assistant redacted, with their count; other roles as they are."""
    own = F.col("role").isin(REDACTED_ROLES)
    clean = turns.withColumn("_clean", redaction(F.col("text")))
    return clean.withColumns({"redactions": F.when(own, redaction_count(F.col("_clean.counts"))).otherwise(0), "text": F.when(own, F.col("_clean.text")).otherwise(F.col("text"))}).drop("_clean")


def last_user_turn(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("role") == "user").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def trim_to_context(turns: DataFrame, *, window: int, max_tokens: int, overhead: int = 0) -> DataFrame:
    """The turns that stay: a leading system message and the longest run of last turns that fits.

    The last turn always stays; ``fits`` is false where even that is too much.
    """
    own = Window.partitionBy("conv_id")
    costed = turns.withColumn("tokens", count_tokens(F.col("text")) + overhead)
    first = F.first("role").over(own.orderBy("turn")) == "system"
    leading = first & (F.row_number().over(own.orderBy("turn")) == 1)
    costed = costed.withColumns({"leading": leading, "last": F.row_number().over(own.orderBy(F.desc("turn"))) == 1})
    fixed = F.sum(F.when(F.col("leading"), F.col("tokens")).otherwise(0)).over(own)
    after = F.sum(F.when(F.col("leading"), 0).otherwise(F.col("tokens"))).over(own.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    room = F.lit(window - max_tokens)
    kept = costed.withColumns({"need": fixed + after})
    stays = F.col("leading") | F.col("last") | (F.col("need") <= room)
    least = F.max(F.when(F.col("last"), F.col("need"))).over(own)
    return kept.withColumn("fits", least <= room).where(stays).drop("leading", "last", "need")
