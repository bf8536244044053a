"""Intent routing: mean of the nearest exemplars of each intent, with a threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULTS, Settings
from tessera.functions.text import normalize_dedup, routing_warning, safe_ratio
from tessera.shared import written

#: Exemplars are a small, hand-kept table; a larger one is refused.
EXEMPLAR_BOUND = 20_000


def intent_scores(queries: DataFrame, exemplars: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, intent, score): the mean of the ``router_top`` largest cosines.

    Queries (query_id, v), exemplars (exemplar_id, intent, v), all unit vectors. The
    exemplars are handed to every task within their bound; queries are scored in
    blocks and never shuffled.
    """
    bank = exemplars.select("intent", "v").limit(EXEMPLAR_BOUND + 1).toPandas()
    if len(bank) > EXEMPLAR_BOUND:
        raise ValueError("too many exemplars")
    intents = sorted(bank["intent"].unique())
    shared = queries.sparkSession.sparkContext.broadcast({i: np.stack(bank["v"][bank["intent"] == i].to_list()).astype(np.float64) for i in intents})
    top = settings.router_top

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and shared.value:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                best = [np.sort(v @ bank.T, axis=1)[:, ::-1][:, :top].mean(axis=1) for bank in shared.value.values()]
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(batch.column(0).to_numpy(), len(best))), pa.array(np.repeat(list(shared.value), n).tolist(), pa.string()), pa.array(np.concatenate(best))], names=["query_id", "intent", "score"])

    rows = queries.where(F.col("query_id").isNotNull() & F.col("v").isNotNull()).select(F.col("query_id").cast("long"), "v")
    return rows.mapInArrow(score, "query_id long, intent string, score double")


def route(scores: DataFrame, intent_order: list[str], settings: Settings = DEFAULTS, threshold: Column | float | None = None) -> DataFrame:
    """(query_id, intent, confidence, route, fallback_applied): equal scores go to the intent listed first.

    Below the threshold the intent is ``general``; the confidence stays the best score's.
    """
    place = F.coalesce(F.array_position(F.array(*map(F.lit, intent_order)), F.col("intent")), F.lit(0))
    best = scores.groupBy("query_id").agg(F.max_by("intent", F.struct(F.round("score", 9), -place)).alias("best"), F.max("score").alias("confidence"))
    bound = settings.router_threshold if threshold is None else threshold
    return with_route(best, F.lit(bound) if isinstance(bound, float) else bound)


def with_route(best: DataFrame, threshold: Column) -> DataFrame:
    fallback = F.col("confidence") < threshold
    intent = F.when(fallback, "general").otherwise(F.col("best"))
    return best.withColumns({"fallback_applied": fallback, "intent": intent, "route": F.when(intent == "rag", "rag").otherwise("hf_local")}).drop("best")


def confusion(pairs: DataFrame, labels: list) -> DataFrame:
    """(actual, predicted, n) of known labels, zero counts included."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(a, p) for a in labels for p in labels], "actual string, predicted string")
    return grid.join(pairs.groupBy("actual", "predicted").agg(F.count("*").alias("n")), ["actual", "predicted"], "left").fillna(0, ["n"])


def class_metrics(pairs: DataFrame) -> DataFrame:
    """Per class: tp, fp, fn, support, precision, recall and F1."""
    marks = pairs.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit(1).alias("a"), (F.col("actual") == F.col("predicted")).cast("int").alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("a"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("m")).select("m.*")
    sums = marks.groupBy("label").agg(F.sum("t").alias("tp"), (F.sum("p") - F.sum("t")).alias("fp"), (F.sum("a") - F.sum("t")).alias("fn"), F.sum("a").alias("support"))
    precision, recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumns({"precision": precision, "recall": recall}).withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def threshold_sweep(best: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, accuracy, fallbacks) for queries with actual, best and confidence."""
    grid = best.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    decided = best.crossJoin(F.broadcast(grid)).withColumn("decided", F.when(F.col("confidence") < F.col("threshold"), "general").otherwise(F.col("best")))
    return decided.groupBy("threshold").agg(F.avg((F.col("decided") == F.col("actual")).cast("double")).alias("accuracy"), F.sum((F.col("confidence") < F.col("threshold")).cast("long")).alias("fallbacks"))


def leaked(evaluation: DataFrame, training: DataFrame, text_col: str = "text") -> DataFrame:
    """Evaluation rows whose normalised text is in the training table; none should be."""
    keys = training.select(normalize_dedup(F.col(text_col)).alias("key")).distinct()
    return evaluation.withColumn("key", normalize_dedup(F.col(text_col))).join(keys, "key", "left_semi").drop("key")


def adjacent_similarity(rows: DataFrame, group: list[str], order: str, vector: str = "v") -> DataFrame:
    """Cosine of every row's vector with the one before it in its group, in ``order``; a group's first row has none and is left out.

    Rows are dealt into ranges of (group, order), as many as there are shuffle partitions,
    so that a group of any size is many tasks' work; the last row of each range is
    handed on to the next one that has rows. Rows of one group and place are in no certain order.
    """
    from tessera.functions.vectors import cosine

    dealt = rows.repartitionByRange(*group, order).withColumn("_range", F.spark_partition_id())
    ranged = written(dealt, "ranges")  # ranges come from a sample, and must not be drawn anew
    place = F.struct(*group, order)
    last = ranged.groupBy("_range").agg(F.max_by(F.struct(F.col(vector).alias("v"), F.struct(*group).alias("g")), place).alias("_carried"))  # a row a range
    carried = last.select("_range", F.lag("_carried").over(Window.partitionBy(F.lit(0)).orderBy("_range")).alias("_carried"))
    own = F.lag(F.struct(F.col(vector).alias("v"), F.struct(*group).alias("g"))).over(Window.partitionBy("_range").orderBy(*group, order))
    before = ranged.withColumn("_own", own).join(F.broadcast(carried), "_range").withColumn("_before", F.coalesce("_own", "_carried"))
    same = before.where(F.col("_before.v").isNotNull() & F.col("_before.g").eqNullSafe(F.struct(*group)))
    return same.withColumn("similarity", cosine(F.col(vector), F.col("_before.v"))).drop("_range", "_own", "_carried", "_before")


def routing_result(routed: DataFrame, threshold: float = DEFAULTS.router_threshold) -> DataFrame:
    """Routes as they are shown: the confidence to four digits, the threshold to two, a warning only where one fell back."""
    bound = F.round(F.lit(threshold), 2)
    return routed.withColumns({"confidence": F.round("confidence", 4), "threshold": bound, "warning": routing_warning(F.col("fallback_applied"), F.round("confidence", 4), bound)})


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of a threshold sweep with the largest accuracy, the smallest threshold of equals."""
    best = F.max_by(F.struct("threshold", "accuracy", "fallbacks"), F.struct(F.round("accuracy", 9), -F.col("threshold"))).alias("b")
    return sweep.agg(best).select("b.*")
