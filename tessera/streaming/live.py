"""Streaming metrics and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.operators.posting_index import PostingIndex
from tessera.operators.store import ChunkStore
from tessera.shared import written


def request_counters(requests: DataFrame, *, intent: str = "event_type", status: str | None = None, value: str = "value", sums: tuple[str, ...] = ()) -> DataFrame:
    """Running (intent, status, requests, duration_sum and the sums of further columns); for a batch or, in update mode, a stream.

    Without a status column all requests have status 200.
    """
    code = F.lit(200) if status is None else F.col(status).cast("int")
    return requests.groupBy(F.col(intent).alias("intent"), code.alias("status")).agg(F.count("*").alias("requests"), F.sum(value).alias("duration_sum"), *(F.sum(c).alias(c) for c in sums))


def request_totals(counters: DataFrame, *, pii: str = "pii_redactions", prompt: str = "prompt_tokens", completion: str = "completion_tokens", active: int = 0) -> DataFrame:
    """(name, value) for the exposition, from counters that carry these sums; ``active`` is the last ``current`` of ``requests_in_flight``."""
    columns = {"active_requests": F.lit(active), "pii_redactions": F.sum(pii), "prompt_tokens": F.sum(prompt), "completion_tokens": F.sum(completion), "duration_sum": F.sum("duration_sum"), "duration_count": F.sum("requests")}
    one = counters.agg(*(c.cast("double").alias(n) for n, c in columns.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(n, F.lit(0.0)).alias("value")) for n in columns))).alias("x")).select("x.*")


def requests_in_flight(requests: DataFrame, *, start: str = "ts", seconds: str = "value", unit: int = 60) -> DataFrame:
    """(unit_start, peak, current): of each unit of time with a start or an end, the most requests at once and those left at its end.

    ``unit`` is in seconds. A request is in flight from its start until, not at, its end;
    those of no duration never are, and those without a start or with a negative duration are
    left out. Changes of one microsecond are added up before anything is shuffled by time.
    Running sums go over seconds within an hour and over hours, so that no task has more than
    the different microseconds of one second, the seconds of one hour, or all hours: a hot
    minute is sixty tasks' work.
    """
    begin = F.unix_micros(F.col(start).cast("timestamp"))
    known = requests.where(F.col(start).isNotNull() & (F.col(seconds) >= 0))
    ends = F.array(F.struct(begin.alias("at"), F.lit(1).alias("d")), F.struct((begin + F.floor(F.col(seconds) * 1_000_000)).alias("at"), F.lit(-1).alias("d")))
    changes = known.select(F.explode(ends).alias("x")).groupBy(F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))
    changes = written(changes.withColumn("second", F.floor(F.col("at") / F.lit(1_000_000))), "changes")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    by_second = changes.groupBy("second", F.floor(F.col("second") / F.lit(3600)).alias("hour")).agg(F.sum("d").alias("d"))
    by_hour = by_second.groupBy("hour").agg(F.sum("d").alias("d")).withColumn("base", F.coalesce(F.sum("d").over(before(F.lit(0)).orderBy("hour")), F.lit(0)))
    carried = by_second.withColumn("own", F.coalesce(F.sum("d").over(before("hour").orderBy("second")), F.lit(0))).join(by_hour.select("hour", "base"), "hour").select("second", (F.col("own") + F.col("base")).alias("carry"))
    running = changes.join(carried, "second").withColumn("flying", F.col("carry") + F.sum("d").over(Window.partitionBy("second").orderBy("at")))
    unit_start = F.timestamp_seconds(F.floor(F.col("second") / F.lit(unit)) * unit).alias("unit_start")
    return running.groupBy(unit_start).agg(F.greatest(F.max("flying"), F.min_by("carry", "at")).alias("peak"), F.max_by("flying", "at").alias("current"))


def windowed_counters(requests: DataFrame, *, time: str = "ts", intent: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, end, intent, requests) of tumbling windows; rows later than the watermark are left out."""
    rows = requests.withWatermark(time, late) if requests.isStreaming else requests
    return rows.groupBy(F.window(time, width), F.col(intent).alias("intent")).agg(F.count("*").alias("requests")).select("window.start", "window.end", "intent", "requests")


def ingest_stream(pages: DataFrame, store: ChunkStore, chunk: Callable[[DataFrame], DataFrame], checkpoint: str, index: PostingIndex | None = None) -> StreamingQuery:
    """Chunk every micro-batch of pages and upsert it, into the index also if one is given; a replayed batch changes nothing.

    The upsert replaces rows of equal keys, so that a batch that runs again after a
    failure gives the table and the index it gave before.
    """

    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            chunks = chunk(batch)
            store.add(chunks)
            if index is not None:
                index.add(chunks)
                index.compact()

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
