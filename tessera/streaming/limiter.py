"""Sliding-window-log rate limiting: a batch form and a streaming form of one rule.

A key may have ``limit`` allowed requests within ``window`` seconds. Denied requests
are not logged, so that the rule is not a window count and each key's requests are
decided in order. State is bounded by ``limit`` timestamps a key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.config import DEFAULTS


def decide(times: Iterable[float], log: deque, limit: int, window: float) -> Iterator[tuple[bool, int]]:
    """(allowed, retry_after) of each time in order; ``log`` holds the allowed ones still in the window.

    A request without a time lies in no window: it is allowed and not logged.
    """
    for t in times:
        if t is None or t != t:
            yield True, 0
            continue
        while log and log[0] <= t - window:
            log.popleft()
        if len(log) >= limit:
            yield False, max(1, int(log[0] + window - t)) if log else 1
        else:
            log.append(t)
            yield True, 0


def rate_limit(requests: DataFrame, *, key: str = "user_id", time: str = "ts", request: str = "event_id", limit: int = DEFAULTS.limiter_requests, window: int = DEFAULTS.limiter_seconds, enabled: bool = True) -> DataFrame:
    """(request, key, allowed, retry_after) for every request, also those without a time or a key.

    Rows are dealt by key and sorted, and each task streams through its rows; one
    key's rows are never held together.
    """
    columns = requests.select(F.col(request).cast("long").alias("request"), F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").cast("double").alias("t"))
    if not enabled:
        return columns.select("request", "key", F.lit(True).alias("allowed"), F.lit(0).alias("retry_after"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, log = object(), deque()
        for batch in batches:
            keys, times = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            allowed, retry = [], []
            for own, t in zip(keys, times, strict=True):
                if own != last:
                    last, log = own, deque()
                ok, wait = next(decide([t], log, limit, window))
                allowed.append(ok)
                retry.append(wait)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_()), pa.array(retry, pa.int32())], names=["request", "key", "allowed", "retry_after"])

    return columns.repartition("key").sortWithinPartitions("key", "t", "request").mapInArrow(run, "request long, key string, allowed boolean, retry_after int")


def rate_limit_stream(requests: DataFrame, *, key: str = "user_id", time: str = "ts", request: str = "event_id", limit: int = DEFAULTS.limiter_requests, window: int = DEFAULTS.limiter_seconds, late: str = "1 minute") -> DataFrame:
    """The same decisions over a stream, by event time, so that a replay decides as the first run did.

    A key's log is dropped when the watermark, ``late`` behind the latest time, has passed
    its last window. Requests later than the watermark (at first, those up to the epoch) are left out; those of a key within
    a micro-batch are decided in the order of their times.
    """

    def run(own: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames)).sort_values(["t", "request"])
        found = list(decide(rows["t"], log, limit, window))
        state.update((list(log),))
        if log:
            state.setTimeoutTimestamp(max(int((log[-1] + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"request": rows["request"].to_numpy(), "key": own[0], "allowed": [f[0] for f in found], "retry_after": pd.array([f[1] for f in found], "int32")})

    timed = requests.select(F.col(request).cast("long").alias("request"), F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("at")).withWatermark("at", late)
    columns = timed.withColumn("t", F.col("at").cast("double"))
    return columns.groupBy("key").applyInPandasWithState(run, "request long, key string, allowed boolean, retry_after int", "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)
