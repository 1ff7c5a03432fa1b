"""The request limiter as keyed state with timers: state that ends by itself."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from cellgrid.functions import vocab
from cellgrid.streaming.limiter import MICROS, check_limit, decide

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "event_id BIGINT, ip STRING, us BIGINT, allowed BOOLEAN, retry_after BIGINT, reason STRING, kind STRING, watermark_ms BIGINT"
SLICE = 10_000


class Limiter(StatefulProcessor):
    """Decisions of one client at a time; its allowed times are list state, and a timer ends them.

    The timer stands one window behind the last allowed time, where the state can no longer
    change a decision.  Of a client's rows in a micro-batch only time and id are held
    together, to be sorted; decisions go out in slices.
    """

    def __init__(self, limit: int, window_us: int) -> None:
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", StructType([StructField("us", LongType())]))

    def frame(self, key: tuple, kind: str, watermark: int, ids=(None,), us=(None,), allowed=None, wait=None, reason=None) -> pd.DataFrame:
        return pd.DataFrame({
            "event_id": pd.array(ids, "Int64"), "ip": key[0], "us": pd.array(us, "Int64"), "allowed": allowed,
            "retry_after": pd.array([None] * len(ids) if wait is None else wait, "Int64"), "reason": reason, "kind": kind,
            "watermark_ms": watermark,
        })

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = [batch[["us", "event_id"]].to_numpy(np.int64) for batch in rows]
        given = np.concatenate(held)
        given = given[np.lexsort((given[:, 1], given[:, 0]))]
        late = given[:, 0] <= watermark * 1000 if watermark > 0 else np.zeros(len(given), bool)
        for low in range(0, int(late.sum()), SLICE):
            part = given[late][low : low + SLICE]
            yield self.frame(key, "row", watermark, part[:, 1], part[:, 0], reason="late")
        given = given[~late]
        if not len(given):
            return
        known = [row[0] for row in self.ring.get()] if self.ring.exists() else []
        ring = deque(known)
        allowed, wait = decide(given[:, 0], ring, self.limit, self.window_us)
        self.ring.put([(int(t),) for t in ring])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(max(ring, default=0) // 1000 + self.window_us // 1000, watermark) + 1)
        if not known:
            yield self.frame(key, "opened", watermark)
        for low in range(0, len(given), SLICE):
            part = slice(low, low + SLICE)
            yield self.frame(key, "row", watermark, given[part, 1], given[part, 0], allowed[part], wait[part])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        yield self.frame(key, "closed", timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def limited(
    log: DataFrame, limit: int = vocab.REQUESTS_PER_WINDOW, window_s: float = vocab.WINDOW_SECONDS, lateness: str = "10 seconds"
) -> DataFrame:
    """Decisions for a stream ``(event_id, ip, ts)``, and when each client's state opens and closes.

    Rows of ``kind`` 'row' are as in ``limiter.rate_limit_stream``: ``allowed``, ``retry_after``, and
    for rows later than ``lateness`` only the ``reason`` 'late'.  Rows 'opened' and 'closed' say
    that a client got state, or that the watermark passed its timer; in between it is live.
    ``watermark_ms`` is that of the row's micro-batch.  The state store must be RocksDB (``ROCKSDB``).
    """
    check_limit(limit)
    # ``ts`` moves the watermark and stays behind, so that Spark drops no row before the processor sees it
    rows = log.withWatermark("ts", lateness).select("event_id", F.coalesce("ip", F.lit("unknown")).alias("ip"), F.unix_micros("ts").alias("us"))
    return rows.groupBy("ip").transformWithStateInPandas(
        statefulProcessor=Limiter(limit, round(window_s * MICROS)), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime"
    )


def live_clients(rows: DataFrame) -> DataFrame:
    """``(watermark_ms, opened, closed, live)`` from the output of ``limited``: state over its micro-batches.

    One row per micro-batch that opened or closed a client, so the running sum is over few rows.
    """
    steps = rows.where(F.col("kind") != "row").groupBy("watermark_ms").agg(
        F.count_if(F.col("kind") == "opened").alias("opened"), F.count_if(F.col("kind") == "closed").alias("closed")
    )
    so_far = Window.orderBy("watermark_ms").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("live", F.sum(F.col("opened") - F.col("closed")).over(so_far))
