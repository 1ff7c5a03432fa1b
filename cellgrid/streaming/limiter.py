"""Sliding-window request limiter: stream and batch.

A request is allowed if fewer than ``limit`` *allowed* requests of its client lie in the
last window; an entry exactly one window old has expired, and denied requests leave no
trace.  Decisions therefore depend on earlier decisions, which no window function can
express: this is the one operator that folds ordered rows in pandas.
"""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cellgrid.functions import vocab
from cellgrid.functions.scalars import micros
from cellgrid.operators.traffic import time_stretches, with_trailing_count

MICROS = 1_000_000


def check_limit(limit: int) -> None:
    if limit < 1:
        raise ValueError("limit must be at least 1")


def decide(times: np.ndarray, ring: deque, limit: int, window_us: int) -> tuple[np.ndarray, np.ndarray]:
    """Decisions and seconds to wait for ascending ``times``; ``ring`` holds the allowed times.

    The ring never holds more than ``limit`` entries.  While it is full, everything before
    the oldest entry expires is denied in one step.
    """
    allowed = np.zeros(len(times), dtype=bool)
    wait = np.zeros(len(times), dtype=np.int64)
    i = 0
    while i < len(times):
        now = int(times[i])
        while ring and ring[0] <= now - window_us:
            ring.popleft()
        if len(ring) < limit:
            allowed[i] = True
            insort(ring, now)  # an earlier batch may have held a later time
            i += 1
            continue
        free = ring[0] + window_us
        stop = i + int(np.searchsorted(times[i:], free, side="left"))
        left = free - times[i:stop]
        wait[i:stop] = np.maximum(1, -(-left // MICROS))
        i = stop
    return allowed, wait


# --- batch --------------------------------------------------------------------------
def busy_runs(log: DataFrame, limit: int, window_us: int) -> DataFrame:
    """Log rows with ``run``: NULL where surely allowed, else the start of their busy run.

    A row whose raw count over the last window is within the limit is allowed whatever
    happened before.  Only rows with a higher raw count are open, and they depend on nothing
    outside the run of rows that lie within one window of an open row.  Runs are independent
    of each other, so a client's history splits wherever it is calm.  All of this works on
    (client, stretch of time) groups; the start of a run that crosses stretches comes from a
    window over one summary row per stretch.
    """
    order = Window.partitionBy("ip", "stretch").orderBy("us", "event_id")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    # a frame that ends at the last row is added up anew at each row; backwards it is one step per row
    back = Window.partitionBy("ip", "stretch").orderBy(F.desc("us"), F.desc("event_id"))
    since = back.rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("trailing") > limit, F.col("us"))
    rows = (
        with_trailing_count(time_stretches(log, window_us, before=3, after=1), window_us, "trailing")
        .withColumn("before", F.last(opened, ignorenulls=True).over(until))
        .withColumn("after", F.last(opened, ignorenulls=True).over(since))
        .withColumn("busy", F.coalesce(F.col("us") - F.col("before") < window_us, F.lit(False))
                    | F.coalesce(F.col("after") - F.col("us") < window_us, F.lit(False)))
        .withColumn("gap", F.col("us") - F.lag("us").over(order))
        .withColumn("after_busy", F.coalesce(F.lag("busy").over(order), F.lit(False)))
        .where("own")
    )
    starts = F.col("busy") & (~F.col("after_busy") | (F.col("gap") >= window_us))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.when(starts, F.col("us"))).withColumn(
        "run_here", F.last("start", ignorenulls=True).over(so_far)
    )
    # rows at the head of a stretch may continue a run that started in an earlier one
    history = Window.partitionBy("ip").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    summary = rows.groupBy("ip", "stretch").agg(F.max("start").alias("last_start"))
    carried = summary.select("ip", "stretch", F.last("last_start", ignorenulls=True).over(history).alias("carried"))
    run = F.when(F.col("busy"), F.coalesce("run_here", "carried"))
    return rows.join(carried, ["ip", "stretch"]).withColumn("run", run)


def rate_limit(
    log: DataFrame, limit: int = vocab.REQUESTS_PER_WINDOW, window_s: float = vocab.WINDOW_SECONDS
) -> DataFrame:
    """Decisions for a finished log ``(event_id, ip, ts)``: adds ``allowed`` and ``retry_after``.

    Rows outside busy runs are decided by window functions alone.  Busy runs are sorted by
    Spark and folded batch by batch; the fold keeps one ring of at most ``limit`` times, so
    no run is ever gathered in memory.
    """
    check_limit(limit)
    window_us = round(window_s * MICROS)
    marked = busy_runs(log.select("event_id", F.coalesce("ip", F.lit("unknown")).alias("ip"), micros("ts").alias("us")), limit, window_us)
    keep = ["event_id", "ip", "us"]
    calm = marked.where(F.col("run").isNull()).select(
        *keep, F.lit(True).alias("allowed"), F.lit(0).cast("long").alias("retry_after")
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ring = None, deque()
        for batch in batches:
            times = batch["us"].to_numpy()
            allowed, wait = np.zeros(len(batch), dtype=bool), np.zeros(len(batch), dtype=np.int64)
            # consecutive rows of one run; a run may continue in the next batch
            ips, runs = batch["ip"].to_numpy(), batch["run"].to_numpy()
            edges = np.flatnonzero((ips[1:] != ips[:-1]) | (runs[1:] != runs[:-1])) + 1
            for first, last in zip([0, *edges], [*edges, len(batch)]):
                if first == last:
                    continue
                if (ips[first], runs[first]) != current:
                    current, ring = (ips[first], runs[first]), deque()
                allowed[first:last], wait[first:last] = decide(times[first:last], ring, limit, window_us)
            yield batch[keep].assign(allowed=allowed, retry_after=wait)

    busy = (
        marked.where(F.col("run").isNotNull()).select(*keep, "run")
        .repartition("ip", "run").sortWithinPartitions("ip", "run", "us", "event_id")
        .mapInPandas(fold, "event_id BIGINT, ip STRING, us BIGINT, allowed BOOLEAN, retry_after BIGINT")
    )
    return calm.unionByName(busy)


# --- stream -------------------------------------------------------------------------
def rate_limit_stream(
    log: DataFrame,
    limit: int = vocab.REQUESTS_PER_WINDOW,
    window_s: float = vocab.WINDOW_SECONDS,
    lateness: str = "10 seconds",
) -> DataFrame:
    """Decisions for a stream ``(event_id, ip, ts)`` with event time ``ts`` (``TIMESTAMP``).

    State per client is the list of its allowed times, at most ``limit`` long.  It is dropped
    once the watermark passes the last of them by a window, which cannot change a decision;
    so state follows the number of active clients without evicting any.  The rows of one
    client in one micro-batch are sorted together: bound the micro-batch at the source
    (files or offsets per trigger) where a client may send very many.

    Rows may arrive out of order within ``lateness``.  Later ones get no decision and leave no
    trace: they come out with null ``allowed`` and ``retry_after`` and the ``reason`` 'late', which
    is null for all others.
    """
    check_limit(limit)
    window_us = round(window_s * MICROS)
    columns = ["event_id", "ip", "us", "allowed", "retry_after", "reason"]

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ring = deque(state.get[0]) if state.exists else deque()
        watermark = state.getCurrentWatermarkMs()
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["us", "event_id"], kind="stable")
        late = rows["us"] <= watermark * 1000 if watermark > 0 else pd.Series(False, rows.index)
        if late.any():
            yield rows[late][["event_id", "us"]].assign(ip=key[0], allowed=None, retry_after=None, reason="late")[columns]
            rows = rows[~late]
        if rows.empty and not state.exists:
            return
        allowed, wait = decide(rows["us"].to_numpy(), ring, limit, window_us)
        state.update((list(ring),))
        state.setTimeoutTimestamp(max(max(ring, default=0) // 1000 + window_us // 1000, watermark) + 1)
        yield pd.DataFrame(
            {"event_id": rows["event_id"], "ip": key[0], "us": rows["us"], "allowed": allowed, "retry_after": wait, "reason": None}
        )

    # Spark drops late rows before a stateful step by the column that is marked as event time.
    # ``ts`` moves the watermark and stays behind; the mark is on a time that is never late.
    never_late = F.lit("2262-01-01").cast("timestamp").alias("never_late", metadata={"spark.watermarkDelayMs": 0})
    return (
        log.withWatermark("ts", lateness)
        .select("event_id", "ip", F.unix_micros("ts").alias("us"), never_late)
        .groupBy("ip")
        .applyInPandasWithState(
            step,
            "event_id BIGINT, ip STRING, us BIGINT, allowed BOOLEAN, retry_after BIGINT, reason STRING",
            "ring ARRAY<BIGINT>",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
