"""The question cache over a stream: the first success of each key as state that ends by itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from cellgrid.functions.scalars import question_key

OUTPUT = "question_id BIGINT, key STRING, hit BOOLEAN"
SLICE = 10_000
NULL_PARTS = 64


class FirstSuccess(StatefulProcessor):
    """Time and id of a key's first success, until no row of the key came for ``keep_us``.

    Of a key's rows in a micro-batch time, id and outcome are held together (17 bytes a row);
    bound the micro-batch at the source.
    """

    def __init__(self, keep_us: int) -> None:
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        number = StructType([StructField("us", LongType()), StructField("id", LongType())])
        self.first = handle.getValueState("first", number)
        self.last = handle.getValueState("last", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(b["us"].to_numpy(np.int64), b["question_id"].to_numpy(np.int64), b["ok"].to_numpy(bool)) for b in rows]
        us, ids, ok = (np.concatenate(part) for part in zip(*held))
        if pd.isna(key[0]):  # no question, no answer to keep
            yield from self.frames(key, ids, np.zeros(len(us), bool))
            return
        first = tuple(self.first.get()) if self.first.exists() else None
        if ok.any():
            least = np.lexsort((ids[ok], us[ok]))[0]
            found = (int(us[ok][least]), int(ids[ok][least]))
            if first is None or found < first:
                first = found
                self.first.update(first)
        hit = np.zeros(len(us), bool) if first is None else (us > first[0]) | ((us == first[0]) & (ids > first[1]))
        last = max(int(us.max()), self.last.get()[0] if self.last.exists() else 0)
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # a timer must lie ahead of the watermark
        self.handle.registerTimer(max((last + self.keep_us) // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        yield from self.frames(key, ids, hit)

    def frames(self, key: tuple, ids: np.ndarray, hit: np.ndarray) -> Iterator[pd.DataFrame]:
        for low in range(0, len(ids), SLICE):
            part = slice(low, low + SLICE)
            yield pd.DataFrame({"question_id": ids[part], "key": key[0], "hit": hit[part]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached_questions(questions: DataFrame, keep: str = "2 days", lateness: str = "10 minutes") -> DataFrame:
    """``(question_id, key, hit)`` for a stream ``(question_id, ts, text, scope, ok)``.

    A row is a hit if a success of its key, known when its micro-batch is decided, comes before
    it in order of time and id.  That is ``traffic.question_cache`` as long as an earlier success
    does not arrive in a later micro-batch; where it does, decisions already given stand, as
    they do in a live cache.  A key is forgotten ``keep`` after its last row, by the watermark; a
    row that comes later than ``lateness`` is still decided by what is known.  A null text or scope has
    a null key and is never a hit.  The state store must be RocksDB (``keyed_limiter.ROCKSDB``).
    """
    keep_us = int(pd.Timedelta(keep).total_seconds() * 1_000_000)
    # ``ts`` moves the watermark and stays behind, so that Spark drops no late row
    rows = questions.withWatermark("ts", lateness).select(
        F.col("question_id").cast("long"), question_key("text", "scope").alias("key"), F.unix_micros("ts").alias("us"),
        F.coalesce("ok", F.lit(False)).alias("ok"),
    )
    # rows without a key need no state, so they are dealt out instead of being one group
    dealt = rows.withColumn("part", F.when(F.col("key").isNull(), F.pmod("question_id", F.lit(NULL_PARTS))).otherwise(F.lit(0)))
    return dealt.groupBy("key", "part").transformWithStateInPandas(
        statefulProcessor=FirstSuccess(keep_us), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime"
    )
