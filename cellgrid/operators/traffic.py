"""Question and request logs: de-duplication, rates, cache counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cellgrid.functions import vocab
from cellgrid.functions.scalars import micros, question_key
from cellgrid.operators.joins import BROADCAST_ROWS, most_frequent, salted_join
from cellgrid.session import written

# Time is cut into stretches of this many windows, so that one busy client becomes many
# groups; rows near the ends of a stretch are repeated as context for their neighbours.
STRETCH_WINDOWS = 16


def question_cache(questions: DataFrame) -> DataFrame:
    """Questions with their ``key`` and whether an earlier success of the same key answers them.

    A row is a hit if the first successful row of its key comes before it, so one
    aggregation per key with map-side combine is enough; no history of a popular question
    is ever gathered in one task.  The keys go through a table, with their counts: it tells
    whether they are few enough to broadcast and, if not, which of them to salt.
    """
    keyed = questions.withColumn("key", question_key("text", "scope"))
    order = F.struct("ts", "question_id")
    per_key = keyed.groupBy("key").agg(
        F.min(F.when(F.col("ok"), order)).alias("first_ok"), F.count(F.lit(1)).alias("hot_rows")
    )
    seen = Observation()
    per_key = written(per_key, "keys", seen, keys=F.count(F.lit(1)))
    first = per_key.select("key", "first_ok")
    if seen.get["keys"] <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(first), "key", "left")
    else:
        joined = salted_join(keyed, first, ["key"], "left", hot=most_frequent(per_key, ["key"]))
    return joined.withColumn("hit", F.coalesce(F.col("first_ok") < order, F.lit(False))).drop("first_ok")


def cache_stats(cached: DataFrame) -> DataFrame:
    """Hits, misses and stored entries of ``question_cache`` output.

    Exactly one row per stored key is a successful miss, so entries need no distinct count.
    """
    return cached.agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
        F.count_if(~F.col("hit") & F.col("ok")).alias("entries"),
    )


# --- rates --------------------------------------------------------------------------
def time_stretches(log: DataFrame, window_us: int, before: int, after: int) -> DataFrame:
    """Log rows with ``stretch`` and ``own``: their own stretch, and context for its neighbours.

    A row within ``before`` windows of a stretch's end is repeated in the next stretch, one
    within ``after`` windows of its start in the previous one.
    """
    size = window_us * STRETCH_WINDOWS
    at = F.floor(F.col("us") / size)
    into = F.col("us") - at * size
    copies = F.concat(
        F.array(at),
        F.when(into >= size - before * window_us, F.array(at + 1)).otherwise(F.array().cast("array<bigint>")),
        F.when(into < after * window_us, F.array(at - 1)).otherwise(F.array().cast("array<bigint>")),
    )
    return log.withColumn("home", at).withColumn("stretch", F.explode(copies)).withColumn(
        "own", F.col("home") == F.col("stretch")
    ).drop("home")


def with_trailing_count(rows: DataFrame, window_us: int, name: str) -> DataFrame:
    """``rows`` with the number of rows in ``(t - window, t]`` of their client and stretch.

    Every row also leaves the window again, as a row of its own one window later; a running
    sum over arrivals and departures then takes one step per row however many rows a window
    holds, where a sliding frame would add the whole window up again.
    """
    away = rows.columns
    arrive = rows.withColumn(name, F.lit(1).cast("long"))
    leave = rows.select(
        *[(F.col(c) if c in ("ip", "stretch") else (F.col("us") + window_us) if c == "us" else F.lit(None).cast(rows.schema[c].dataType)).alias(c)
          for c in away], F.lit(-1).cast("long").alias(name),
    )
    # rows of equal time count together, departures included
    so_far = Window.partitionBy("ip", "stretch").orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    both = arrive.withColumn("arrives", F.lit(True)).unionByName(leave.withColumn("arrives", F.lit(False)))
    return both.withColumn(name, F.sum(name).over(so_far)).where("arrives").drop("arrives")


def request_rate(log: DataFrame, window_s: float = vocab.WINDOW_SECONDS, time: Column | None = None) -> DataFrame:
    """Log rows ``(ip, ts, ...)`` with ``requests``: how many of the client fall in the last window."""
    window_us = round(window_s * 1_000_000)
    timed = log.withColumn("us", micros("ts") if time is None else time)
    counted = with_trailing_count(time_stretches(timed, window_us, before=1, after=0), window_us, "requests")
    return counted.where("own").drop("own", "stretch", "us")
