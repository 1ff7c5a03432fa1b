"""Joins that stay sound when a side grows or one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A broadcast side is sent to every executor and hashed there, so it must be known to be
# small.  Rows of the sides used here are a few hundred bytes at most.
BROADCAST_ROWS = 500_000
# Keys above this many rows are split, each into so many parts that none has more.
HOT_KEY_ROWS = 200_000


def row_bound(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True where ``df`` has at most ``max_rows`` rows (one counting job, nothing collected)."""
    return df.count() <= max_rows


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """The keys of ``df`` with more than ``min_rows`` rows, and into how many parts each is split."""
    return most_frequent(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("hot_rows")), keys, min_rows)


def most_frequent(counts: DataFrame, keys: Sequence[str], min_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """``hot_keys`` from a table of keys and their ``hot_rows``."""
    parts = F.ceil(F.col("hot_rows") / F.lit(min_rows)).cast("int")
    return counts.where(F.col("hot_rows") > min_rows).select(*keys, parts.alias("parts"))


def salted_join(
    many: DataFrame,
    few: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Column | None = None,
    min_rows: int = HOT_KEY_ROWS,
    hot: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Shuffle join whose hot keys on the ``many`` side are spread over several tasks.

    Rows of a hot key get a salt from ``spread`` (a hash of the whole row by default); the
    ``few`` rows of that key are repeated once per salt, so every pair still meets exactly
    once.  A key has as many salts as its rows need, and every key above ``min_rows`` is split.
    ``how`` may be ``inner`` or ``left``.  ``hot`` are the hot keys where the caller has counted
    them already.  ``partitions`` is for joins that make far more rows than they read: adaptive
    execution goes by what is read and would leave them in few tasks.

    There are at most ``rows / min_rows`` hot keys, half a million in 10^11 rows, so their table
    is broadcast; it is counted within the join's own plan, not before.  Neither side is: Spark
    takes rows that ``explode`` makes to be as many as those it makes them from, so by its own
    estimate it would send millions of them through the driver.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    keys = list(keys)
    if hot is None:
        hot = hot_keys(many, keys, min_rows)
    hot = F.broadcast(hot)
    spread = F.xxhash64(*[F.col(c) for c in many.columns]) if spread is None else spread
    salt = F.coalesce(F.pmod(spread, F.col("parts")).cast("int"), F.lit(0))
    copies = F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)
    left = many.join(hot, keys, "left").withColumn("salt", salt).drop("parts")
    right = few.join(hot, keys, "left").withColumn("salt", F.explode(copies)).drop("parts")
    if partitions:
        left, right = (side.repartition(partitions, *keys, "salt") for side in (left, right))
    return left.join(right.hint("merge"), [*keys, "salt"], how).drop("salt")


def lookup_join(
    many: DataFrame,
    few: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    few_is_small: bool | None = None,
) -> DataFrame:
    """Join a large table with a dimension, choosing the strategy by the dimension's size.

    Up to ``max_rows`` rows the dimension is broadcast, and the large side is not moved.
    Beyond, both sides are shuffled and hot keys are salted.  ``few_is_small`` carries the
    result of an earlier check, to avoid counting twice.
    """
    if few_is_small is None:
        few_is_small = row_bound(few, max_rows)
    if few_is_small:
        return many.join(F.broadcast(few), list(keys), how)
    return salted_join(many, few, keys, how)
