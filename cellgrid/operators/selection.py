"""Exact percentiles of groups of any size: a sketch brackets them, counts decide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.operators.joins import lookup_join
from cellgrid.session import written

GRID = 500  # stretches of equal counts into which a sketch cuts a bracket
ACCURACY = 10_000  # of the sketch: ranks are wrong by a ten-thousandth of the rows at most
BRACKET_ROWS = 2_000_000  # a bracket with more is cut again
ROUNDS = 4  # of cutting: 2 million rows are left of 10^13; what ties leave beyond is decided by counts all the same


def _within(rows: DataFrame, brackets: DataFrame, key: str) -> DataFrame:
    """The values inside the bracket of each of their group's percentiles."""
    return lookup_join(rows, brackets, [key], "inner").where(F.col("v").between(F.col("lo"), F.col("hi")))


def _start(rows: DataFrame, key: str, quantiles: Sequence[float]) -> DataFrame:
    """A bracket per group and percentile that holds the whole group."""
    place = F.col("q") * (F.col("n") - 1)
    whole = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    each = whole.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    return each.select(
        key, "q", "n", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("held"),
        F.floor(place).alias("first"), F.ceil(place).alias("last"),
    )


def _cut(rows: DataFrame, open_brackets: DataFrame, key: str) -> DataFrame:
    """Narrower brackets. A sketch proposes the bounds; they hold only if counting confirms them."""
    shares = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    sketches = _within(rows, open_brackets, key).groupBy(key, "q").agg(F.percentile_approx("v", shares, F.lit(ACCURACY)).alias("grid"))
    at = F.floor((F.col("first") - F.col("below")) / F.col("held") * GRID).cast("int")
    proposed = written(open_brackets.join(sketches, [key, "q"]).select(
        *open_brackets.columns, F.get("grid", F.greatest(at - 1, F.lit(0))).alias("new_lo"), F.get("grid", F.least(at + 2, F.lit(GRID))).alias("new_hi")
    ), "percentiles")
    counts = _within(rows, proposed, key).groupBy(key, "q").agg(
        F.count_if(F.col("v") < F.col("new_lo")).alias("fewer"), F.count_if(F.col("v").between(F.col("new_lo"), F.col("new_hi"))).alias("inner")
    )
    below = F.col("below") + F.col("fewer")
    sound = (below <= F.col("first")) & (below + F.col("inner") > F.col("last"))

    def kept(new: Column, old: str) -> Column:
        return F.when(sound, new).otherwise(F.col(old)).alias(old)

    changed = {"lo": F.col("new_lo"), "hi": F.col("new_hi"), "below": below, "held": F.col("inner")}
    return proposed.join(counts, [key, "q"]).select(*[kept(changed[c], c) if c in changed else F.col(c) for c in open_brackets.columns])


def exact_percentiles(
    rows: DataFrame, key: str, value: str, quantiles: Sequence[float], bracket_rows: int = BRACKET_ROWS
) -> DataFrame:
    """``(key, q, percentile)``: interpolated percentiles of the values of each group, without error.

    A bracket around each percentile starts as the whole group. While one holds more than
    ``bracket_rows`` rows, a mergeable sketch of its values proposes a narrower one, and a count of
    what lies below and inside confirms it. Inside the last bracket, equal values are counted and
    the percentile is read off their running counts. No buffer or task holds a group: sketches and
    counts are combined map-side, and a value that a third of all rows share is one row of the counts.

    Null values are left out, and groups without values are absent. Rows are read twice, and twice more
    per round: pass a stored table. Brackets are few beside the rows; ``lookup_join`` decides how they meet.
    """
    rows = rows.select(key, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    brackets = written(_start(rows, key, quantiles), "percentiles")
    wide = (F.col("held") > bracket_rows) & (F.col("lo") < F.col("hi"))
    for _ in range(ROUNDS):
        if brackets.where(wide).isEmpty():
            break
        brackets = written(brackets.where(~wide).unionByName(_cut(rows, brackets.where(wide), key)), "percentiles")
    return _read_off(rows, brackets, key)


def _read_off(rows: DataFrame, brackets: DataFrame, key: str) -> DataFrame:
    """Percentiles by the running counts of the distinct values inside each bracket."""
    facts = ["q", "n", "below", "first", "last"]
    counts = _within(rows, brackets, key).groupBy(key, *facts, "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.col("below") + F.expr(f"sum(c) OVER (PARTITION BY `{key}`, q ORDER BY v ROWS UNBOUNDED PRECEDING)")
    ends = counts.withColumn("upto", upto).groupBy(key, "q", "n", "first").agg(
        F.min(F.when(F.col("upto") > F.col("first"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.col("last"), F.col("v"))).alias("b")
    )
    share = F.col("q") * (F.col("n") - 1) - F.col("first")
    return ends.select(key, "q", (F.col("a") + (F.col("b") - F.col("a")) * share).alias("percentile"))
