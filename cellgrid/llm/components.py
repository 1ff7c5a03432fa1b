"""Connected components of a distributed graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import stored


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge; the root is the smallest node reachable.

    Each round is two grouped minima and two equality joins, so a node with very many
    neighbours is pre-aggregated before it is shuffled and its join partition can be split.
    Every round is written to the shared work folder.  An empty edge table gives no rows;
    loops, repeated edges, nulls and either direction of an edge are accepted.
    """
    links = edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
    links = stored(links.where("a < b").distinct(), "components")
    state = _state(links)
    while state[0]:
        links = stored(_small_star(_large_star(links)), "components")
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def _state(links: DataFrame) -> tuple:
    """Count and checksum of the edges; equal twice in a row means nothing moved."""
    return tuple(
        links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))
        ).first()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Hang the larger neighbours of each node on its smallest neighbour (or itself)."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    hung = both.where("b > a").join(least, "a").select(F.least("a", "m").alias("a"), "b")
    return hung.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b")
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()
