"""Integer vectors, their exact products, and merging of bounded best lists; shared by the searches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST = "array<struct<lost: long, vec_id: long>>"  # ``lost`` is the negated score, so lists sort upwards


def integer_vector(vector: Column, factor: int) -> Column:
    """``floor(factor * x)`` of each component x, as longs; null for a vector that is null or
    holds a null or non-finite component.  A component beyond 2^62 after scaling is an error."""
    scaled = F.transform(vector, lambda x: x.cast("double") * F.lit(float(factor)))
    odd = F.exists(scaled, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    large = F.exists(scaled, lambda x: F.abs(x) > float(1 << 62))
    whole = F.when(large, F.raise_error(F.lit("a scaled component does not fit a long"))).otherwise(F.transform(scaled, lambda x: F.floor(x)))
    return F.when(vector.isNotNull() & ~F.coalesce(odd, F.lit(True)), whole)


def matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix of longs."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(lists), -1) if len(flat) else np.zeros((len(lists), 0), np.int64)


def largest(rows: np.ndarray) -> int:
    return max(abs(int(rows.max())), abs(int(rows.min()))) if rows.size else 0


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two integer matrices, exact.

    The arithmetic is the fastest in which no sum can be rounded: floats of 24 or 53 bits,
    longs, or Python's integers.
    """
    bound = largest(left) * largest(right) * max(1, left.shape[1])
    for limit, kind in ((1 << 24, np.float32), (1 << 53, np.float64), (1 << 63, np.int64)):
        if bound < limit:
            found = left.astype(kind) @ right.astype(kind).T
            return found if kind is np.int64 else found.astype(np.int64)
    found = left.astype(object) @ right.astype(object).T
    if found.size and max(found.max(), -found.min()) >= 1 << 63:
        raise OverflowError("an inner product does not fit a long")
    return found.astype(np.int64)


def products_of_rows(rows: np.ndarray) -> np.ndarray:
    """The inner product of each row with itself."""
    small = largest(rows) ** 2 * max(1, rows.shape[1]) < 1 << 63
    return (rows * rows).sum(1) if small else (rows.astype(object) ** 2).sum(1)


def list_array(counts: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Best lists, one after the other, as an Arrow column of type ``LIST``."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array(-scores, pa.int64()), pa.array(ids, pa.int64())], ["lost", "vec_id"])
    return pa.ListArray.from_arrays(pa.array(offsets), entries)


def merged(lists: DataFrame, keys: list[str], part: str, parts: int, k: int, fan: int = 16) -> DataFrame:
    """``(*keys, best)``: the first ``k`` entries over all lists of a key, by a tree of merges.

    Each level merges at most about ``fan`` lists of ``k`` entries per group, so no task holds
    more than that for a key however many ``parts`` there are.
    """
    while True:
        groups = max(1, -(-parts // fan))
        level = F.pmod(F.xxhash64(part), F.lit(groups)) if groups > 1 else F.lit(0).cast("long")
        together = lists.groupBy(*keys, level.alias("level")).agg(F.flatten(F.collect_list("best")).alias("best"))
        lists = together.select(*keys, F.col("level").alias(part), F.slice(F.array_sort("best"), 1, k).alias("best"))
        if groups == 1:
            return lists.drop(part)
        parts = groups


def tiled(left: DataFrame, right: DataFrame, keys: list[str], tile: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``tile`` on the rows of both tables that agree in ``keys``.

    Both may stem from one table, so the columns of ``right`` get names of their own for Spark, and
    their old ones again inside.
    """
    names = right.columns
    other = right.select(*[F.col(c).alias(f"other_{c}") for c in names])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return tile(a, b.rename_columns([c.removeprefix("other_") for c in b.column_names]))

    return left.groupBy(*keys).cogroup(other.groupBy(*[f"other_{c}" for c in keys])).applyInArrow(run, schema)
