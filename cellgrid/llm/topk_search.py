"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import stored
from cellgrid.llm.vectors import LIST, integer_vector, list_array, matrix, merged, products, products_of_rows, tiled

BLOCK_ROWS = 2048  # queries of a tile
SHARD_ROWS = 8192  # candidates of a tile
STRIP = 1 << 22  # scores that a tile holds at once


def best_of_tile(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores of each row, ties to the smaller position; unordered.

    Scores above a row's k-th are chosen by partial selection; of those equal to it, the first
    ones fill what is left.
    """
    rows, n = scores.shape
    if n <= k:
        return np.broadcast_to(np.arange(n), (rows, n))
    bound = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
    above, equal = scores > bound, scores == bound
    left = k - above.sum(1)
    chosen = above
    tied = equal.sum(1) > left
    chosen[~tied] |= equal[~tied]
    if tied.any():
        rank = np.cumsum(equal[tied], axis=1)
        chosen[tied] |= equal[tied] & (rank <= left[tied][:, None])
    return np.nonzero(chosen)[1].reshape(rows, k)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    factor: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    shard_rows: int = SHARD_ROWS,
    fan: int = 16,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows with the highest inner product of each query row.

    Vectors become integers (``floor(factor * x)``) and scores are exact.  Queries and
    candidates are dealt at random into blocks and shards of bounded size; each tile of a block
    and a shard is one matrix product, of which each query keeps ``k + 1`` entries, and the
    lists of a query are merged in a tree of ``fan`` lists a step.  Both sides are copied once
    per opposite part, so what is shuffled is the products' number over the tile's side.

    Candidates are all rows but the query's own; ties go to the smaller id; a query with fewer
    candidates lists them all.  Rows take no part if the id or the vector is null, or a
    component null or not finite; a query meets only vectors of its own length.  Of rows with
    equal ids each counts: such query rows each give a list.  An empty table gives no rows, and
    other columns are ignored.
    """
    whole = integer_vector(vectors[vector_col], factor)
    row = F.monotonically_increasing_id()
    rows = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"), row.alias("row")
    )
    rows = rows.where("vec_id is not null and v is not null").withColumn("deal", F.xxhash64("row"))
    rows = stored(rows, "topk")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking")).first()
    blocks, shards = max(1, -(-found.asking // block_rows)), max(1, -(-found.n // shard_rows))

    def part(name: str, number: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(name), "deal"), F.lit(number)).cast("int").alias(name)

    def each(name: str, number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias(name)

    size = F.size("v").alias("size")
    asking = rows.where("asks").select("row", "vec_id", "v", size, part("block", blocks), each("shard", shards))
    offered = rows.select("vec_id", "v", size, part("shard", shards), each("block", blocks))

    def tile(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return empty
        ids = candidates.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, offers = ids[order], matrix(candidates.column("v"))[order]
        asked = matrix(queries.column("v"))
        kept = min(k + 1, len(ids))
        at, scores = np.empty((len(asked), kept), np.int64), np.empty((len(asked), kept), np.int64)
        step = max(1, STRIP // len(ids))
        for low in range(0, len(asked), step):
            strip = products(asked[low : low + step], offers)
            best = best_of_tile(strip, k + 1)
            at[low : low + step], scores[low : low + step] = best, np.take_along_axis(strip, best, axis=1)
        own = [int(x) for x in products_of_rows(asked)]
        best = list_array(np.full(len(asked), kept), scores.ravel(), ids[at].ravel())
        shard = pa.array([candidates.column("shard")[0].as_py()] * len(asked), pa.int32())
        return pa.table(
            [queries.column("row"), queries.column("vec_id"), pa.array(own, pa.int64()), shard, best], schema=empty.schema
        )

    schema = f"row long, query_id long, own long, shard int, best {LIST}"
    entry = pa.struct([("lost", pa.int64()), ("vec_id", pa.int64())])
    fields = [("row", pa.int64()), ("query_id", pa.int64()), ("own", pa.int64()), ("shard", pa.int32()), ("best", pa.list_(entry))]
    empty = pa.schema(fields).empty_table()
    keys = ["size", "block", "shard"]
    lists = tiled(asking, offered, keys, tile, schema)
    best = merged(lists, ["row", "query_id", "own"], "shard", shards, k + 1, fan)
    # the query's own row is an entry with its id and its own score; others like it give the same output
    at = F.array_position("best", F.struct((-F.col("own")).alias("lost"), F.col("query_id").alias("vec_id")))
    others = F.slice(F.filter("best", lambda x, i: (i + 1) != at), 1, k)
    ranked = best.select("query_id", F.posexplode(others).alias("at", "e"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.lost")).alias("score"))

