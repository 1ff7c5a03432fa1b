"""Hard negatives by coordinate pruning in length buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import stored
from cellgrid.llm.vectors import LIST, integer_vector, list_array, matrix, merged, products, products_of_rows, tiled
from cellgrid.operators.joins import lookup_join

BLOCK_ROWS = 2048  # anchors of a tile
SHARD_ROWS = 8192  # candidates of a tile
BUCKET_ROWS = 2048  # candidates of similar length that share sorted lists
FOCUS = 4  # coordinates whose ranges are intersected
SPARE = 0.5  # a range that holds more than this share of a bucket excludes too little to be intersected
SLACK = 1e-9  # by which ranges are widened against rounding; what they let through is verified exactly
LOWEST, HIGHEST = -(1 << 63) + 1, (1 << 63) - 1


class Slots:
    """The best ``k`` (score, id) of each slot: an anchor, and the range a score must lie in."""

    def __init__(self, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.owner, self.low, self.high, self.k = owner, low, high, k
        self.scores = [np.zeros(0, np.int64)] * len(owner)
        self.ids = [np.zeros(0, np.int64)] * len(owner)
        self.least = low.copy()  # a lower score can no longer enter

    def offer(self, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = np.flatnonzero((scores >= self.least[slot]) & (scores <= self.high[slot]))
        if not len(fit):
            return
        scores, ids = scores[fit], ids[fit]
        if len(fit) > 4 * self.k:
            top = scores >= np.partition(scores, len(fit) - self.k)[len(fit) - self.k]
            scores, ids = scores[top], ids[top]
        scores = np.concatenate([self.scores[slot], scores])
        ids = np.concatenate([self.ids[slot], ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores[slot], self.ids[slot] = scores[first], ids[first]
        if len(first) == self.k:
            self.least[slot] = max(self.least[slot], scores[first[-1]])

    def thresholds(self, anchors: int) -> np.ndarray:
        """For each anchor the least score that any of its slots still takes."""
        least = np.full(anchors, HIGHEST)
        live = self.least <= self.high
        np.minimum.at(least, self.owner[live], self.least[live])
        return least


class Bucket:
    """Candidates of similar length, with their directions' values sorted by coordinate."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        self.rows, self.ids, self.labels = rows, ids, labels
        lengths = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        self.longest = float(lengths.max())
        directions = rows / np.maximum(lengths, 1e-300)[:, None]
        self.lists = np.argsort(directions, axis=0, kind="stable")
        self.values = np.take_along_axis(directions, self.lists, axis=0)

    def ranges(self, directions: np.ndarray, focus: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the list of each focus coordinate the directions within the angle lie."""
        angle = np.arccos(np.clip(np.take_along_axis(directions, focus, axis=1), -1, 1))
        reach = np.arccos(np.clip(cosines, -1, 1))[:, None]
        low = np.cos(np.minimum(np.pi, angle + reach)) - SLACK
        high = np.cos(np.maximum(0, angle - reach)) + SLACK
        begin, end = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            at = focus == f
            begin[at] = np.searchsorted(self.values[:, f], low[at], side="left")
            end[at] = np.searchsorted(self.values[:, f], high[at], side="right")
        return begin, end

    def candidates(self, focus: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray | None:
        """Rows that lie in all ranges that exclude enough; None where no range does."""
        narrow = np.flatnonzero(end - begin <= SPARE * len(self.rows))
        if not len(narrow):
            return None
        met = np.zeros(len(self.rows), np.int16)
        for k in narrow:
            met[self.lists[begin[k] : end[k], focus[k]]] += 1
        return np.flatnonzero(met == len(narrow))


def mine(
    anchors: np.ndarray, labels: np.ndarray, slots: Slots, rows: np.ndarray, ids: np.ndarray, row_labels: np.ndarray, other: bool,
    bucket_rows: int = BUCKET_ROWS,
) -> tuple[int, int]:
    """Fill ``slots`` from the candidate ``rows``: of another label, or of any.

    Buckets are taken from the longest vectors down.  For each, an anchor's threshold over the
    product of lengths is the cosine that a candidate must reach; anchors that no vector of
    the bucket can satisfy skip it, and the others verify only what their ranges let through.
    Returns how many products were verified, and how many there are.
    """
    own = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))
    directions = anchors / np.maximum(own, 1e-300)[:, None]
    focus = np.argsort(-np.abs(directions), axis=1, kind="stable")[:, :FOCUS]
    slots_of: list[list[int]] = [[] for _ in anchors]
    for slot, anchor in enumerate(slots.owner):
        slots_of[anchor].append(slot)
    norms = (rows.astype(np.float64) ** 2).sum(1)
    order = np.lexsort((ids, -norms))
    verified = 0

    def offer(anchor: int, scores: np.ndarray, bucket: Bucket, at: np.ndarray | slice) -> None:
        found, found_ids = scores, bucket.ids[at]
        if other:
            keep = bucket.labels[at] != labels[anchor]
            found, found_ids = found[keep], found_ids[keep]
        for slot in slots_of[anchor]:
            slots.offer(slot, found, found_ids)

    for low in range(0, len(order), bucket_rows):
        part = order[low : low + bucket_rows]
        bucket = Bucket(rows[part], ids[part], row_labels[part])
        least = slots.thresholds(len(anchors)).astype(np.float64)
        reach = own * bucket.longest
        open_ = np.flatnonzero(least <= reach * (1 + SLACK) + SLACK)
        bounded = least[open_] > 0
        whole = list(open_[~bounded])
        asked = open_[bounded]
        if len(asked):
            begin, end = bucket.ranges(directions[asked], focus[asked], least[asked] / reach[asked])
            for k, anchor in enumerate(asked):
                at = bucket.candidates(focus[anchor], begin[k], end[k])
                if at is None:
                    whole.append(anchor)
                elif len(at):
                    verified += len(at)
                    offer(anchor, products(anchors[anchor : anchor + 1], bucket.rows[at])[0], bucket, at)
        if whole:
            verified += len(whole) * len(part)
            for anchor, scores in zip(whole, products(anchors[whole], bucket.rows)):
                offer(anchor, scores, bucket, slice(None))
    return verified, len(anchors) * len(rows)


def _part(name: str, number: Column | int) -> Column:
    return F.pmod(F.xxhash64(F.lit(name), "deal"), F.lit(number) if isinstance(number, int) else number).cast("int").alias(name)


def _each(name: str, number: Column | int) -> Column:
    last = (F.lit(number) if isinstance(number, int) else number.cast("int")) - 1
    return F.explode(F.sequence(F.lit(0), last)).alias(name)


ENTRY = pa.list_(pa.struct([("lost", pa.int64()), ("vec_id", pa.int64())]))


def _positives(rows: DataFrame, count: int, block_rows: int, shard_rows: int, fan: int) -> DataFrame:
    """``(row, positives)``: the first ``count`` other rows of an anchor's label, best first."""
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking"))
    blocks, shards = F.ceil(F.col("asking") / block_rows).cast("int"), F.ceil(F.col("n") / shard_rows).cast("int")
    sizes = stored(sizes.where("asking > 0").select("label", blocks.alias("blocks"), shards.alias("shards")), "negatives")
    known = lookup_join(rows, sizes, ["label"], "inner")
    part = _part("shard", F.col("shards")), _part("block", F.col("blocks"))
    asking = known.where("asks").select("row", "vec_id", "v", "label", "size", part[1], _each("shard", F.col("shards")))
    offered = known.select("vec_id", "v", "label", "size", part[0], _each("block", F.col("blocks")))
    fields = [("row", pa.int64()), ("anchor_id", pa.int64()), ("own", pa.int64()), ("shard", pa.int32()), ("best", ENTRY)]
    empty = pa.schema(fields).empty_table()

    def tile(asked: pa.Table, others: pa.Table) -> pa.Table:
        if not asked.num_rows or not others.num_rows:
            return empty
        anchors, n = matrix(asked.column("v")), asked.num_rows
        slots = Slots(np.arange(n), np.full(n, LOWEST), np.full(n, HIGHEST), count + 1)
        ids = others.column("vec_id").to_numpy()
        mine(anchors, np.zeros(n), slots, matrix(others.column("v")), ids, np.zeros(len(ids)), False)
        best = list_array(np.array(list(map(len, slots.ids))), np.concatenate(slots.scores), np.concatenate(slots.ids))
        own = pa.array([int(x) for x in products_of_rows(anchors)], pa.int64())
        return pa.table([asked.column("row"), asked.column("vec_id"), own, others.column("shard").slice(0, 1).take([0] * n), best], schema=empty.schema)

    keys = ["label", "size", "block", "shard"]
    lists = tiled(asking, offered, keys, tile, f"row long, anchor_id long, own long, shard int, best {LIST}")
    most = sizes.agg(F.max("shards")).first()[0] or 1
    best = merged(lists, ["row", "anchor_id", "own"], "shard", most, count + 1, fan)
    at = F.array_position("best", F.struct((-F.col("own")).alias("lost"), F.col("anchor_id").alias("vec_id")))
    return best.select("row", F.slice(F.filter("best", lambda x, i: (i + 1) != at), 1, count).alias("positives"))


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    k: int = 10,
    positives: int = 5,
    window: tuple[int, int] = (30, 90),
    factor: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    shard_rows: int = SHARD_ROWS,
    fan: int = 16,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    An anchor's positives are the first ``positives`` other rows of its label by integer inner
    product (``floor(factor * x)``; ties: smaller id).  For each, its negatives are the first
    ``k`` rows of other labels whose score lies within ``window`` percent of the positive's.

    Candidates lie in shards by length, and a shard in buckets from the longest vectors down;
    each bucket holds a sorted list per coordinate.  The least score that can still enter
    an anchor's lists bounds the angle, hence a range of each focus coordinate; candidates in
    all ranges are verified exactly (``mine``).  Anchors are not sent to shards whose longest
    vector cannot reach their least score.  Tiles are bounded on both sides, hot labels
    are several blocks and shards, and lists are merged in a tree.

    Rows take no part if id, label or vector is null, or a component null or not finite; an
    anchor meets only vectors of its own length.  An anchor without positives or without rows
    in the window gives none.  Anchor rows of equal ids each give their rows, equal rows are
    candidates each.  An empty table gives no rows, and other columns are ignored.
    """
    columns = [vectors[id_col].cast("long").alias("vec_id"), label.cast("long").alias("label"), integer_vector(vectors[vector_col], factor).alias("v")]
    rows = vectors.select(*columns, F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"))
    rows = rows.where("vec_id is not null and label is not null and v is not null")
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows = stored(rows.withColumns({"deal": F.xxhash64("row"), "size": F.size("v"), "length": F.sqrt(square)}), "negatives")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking")).first()
    blocks, shards = max(1, -(-found.asking // block_rows)), max(1, -(-found.n // shard_rows))

    best = stored(_positives(rows, positives, block_rows, shard_rows, fan).where("size(positives) > 0"), "negatives")
    ranged = rows.repartitionByRange(shards, F.desc("length"), "deal").select("vec_id", "v", "label", "size", "length", F.spark_partition_id().alias("shard"))
    ranged = stored(ranged, "negatives")
    longest = ranged.groupBy("size", "shard").agg(F.max("length").alias("longest"))
    least = F.ceil(F.array_min(F.transform("positives", lambda p: -p["lost"])) * (window[0] / 100)) - 1  # a bound from below
    asking = rows.where("asks").join(best, "row").select("row", "vec_id", "v", "label", "size", "length", "positives", _part("block", blocks))
    lasts = ranged.agg(F.max("shard")).first()[0] or 0
    asking = lookup_join(asking.select("*", _each("shard", lasts + 1)), longest, ["size", "shard"], "inner")
    asking = asking.where(least <= F.col("length") * F.col("longest") * (1 + SLACK) + 1).drop("length", "longest")
    offered = ranged.select("vec_id", "v", "label", "size", "shard", _each("block", blocks))
    fields = [
        ("row", pa.int64()), ("slot", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()),
        ("shard", pa.int32()), ("best", ENTRY),
    ]
    empty = pa.schema(fields).empty_table()

    def tile(asked: pa.Table, others: pa.Table) -> pa.Table:
        if not asked.num_rows or not others.num_rows:
            return empty
        owner, number, ids, scores = [], [], [], []
        for k_, entries in enumerate(asked.column("positives").to_pylist()):
            owner += [k_] * len(entries)
            number += range(len(entries))
            ids += [e["vec_id"] for e in entries]
            scores += [-e["lost"] for e in entries]
        low = np.array([-(-window[0] * s // 100) for s in scores], np.int64)
        high = np.array([window[1] * s // 100 for s in scores], np.int64)
        slots = Slots(np.array(owner, np.int64), low, high, k)
        mine(
            matrix(asked.column("v")), asked.column("label").to_numpy(), slots, matrix(others.column("v")),
            others.column("vec_id").to_numpy(), others.column("label").to_numpy(), True,
        )
        counts = np.array(list(map(len, slots.ids)))
        some = np.flatnonzero(counts)
        if not len(some):
            return empty
        best = list_array(counts[some], np.concatenate(slots.scores), np.concatenate(slots.ids))
        at = pa.array(slots.owner[some])
        shard = others.column("shard").slice(0, 1).take([0] * len(some))
        return pa.table(
            [asked.column("row").take(at), pa.array(np.array(number, np.int32)[some]), asked.column("vec_id").take(at),
             pa.array(np.array(ids, np.int64)[some]), pa.array(np.array(scores, np.int64)[some]), shard, best], schema=empty.schema
        )

    schema = f"row long, slot int, anchor_id long, positive_id long, positive_score long, shard int, best {LIST}"
    keys = ["size", "block", "shard"]
    lists = tiled(asking, offered, keys, tile, schema)
    made = merged(lists, ["row", "slot", "anchor_id", "positive_id", "positive_score"], "shard", lasts + 1, k, fan)
    ranked = made.select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("at", "e"))
    return ranked.select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("negative_id"), "positive_score",
        (-F.col("e.lost")).alias("negative_score"),
    )
