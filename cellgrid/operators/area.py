"""Block means of any block size from one table of running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.functions import vocab
from cellgrid.operators.fields import field_frames, place_on_blocks, present, with_blocks
from cellgrid.operators.joins import lookup_join, row_bound

ONE_CELL = 1 << 30  # a cap under which each cell is its own block


def summed_area(field: DataFrame, request: str = "request_id") -> DataFrame:
    """``(request_id, iy, ix, total, held)``: sum and number of values at or below each place of a field.

    A row per place of the field's axes, so the table is as large as a full grid. Columns are summed
    within a row of the grid and then rows within a column: no window is longer than an axis.
    Write it once; ``block_means`` takes four of its rows per block, whatever the block size.
    """
    frames = with_blocks(field_frames(field, request), ONE_CELL, ONE_CELL)
    value = present(F.col("value"))
    placed = place_on_blocks(field, frames, request).groupBy(request, F.col("by").alias("iy"), F.col("bx").alias("ix")).agg(
        F.sum(value).alias("total"), F.count(value).alias("held")
    )
    grid = frames.select(request, "nx", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("iy"))
    grid = grid.select(request, "iy", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("ix"))
    full = grid.join(placed, [request, "iy", "ix"], "left").fillna({"total": 0.0, "held": 0})
    for along, across in (("ix", "iy"), ("iy", "ix")):
        upto = Window.partitionBy(request, across).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        full = full.withColumns({c: F.sum(c).over(upto) for c in ("total", "held")})
    return full.select(request, "iy", "ix", "total", "held")


def block_means(
    areas: DataFrame, frames: DataFrame, max_nlon: int = vocab.MAX_NLON, max_nlat: int = vocab.MAX_NLAT, request: str = "request_id"
) -> DataFrame:
    """What ``fields.downsample`` gives under a cap, from stored ``summed_area`` rows and ``field_frames``.

    A block is the sum at its last place less those left of it and below it, plus the one below and left:
    four rows on equal keys. Sums are of doubles, so means agree with direct ones to rounding.
    """
    blocks = with_blocks(frames, max_nlon, max_nlat)
    out = blocks.select(request, "fy", "fx", "out_lons", F.posexplode("out_lats").alias("by", "lat")).select(
        request, "fy", "fx", "by", "lat", F.posexplode("out_lons").alias("bx", "lon")
    )

    def corner(down: int, left: int, sign: int) -> Column:
        return F.struct(
            ((F.col("by") + 1 - down) * F.col("fy") - 1).alias("iy"), ((F.col("bx") + 1 - left) * F.col("fx") - 1).alias("ix"),
            F.lit(sign).alias("sign"),
        )

    corners = out.select(request, "by", "bx", "lat", "lon", F.inline(F.array(corner(0, 0, 1), corner(0, 1, -1), corner(1, 0, -1), corner(1, 1, 1))))
    met = lookup_join(areas, corners, [request, "iy", "ix"], "inner", few_is_small=row_bound(corners))
    return met.groupBy(request, "by", "bx", "lat", "lon").agg(
        F.sum(F.col("sign") * F.col("total")).alias("total"), F.sum(F.col("sign") * F.col("held")).alias("held")
    ).select(request, "by", "bx", "lat", "lon", F.when(F.col("held") > 0, F.col("total") / F.col("held")).alias("value"))
