"""Fields: time means, step counts, coarsening, comparison of two windows.

A field is ``(request_id, seg, lat, lon, value)``; a missing cell is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.functions import vocab
from cellgrid.operators.joins import lookup_join
from cellgrid.operators.slicing import day_steps
from cellgrid.session import written

CELL_KEYS = ("request_id", "seg", "lat", "lon")


def present(value: Column | str) -> Column:
    """NULL for NaN, so that averages skip it (an average over NaN would be NaN)."""
    value = F.col(value) if isinstance(value, str) else value
    return F.nanvl(value, F.lit(None).cast("double"))


def time_bucket(aggregation: Column) -> Column:
    """The stretch of time whose steps are averaged first: whole window, day or month."""
    return (
        F.when(aggregation == "daily", F.col("day"))
        .when(aggregation == "monthly_mean", F.trunc("day", "month"))
    )


def bucket_means(sliced: DataFrame, keys: Sequence[str] = CELL_KEYS) -> DataFrame:
    """First stage of a time mean: one mean per cell and ``bucket``, missing values skipped.

    Rows carry a sum ``total`` and a count ``seen``, of a single step or a whole day.  The
    steps of a cell lie next to each other in stored cells, so the map-side partial
    aggregate shrinks the shuffle about as many times as a day has steps.
    """
    mean = F.sum("total") / F.nullif(F.sum("seen"), F.lit(0))
    return sliced.groupBy(*keys, "bucket").agg(mean.alias("value"))


def step_totals(cells: DataFrame) -> DataFrame:
    """Cells with ``total`` and ``seen`` for their single value."""
    total = present("value")
    return cells.withColumns({"total": total, "seen": F.when(total.isNotNull(), 1).otherwise(0).cast("long")})


def collapse_time(sliced: DataFrame, aggregation: str, keys: Sequence[str] = CELL_KEYS) -> DataFrame:
    """One value per cell.  ``hourly`` is the mean of all steps; ``daily`` and
    ``monthly_mean`` are unweighted means of the day or month means, so that a partial day
    counts as much as a full one and a day without data not at all.
    """
    if aggregation not in vocab.AGGREGATIONS:
        raise ValueError(f"aggregation must be one of {vocab.AGGREGATIONS}")
    if aggregation == "hourly":
        return sliced.groupBy(*keys).agg(F.avg(present("value")).alias("value"))
    steps = step_totals(sliced).withColumn("bucket", time_bucket(F.lit(aggregation)))
    return bucket_means(steps, keys).groupBy(*keys).agg(F.avg("value").alias("value"))


def day_partials(cells: DataFrame) -> DataFrame:
    """Sum and count of every cell and day; means over whole days follow from these alone."""
    return cells.groupBy("variable", "day", "lat", "lon").agg(
        F.sum(present("value")).alias("total"), F.count(present("value")).alias("seen")
    )


def time_steps_used(request_days: DataFrame, axes: DataFrame, request: str = "request_id") -> DataFrame:
    """``(request_id, time_steps_used)``: steps of the variable inside each window.

    Counted on the time axis, before any box is applied, as a step whose cells are all
    missing is still a step.  The axis is joined as one small array per day, so nothing
    fans out by steps.
    """
    return (
        lookup_join(request_days, day_steps(axes), ["variable", "day"], "left")
        .groupBy(request)
        .agg(F.coalesce(F.sum(steps_inside()), F.lit(0)).cast("long").alias("time_steps_used"))
    )


def steps_inside() -> Column:
    """How many of a day's ``steps`` lie in the window."""
    return F.array_size(F.filter("steps", lambda x: x.between(F.col("start_time"), F.col("end_time"))))


# --- coarsening ---------------------------------------------------------------------
def field_frames(field: DataFrame, request: str = "request_id") -> DataFrame:
    """The axes of each field, read from its own cells (bounded by the grid's axes)."""
    return field.groupBy(request).agg(
        F.sort_array(F.collect_set("lat")).alias("lats"),
        F.sort_array(F.collect_set(F.struct("seg", "lon"))).alias("lon_axis"),
    ).withColumn("ny", F.size("lats")).withColumn("nx", F.size("lon_axis"))


def with_blocks(frames: DataFrame, max_nlon: int = vocab.MAX_NLON, max_nlat: int = vocab.MAX_NLAT) -> DataFrame:
    """Block sizes that bring each field under the cap, and the coarse axes.

    ``fy, fx`` are the block sizes, ``oy, ox`` the coarse sizes; rows and columns that do not
    fill a block at the end of the slice are dropped.  Row-wise arithmetic, no join.
    """
    some = "ny > 0 AND nx > 0"  # no blocks, and NULL axes, for an empty slice
    sized = frames.selectExpr(
        "*", f"IF({some}, CAST(ceil(ny / {int(max_nlat)}) AS INT), NULL) AS fy",
        f"IF({some}, CAST(ceil(nx / {int(max_nlon)}) AS INT), NULL) AS fx",
    ).selectExpr(
        "*", "CAST(floor(ny / fy) AS INT) AS oy", "CAST(floor(nx / fx) AS INT) AS ox", "fy > 1 OR fx > 1 AS downsampled"
    )
    # mean longitudes are taken on unwrapped values and turned back if they passed 180
    unwrapped = "aggregate(m, 0D, (a, x) -> a + x.lon + IF(x.seg = 1, 360D, 0D)) / size(m)"
    turned = f"transform(lon_blocks, m -> IF(exists(m, x -> x.seg = 1) AND {unwrapped} >= 180, {unwrapped} - 360, {unwrapped}))"
    return sized.selectExpr(
        "*", "transform(sequence(0, oy - 1), b -> aggregate(slice(lats, b * fy + 1, fy), 0D, (a, x) -> a + x) / fy) AS out_lats",
        "transform(sequence(0, ox - 1), b -> slice(lon_axis, b * fx + 1, fx)) AS lon_blocks",
    ).withColumn("out_lons", F.expr(turned)).drop("lon_blocks")


def place_on_blocks(field: DataFrame, blocks: DataFrame, request: str = "request_id") -> DataFrame:
    """Field rows with ``by, bx`` and the block's coordinates; trimmed edges are dropped.

    Joins the exploded axes (a few hundred rows per request), broadcast where they are few.
    """
    def rows(axis: str, names: list[str]) -> DataFrame:
        return blocks.select(request, "fy", "fx", "oy", "ox", "out_lats", "out_lons", F.posexplode(axis).alias(*names))

    by = F.floor(F.col("iy") / F.col("fy")).cast("int")
    bx = F.floor(F.col("ix") / F.col("fx")).cast("int")
    lats = rows("lats", ["iy", "lat"]).withColumn("by", by).where("by < oy").select(
        request, "lat", "by", F.get("out_lats", F.col("by")).alias("out_lat")
    )
    lons = rows("lon_axis", ["ix", "at"]).withColumn("bx", bx).where("bx < ox").select(
        request, "at.seg", "at.lon", "bx", F.get("out_lons", F.col("bx")).alias("out_lon")
    )
    return lookup_join(
        lookup_join(field, lats, [request, "lat"], "inner"), lons, [request, "seg", "lon"], "inner"
    )


def downsample(
    field: DataFrame, max_nlon: int = vocab.MAX_NLON, max_nlat: int = vocab.MAX_NLAT, request: str = "request_id"
) -> DataFrame:
    """Fields coarsened to the cap by block means: ``(request_id, by, bx, lat, lon, value)``.

    Every block of the coarse grid has a row; its value is NULL where it holds no value.  The axes, a row per field, go through a table: they are computed once, and counting them
    for the join does not run the field again.
    """
    blocks = written(with_blocks(field_frames(field, request), max_nlon, max_nlat), "axes")
    means = place_on_blocks(field, blocks, request).groupBy(request, "by", "bx").agg(F.avg("value").alias("value"))
    # a request has oy * ox blocks, at most the cap
    grid = blocks.select(request, "out_lons", F.posexplode("out_lats").alias("by", "lat")).select(
        request, "by", "lat", F.posexplode("out_lons").alias("bx", "lon")
    )
    return grid.join(means, [request, "by", "bx"], "left").select(request, "by", "bx", "lat", "lon", "value")


# --- comparison ---------------------------------------------------------------------
def compare_windows(first: DataFrame, second: DataFrame, keys: Sequence[str] = CELL_KEYS) -> DataFrame:
    """Two fields side by side with difference and ratio; cells of either side are kept."""
    keys = list(keys)
    a = first.select(*keys, F.col("value").alias("value_a"))
    b = second.select(*keys, F.col("value").alias("value_b"))
    return (
        a.join(b, keys, "full_outer")
        .withColumn("difference", F.col("value_b") - F.col("value_a"))
        .withColumn("ratio", F.col("value_b") / F.nullif(F.col("value_a"), F.lit(0.0)))
    )
