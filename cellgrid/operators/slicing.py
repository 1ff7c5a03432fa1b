"""Space-time selection: coordinate axes, boxes with antimeridian wrap, windows.

``cells`` has ``variable, day, time, lat, lon, value``.  ``day`` is the UTC date of ``time``
and the partition column of stored cells, so each predicate on time carries one on day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.operators.joins import salted_join

TILE_DEGREES = 15


def with_day(cells: DataFrame) -> DataFrame:
    return cells if "day" in cells.columns else cells.withColumn("day", F.to_date("time"))


# --- one box, one window ------------------------------------------------------------
def slice_bbox(
    cells: DataFrame, w: float, s: float, e: float, n: float, extent: tuple[float, float] | None = None
) -> DataFrame:
    """Cells whose centre lies in the box, both ends included, with the longitude piece ``seg``.

    ``w > e`` wraps: piece 0 is ``w..max`` and piece 1 ``min..e``.  A piece whose width is
    zero after clipping to the data's own extent selects nothing.  Both pieces come from a
    single scan: they cannot overlap, so the union is one OR over literal ranges, which
    reaches the Parquet row-group filter.  ``extent`` is the grid's (min, max) longitude
    where the caller knows it; otherwise two scalar subqueries read it from ``lon`` alone.
    """
    if extent is None:
        lo, hi = cells.agg(F.min("lon")).scalar(), cells.agg(F.max("lon")).scalar()
    else:
        lo, hi = F.lit(float(extent[0])), F.lit(float(extent[1]))
    west, east = F.lit(float(w)), F.lit(float(e))
    lon = F.col("lon")
    rows = cells.where(F.col("lat").between(float(s), float(n)))
    if w <= e:
        wide = F.least(east, hi) > F.greatest(west, lo)
        return rows.where(lon.between(float(w), float(e)) & wide).withColumn("seg", F.lit(0))
    left = (lon >= float(w)) & (hi > F.greatest(west, lo))
    right = (lon <= float(e)) & (F.least(east, hi) > lo)
    return rows.where(left | right).withColumn("seg", F.when(lon >= float(w), 0).otherwise(1))


def slice_time(cells: DataFrame, t0: dt.datetime, t1: dt.datetime) -> DataFrame:
    """Cells whose step lies in ``t0..t1``, both ends included (naive times are UTC)."""
    t0, t1 = (t if t.tzinfo is None else t.astimezone(dt.timezone.utc).replace(tzinfo=None) for t in (t0, t1))
    start, end = (F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz") for t in (t0, t1))
    return cells.where(F.col("day").between(F.lit(t0.date()), F.lit(t1.date())) & F.col("time").between(start, end))


# --- coordinate axes ----------------------------------------------------------------
def cell_axes(cells: DataFrame) -> DataFrame:
    """The coordinate axes of every variable: ``(variable, axis, day, coord, time)``.

    Rows of axis ``lat`` and ``lon`` hold one coordinate each; rows of axis ``time`` hold
    one step of one day.  One scan with grouping sets; partial aggregation leaves only the
    distinct coordinates of each task to shuffle.  Stored next to the cells by
    ``write_cells``, so that requests need not scan cells for them.
    """
    grouped = (
        cells.groupingSets(
            [["variable", "lat"], ["variable", "lon"], ["variable", "day", "time"]],
            "variable", "lat", "lon", "day", "time",
        )
        .agg(F.grouping("lat").alias("no_lat"), F.grouping("lon").alias("no_lon"))
    )
    axis = F.when(F.col("no_lat") == 0, "lat").when(F.col("no_lon") == 0, "lon").otherwise("time")
    return grouped.select(
        "variable", axis.alias("axis"), "day", F.coalesce("lat", "lon").alias("coord"), "time"
    )


def grid_axes(axes: DataFrame) -> DataFrame:
    """One row per variable with its sorted ``lats`` and ``lons`` (bounded by the grid)."""
    return (
        axes.where(F.col("axis").isin("lat", "lon"))
        .groupBy("variable")
        .agg(
            F.sort_array(F.collect_set(F.when(F.col("axis") == "lat", F.col("coord")))).alias("lats"),
            F.sort_array(F.collect_set(F.when(F.col("axis") == "lon", F.col("coord")))).alias("lons"),
        )
    )


def day_steps(axes: DataFrame) -> DataFrame:
    """``(variable, day, steps)``: the sorted time steps of each day (24 for hourly grids)."""
    return (
        axes.where(F.col("axis") == "time")
        .groupBy("variable", "day")
        .agg(F.sort_array(F.collect_set("time")).alias("steps"))
    )


# --- many boxes, many windows -------------------------------------------------------
def request_frames(requests: DataFrame, grid: DataFrame) -> DataFrame:
    """Where each good request lies on its variable's grid.

    Adds the two longitude pieces as ranges (``l_lo..l_hi``, ``r_lo..r_hi``; NULL where a
    piece is dropped), the selected axes ``lats`` and ``lon_axis`` (``seg, lon``) and their
    sizes, and ``grid_known``.  Everything follows from the request row and one row per
    variable (``grid_axes``); joining the latter is the only join.
    """
    known = requests.join(
        grid.selectExpr("variable AS variable_name", "lats AS all_lats", "lons AS all_lons"), "variable_name", "left"
    )
    left, right = "(l_hi > l_lo)", "(w > e AND r_hi > r_lo)"
    ranges = known.selectExpr(
        "*", "all_lons IS NOT NULL AS grid_known",
        "greatest(w, array_min(all_lons)) AS l_lo",
        "IF(w > e, array_max(all_lons), least(e, array_max(all_lons))) AS l_hi",
        "array_min(all_lons) AS r_lo", "least(e, array_max(all_lons)) AS r_hi",
    ).selectExpr(
        *[c for c in known.columns], "grid_known", f"IF({left}, l_lo, NULL) AS l_lo", f"IF({left}, l_hi, NULL) AS l_hi",
        f"IF({right}, r_lo, NULL) AS r_lo", f"IF({right}, r_hi, NULL) AS r_hi",
    )
    piece = "transform(filter(all_lons, x -> coalesce(x BETWEEN {0}_lo AND {0}_hi, false)), x -> struct({1} AS seg, x AS lon))"
    axes = ranges.selectExpr(
        "*", "filter(all_lats, x -> x BETWEEN s AND n) AS lats",
        f"concat({piece.format('l', 0)}, {piece.format('r', 1)}) AS lon_axis",
    )
    return axes.selectExpr(
        *[c for c in axes.columns if c not in ("all_lats", "all_lons")],
        "coalesce(array_size(lats), 0) AS ny", "coalesce(array_size(lon_axis), 0) AS nx",
        # places on the variable's own grid, counted from 0
        "CAST(array_position(all_lats, get(lats, 0)) AS INT) - 1 AS first_lat",
        "CAST(array_position(all_lons, get(filter(lon_axis, x -> x.seg = 0), 0).lon) AS INT) - 1 AS first_left",
        "array_size(filter(lon_axis, x -> x.seg = 0)) AS n_left",
    )


def in_piece(low: str, high: str) -> Column:
    return F.coalesce(F.col("lon").between(F.col(low), F.col(high)), F.lit(False))


def slice_requests(
    cells: DataFrame, spans: DataFrame, spans_are_small: bool, tile_degrees: int | None = None
) -> DataFrame:
    """Every cell that a request selects, for all requests at once.

    ``spans`` holds one row per request and granule day: ``request_id, variable, day, s, n,
    l_lo, l_hi, r_lo, r_hi, start_time, end_time`` and whatever else should travel along.
    The join is on equal (variable, day); box and window are residual conditions.  With
    ``tile_degrees`` both sides also carry a square tile, so that a cell only meets the
    requests that touch its tile; worth it for many small boxes.

    Small spans are broadcast and the cells never move.  Otherwise both sides are shuffled;
    a (variable, day, tile) that very many requests share is salted on the request side.
    """
    keys = ["variable", "day"]
    if not spans_are_small:
        tile_degrees = tile_degrees or TILE_DEGREES
    if tile_degrees:
        keys.append("tile")
        spans = spans.withColumn("tile", F.explode(span_tiles(tile_degrees)))
        cells = cells.withColumn("tile", tile_of(F.col("lat"), F.col("lon"), tile_degrees))
    if spans_are_small:
        joined = cells.join(F.broadcast(spans), keys)
    else:
        joined = salted_join(spans, cells, keys, spread=F.xxhash64("request_id"))
    right = in_piece("r_lo", "r_hi")
    return (
        joined.where(
            F.col("lat").between(F.col("s"), F.col("n"))
            & (in_piece("l_lo", "l_hi") | right)
            & F.col("time").between(F.col("start_time"), F.col("end_time"))
        )
        .withColumn("seg", F.when(right & ~in_piece("l_lo", "l_hi"), 1).otherwise(0))
        .drop("tile")
    )


def tile_of(lat: Column, lon: Column, size: int) -> Column:
    columns = 360 // size + 1
    return (F.floor((lat + 90) / size) * columns + F.floor((lon + 180) / size)).cast("int")


def span_tiles(size: int) -> Column:
    """Ids of the tiles that a span's box touches."""
    columns = 360 // size + 1

    def band(low: Column, high: Column, offset: int) -> Column:
        return F.sequence(F.floor((low + offset) / size).cast("int"), F.floor((high + offset) / size).cast("int"))

    def lon_band(low: str, high: str) -> Column:
        return F.when(F.col(low).isNull(), F.array().cast("array<int>")).otherwise(band(F.col(low), F.col(high), 180))

    lon_tiles = F.array_union(lon_band("l_lo", "l_hi"), lon_band("r_lo", "r_hi"))
    return F.flatten(
        F.transform(band(F.col("s"), F.col("n"), 90), lambda y: F.transform(lon_tiles, lambda x: y * columns + x))
    )


# --- positions and order ------------------------------------------------------------
def slice_index(frames: DataFrame, request: str = "request_id") -> DataFrame:
    """Position of every row and column within a slice: ``(request, axis, seg, coord, position)``.

    ``frames`` are ``request_frames``: positions count all coordinates of the grid's own axes
    inside the box, whether cells hold values there or not.
    """
    lats = frames.select(request, F.lit("lat").alias("axis"), F.lit(0).alias("seg"), F.posexplode("lats").alias("position", "coord"))
    lons = frames.select(request, F.lit("lon").alias("axis"), F.posexplode("lon_axis").alias("position", "at"))
    return lats.select(request, "axis", "seg", "coord", "position").unionByName(
        lons.select(request, "axis", F.col("at.seg").alias("seg"), F.col("at.lon").alias("coord"), "position")
    )


def ordered_cells(field: DataFrame, request: str = "request_id") -> DataFrame:
    """Cells with latitude ascending and longitude in slice order (range-partitioned sort)."""
    return field.orderBy(request, "lat", "seg", "lon")
