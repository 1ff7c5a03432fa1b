"""From fields and documents to colours, extents and legends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.functions import vocab
from cellgrid.functions.colour import colormap_for, legend_gradient, with_ramp_colour
from cellgrid.functions.scalars import computed_once, format_tick, grid_title, pretty_variable
from cellgrid.operators.fields import present
from cellgrid.operators.selection import exact_percentiles
from cellgrid.sources.documents import explode_grid_documents

LOW, HIGH = 0.02, 0.98


def _finite(value: Column) -> Column:
    return F.when(F.abs(present(value)) < F.lit(float("inf")), value)


def _widened(p_low: Column, p_high: Column) -> Column:
    """The range as a struct; an empty field is 0..1, a constant one is widened a little."""
    constant = ~(p_high > p_low)
    margin = F.when(F.abs(p_low) > 0, F.abs(p_low) * 0.01).otherwise(F.lit(1e-6))
    vmin = F.when(p_low.isNull(), 0.0).when(constant, p_low - margin).otherwise(p_low)
    vmax = F.when(p_low.isNull(), 1.0).when(constant, p_low + margin).otherwise(p_high)
    return F.struct(
        vmin.alias("vmin"), ((vmin + vmax) / 2).alias("vmid"), vmax.alias("vmax"), p_low.isNull().alias("empty")
    )


def normalize_range(field: DataFrame, request: str = "request_id", null_as_zero: bool = False) -> DataFrame:
    """``(request_id, vmin, vmid, vmax, empty)``: exact interpolated p2 and p98 of the finite values.

    For fields under the output cap, 64,800 values at most, which bounds the value counts
    that the exact percentile keeps.  ``null_as_zero`` counts missing cells as zeros, as the
    browser code does.
    """
    value = _finite(F.coalesce(F.col("value"), F.lit(0.0)) if null_as_zero else F.col("value"))
    ends = field.groupBy(request).agg(F.percentile(value, F.array(F.lit(LOW), F.lit(HIGH))).alias("p"))
    return ends.select(request, _widened(F.get("p", F.lit(0)), F.get("p", F.lit(1))).alias("r")).select(request, "r.*")


def exact_range(field: DataFrame, request: str = "request_id", **bounds: int) -> DataFrame:
    """``normalize_range`` for fields of any size: no buffer holds a field's values.

    Requests without finite values are kept and ``empty``. Pass a stored table.
    """
    finite = field.select(request, _finite(F.col("value")).alias("value"))
    ends = exact_percentiles(finite, request, "value", (LOW, HIGH), **bounds).groupBy(request).agg(
        F.max(F.when(F.col("q") == LOW, F.col("percentile"))).alias("p_low"), F.max(F.when(F.col("q") == HIGH, F.col("percentile"))).alias("p_high")
    )
    every = field.select(request).distinct().join(ends, request, "left")
    return every.select(request, _widened(F.col("p_low"), F.col("p_high")).alias("r")).select(request, "r.*")


def _sorted_percentile(values: Column, q: float) -> Column:
    position = (F.size(values) - 1) * F.lit(q)
    low, high = F.floor(position).cast("int"), F.ceil(position).cast("int")
    at_low, at_high = F.get(values, low), F.get(values, high)
    return at_low + (at_high - at_low) * (position - low)


def with_document_range(docs: DataFrame) -> DataFrame:
    """Documents with ``vmin, vmid, vmax, empty``, computed inside each row: no shuffle."""
    finite = F.filter(F.flatten("values"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    ranked = computed_once(docs, ranked=F.sort_array(finite))
    ends = computed_once(
        ranked,
        p_low=F.when(F.size("ranked") > 0, _sorted_percentile(F.col("ranked"), LOW)),
        p_high=F.when(F.size("ranked") > 0, _sorted_percentile(F.col("ranked"), HIGH)),
    )
    ranged = computed_once(ends, range=_widened(F.col("p_low"), F.col("p_high")))
    return ranged.select(*docs.columns, "range.*")


# --- longitudes ---------------------------------------------------------------------
def unwrap_lons(axis: DataFrame, request: str = "request_id") -> DataFrame:
    """Adds ``unwrapped`` to lon axis rows ``(request_id, position, lon)``: +360 at every drop.

    Windows over the axis of one request, a few hundred rows; cells never pass through them.
    """
    order = Window.partitionBy(request).orderBy("position")
    drop = F.when(F.col("lon") < F.lag("lon").over(order), 360.0).otherwise(0.0)
    return (
        axis.withColumn("turn", drop)
        .withColumn("unwrapped", F.col("lon") + F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("turn")
    )


def grid_extent(axes: DataFrame, request: str = "request_id") -> DataFrame:
    """``(request_id, west, south, east, north)`` from slice axes ``(request_id, axis, position, coord)``."""
    lons = unwrap_lons(axes.where(F.col("axis") == "lon").withColumnRenamed("coord", "lon"), request)
    ew = lons.groupBy(request).agg(F.min("unwrapped").alias("west"), F.max("unwrapped").alias("east"))
    ns = axes.where(F.col("axis") == "lat").groupBy(request).agg(
        F.min("coord").alias("south"), F.max("coord").alias("north")
    )
    return ew.join(ns, request).select(request, "west", "south", "east", "north")


def grid_corners(extent: DataFrame, request: str = "request_id") -> DataFrame:
    """The four corners in order top left, top right, bottom right, bottom left."""
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    corners = F.array(
        corner("west", "north"), corner("east", "north"), corner("east", "south"), corner("west", "south")
    )
    return extent.select(request, F.posexplode(corners).alias("corner", "at")).select(request, "corner", "at.*")


# --- pixels and legends -------------------------------------------------------------
def canvas_row(iy: Column | str, ny: Column | str) -> Column:
    """Row on a canvas whose first row is the northernmost latitude."""
    iy, ny = (F.col(c) if isinstance(c, str) else c for c in (iy, ny))
    return ny - 1 - iy


def colorize_grid(docs: DataFrame, request: str = "request_id", colormap: Column | None = None) -> DataFrame:
    """Every document as pixels ``(request_id, y, x, r, g, b, a)``; missing cells are transparent.

    The range comes from the document row itself, so the only work is one explode.
    """
    ramp = colormap_for("variable") if colormap is None else colormap
    ranged = with_document_range(docs).withColumn("colormap", ramp)
    cells = explode_grid_documents(ranged, request, keep=("colormap", "vmin", "vmax", "ny", "nx")).where(
        F.col("error").isNull()
    )
    t = (F.col("value") - F.col("vmin")) / (F.col("vmax") - F.col("vmin"))
    seen = _finite(F.col("value")).isNotNull()
    pixels = with_ramp_colour(cells, F.col("colormap"), F.when(seen, t))
    return pixels.select(
        request, canvas_row("iy", "ny").alias("y"), F.col("ix").alias("x"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in "rgb"],
        F.when(seen, vocab.PIXEL_ALPHA).otherwise(0).alias("a"),
    )


def legend_for_grid(docs: DataFrame, request: str = "request_id") -> DataFrame:
    """Title, ticks, gradient and caption line of each document."""
    ticks = with_document_range(docs)
    for end in ("min", "mid", "max"):
        ticks = computed_once(ticks, **{f"tick_{end}": format_tick(f"v{end}")})
    return ticks.select(
        request, pretty_variable("variable").alias("title"), legend_gradient(colormap_for("variable")).alias("gradient"),
        "tick_min", "tick_mid", "tick_max",
        grid_title(F.col("units"), F.col("time_start"), F.col("time_end"), F.col("aggregation")).alias("meta"),
    )
