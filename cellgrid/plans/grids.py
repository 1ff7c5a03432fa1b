"""From a table of grid requests to answers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cellgrid.functions import vocab
from cellgrid.operators.fields import bucket_means, day_partials, step_totals, steps_inside, time_bucket, with_blocks
from cellgrid.operators.joins import BROADCAST_ROWS, lookup_join
from cellgrid.operators.requests import check_requests, good_requests, window_days
from cellgrid.operators.slicing import (
    TILE_DEGREES, cell_axes, day_steps, grid_axes, request_frames, slice_requests, span_tiles, with_day,
)
from cellgrid.session import written
from cellgrid.sources.documents import explode_grid_documents, grid_documents

SPEC = ["variable_name", "w", "s", "e", "n", "start_time", "end_time", "agg"]
# Documents are broadcast only up to this size: distinct requests times the cells of the output cap.
DOCUMENT_BYTES = 64 << 20
PLACES = ["first_lat", "first_left", "n_left", "fy", "fx", "oy", "ox"]
# Up to this many distinct requests every cell is simply held against all of them.
UNTILED_REQUESTS = 4
BOX = ["s", "n", "l_lo", "l_hi", "r_lo", "r_hi", "start_time", "end_time"]


def covered_days(asked: DataFrame, manifest: DataFrame, axes: DataFrame) -> DataFrame:
    """Requests with their indexed ``days`` and the time steps inside the window.

    A window becomes days, which meet the index and the time axis on equal keys; one
    aggregation brings them back to a row per request.  Days in the calendar bound the
    array.
    """
    days = window_days(asked.withColumn("variable", F.col("variable_name")), manifest)
    indexed = manifest.select("day", F.lit(True).alias("indexed")).distinct()
    steps = F.when(F.col("indexed"), steps_inside())
    return (
        days.join(indexed, "day", "left")
        .join(day_steps(axes), ["variable", "day"], "left")
        .groupBy("request_id", *SPEC)
        .agg(
            F.collect_list(F.when(F.col("indexed"), F.col("day"))).alias("days"),
            F.coalesce(F.sum(steps), F.lit(0)).cast("long").alias("time_steps_used"),
        )
    )


def coverage_status(frames: DataFrame) -> DataFrame:
    """Adds ``granule_days, missing_days`` and ``gap``: why a valid request selects nothing.

    Gaps in the index are no error; they show up in ``missing_days``.
    """
    counted = frames.selectExpr(
        "*", "size(days) AS granule_days", "datediff(to_date(end_time), to_date(start_time)) + 1 - size(days) AS missing_days"
    )
    return counted.withColumn("gap", F.expr("""
        CASE WHEN granule_days = 0 THEN 'no_coverage' WHEN NOT grid_known THEN 'variable_absent'
             WHEN l_lo IS NULL AND r_lo IS NULL THEN 'no_longitude_cells' WHEN ny = 0 OR nx = 0 THEN 'no_grid_cells'
             WHEN time_steps_used = 0 THEN 'no_time_steps' END"""))


COVERAGE_TEXT = {
    "no_coverage": "no indexed granule covers the window",
    "variable_absent": "the variable is not in the indexed collection",
    "no_longitude_cells": "the box selects no longitude",
    "no_grid_cells": "the box selects no grid cell",
    "no_time_steps": "the window selects no time step",
}


def request_coverage(checked: DataFrame, manifest: DataFrame, axes: DataFrame) -> DataFrame:
    """``(request_id, granule_days, missing_days, time_steps_used, gap)`` of the good requests."""
    frames = request_frames(covered_days(good_requests(checked), manifest, axes), grid_axes(axes))
    return coverage_status(frames).select("request_id", "granule_days", "missing_days", "time_steps_used", "gap")


class GridAnswers:
    """Answers to one table of requests, as DataFrames that share their inputs.

    Identical requests are answered once, so a popular request costs as much as a rare one.
    ``axes`` are the stored coordinate axes; without them they are read from the cells.

    The state of the distinct requests (a row each: parsed request, place on the grid,
    indexed days) feeds every output.  It is computed once into a table in the work folder,
    whose counts decide the join strategies.
    """

    def __init__(
        self,
        requests: DataFrame,
        cells: DataFrame,
        manifest: DataFrame,
        today: dt.date,
        latency_days: int = vocab.ARCHIVE_LATENCY_DAYS,
        axes: DataFrame | None = None,
        max_nlon: int = vocab.MAX_NLON,
        max_nlat: int = vocab.MAX_NLAT,
        broadcast_rows: int = BROADCAST_ROWS,
    ):
        self.cells = with_day(cells)
        seen_axes = Observation()
        place = F.count_if(F.col("axis") != "time")
        self.axes = written(cell_axes(self.cells), "axes", seen_axes, n=place) if axes is None else axes
        self.manifest = manifest
        self.checked = check_requests(requests, today, latency_days)
        asked = good_requests(self.checked).groupBy(*SPEC).agg(F.min("request_id").alias("request_id"))
        served = F.col("variable").isin(*vocab.COLUMN_VARIABLES)
        self.grid = grid_axes(self.axes.where(served))
        frames = request_frames(covered_days(asked, manifest, self.axes), self.grid)
        seen = Observation()
        self.state = written(
            with_blocks(coverage_status(frames), max_nlon, max_nlat), "requests", seen,
            requests=F.count(F.lit(1)), spans=F.coalesce(F.sum("granule_days"), F.lit(0)),
            tiles=F.coalesce(F.sum(F.col("granule_days") * F.size(span_tiles(TILE_DEGREES))), F.lit(0)),
        )
        self.n_requests, n_spans = seen.get["requests"], seen.get["spans"]
        axis_rows = seen_axes.get["n"] if axes is None else axes.agg(place).first()[0]
        self.documents_small = self.n_requests * max_nlon * max_nlat * 8 <= DOCUMENT_BYTES
        self.asked_small = self.n_requests <= broadcast_rows
        self.axis_small = axis_rows <= broadcast_rows
        # tiles spare a cell the requests elsewhere on the globe, at more span rows
        tiled_small = seen.get["tiles"] <= broadcast_rows
        self.tiles = TILE_DEGREES if self.n_requests > UNTILED_REQUESTS and (tiled_small or n_spans > broadcast_rows) else None
        self.spans_small = (seen.get["tiles"] if self.tiles else n_spans) <= broadcast_rows

    def _spans(self) -> DataFrame:
        """One row per distinct request and indexed day, with scalars only.

        Served requests all have granule days; that comparison is there because the
        optimizer prunes partitions dynamically only where it sees a selective predicate.
        """
        served = self.state.where(F.col("gap").isNull() & (F.col("granule_days") > 0))
        return served.select(
            "request_id", F.col("variable_name").alias("variable"), *BOX, "agg", F.explode("days").alias("day")
        ).withColumn("bucket", time_bucket(F.col("agg"))).drop("agg")

    def _selected(self) -> DataFrame:
        """Every selected cell and step, or day sum: ``request_id, bucket, lat, lon, total, seen``.

        Days that lie whole in a window are summed once for all requests, the days at its ends
        step by step; so an answer does not depend on what else was asked.
        """
        spans = self._spans()
        steps = step_totals(self.cells).select("variable", "day", "time", "lat", "lon", "total", "seen")
        midnight = F.col("day").cast("timestamp_ntz")
        whole = (F.col("start_time") <= midnight) & (
            F.col("end_time") >= midnight + F.expr("INTERVAL '23:59:59.999999' HOUR TO SECOND")
        )
        wanted = spans.where(whole).select("variable", "day").distinct()
        # at most one row per variable and indexed day
        days = day_partials(self.cells.join(F.broadcast(wanted), ["variable", "day"], "left_semi")).withColumn("time", midnight)
        inner = slice_requests(days, spans.where(whole), self.spans_small, self.tiles)
        edges = slice_requests(steps, spans.where(~whole), self.spans_small, self.tiles)
        return inner.unionByName(edges)

    def block_cells(self) -> DataFrame:
        """``(request_id, by, bx, value)``: the coarsened fields of the distinct requests.

        Single steps only meet the spans and a hash aggregate; positions and block numbers
        are looked up afterwards, on one row per cell and bucket.
        """
        means = bucket_means(self._selected(), ["request_id", "lat", "lon"])
        places = self.state.selectExpr("request_id", "variable_name AS variable", "r_hi", *PLACES)
        lats = self.grid.select("variable", F.posexplode("lats").alias("gy", "lat"))
        lons = self.grid.select("variable", F.posexplode("lons").alias("gx", "lon"))
        on_grid = lookup_join(means, places, ["request_id"], "inner", few_is_small=self.asked_small)
        on_grid = lookup_join(on_grid, lats, ["variable", "lat"], "inner", few_is_small=self.axis_small)
        on_grid = lookup_join(on_grid, lons, ["variable", "lon"], "inner", few_is_small=self.axis_small)
        # the right piece of a wrap starts at the grid's own first column and follows the left
        placed = on_grid.selectExpr(
            "request_id", "value", "fy", "fx", "oy", "ox", "gy - first_lat AS iy",
            "IF(coalesce(lon <= r_hi, false), n_left + gx, gx - first_left) AS ix",
        ).selectExpr(
            "request_id", "value", "iy", "ix", "oy", "ox", "CAST(floor(iy / fy) AS INT) AS by", "CAST(floor(ix / fx) AS INT) AS bx"
        ).where("by < oy AND bx < ox")
        keys = ["request_id", "by", "bx", "iy", "ix"]
        # one exchange on (request, block row) serves the time mean, the block mean and the
        # rows of the documents; a block row is a bounded share of a request
        return (
            placed.repartition("request_id", "by")
            .groupBy(*keys).agg(F.avg("value").alias("value"))
            .groupBy("request_id", "by", "bx").agg(F.avg("value").alias("value"))
        )

    def distinct_documents(self) -> DataFrame:
        """One document per distinct request that selects something."""
        served = self.state.where(F.col("gap").isNull()).withColumn("variable", F.col("variable_name"))
        return grid_documents(self.block_cells(), served)

    def statuses(self) -> DataFrame:
        """Every request with its status: 200, or the first rule or coverage check it failed."""
        known = self.state.select(
            *SPEC, "gap", "granule_days", "missing_days", "time_steps_used", F.col("request_id").alias("answer_id")
        )
        # a refused request may agree with a good one in all parts of its answer
        asked = self.checked.withColumn("agg", F.when(F.col("reason").isNull(), F.col("agg")))
        joined = lookup_join(asked, known, SPEC, "left", few_is_small=self.asked_small)
        text = F.create_map(*[F.lit(x) for pair in COVERAGE_TEXT.items() for x in pair])
        return joined.select(
            "request_id",
            F.coalesce("reason", "gap").alias("reason"),
            F.when(F.col("reason").isNotNull(), F.col("error_class"))
            .when(F.col("gap") == "variable_absent", "unknown_variable")
            .when(F.col("gap").isNotNull(), "bad_request").alias("error_class"),
            F.when(F.coalesce("reason", "gap").isNull(), 200).otherwise(422).alias("status"),
            F.coalesce("message", F.try_element_at(text, F.col("gap"))).alias("message"),
            "granule_days", "missing_days", "time_steps_used", "answer_id",
        )

    def documents(self) -> DataFrame:
        """Every request with status and, where it is 200, its document."""
        docs = self.distinct_documents().withColumnRenamed("request_id", "answer_id").drop("time_steps_used")
        return lookup_join(
            self.statuses(), docs, ["answer_id"], "left", few_is_small=self.documents_small
        ).drop("answer_id")

    def cells_out(self) -> DataFrame:
        """Every answered request as flat cells, missing ones included."""
        answered = self.documents().where(F.col("status") == 200)
        return explode_grid_documents(answered, keep=("time_steps_used",)).drop("error")


def answer_grid_requests(requests: DataFrame, cells: DataFrame, manifest: DataFrame, today: dt.date, **options) -> DataFrame:
    """Documents or first errors for a table of requests; see ``GridAnswers``."""
    return GridAnswers(requests, cells, manifest, today, **options).documents()
