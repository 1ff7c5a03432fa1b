"""One named query per operator: ``(spark, sf_dir) -> DataFrame`` over the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.functions import colour, scalars
from cellgrid.operators import area, cover, fields, phrases, prefix, render, requests, slicing, traffic
from cellgrid.plans import drafts as plans
from cellgrid.plans.grids import GridAnswers, request_coverage
from cellgrid.session import work_folder, written
from cellgrid.sources import cells as cell_store
from cellgrid.sources import chunk_refs, chunk_source, dimensions, granules, zones
from cellgrid.sources.documents import explode_grid_documents
from cellgrid.sources.fixtures import fixture, table
from cellgrid.sources.index_log import IndexLog
from cellgrid.streaming import keyed_limiter, limiter, question_stream
from cellgrid.streaming.listing import index_listing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TODAY = dt.date(2024, 6, 1)
REF_DATE = dt.date(2024, 2, 10)
WRAP_BOX = (100.0, -40.0, -60.0, 40.0)
GLOBE = (100.0, -90.0, 99.999, 90.0)  # everything, starting at 100 degrees east
MIDDLE = dt.datetime(2024, 1, 15)
T0, T1 = dt.datetime(2024, 1, 3, 12), dt.datetime(2024, 1, 20, 18, 30)
BASE, COLLECTION = "s3://archive/grids", "tavg1_2d_aer_Nx"
LIMIT, LIMIT_WINDOW = 3, 7200.0


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def day_text(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def time_text(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def four(column: str) -> Column:
    return scalars.grid_value(column).alias(column)


# --- sources ------------------------------------------------------------------------
def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The index as a stored table, as an index is."""
    return written(fixture(spark, sf, "manifest"), "manifest")


ARCHIVES: dict[tuple[str, str], str] = {}  # folders of archives written in a session


def _archive(spark: SparkSession, sf: str) -> str:
    """Folder of the cells and their axes, as ``write_cells`` leaves them; written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in ARCHIVES:
        path = work_folder(spark, "archive")
        cell_store.write_cells(fixture(spark, sf, "grid_obs"), path)
        ARCHIVES[key] = path
    return ARCHIVES[key]


def _axes(spark: SparkSession, sf: str) -> DataFrame:
    return cell_store.read_axes(spark, _archive(spark, sf))


def _calendar(spark: SparkSession, sf: str) -> DataFrame:
    span = table(spark, sf, "events").agg(F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))
    days = span.select(granules.calendar_days(F.col("first"), F.col("last")).alias("day"))
    return days.withColumn("url", granules.granule_url("day", BASE, COLLECTION))


@query("granule_calendar")
def granule_calendar(spark, sf):
    return _calendar(spark, sf).select(day_text("day").alias("day"), "url")


@query("list_granules")
def list_granules(spark, sf):
    files = granules.list_granules(spark, sf, pattern="*.parquet")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


@query("first_n_granules")
def first_n_granules(spark, sf):
    return granules.first_n_granules(_calendar(spark, sf).withColumnRenamed("url", "path"), 12).select("path")


@query("granule_date")
def granule_date(spark, sf):
    digits = F.when(F.col("event_id") % 11 == 0, F.lit("20241399")).otherwise(F.date_format("ts", "yyyyMMdd"))
    ending = F.when(F.col("event_id") % 7 == 0, F.lit(".nc")).otherwise(F.lit(".nc4"))
    files = table(spark, sf, "events").withColumn("path", F.concat(F.lit("a/b/M.x."), digits, ending))
    return granules.with_granule_date(files).select("event_id", day_text("day").alias("day"))


@query("read_manifest")
def read_manifest(spark, sf):
    days = fixture(spark, sf, "manifest").select(F.col("day").cast("string").alias("key"), "ref_name", F.weekofyear("day").alias("week"))
    links = days.select(F.concat(F.lit("s3://archive/"), "ref_name").alias("key"), "ref_name", "week")
    texts = (
        days.unionByName(links).groupBy("week")
        .agg(F.map_from_entries(F.collect_list(F.struct("key", "ref_name"))).alias("files"))
        .select(F.to_json(F.struct(F.lit(COLLECTION).alias("collection"), "files")).alias("value"))
    )
    return granules.manifest_rows(texts).select(day_text("day").alias("day"), "ref_name")


@query("pending_granules")
def pending_granules(spark, sf):
    return granules.pending_granules(_calendar(spark, sf).select("url"), fixture(spark, sf, "manifest")).select("url", "ref_name")


@query("merge_manifest")
def merge_manifest(spark, sf):
    manifest = fixture(spark, sf, "manifest").select(F.col("day").cast("string").alias("key"), "ref_name")
    link = F.concat(F.lit("s3://archive/loose/"), (F.col("user_id") % 40).cast("string"))
    built = table(spark, sf, "events").select(
        F.when(F.dayofmonth("ts") % 3 == 0, granules.granule_url("ts", BASE, COLLECTION)).otherwise(link).alias("url"),
        F.concat(F.lit("v"), F.col("event_id").cast("string"), F.lit(".json")).alias("ref_name"),
        F.col("event_id").alias("position"),
    )
    return granules.merge_manifest(manifest, built)


@query("build_index")
def build_index(spark, sf):
    folder = work_folder(spark, "index")
    indexed = fixture(spark, sf, "manifest").select(F.col("day").cast("string").alias("key"), "ref_name")
    granules.write_manifest(indexed, f"{folder}/old", COLLECTION, BASE)
    built = granules.build_index(_calendar(spark, sf), f"{folder}/old", f"{folder}/new", COLLECTION, BASE)
    index = granules.read_manifest(spark, f"{folder}/new")
    marked = index.join(built.select("ref_name", F.lit(True).alias("built")), "ref_name", "left")
    return marked.select(day_text("day").alias("day"), "ref_name", F.coalesce("built", F.lit(False)).alias("built"))


def _granule_links(spark: SparkSession, sf: str) -> DataFrame:
    """A link per event, to the granule of its day or to one of forty loose files."""
    link = F.concat(F.lit("s3://archive/loose/"), (F.col("user_id") % 40).cast("string"))
    dated = granules.granule_url("ts", BASE, COLLECTION)
    return table(spark, sf, "events").select("event_id", F.when(F.dayofmonth("ts") % 3 == 0, dated).otherwise(link).alias("url"))


def _manifest_log(spark: SparkSession, sf: str) -> IndexLog:
    """A log whose first commit is the manifest."""
    log = IndexLog(spark, work_folder(spark, "index-log"))
    log.add(fixture(spark, sf, "manifest").select(F.col("day").cast("string").alias("key"), "ref_name", F.lit(0).alias("position")))
    return log


@query("index_log")
def index_log(spark, sf):
    """Four builders put entries under common keys; the index is compacted in between."""
    log = _manifest_log(spark, sf)
    built = _granule_links(spark, sf).select(
        granules.manifest_key("url").alias("key"), F.concat(F.lit("v"), F.col("event_id").cast("string"), F.lit(".json")).alias("ref_name"),
        F.col("event_id").alias("position"),
    )
    for builder in range(4):
        log.add(built.where(F.pmod("position", F.lit(4)) == builder))
        if builder == 1:
            log.compact()
    return log.snapshot()


@query("index_listing")
def index_listing_query(spark, sf):
    """The links as a stream of listings of two files per micro-batch, which name most granules many times."""
    folder = work_folder(spark, "listing")
    links = _granule_links(spark, sf).select("url")
    links.repartition(8).write.parquet(f"{folder}/listing")
    log = _manifest_log(spark, sf)
    stream = spark.readStream.schema(links.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/listing")
    index_listing(stream, log, f"{folder}/state").awaitTermination()
    return log.snapshot()


def _reference_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Reference JSON of each day; a day has one entry per chunk of the grid at most."""
    rows = fixture(spark, sf, "chunk_rows")
    entry = F.concat(
        F.lit('["s3://archive/'), "path", F.lit('", '), F.col("offset").cast("string"), F.lit(", "),
        F.col("length").cast("string"), F.lit("]"),
    )
    key = F.concat("variable", F.lit("/"), F.concat_ws(".", *[F.col(c).cast("string") for c in ("ct", "cy", "cx")]))
    body = F.array_join(F.collect_list(F.concat(F.lit('"'), key, F.lit('": '), entry)), ", ")
    return rows.groupBy("path").agg(
        F.concat(F.lit('{"version": 1, "refs": {".zgroup": "{}", '), body, F.lit("}}")).alias("value")
    )


@query("read_chunk_refs")
def read_chunk_refs(spark, sf):
    refs = chunk_refs.chunk_refs(_reference_texts(spark, sf))
    return refs.select("path", "key", "inline", "url", "offset", "length")


@query("remote_scheme")
def remote_scheme(spark, sf):
    n = F.col("event_id") % 9
    url = (
        F.when(n == 4, "https://host/file").when(n == 5, "http://host/file").when(n == 6, "s3://bucket/file")
        .when(n == 7, "gs://bucket/file").otherwise("/local/file")
    )
    refs = table(spark, sf, "events").select(
        F.concat_ws("-", "event_type", (F.col("user_id") % 400).cast("string")).alias("collection"),
        day_text("ts").alias("path"), F.col("event_id").alias("position"), url.alias("url"),
        F.lit(None).cast("string").alias("inline"),
    )
    return chunk_refs.remote_scheme(refs)


@query("chunk_report")
def chunk_report(spark, sf):
    dims = fixture(spark, sf, "chunk_rows").groupBy("path", "variable").agg(
        F.countDistinct("ct").alias("nt"), F.min("offset").alias("position")
    )
    ints = lambda *xs: F.array(*[x.cast("long") for x in xs])
    meta = F.to_json(F.struct(
        ints(F.col("nt"), F.lit(361), F.lit(576)).alias("shape"), ints(F.lit(1), F.lit(91), F.lit(144)).alias("chunks"),
        F.when(F.col("variable") == "BCEXTTAU", "<f8").otherwise("<f4").alias("dtype"),
    ))
    refs = dims.select("path", "position", F.concat("variable", F.lit("/.zarray")).alias("key"), meta.alias("inline"))
    return chunk_refs.chunk_report(refs)


@query("prune_chunks")
def prune_chunks(spark, sf):
    k = F.col("n_nationkey")
    first = F.date_add(F.lit("2024-01-03").cast("date"), k % 9)
    ranges = table(spark, sf, "nation").select(
        k.cast("long").alias("request_id"),
        F.explode(F.transform(F.sequence(first, F.date_add(first, 5)), day_text)).alias("path"),
        F.when(k % 2 == 0, "DUEXTTAU").otherwise("TOTEXTTAU").alias("variable"),
        (k % 12).alias("t_lo"), (k % 12 + 11).alias("t_hi"), F.lit(1).alias("t_len"),
        (k * 13 % 300).alias("y_lo"), (k * 13 % 300 + 60).alias("y_hi"), F.lit(91).alias("y_len"),
        (k * 37 % 500).alias("x_lo"), (k * 37 % 500 + 75).alias("x_hi"), F.lit(144).alias("x_len"),
    )
    refs = chunk_refs.chunk_refs(_reference_texts(spark, sf))
    return chunk_refs.bytes_to_read(chunk_refs.prune_chunks(refs, ranges))


@query("prune_chunks_pushed")
def prune_chunks_pushed(spark, sf):
    """Every customer's chunks from reference files read through the data source."""
    folder = work_folder(spark, "references")
    _reference_texts(spark, sf).write.partitionBy("path").text(folder)
    k = F.col("c_custkey")
    first = F.date_add(F.lit("2024-01-03").cast("date"), (k % 9).cast("int"))
    ranges = table(spark, sf, "customer").select(
        k.cast("long").alias("request_id"), F.explode(F.sequence(first, F.date_add(first, 5))).alias("day"),
        F.when(k % 2 == 0, "DUEXTTAU").otherwise("TOTEXTTAU").alias("variable"),
        (k % 12).alias("t_lo"), (k % 12 + 8).alias("t_hi"), F.lit(1).alias("t_len"),
        (k * 13 % 300).alias("y_lo"), (k * 13 % 300 + 60).alias("y_hi"), F.lit(91).alias("y_len"),
        (k * 37 % 500).alias("x_lo"), (k * 37 % 500 + 75).alias("x_hi"), F.lit(144).alias("x_len"),
    )
    near = chunk_source.within(chunk_source.read_chunks(spark, folder), ranges)
    return chunk_refs.bytes_to_read(chunk_refs.prune_index(near, ranges, "day"))


@query("decode_cf_time")
def decode_cf_time(spark, sf):
    n, hour, day = F.col("event_id") % 4, F.hour("ts"), day_text("ts")
    raw = F.when(n == 0, hour * 60.0).when(n == 1, hour + 0.5).when(n == 2, hour * 3600.0).otherwise((hour + 0.5) / 24)
    units = (
        F.when(n == 0, F.concat(F.lit("minutes since "), day, F.lit(" 00:30:00")))
        .when(n == 1, F.concat(F.lit("hours since "), day, F.lit(" 00:00:00")))
        .when(n == 2, F.concat(F.lit("seconds since "), day, F.lit("T00:30:00Z")))
        .otherwise(F.concat(F.lit("days since "), day))
    )
    raws = table(spark, sf, "events").select("event_id", raw.alias("raw"), units.alias("units"))
    return cell_store.decode_cf_time(raws, "raw", "units").select("event_id", time_text("time").alias("time"))


def _flat_cells(cells: DataFrame) -> DataFrame:
    return cells.select("variable", time_text("time").alias("time"), "lat", "lon", four("value"))


@query("concat_granules")
def concat_granules(spark, sf):
    cells = fixture(spark, sf, "grid_obs")
    early = cells.where(F.dayofmonth("day") <= 12)
    late = cells.where(F.dayofmonth("day") > 12)
    return _flat_cells(cell_store.concat_granules(early, late))


@query("write_cells")
def write_cells(spark, sf):
    path = work_folder(spark, "cells")
    cell_store.write_cells(fixture(spark, sf, "grid_obs"), path)
    return _flat_cells(cell_store.read_cells(spark, path))


# --- requests -----------------------------------------------------------------------
@query("canonical_variable")
def canonical_variable(spark, sf):
    return fixture(spark, sf, "drafts").select("draft_id", scalars.canonical_variable("variable").alias("variable"))


@query("servable_variable")
def servable_variable(spark, sf):
    return fixture(spark, sf, "drafts").select("draft_id", scalars.servable_variable("variable").alias("servable"))


@query("parse_bbox")
def parse_bbox(spark, sf):
    return fixture(spark, sf, "box_texts").select("box_id", scalars.parse_bbox("bbox").alias("b")).select("box_id", "b.*")


@query("parse_utc_time")
def parse_utc_time(spark, sf):
    texts = fixture(spark, sf, "time_texts")
    return texts.select("event_id", time_text(scalars.parse_utc_time("text")).alias("time"))


@query("check_requests")
def check_requests(spark, sf):
    checked = requests.check_requests(fixture(spark, sf, "customer_requests"), TODAY)
    return checked.select("request_id", "reason", "error_class", F.coalesce("status", F.lit(200)).alias("status"))


@query("granules_for_window")
def granules_for_window(spark, sf):
    checked = requests.check_requests(fixture(spark, sf, "customer_requests"), TODAY)
    found = requests.granules_for_window(checked, _manifest(spark, sf))
    return found.select("request_id", day_text("day").alias("day"), "ref_name")


@query("coverage_status")
def coverage_status(spark, sf):
    checked = requests.check_requests(fixture(spark, sf, "customer_requests"), TODAY)
    coverage = request_coverage(checked, _manifest(spark, sf), _axes(spark, sf))
    return coverage.withColumns({c: F.col(c).cast("long") for c in ("granule_days", "missing_days")})


@query("time_steps_used")
def time_steps_used(spark, sf):
    checked = requests.check_requests(fixture(spark, sf, "customer_requests"), TODAY)
    manifest = _manifest(spark, sf)
    good = requests.good_requests(checked).withColumn("variable", F.col("variable_name"))
    days = requests.window_days(good, manifest).join(manifest.select("day"), "day", "left_semi")
    return fields.time_steps_used(days, _axes(spark, sf))


# --- slices -------------------------------------------------------------------------
def _slice(spark: SparkSession, sf: str) -> DataFrame:
    """All cells, as one slice per variable that wraps around the globe."""
    boxed = slicing.slice_bbox(fixture(spark, sf, "grid_obs"), *GLOBE, extent=(-180.0, 180.0))
    return boxed.withColumn("request_id", F.col("variable"))


@query("slice_bbox")
def slice_bbox(spark, sf):
    found = slicing.slice_bbox(fixture(spark, sf, "grid_obs"), -100.0, -35.0, 50.0, 30.0)
    return found.select("variable", time_text("time").alias("time"), "lat", "lon", "seg", four("value"))


@query("wrap_union")
def wrap_union(spark, sf):
    found = slicing.slice_bbox(fixture(spark, sf, "grid_obs"), *WRAP_BOX)
    return found.select("variable", time_text("time").alias("time"), "lat", "lon", "seg", four("value"))


@query("slice_time")
def slice_time(spark, sf):
    return _flat_cells(slicing.slice_time(fixture(spark, sf, "grid_obs"), T0, T1))


def _answers(spark: SparkSession, sf: str, **options) -> GridAnswers:
    return GridAnswers(
        fixture(spark, sf, "grid_requests"), fixture(spark, sf, "grid_obs"), _manifest(spark, sf), TODAY, **options
    )


@query("slice_requests")
def slice_requests(spark, sf):
    checked = requests.good_requests(requests.check_requests(fixture(spark, sf, "grid_requests"), TODAY))
    cells = fixture(spark, sf, "grid_obs")
    frames = slicing.request_frames(checked, slicing.grid_axes(_axes(spark, sf)))
    spans = granules_joined(frames, _manifest(spark, sf))
    found = slicing.slice_requests(cells, spans, spans_are_small=spans.count() <= 100_000)
    return found.select(
        F.col("request_id").cast("long").alias("request_id"), "variable", time_text("time").alias("time"), "lat", "lon", "seg", four("value")
    )


def _mixed_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Globe-wide and small boxes over two days each."""
    boxes = fixture(spark, sf, "mixed_boxes").withColumn("day", F.explode(F.array("day0", F.date_add("day0", 1))))
    midnight = F.col("day0").cast("timestamp_ntz")
    return boxes.withColumns({
        "start_time": midnight + F.expr("INTERVAL '6' HOUR"), "end_time": midnight + F.expr("INTERVAL '30' HOUR")
    }).drop("day0")


def _shown(cells: DataFrame) -> DataFrame:
    """What rows show of a cell, worked out once a cell and not once a box that holds it."""
    return cells.withColumns({"shown": time_text("time"), "value": four("value")})


def _sliced_rows(found: DataFrame) -> DataFrame:
    return found.select(F.col("request_id").cast("long").alias("request_id"), F.col("shown").alias("time"), "lat", "lon", "seg", "value")


@query("slice_covered")
def slice_covered(spark, sf):
    """On the full-resolution grid."""
    return _sliced_rows(cover.slice_covered(_shown(fixture(spark, sf, "fine_obs")), _mixed_spans(spark, sf)))


@query("slice_zoned")
def slice_zoned(spark, sf):
    """The same from files along the curve, which came in two batches."""
    path, cells = work_folder(spark, "zoned"), written(fixture(spark, sf, "fine_obs"), "fine")
    for batch in (cells.where(F.dayofmonth("day") <= 12), cells.where(F.dayofmonth("day") > 12)):
        zones.write_zoned(batch, path, rows_per_file=20_000)
    return _sliced_rows(zones.slice_zoned(spark, path, written(_mixed_spans(spark, sf), "spans"), _shown))


def granules_joined(frames: DataFrame, manifest: DataFrame) -> DataFrame:
    shape = frames.select(
        "request_id", F.col("variable_name").alias("variable"), "s", "n", "l_lo", "l_hi", "r_lo", "r_hi", "start_time", "end_time"
    )
    return requests.window_days(shape, manifest).join(manifest.select("day"), "day", "left_semi")


def _index(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and columns of every good request on its grid."""
    good = requests.good_requests(requests.check_requests(fixture(spark, sf, "customer_requests"), TODAY))
    axes = slicing.grid_axes(_axes(spark, sf))
    index = slicing.slice_index(slicing.request_frames(good, axes))
    return index.withColumn("request_id", F.col("request_id").cast("long"))


@query("slice_index")
def slice_index(spark, sf):
    return _index(spark, sf).select("request_id", "axis", "seg", "coord", F.col("position").cast("long").alias("position"))


@query("ordered_cells")
def ordered_cells(spark, sf):
    return slicing.ordered_cells(fields.collapse_time(_slice(spark, sf), "hourly")).select("request_id", "lat", "seg", "lon", four("value"))


@query("canvas_order")
def canvas_order(spark, sf):
    index = _index(spark, sf).where(F.col("axis") == "lat")
    sizes = index.groupBy("request_id").agg((F.max("position") + 1).alias("ny"))
    return index.join(sizes, "request_id").select(
        "request_id", F.col("coord").alias("lat"), render.canvas_row("position", "ny").cast("long").alias("y")
    )


# --- fields -------------------------------------------------------------------------
def _field(spark: SparkSession, sf: str, aggregation: str) -> DataFrame:
    return fields.collapse_time(_slice(spark, sf), aggregation)


def _field_rows(field: DataFrame) -> DataFrame:
    return field.select("request_id", "seg", "lat", "lon", four("value"))


@query("prefix_fields")
def prefix_fields(spark, sf):
    """Every good request's field from running sums that were appended in two steps."""
    index = _manifest(spark, sf)
    cells = written(fixture(spark, sf, "grid_obs").join(index.select("day"), "day", "left_semi"), "cells")
    path = work_folder(spark, "prefix")
    cut = F.lit("2024-01-08").cast("date")
    prefix.write_prefix(cells.where(F.col("day") < cut), path, first=True)
    prefix.write_prefix(cells.where(F.col("day") >= cut), path)
    good = requests.good_requests(requests.check_requests(fixture(spark, sf, "customer_requests").repartition("request_id"), TODAY))
    frames = slicing.request_frames(good, slicing.grid_axes(_axes(spark, sf))).withColumn("variable", F.col("variable_name"))
    windows = frames.select("request_id", "variable", *prefix.BOX, "start_time", "end_time", "agg")
    found = prefix.prefix_fields(windows, prefix.read_prefix(spark, path), prefix.read_days(spark, path), cells)
    return found.select(F.col("request_id").cast("long").alias("request_id"), "seg", "lat", "lon", four("value"))


@query("collapse_hourly")
def collapse_hourly(spark, sf):
    return _field_rows(_field(spark, sf, "hourly"))


@query("collapse_daily")
def collapse_daily(spark, sf):
    return _field_rows(_field(spark, sf, "daily"))


@query("collapse_monthly")
def collapse_monthly(spark, sf):
    cells = fixture(spark, sf, "grid_history")
    sliced = slicing.slice_bbox(cells, *GLOBE, extent=(-180.0, 180.0)).withColumn("request_id", F.col("variable"))
    return _field_rows(fields.collapse_time(sliced, "monthly_mean"))


@query("downsample")
def downsample(spark, sf):
    coarse = fields.downsample(fixture(spark, sf, "grid_fine"))
    return coarse.select(
        F.col("by").cast("long").alias("by"), F.col("bx").cast("long").alias("bx"),
        F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), four("value"),
    )


@query("normalize_range")
def normalize_range(spark, sf):
    out = render.normalize_range(_field(spark, sf, "daily"))
    return out.select("request_id", *[F.round(c, 6).alias(c) for c in ("vmin", "vmid", "vmax")], "empty")


@query("block_means")
def block_means(spark, sf):
    """Three block sizes from one stored table of running sums."""
    field = fixture(spark, sf, "grid_fine")
    areas, frames = written(area.summed_area(field), "areas"), written(fields.field_frames(field), "frames")
    sizes = [(360, 180), (90, 60), (41, 17)]
    each = [area.block_means(areas, frames, *cap).withColumn("max_nlon", F.lit(cap[0]).cast("long")) for cap in sizes]
    rows = each[0].unionByName(each[1]).unionByName(each[2])
    return rows.select(
        "max_nlon", F.col("by").cast("long").alias("by"), F.col("bx").cast("long").alias("bx"),
        F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), four("value"),
    )


@query("exact_range")
def exact_range(spark, sf):
    """Over all values of a variable, uncapped; brackets of a thousand rows, so that rounds are needed."""
    field = written(fixture(spark, sf, "fine_obs").select(F.col("variable").alias("request_id"), "value"), "field")
    out = render.exact_range(field, bracket_rows=1_000)
    return out.select("request_id", *[F.round(c, 6).alias(c) for c in ("vmin", "vmid", "vmax")], "empty")


@query("unwrap_lons")
def unwrap_lons(spark, sf):
    axis = _index(spark, sf).where(F.col("axis") == "lon").withColumnRenamed("coord", "lon")
    return render.unwrap_lons(axis).select("request_id", F.col("position").cast("long").alias("position"), "lon", "unwrapped")


@query("grid_extent")
def grid_extent(spark, sf):
    return render.grid_extent(_index(spark, sf))


@query("grid_corners")
def grid_corners(spark, sf):
    return render.grid_corners(render.grid_extent(_index(spark, sf))).withColumn("corner", F.col("corner").cast("long"))


@query("compare_windows")
def compare_windows(spark, sf):
    cells = _slice(spark, sf)
    first = fields.collapse_time(cells.where(F.col("time") < F.lit(MIDDLE).cast("timestamp_ntz")), "daily")
    second = fields.collapse_time(cells.where(F.col("time") >= F.lit(MIDDLE).cast("timestamp_ntz")), "daily")
    both = fields.compare_windows(first, second)
    return both.select("request_id", "seg", "lat", "lon", *[four(c) for c in ("value_a", "value_b", "difference")], F.round("ratio", 2).alias("ratio"))


# --- documents ----------------------------------------------------------------------
@query("grid_documents")
def grid_documents(spark, sf):
    docs = _answers(spark, sf).documents().where(F.col("status") == 200)
    gaps = F.size(F.filter(F.flatten("values"), lambda v: v.isNull()))
    return docs.select(
        F.col("request_id").cast("long").alias("request_id"), "variable", "units", F.array_join(F.col("lats").cast("array<string>"), ",").alias("lats"),
        F.array_join(F.col("lons").cast("array<string>"), ",").alias("lons"), F.col("nx").cast("long").alias("nx"),
        F.col("ny").cast("long").alias("ny"), gaps.cast("long").alias("n_missing"), "time_start", "time_end",
        F.col("time_steps_used").cast("long").alias("time_steps_used"), "aggregation", "downsampled", F.col("source"),
    )


@query("explode_grid_documents")
def explode_docs(spark, sf):
    docs = _answers(spark, sf).documents().where(F.col("status") == 200)
    return explode_grid_documents(docs).select(
        F.col("request_id").cast("long").alias("request_id"), F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), "lat", "lon", "value", "error"
    )


@query("answer_grid_requests")
def answer_grid_requests(spark, sf):
    answers = _answers(spark, sf).documents()
    flat = explode_grid_documents(answers, keep=("status", "reason", "time_steps_used", "missing_days"))
    return flat.select(
        F.col("request_id").cast("long").alias("request_id"), F.col("status").cast("long").alias("status"), "reason",
        F.col("time_steps_used").cast("long").alias("time_steps_used"), F.col("missing_days").cast("long").alias("missing_days"),
        F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), "lat", "lon", "value",
    )


@query("answer_many_requests")
def answer_many_requests(spark, sf):
    """Every customer's request with its full answer, over stored cells and axes."""
    path = _archive(spark, sf)
    answers = GridAnswers(
        fixture(spark, sf, "customer_requests"), cell_store.read_cells(spark, path), _manifest(spark, sf), TODAY,
        axes=cell_store.read_axes(spark, path),
    )
    flat = explode_grid_documents(answers.documents(), keep=("status", "reason", "time_steps_used", "missing_days"))
    return flat.select(
        F.col("request_id").cast("long").alias("request_id"), F.col("status").cast("long").alias("status"), "reason",
        F.col("time_steps_used").cast("long").alias("time_steps_used"), F.col("missing_days").cast("long").alias("missing_days"),
        F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), "lat", "lon", "value",
    )


@query("colorize_grid")
def colorize_grid(spark, sf):
    docs = _answers(spark, sf).documents().where(F.col("status") == 200)
    return render.colorize_grid(docs).select(*[F.col(c).cast("long").alias(c) for c in ("request_id", "y", "x", "r", "g", "b", "a")])


@query("legend_for_grid")
def legend_for_grid(spark, sf):
    docs = _answers(spark, sf).documents().where(F.col("status") == 200)
    return render.legend_for_grid(docs).withColumn("request_id", F.col("request_id").cast("long"))


# --- plans --------------------------------------------------------------------------
def _drafts(spark: SparkSession, sf: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    span = F.expr("make_dt_interval(CAST(span_days AS INT), 0, 0, -1)")
    return fixture(spark, sf, "drafts").withColumn("time_start", start).withColumn("time_end", start + span)


def _places(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fixture(spark, sf, "places"), fixture(spark, sf, "place_aliases")


def _located(spark: SparkSession, sf: str) -> DataFrame:
    return plans.with_plan_defaults(plans.plans_from_drafts(_drafts(spark, sf), *_places(spark, sf)))


@query("resolve_places")
def resolve_places(spark, sf):
    return plans.resolve_places(fixture(spark, sf, "drafts"), *_places(spark, sf)).select(
        "draft_id", "place_name", "w", "s", "e", "n", "place_error"
    )


@query("known_places")
def known_places(spark, sf):
    return plans.known_places(fixture(spark, sf, "places"), 12)


@query("plan_from_draft")
def plan_from_draft(spark, sf):
    blank = F.when(F.col("draft_id") % 17 == 0, F.lit(" ")).otherwise(F.col("place"))
    needs = F.when(F.col("draft_id") % 19 == 0, F.lit("need_location"))
    drafts = _drafts(spark, sf).withColumn("place", blank).withColumn("error", needs)
    out = plans.plans_from_drafts(drafts, *_places(spark, sf))
    return out.select("draft_id", "place_name", F.get("bbox", F.lit(0)).alias("w"), F.get("bbox", F.lit(3)).alias("n"), "refusal")


@query("check_plan_schema")
def check_plan_schema(spark, sf):
    k = F.col("draft_id")
    box = F.array((k % 400 - 200).cast("double"), F.lit(-10.0), (k % 90).cast("double"), (k % 50 - 20).cast("double"))
    odd = _drafts(spark, sf).drop("place").withColumns({
        "bbox": F.when(k % 23 == 0, F.slice(box, 1, 3)).otherwise(box),
        "intent": F.when(k % 29 == 0, "other").otherwise(F.col("intent")),
        "opacity": F.when(k % 3 != 0, (k % 14).cast("double") / 10),
        "mode": F.when(k % 31 == 0, "binary"),
        "aggregation": F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("aggregation")),
        "time_end": F.when(k % 37 == 0, F.lit("2023-12-31 00:00:00").cast("timestamp_ntz")).otherwise(F.col("time_end")),
    })
    return plans.check_plan_schema(odd).select(
        "draft_id", "variable", "aggregation", "mode", "opacity", "colormap", F.array_join("errors", ",").alias("errors")
    )


@query("validate_plans")
def validate_plans(spark, sf):
    return plans.validate_plans(plans.with_plan_defaults(_drafts(spark, sf))).select("draft_id", "violation")


@query("intent_defaults")
def intent_defaults(spark, sf):
    k = F.col("draft_id")
    open_ones = _drafts(spark, sf).withColumns({
        c: F.when(k % m != 0, F.col(c)) for c, m in (("level", 2), ("source", 3), ("aggregation", 5))
    })
    return plans.apply_intent_defaults(open_ones).select("draft_id", "level", "source", "aggregation")


@query("route_source")
def route_source(spark, sf):
    moved = _drafts(spark, sf).withColumn("time_start", F.expr("time_start + make_dt_interval(CAST(draft_id % 60 AS INT))"))
    return plans.route_source(moved, REF_DATE, F.col("draft_id") % 7 == 0).select("draft_id", "routed_source")


@query("style_defaults")
def style_defaults(spark, sf):
    return plans.style_for(_drafts(spark, sf), F.col("draft_id") % 2 == 0).select("draft_id", "colormap", "mode", "opacity")


@query("data_url")
def data_url(spark, sf):
    return _located(spark, sf).select("draft_id", plans.data_url().alias("data_url"))


@query("legend_spec")
def legend_spec(spark, sf):
    return _drafts(spark, sf).select("draft_id", plans.legend_spec().alias("l")).select("draft_id", "l.*")


@query("legend_stops")
def legend_stops(spark, sf):
    return plans.legend_stops(_drafts(spark, sf), dimensions.colormaps(spark)).withColumn("position", F.col("position").cast("long"))


@query("auto_caption")
def auto_caption(spark, sf):
    captions = _located(spark, sf).withColumn(
        "caption", F.when(F.col("draft_id") % 3 == 0, "given").when(F.col("draft_id") % 3 == 1, "")
    )
    return captions.select("draft_id", plans.auto_caption().alias("caption"))


@query("exceedance")
def exceedance(spark, sf):
    name = (
        F.when(F.col("event_type") == "click", "PM25").when(F.col("event_type") == "view", "PM10")
        .when(F.col("event_type") == "purchase", "O3").when(F.col("event_type") == "signup", "NO2").otherwise("DUEXTTAU")
    )
    values = table(spark, sf, "events").select(
        "event_id", name.alias("variable"), F.when(F.col("event_id") % 47 != 0, F.col("value")).alias("value")
    )
    return plans.exceedance(values, dimensions.guidelines(spark), "24h").select("event_id", "threshold", "exceeds")


@query("answer_plans")
def answer_plans(spark, sf):
    out = plans.answer_plans(_drafts(spark, sf), *_places(spark, sf))
    return out.select(
        "draft_id", F.col("status").cast("long").alias("status"), "problem", "variable", "place_name", "data_url",
        F.col("legend.stops").alias("stops"), "caption",
    )


@query("answer_questions")
def answer_questions(spark, sf):
    minutes = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(question_id AS INT), 0)")
    asked = fixture(spark, sf, "event_questions").select(
        "question_id", "text", F.lit("all").alias("scope"), minutes.alias("ts"), (F.col("question_id") % 13 != 0).alias("ok")
    )
    drafts = _drafts(spark, sf).withColumn("source", F.when(F.col("draft_id") % 5 != 0, F.col("source")))
    out = plans.answer_questions(asked, drafts, *_places(spark, sf), dimensions.event_catalog(spark), REF_DATE)
    return out.select(
        "question_id", "cached", F.coalesce(F.array_join("event_ids", ","), F.lit("")).alias("events"),
        F.col("status").cast("long").alias("status"), "problem", "source", F.col("style.colormap").alias("colormap"),
        "data_url", "caption",
    )


# --- questions ----------------------------------------------------------------------
@query("match_events")
def match_events(spark, sf):
    return plans.match_events(fixture(spark, sf, "event_questions"), dimensions.event_catalog(spark))


@query("event_plans")
def event_plans(spark, sf):
    events = dimensions.event_catalog(spark)
    matches = plans.match_events(fixture(spark, sf, "event_questions"), events)
    return plans.event_plans(matches, events).select(
        "question_id", "event_id", "source", "level", "intent", "variable", "aggregation",
        F.get("bbox", F.lit(0)).alias("w"), time_text("time_start").alias("time_start"),
    )


@query("tag_aerosol_words")
def tag_aerosol_words(spark, sf):
    return plans.tag_aerosol_words(fixture(spark, sf, "questions")).select("question_id", "phrase", "variable", "level")


@query("tag_phrases")
def tag_phrases(spark, sf):
    """Which opening words of a benchmark item each document holds; two, three or four words of an item."""
    opening = F.slice(F.split(F.trim(scalars.phrase_text("text")), " "), F.lit(1), (F.col("item_id") % 3 + 2).cast("int"))
    items = table(spark, sf, "benchmark").select(F.array_join(opening, " ").alias("phrase"))
    return phrases.tag_phrases(table(spark, sf, "documents").select("doc_id", "text"), items).select("doc_id", "found")


@query("normalize_question")
def normalize_question(spark, sf):
    talk = table(spark, sf, "conversations")
    return talk.select("conv_id", "turn", scalars.normalize_question("text").alias("normal"))


@query("question_key")
def question_key(spark, sf):
    return fixture(spark, sf, "questions").select("question_id", scalars.question_key("text", "scope").alias("key"))


@query("question_cache")
def question_cache(spark, sf):
    return traffic.question_cache(fixture(spark, sf, "questions")).select("question_id", "key", "hit")


@query("question_cache_stream")
def question_cache_stream(spark, sf):
    folder = work_folder(spark, "question-stream")
    return _run_keyed(question_stream.cached_questions(_in_stretches(fixture(spark, sf, "questions"), folder)), folder)


@query("cache_stats")
def cache_stats(spark, sf):
    return traffic.cache_stats(traffic.question_cache(fixture(spark, sf, "questions")))


# --- scalars ------------------------------------------------------------------------
@query("grid_value")
def grid_value(spark, sf):
    value = F.when(F.col("event_id") % 47 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 97.31)
    return table(spark, sf, "events").select("event_id", scalars.grid_value(value).alias("value"))


@query("hex_to_rgb")
def hex_to_rgb(spark, sf):
    code = F.lower(F.lpad(F.hex(F.col("event_id") * 7919 % 16777216), 6, "0"))
    text = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("#x"), code)).otherwise(F.concat(F.lit("#"), code))
    return table(spark, sf, "events").select("event_id", colour.hex_to_rgb(text).alias("c")).select(
        "event_id", *[F.col(f"c.{x}").cast("long").alias(x) for x in "rgb"], "c.error"
    )


@query("sample_colormap")
def sample_colormap(spark, sf):
    ramp = colour.colormap_for(F.when(F.col("event_id") % 2 == 0, "DUEXTTAU").otherwise("TOTEXTTAU"))
    t = F.col("value") / 97.31 - 0.25
    events = table(spark, sf, "events").select("event_id", "value")
    return colour.with_ramp_colour(events, ramp, t).select("event_id", *[F.col(x).cast("long").alias(x) for x in "rgb"])


@query("colormap_for")
def colormap_for(spark, sf):
    return fixture(spark, sf, "drafts").select("draft_id", colour.colormap_for("variable").alias("colormap"))


@query("pretty_variable")
def pretty_variable(spark, sf):
    return fixture(spark, sf, "drafts").select("draft_id", scalars.pretty_variable(F.trim("variable")).alias("title"))


@query("format_tick")
def format_tick(spark, sf):
    # every fifth value prints with four digits, so that halves of the third occur
    plain = F.when(F.col("event_id") % 47 != 0, F.col("value") / 97.31)
    value = F.when(F.col("event_id") % 5 == 0, F.col("event_id") / 1000).otherwise(plain)
    return table(spark, sf, "events").select("event_id", scalars.format_tick(value).alias("tick"))


@query("legend_gradient")
def legend_gradient(spark, sf):
    return fixture(spark, sf, "drafts").select("draft_id", colour.legend_gradient(colour.colormap_for("variable")).alias("gradient"))


@query("grid_title")
def grid_title(spark, sf):
    end = _drafts(spark, sf).select("draft_id", "aggregation", scalars.iso_utc("time_start").alias("a"), scalars.iso_utc("time_end").alias("b"))
    return end.select("draft_id", scalars.grid_title(F.lit("dimensionless"), F.col("a"), F.col("b"), F.col("aggregation")).alias("title"))


# --- dimension files ----------------------------------------------------------------
def _json_files(rows: DataFrame, name: str, body: Column) -> str:
    """A JSON document per 50 customers: ``{name: [body, ...]}``; returns their folder."""
    path = f"{work_folder(rows.sparkSession, name)}/files"
    rows.groupBy(F.expr("c_custkey div 50").alias("document")).agg(F.collect_list(body).alias(name)).select(name).write.option("maxRecordsPerFile", 1).json(path)
    return path


def _some_box() -> Column:
    return F.expr("array(CAST(c_custkey % 300 - 170 AS DOUBLE), -35D, CAST(c_custkey % 300 - 150 AS DOUBLE), 45.5D)")


@query("read_gazetteer")
def read_gazetteer(spark, sf):
    body = F.struct(F.col("c_name").alias("name"), _some_box().alias("bbox"))
    return dimensions.read_gazetteer(spark, _json_files(table(spark, sf, "customer"), "places", body))


@query("read_event_catalog")
def read_event_catalog(spark, sf):
    plan = F.expr("named_struct('source', 'merra2', 'level', 'column', 'intent', 'plume', 'variable', c_mktsegment, 'aggregation', 'daily')")
    body = F.struct(
        F.col("c_name").alias("id"), F.col("c_name").alias("name"), F.array("c_mktsegment", F.lit("dust")).alias("aliases"), _some_box().alias("bbox"),
        F.expr("concat('2020-06-', lpad(c_custkey % 28 + 1, 2, '0'), 'T02:00:00+02:00')").alias("time_start"),
        F.expr("concat('2020-07-', lpad(c_custkey % 28 + 1, 2, '0'))").alias("time_end"),
        F.array_repeat(plan, F.expr("CAST(c_custkey % 3 AS INT)")).alias("suggested_plans"),
    )
    events = dimensions.read_event_catalog(spark, _json_files(table(spark, sf, "customer"), "events", body))
    return events.select(
        "id", "name", F.array_join("aliases", ",").alias("aliases"), F.get("bbox", F.lit(0)).alias("w"), time_text("time_start").alias("time_start"),
        time_text("time_end").alias("time_end"), F.size("suggested_plans").cast("long").alias("n_plans"),
        F.get("suggested_plans", F.lit(0))["variable"].alias("first_variable"),
    )


@query("read_colormaps")
def read_colormaps(spark, sf):
    """Ramps of three stops, one per part, 50 to a document."""
    stops = F.expr("array(array('0', '#0000ff'), array('0.5', concat('#', lpad(lower(hex(p_partkey % 16777216)), 6, '0'))), array('1', '#ff0000'))")
    ramp = F.struct(stops.alias("stops"), F.lit("AOD").alias("units"))
    named = F.struct(F.concat(F.lit("ramp "), F.col("p_partkey").cast("string")).alias("name"), ramp.alias("ramp"))
    path = f"{work_folder(spark, 'colormaps')}/files"
    documents = table(spark, sf, "part").groupBy(F.expr("p_partkey div 50").alias("document")).agg(F.map_from_entries(F.collect_list(named)).alias("ramps"))
    documents.select(F.to_json("ramps")).write.option("maxRecordsPerFile", 1).text(path)
    return dimensions.read_colormaps(spark, path).select(
        "colormap", F.col("position").cast("long").alias("position"), "t", *[F.col(c).cast("long").alias(c) for c in "rgb"], "units"
    )


# --- request log --------------------------------------------------------------------
def _log(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "request_log").select("event_id", "ts", scalars.client_ip("xff", "peer").alias("ip"))


@query("client_ip")
def client_ip(spark, sf):
    return _log(spark, sf).select("event_id", "ip")


@query("request_rate")
def request_rate(spark, sf):
    return traffic.request_rate(_log(spark, sf), LIMIT_WINDOW).select("event_id", "ip", "requests")


@query("rate_limit")
def rate_limit(spark, sf):
    return limiter.rate_limit(_log(spark, sf), LIMIT, LIMIT_WINDOW).select("event_id", "ip", "allowed", "retry_after")


@query("rate_limit_stream")
def rate_limit_stream(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    forwarded, peer = fixture_columns()
    log = stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), scalars.client_ip(forwarded, peer).alias("ip"))
    folder = work_folder(spark, "limiter")
    run = (
        limiter.rate_limit_stream(log, LIMIT, LIMIT_WINDOW).writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
        .outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "ip", "allowed", "retry_after")


def _in_stretches(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` as a stream of four stretches of time of four files each, one stretch per micro-batch."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    for days in ((1, 7), (8, 15), (16, 23), (24, 31)):
        stretch = rows.where(F.dayofmonth("ts").between(*days))
        stretch.repartition(4).write.mode("append").parquet(f"{folder}/log")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/log")


def _run_keyed(stream: DataFrame, folder: str) -> DataFrame:
    """All rows of a stream with keyed state, which needs RocksDB."""
    spark = stream.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, keyed_limiter.ROCKSDB)  # a query keeps the provider that it starts with
    try:
        run = (
            stream.writeStream.format("parquet")
            .option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
            .outputMode("append").trigger(availableNow=True).start()
        )
        run.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{folder}/out")


def _keyed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What the keyed limiter says about the log."""
    folder = work_folder(spark, "keyed-limiter")
    return _run_keyed(keyed_limiter.limited(_in_stretches(_log(spark, sf), folder), LIMIT, LIMIT_WINDOW), folder)


@query("rate_limit_keyed")
def rate_limit_keyed(spark, sf):
    rows = _keyed_rows(spark, sf).where(F.col("kind") == "row")
    return rows.select("event_id", "ip", "allowed", "retry_after", "reason")


@query("limiter_state_bound")
def limiter_state_bound(spark, sf):
    """Clients with state after each micro-batch that opened or closed some."""
    return keyed_limiter.live_clients(_keyed_rows(spark, sf)).select("watermark_ms", "opened", "closed", "live")


def fixture_columns() -> tuple[Column, Column]:
    """The request log's address columns over the raw events."""
    return (
        F.expr("CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN ' , 10.9.9.9' "
               "ELSE concat(' 10.0.0.', CAST(user_id % 8 AS STRING), ' , 70.41.3.18') END"),
        F.expr("CASE WHEN event_id % 20 = 0 THEN NULL ELSE concat('192.168.0.', CAST(user_id % 8 AS STRING)) END"),
    )
