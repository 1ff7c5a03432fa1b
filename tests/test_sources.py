"""Listings, manifests, references and stored cells on small files."""

import datetime as dt
import json

import grids
from pyspark.sql import functions as F

from cellgrid.sources import cells as store
from cellgrid.sources import chunk_refs, dimensions, granules


def test_calendar(spark):
    rows = granules.granule_calendar(spark, "s3://b/p/", "c", dt.date(2024, 2, 28), dt.date(2024, 3, 1)).collect()
    assert [r.url for r in rows] == [f"s3://b/p/2024/{d[:2]}/MERRA2_400.c.2024{d}.nc4" for d in ("0228", "0229", "0301")]
    assert granules.granule_calendar(spark, "x", "c", dt.date(2024, 2, 2), dt.date(2024, 2, 1)).count() == 0


def test_listing(spark, tmp_path):
    for name in ("2024/02/M.c.20240201.nc4", "2024/01/M.c.20240131.nc4", "2024/01/M.c.20240130.nc4", "2024/01/readme.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"xyz")
    files = granules.with_granule_date(granules.list_granules(spark, str(tmp_path), limit=2)).collect()
    assert [(f.day, f.length) for f in files] == [(dt.date(2024, 1, 30), 3), (dt.date(2024, 1, 31), 3)]
    assert granules.list_granules(spark, str(tmp_path)).count() == 3


def test_names(spark):
    paths = spark.createDataFrame([("s3://b/M.c.20240131.nc4",), ("x.nc4",), ("a.20241331.nc4",), ("a.b/file",)], "path STRING")
    got = paths.select(granules.granule_date("path").alias("d"), granules.reference_name("path").alias("r")).collect()
    assert [tuple(g) for g in got] == [
        (dt.date(2024, 1, 31), "M.c.20240131.json"), (None, "x.json"), (None, "a.20241331.json"), (None, "file.json")]


def test_manifest(spark, tmp_path):
    files = {"2024-01-31": "a.json", "s3://b/x.nc4": "x.json", "2024-02-30": "z.json"}
    (tmp_path / "index.json").write_text(json.dumps({"collection": "c", "prefix": "p", "files": files}, indent=1))
    manifest = granules.read_manifest(spark, str(tmp_path / "index.json"))
    assert [tuple(r) for r in manifest.collect()] == [(dt.date(2024, 1, 31), "a.json")]
    urls = spark.createDataFrame([("s3://b/a.nc4",), ("s3://b/new.20240201.nc4",)], "url STRING")
    assert [r.ref_name for r in granules.pending_granules(urls, manifest).collect()] == ["new.20240201.json"]
    old = spark.createDataFrame([("2024-01-31", "a.json"), ("k", "k.json")], "key STRING, ref_name STRING")
    built = spark.createDataFrame([("u.20240131.nc4", "b.json", 1), ("u.20240131.nc4", "c.json", 2), ("u.nc4", "u.json", 0)], "url STRING, ref_name STRING, position INT")
    merged = {r.key: r.ref_name for r in granules.merge_manifest(old, built).collect()}
    assert merged == {"2024-01-31": "c.json", "k": "k.json", "u.nc4": "u.json"}


def test_references(spark, tmp_path):
    def zarray(dtype, chunks):
        return json.dumps({"shape": [24, 361, 576], "chunks": chunks, "dtype": dtype})

    refs = {
        ".zgroup": '{"zarr_format":2}', "lat/.zarray": zarray("<f8", [361]), "DU/.zarray": zarray("<f4", [1, 91, 144]),
        "BC/.zarray": zarray("f8", [1, 91, 144]), "SU/.zarray": zarray("|i2", [24, 361, 576]),
        "lat/0": "base64:AAAA", "DU/0.0.0": ["https://h/f.nc4", 100, 50], "DU/3.1.2": ["s3://b/f.nc4", 200, 70], "DU/3.3.2": ["f.nc4"],
    }
    (tmp_path / "day1.json").write_text(json.dumps({"version": 1, "refs": refs}))
    (tmp_path / "day0.json").write_text(json.dumps({"version": 1, "refs": {"DU/0.0.0": ["/local/f", 0, 9]}}))
    rows = chunk_refs.read_chunk_refs(spark, str(tmp_path)).withColumn("collection", F.lit("c"))
    by_key = {(r.path.rsplit("/", 1)[1], r.key): r for r in rows.collect()}
    assert len(by_key) == 10 and [r.position for r in by_key.values()].count(0) == 2
    assert tuple(by_key[("day1.json", "DU/3.1.2")])[4:7] == ("s3://b/f.nc4", 200, 70)
    assert by_key[("day1.json", "lat/0")].inline == "base64:AAAA" and by_key[("day1.json", "DU/3.3.2")].url == "f.nc4"
    assert chunk_refs.remote_scheme(rows).first().scheme == "https"
    local = rows.where(F.col("path").endswith("day0.json"))
    assert chunk_refs.remote_scheme(local).first().scheme is None
    report = {r.variable: (r.chunks, r.chunk_bytes, r.n_chunks) for r in chunk_refs.chunk_report(rows).collect()}
    assert report == {"DU": ("1x91x144", 52416, 384), "BC": ("1x91x144", 104832, 384), "SU": ("24x361x576", 4 * 24 * 361 * 576, 1)}
    path = by_key[("day1.json", "DU/0.0.0")].path
    ranges = spark.createDataFrame(
        [(1, path, "DU", 0, 3, 1, 60, 95, 91, 290, 300, 144), (2, path, "DU", 0, 1, 1, 200, 250, 91, 0, 10, 144)],
        "request_id INT, path STRING, variable STRING, t_lo INT, t_hi INT, t_len INT, y_lo INT, y_hi INT, y_len INT, x_lo INT, x_hi INT, x_len INT")
    picked = chunk_refs.bytes_to_read(chunk_refs.prune_chunks(rows, ranges)).collect()
    assert [tuple(r) for r in picked] == [(1, 1, 70)]


def test_cf_time(spark):
    rows = [(30.0, "minutes since 2026-09-01 00:30:00"), (1.5, "hours since 2026-09-01"), (2.0, "days since 2026-09-01T12:00:00Z"),
            (1.0, "second since 2026-09-01"), (1.0, "months since 2026-09-01"), (1.0, "minutes since soon"), (None, "days since 2026-09-01")]
    got = store.decode_cf_time(spark.createDataFrame(rows, "raw DOUBLE, units STRING"), "raw", "units").collect()
    t = dt.datetime
    assert [r.time for r in got] == [t(2026, 9, 1, 1), t(2026, 9, 1, 1, 30), t(2026, 9, 3, 12), t(2026, 9, 1, 0, 0, 1), None, None, None]


def test_stored_cells(spark, tmp_path):
    cells = grids.cells(spark)
    path = str(tmp_path / "archive")
    store.write_cells(cells.where("day = DATE'2019-03-11'"), path)
    store.write_cells(cells.where("day = DATE'2019-03-12'"), path)
    back = store.read_cells(spark, path)
    assert back.count() == cells.count()
    assert back.select(cells.columns).exceptAll(cells).count() == 0
    axes = store.read_axes(spark, path).groupBy("variable", "axis").count().collect()
    assert {(r.variable, r.axis): r["count"] for r in axes if r.variable == "DUEXTTAU"} == {
        ("DUEXTTAU", "lat"): 15, ("DUEXTTAU", "lon"): 46, ("DUEXTTAU", "time"): 48}
    one = back.where("variable = 'DUEXTTAU' AND day = DATE'2019-03-11' AND lat BETWEEN 0 AND 10")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(variable" in plan and "GreaterThanOrEqual(lat,0.0)" in plan


def test_dimensions_from_files(spark, tmp_path):
    (tmp_path / "places.json").write_text(json.dumps({"_note": "x", "places": [{"name": "A", "bbox": [1, 2, 3, 4]}]}))
    assert tuple(dimensions.read_gazetteer(spark, str(tmp_path / "places.json")).first()) == ("A", 1.0, 2.0, 3.0, 4.0)
    event = {"id": "e", "name": "E", "aliases": ["x", "y"], "bbox": [1, 2, 3, 4], "time_start": "2020-01-01T00:00:00Z", "time_end": "2020-01-02T00:00:00Z",
             "suggested_plans": [{"source": "merra2", "level": "column", "intent": "plume", "variable": "V", "aggregation": "daily"}]}
    (tmp_path / "events.json").write_text(json.dumps({"_note": "x", "events": [event]}, indent=1))
    row = dimensions.read_event_catalog(spark, str(tmp_path / "events.json")).first()
    assert row.aliases == ["x", "y"] and row.time_start == dt.datetime(2020, 1, 1) and row.suggested_plans[0].variable == "V"
    ramps = {"_note": "x", "r": {"stops": [[0, "#00e400"], [12.5, "#ffff00"]], "units": "u", "guideline_24h": 15.0}}
    (tmp_path / "ramps.json").write_text(json.dumps(ramps))
    stops = dimensions.read_colormaps(spark, str(tmp_path / "ramps.json")).orderBy("position").collect()
    assert [tuple(s) for s in stops] == [("r", 0, 0.0, 0, 228, 0, "u"), ("r", 1, 12.5, 255, 255, 0, "u")]
    assert dimensions.colormaps(spark).count() == 32 and dimensions.trigger_phrases(spark).count() == 18
    assert dimensions.intent_defaults(spark).count() == 3 and dimensions.event_catalog(spark).count() == 3
