"""Requests end to end against plain numpy, under every join strategy."""

import datetime as dt

import grids
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.operators import fields, slicing
from cellgrid.plans.grids import GridAnswers, answer_grid_requests
from cellgrid.sources.documents import document_json, explode_grid_documents

TODAY = dt.date(2019, 8, 1)
SCHEMA = "request_id INT, source STRING, variable STRING, bbox STRING, t0 STRING, t1 STRING, agg STRING"
FULL = ("2019-03-11T00:00:00Z", "2019-03-12T23:59:59Z")
GOOD = [
    (1, "merra2", "DUEXTTAU", "-20,-10,40,30", *FULL, "daily"),
    (2, "merra2", " duaod ", "-180,-90,180,90", "2019-03-11T12:00:00Z", "2019-03-12T05:00:00+00:00", "daily"),
    (3, "merra2", "TOTEXTTAU", "170,-20,-170,20", *FULL, "hourly"),
    (4, "merra2", "totaod", "150,-40,-120,20", "2019-03-11T12:00:00Z", "2019-03-12T23:59:59Z", "monthly_mean"),
    (5, "merra2", "TOTEXTTAU", "-180,-90,180,90", "2019-03-11", "2019-03-12", "hourly"),
    (6, "merra2", "DUEXTTAU", "-20,-10,40,30", *FULL, "daily"),
    (7, "merra2", "DUEXTTAU", "180,-20,-150,20", *FULL, "daily"),
    (8, "merra2", "TOTEXTTAU", "5,-20,-5,20", "2019-03-11T02:30:00Z", "2019-03-11T02:30:00Z", "daily"),
]
BAD = [
    (11, "merra2", "DUEXTTAU", "west,south,east,north", *FULL, "daily", "bbox_format"),
    (12, "merra2", "DUEXTTAU", "5,40,15,20", *FULL, "daily", "bbox_order"),
    (13, "merra2", "DUEXTTAU", "0,0,10,10", FULL[1], FULL[0], "daily", "time_order"),
    (14, "merra2", "DUEXTTAU", "0,0,10,10", *FULL, "weekly", "aggregation"),
    (15, "cams", "DUEXTTAU", "0,0,10,10", *FULL, "daily", "source"),
    (16, "merra2", "FOO", "0,0,10,10", *FULL, "daily", "variable"),
    (17, "merra2", "DUEXTTAU", "0,0,10,10", "2019-03-15T00:00:00Z", "2019-03-16T00:00:00Z", "daily", "no_coverage"),
    (18, "merra2", "OCEXTTAU", "0,0,10,10", *FULL, "daily", "variable_absent"),
    (19, "merra2", "DUEXTTAU", "180,-30,180,-10", *FULL, "daily", "no_longitude_cells"),
    (20, "merra2", "DUEXTTAU", "2,14,6,20", *FULL, "daily", "no_grid_cells"),
    (21, "merra2", "DUEXTTAU", "0,0,10,10", "2019-03-11T00:31:00Z", "2019-03-11T01:00:00Z", "daily", "no_time_steps"),
    (22, "merra2", "DUEXTTAU", "0,0,10,10", "2019-07-20", "2019-07-21", "daily", "latency"),
    (23, None, "DUEXTTAU", "0,0,10,10", *FULL, "daily", "source"),
    (24, "merra2", "DUEXTTAU", None, *FULL, "daily", "bbox_format"),
    (25, "merra2", "DUEXTTAU", "0,0,10,10", "yesterday", FULL[1], "daily", "t0"),
    (26, "merra2", "DUEXTTAU", "0,0,200,10", *FULL, "daily", "bbox_longitude"),
    (27, "merra2", "DUEXTTAU", "0,0,10,nan", *FULL, "daily", "bbox_latitude"),
]


@pytest.fixture(scope="module")
def cells(spark):
    return grids.cells(spark).cache()


def ask(spark, rows):
    return spark.createDataFrame([r[:7] for r in rows], SCHEMA)


def parse(text):
    stamp = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return stamp if stamp.tzinfo is None else stamp.astimezone(dt.timezone.utc).replace(tzinfo=None)


STRATEGIES = {
    "broadcast": {}, "shuffled": {"broadcast_rows": 0}, "capped": {"max_nlon": 3, "max_nlat": 2},
    "capped_shuffled": {"max_nlon": 3, "max_nlat": 2, "broadcast_rows": 0},
}


@pytest.mark.parametrize("name", STRATEGIES)
def test_answers_match_numpy(spark, cells, name):
    options = STRATEGIES[name]
    docs = answer_grid_requests(ask(spark, GOOD), cells, grids.manifest(spark), TODAY, **options).collect()
    assert len(docs) == len(GOOD)
    caps = {k: v for k, v in options.items() if k.startswith("max_")}
    for doc in docs:
        row = next(r for r in GOOD if r[0] == doc.request_id)
        variable = "DUEXTTAU" if "du" in row[2].lower() else "TOTEXTTAU"
        box = tuple(float(x) for x in row[3].split(","))
        lats, lons, values, steps = grids.expected(variable, box, parse(row[4]), parse(row[5]), row[6], **caps)
        assert doc.status == 200 and doc.variable == variable and doc.time_steps_used == steps
        assert (doc.ny, doc.nx) == values.shape
        assert np.allclose(doc.lats, lats, atol=1e-4) and np.allclose(doc.lons, lons, atol=1e-4)
        assert np.allclose(np.array(doc["values"], dtype=float), values, atol=1e-4)
        assert doc.downsampled == bool(caps)


def test_first_errors(spark, cells):
    answers = GridAnswers(ask(spark, BAD), cells, grids.manifest(spark), TODAY)
    got = {r.request_id: r for r in answers.statuses().collect()}
    for row in BAD:
        assert got[row[0]].reason == row[7], row
        assert got[row[0]].status == 422 and got[row[0]].message
        unknown = row[7] in ("variable", "variable_absent")
        assert got[row[0]].error_class == ("unknown_variable" if unknown else "bad_request")


def test_identical_requests_are_answered_once(spark, cells):
    answers = GridAnswers(ask(spark, GOOD), cells, grids.manifest(spark), TODAY)
    assert answers.n_requests == len(GOOD) - 1
    owners = {r.request_id: r.answer_id for r in answers.statuses().collect()}
    assert owners[6] == owners[1] == 1


def test_gaps_in_the_index_are_counted(spark, cells):
    rows = [(1, "merra2", "DUEXTTAU", "0,0,10,10", "2019-03-09", "2019-03-12T23:59:59Z", "daily")]
    only_second = grids.manifest(spark, grids.DAYS[1:])
    row = GridAnswers(ask(spark, rows), cells, only_second, TODAY).documents().first()
    assert (row.status, row.granule_days, row.missing_days, row.time_steps_used) == (200, 1, 3, 24)
    assert np.allclose(row["values"][0][0], grids.array("DUEXTTAU")[24:, 7, 23].mean(), atol=1e-4)


def test_missing_cells_are_null(spark, cells):
    holes = cells.withColumn("value", F.when((F.col("lat") == 0) & (F.col("lon") == 4), float("nan")).otherwise(F.col("value")))
    holes = holes.where(~((F.col("lat") == 12) & (F.col("lon") == 12)))
    rows = [(1, "merra2", "DUEXTTAU", "0,0,20,13", *FULL, "daily")]
    doc = GridAnswers(ask(spark, rows), holes, grids.manifest(spark), TODAY).documents()
    values = doc.first()["values"]
    assert values[0][0] is None and values[1][1] is None
    assert sum(v is None for row in values for v in row) == 2
    text = document_json(doc).first().document
    assert "null" in text and "NaN" not in text


def test_documents_round_trip(spark, cells):
    docs = GridAnswers(ask(spark, GOOD[2:3]), cells, grids.manifest(spark), TODAY).documents()
    doc = docs.first()
    flat = explode_grid_documents(docs).orderBy("iy", "ix").collect()
    assert len(flat) == doc.nx * doc.ny
    assert all(r.value == doc["values"][r.iy][r.ix] and r.lat == doc.lats[r.iy] and r.lon == doc.lons[r.ix] for r in flat)
    assert doc.lons == [172.0, 180.0, -180.0, -172.0]


def test_odd_documents_name_the_row(spark):
    schema = "request_id INT, lats ARRAY<DOUBLE>, lons ARRAY<DOUBLE>, values ARRAY<ARRAY<DOUBLE>>"
    docs = spark.createDataFrame([
        (1, [0.0, 1.0], [0.0, 1.0], [[1.0, 2.0]]), (2, [0.0, 1.0], [0.0, 1.0], [[1.0, 2.0], [3.0]]), (3, None, [0.0], [[1.0]]),
    ], schema)
    errors = {r.request_id: r.error for r in explode_grid_documents(docs).collect()}
    assert "1 rows, expected 2" in errors[1] and "row 1 has 1 columns, expected 2" in errors[2] and "needs" in errors[3]


def test_daily_equals_hourly_on_whole_days(spark, cells):
    sliced = slicing.slice_bbox(cells, -20, -10, 40, 30).withColumn("request_id", F.col("variable"))
    both = fields.compare_windows(fields.collapse_time(sliced, "hourly"), fields.collapse_time(sliced, "daily"))
    assert both.agg(F.max(F.abs("difference"))).first()[0] < 1e-9
    with pytest.raises(ValueError):
        fields.collapse_time(sliced, "weekly")


def test_wrap_is_the_union_of_its_halves(spark, cells):
    wrap = slicing.slice_bbox(cells, 150, -40, -120, 20)
    halves = slicing.slice_bbox(cells, 150, -40, 180, 20).unionByName(slicing.slice_bbox(cells, -180, -40, -120, 20))
    assert wrap.drop("seg").exceptAll(halves.drop("seg")).count() == 0
    assert wrap.count() == halves.count()
    assert slicing.slice_bbox(cells, 180, -40, 180, 20).count() == 0
    # the left piece has no width, so only the right one is left
    assert slicing.slice_bbox(cells, 180, -40, -170, 20).select("seg").distinct().collect() == [(1,)]


def test_full_globe_is_coarsened_under_the_cap(spark):
    field = spark.range(361 * 576).select(
        F.lit(1).alias("request_id"), F.lit(0).alias("seg"), (F.floor(F.col("id") / 576) * 0.5 - 90).alias("lat"),
        ((F.col("id") % 576) * 0.625 - 180).alias("lon"), F.lit(0.0).alias("value"),
    )
    coarse = fields.downsample(field)
    assert coarse.count() == 120 * 288
    same = fields.downsample(field.where("lat < -80 AND lon < -170"))
    assert same.select("lat", "lon").exceptAll(field.where("lat < -80 AND lon < -170").select("lat", "lon")).count() == 0


def test_slice_time_is_inclusive_and_utc(spark, cells):
    t0 = dt.datetime(2019, 3, 11, 2, 30, tzinfo=dt.timezone(dt.timedelta(hours=2)))
    got = slicing.slice_time(cells, t0, dt.datetime(2019, 3, 11, 2, 30)).select("time").distinct().count()
    assert got == 3
    whole = slicing.slice_time(cells, dt.datetime(2019, 3, 11), dt.datetime(2019, 3, 12)).select("time").distinct().count()
    assert whole == 24


def test_a_refused_request_takes_no_answer_of_a_like_one(spark):
    cells = spark.sql("SELECT 'DUEXTTAU' AS variable, TIMESTAMP_NTZ '2024-01-03 00:30:00' AS time, 0D AS lat, explode(array(0D, 10D)) AS lon, 1D AS value")
    manifest = spark.sql("SELECT DATE '2024-01-03' AS day, 'a.json' AS ref_name")
    asked = [(1, "merra2"), (2, "cams")]
    rows = [(i, source, "DUEXTTAU", "-5,-5,20,5", "2024-01-03", "2024-01-04", "daily") for i, source in asked]
    requests = spark.createDataFrame(rows, "request_id int, source string, variable string, bbox string, t0 string, t1 string, agg string")
    found = {r.request_id: r for r in GridAnswers(requests, cells, manifest, dt.date(2024, 6, 1)).documents().collect()}
    assert (found[1].status, found[1].nx) == (200, 2)
    assert (found[2].status, found[2].reason, found[2].nx, found[2].granule_days) == (422, "source", None, None)
