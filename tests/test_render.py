"""Ranges, extents, pixels."""

import pytest
from pyspark.sql import functions as F

from cellgrid.operators import render

DOC = ("request_id INT, variable STRING, units STRING, lats ARRAY<DOUBLE>, lons ARRAY<DOUBLE>, values ARRAY<ARRAY<DOUBLE>>, "
       "nx INT, ny INT, time_start STRING, time_end STRING, aggregation STRING")


def doc(request_id, values, variable="DUEXTTAU", lats=None, lons=None):
    ny, nx = len(values), len(values[0])
    lats = lats or [float(i) for i in range(ny)]
    lons = lons or [float(i) for i in range(nx)]
    return (request_id, variable, "dimensionless", lats, lons, values, nx, ny, "2026-09-01T00:00:00Z", "2026-09-02T00:00:00Z", "daily")


RAMP = [i / 100 for i in range(101)]
CASES = {
    1: ([RAMP], (0.02, 0.98, False)),
    2: ([RAMP[:-1] + [50.0]], (0.02, 0.98, False)),
    3: ([[2.0, 2.0], [2.0, None]], (1.98, 2.02, False)),
    4: ([[0.0, 0.0]], (-1e-6, 1e-6, False)),
    5: ([[None, float("nan")], [float("inf"), None]], (0.0, 1.0, True)),
    6: ([[7.0]], (6.93, 7.07, False)),
}


def test_ranges_by_row_and_by_group(spark):
    docs = spark.createDataFrame([doc(i, v) for i, (v, _) in CASES.items()], DOC)
    by_row = {r.request_id: r for r in render.with_document_range(docs).collect()}
    cells = docs.select("request_id", F.explode(F.flatten("values")).alias("value"))
    by_group = {r.request_id: r for r in render.normalize_range(cells).collect()}
    for i, (_, (low, high, empty)) in CASES.items():
        for got in (by_row[i], by_group[i]):
            assert got.vmin == pytest.approx(low, abs=1e-9) and got.vmax == pytest.approx(high, abs=1e-9), i
            assert got.empty is empty and got.vmid == pytest.approx((got.vmin + got.vmax) / 2)


def test_null_as_zero(spark):
    cells = spark.createDataFrame([(1, None), (1, 10.0)], "request_id INT, value DOUBLE")
    assert render.normalize_range(cells, null_as_zero=True).first().vmin == pytest.approx(0.2)
    assert render.normalize_range(cells).first().vmin == pytest.approx(9.9)


def test_pixels(spark):
    docs = spark.createDataFrame([doc(1, [[0.0, None, 1.0], [0.5, float("nan"), 0.25]])], DOC)
    pixels = {(p.y, p.x): tuple(p)[3:] for p in render.colorize_grid(docs).collect()}
    assert len(pixels) == 6
    assert pixels[(1, 1)] == (0, 0, 0, 0) and pixels[(0, 1)] == (0, 0, 0, 0)  # missing is transparent
    assert pixels[(1, 0)] == (255, 255, 204, 235)  # the south row is the last one
    assert pixels[(1, 2)] == (128, 0, 38, 235)


def test_unwrap_and_extent(spark):
    axes = [("lon", i, float(x)) for i, x in enumerate([170, 175, -175, -170])] + [("lat", i, float(y)) for i, y in enumerate([-10, 0, 10])]
    rows = spark.createDataFrame([(1, *a) for a in axes], "request_id INT, axis STRING, position INT, coord DOUBLE")
    lons = render.unwrap_lons(rows.where("axis = 'lon'").withColumnRenamed("coord", "lon")).orderBy("position")
    assert [r.unwrapped for r in lons.collect()] == [170, 175, 185, 190]
    extent = render.grid_extent(rows)
    assert tuple(extent.first()) == (1, 170.0, -10.0, 190.0, 10.0)
    corners = [tuple(r)[2:] for r in render.grid_corners(extent).orderBy("corner").collect()]
    assert corners == [(170.0, 10.0), (190.0, 10.0), (190.0, -10.0), (170.0, -10.0)]


def test_legend(spark):
    row = render.legend_for_grid(spark.createDataFrame([doc(1, [RAMP])], DOC)).first()
    assert (row.title, row.tick_min, row.tick_mid, row.tick_max) == ("Dust AOD", "0.02", "0.5", "0.98")
    assert row.meta == "dimensionless · 2026-09-01 → 2026-09-02 · daily"
