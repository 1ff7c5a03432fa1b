"""Boxes of all sizes: the same cells as one comparison each, and few pairs beyond."""

import random

import pytest
from pyspark.sql import functions as F

from cellgrid.operators import cover, joins, slicing

SPANS = "request_id long, variable string, s double, n double, l_lo double, l_hi double, r_lo double, r_hi double"


def some_spans(spark, rng, n):
    rows = []
    for i in range(n):
        s, w = rng.randrange(-90, 88), rng.randrange(-180, 178)
        high, wide = rng.choice([(1, 1), (2, 2), (1, 300), (170, 2), (40, 60)])
        box = (float(s), float(min(90, s + high)), float(w), float(min(180, w + wide)), None, None)
        box = rng.choice([box, box, (-90.0, 90.0, -180.0, 180.0, None, None), (-5.0, 5.0, 170.0, 180.0, -180.0, -179.0), (3.0, 3.0, 7.0, 8.0, None, None), (*box[:2], None, None, None, None)])
        rows.append((i, rng.choice("AB"), *box))
    return spark.createDataFrame(rows, SPANS).withColumns({
        "day": F.lit("2024-01-02").cast("date"), "start_time": F.lit("2024-01-02").cast("timestamp_ntz"), "end_time": F.lit("2024-01-03").cast("timestamp_ntz")})


@pytest.fixture(scope="module")
def cells(spark):
    """A dense grid of one degree, with both meridians and both poles."""
    lats = spark.range(181).select((F.col("id") - 90.0).alias("lat"))
    grid = lats.withColumn("variable", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C")))).withColumn("x", F.explode(F.sequence(F.lit(-180), F.lit(180))))
    return grid.select(
        "variable", "lat", F.col("x").cast("double").alias("lon"),
        F.lit("2024-01-02 12:30:00").cast("timestamp_ntz").alias("time"), F.lit("2024-01-02").cast("date").alias("day"), F.lit(1.0).alias("value")).cache()


@pytest.mark.parametrize("bound", [500_000, 0])
def test_same_cells_as_one_tile_size(spark, cells, bound, monkeypatch):
    monkeypatch.setattr(cover, "row_bound", lambda df: joins.row_bound(df, bound))
    spans = some_spans(spark, random.Random(1), 60)
    columns = ["request_id", "variable", "seg", "lat", "lon"]
    got = cover.slice_covered(cells, spans).groupBy(*columns).count()
    want = slicing.slice_requests(cells, spans, True).groupBy(*columns).count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and want.count() > 100_000


def test_join_rows_stay_within_twice_the_result(spark, cells):
    """Globe-wide boxes beside many of a few degrees: one tile size fails at one of them."""
    rng = random.Random(2)
    rows = [(i, "A", -90.0, 90.0, -180.0, 180.0, None, None) for i in range(3)]
    rows += [(10 + i, "A", s, s + 12.0, w, w + 12.0, None, None) for i in range(300) for s, w in [(float(rng.randrange(-90, 78)), float(rng.randrange(-180, 168)))]]
    spans = spark.createDataFrame(rows, SPANS).withColumns({
        "day": F.lit("2024-01-02").cast("date"), "start_time": F.lit("2024-01-02").cast("timestamp_ntz"), "end_time": F.lit("2024-01-03").cast("timestamp_ntz")})
    pairs, kept = cover.tile_pairs(cells, spans).count(), cover.slice_covered(cells, spans).count()
    assert kept <= pairs <= 2 * kept
    assert cover.covered(spans).groupBy("request_id", "seg").count().agg(F.max("count")).first()[0] <= (2 * cover.PER_SIDE + 1) ** 2


def test_many_spans_move_cells_once(spark, cells, monkeypatch):
    """Beyond the bound, cells go into the join once, not once a level, and a small box in a few rows."""
    monkeypatch.setattr(cover, "row_bound", lambda df: joins.row_bound(df, 0))
    rng, moved = random.Random(8), []

    def counted(many, few, *args, **kwargs):
        moved.append((many.count(), few))
        return joins.salted_join(many, few, *args, **kwargs)

    monkeypatch.setattr(cover, "salted_join", counted)
    rows = [(i, "A", s, s + 1 + i % 7, w, w + 1 + i % 9, None, None) for i in range(300) for s, w in [(float(rng.randrange(-90, 82)), float(rng.randrange(-180, 170)))]]
    spans = spark.createDataFrame([*rows, (300, "A", -90.0, 90.0, -180.0, 180.0, None, None)], SPANS).withColumns({
        "day": F.lit("2024-01-02").cast("date"), "start_time": F.lit("2024-01-02").cast("timestamp_ntz"), "end_time": F.lit("2024-01-03").cast("timestamp_ntz")})
    pairs, kept = cover.tile_pairs(cells, spans).count(), cover.slice_covered(cells, spans).count()
    n_spans, few = moved[0]
    assert n_spans <= 3 * len(rows) and few.count() <= 3 * 181 * 361 / 8
    assert kept <= pairs <= kept + 6 * cover.PACK_CELLS * len(rows)  # of a few packs around a small box


def test_packs_hold_each_cell_once(spark, cells):
    """Cells off the globe and repeated ones included; those without a place or time are in no box."""
    odd = spark.sql("""SELECT * FROM VALUES ('A', 95.0D, -200.0D, TIMESTAMP_NTZ'2024-01-02 23:30:00', 2.0D), ('A', 0.0D, 180.0D, TIMESTAMP_NTZ'2024-01-02 23:30:00', CAST(NULL AS DOUBLE)),
        ('A', CAST(NULL AS DOUBLE), 1.0D, TIMESTAMP_NTZ'2024-01-02 00:30:00', 1.0D), ('A', 1.0D, 1.0D, CAST(NULL AS TIMESTAMP_NTZ), 1.0D) AS t(variable, lat, lon, time, value)""")
    odd = odd.withColumn("day", F.lit("2024-01-02").cast("date")).select(*cells.columns)
    packed = cover.packs(cells.unionByName(odd).unionByName(odd)).cache()
    held = packed.select("variable", "day", F.inline("cells")).select(*cells.columns)
    want = cells.unionByName(odd.limit(2)).unionByName(odd.limit(2))
    assert held.exceptAll(want).isEmpty() and want.exceptAll(held).isEmpty()
    assert packed.agg(F.max(F.size("cells"))).first()[0] == cover.PACK_CELLS
    ends = packed.select("*", *[F.expr(f"array_{f}(transform(cells, c -> c.{c}))").alias(f"{c}_{f}") for c in ("lat", "lon", "time") for f in ("min", "max")])
    assert ends.where("lat_min <> lat_lo OR lat_max <> lat_hi OR lon_min <> lon_lo OR lon_max <> lon_hi OR time_min <> time_lo OR time_max <> time_hi").isEmpty()


def test_packed_boxes_off_the_globe_and_without_sides(spark, cells, monkeypatch):
    """Sides beyond the globe, reversed and unknown ones: as compared one by one."""
    monkeypatch.setattr(cover, "row_bound", lambda df: joins.row_bound(df, 0))
    boxes = [(-400.0, 400.0, -400.0, 400.0), (80.0, 100.0, -200.0, -170.0), (5.0, 4.0, 0.0, 1.0), (4.0, 5.0, 1.0, 0.0), (None, 5.0, 0.0, 1.0), (4.0, 5.0, 0.0, None), (22.5, 22.5, 45.0, 45.0), (0.0, 0.0, 0.0, 0.0)]
    spans = spark.createDataFrame([(i, "A", *box, None, None) for i, box in enumerate(boxes)], SPANS).withColumns({
        "day": F.lit("2024-01-02").cast("date"), "start_time": F.lit("2024-01-02 12:30:00").cast("timestamp_ntz"), "end_time": F.lit("2024-01-02 12:30:00").cast("timestamp_ntz")})
    columns = ["request_id", "seg", "lat", "lon"]
    got = cover.slice_covered(cells, spans).select(columns)
    want = cells.join(F.broadcast(spans), ["variable", "day"]).where("lat BETWEEN s AND n AND lon BETWEEN l_lo AND l_hi AND time BETWEEN start_time AND end_time").select("request_id", F.lit(0).alias("seg"), "lat", "lon")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and {r[0] for r in got.select("request_id").distinct().collect()} == {0, 1, 7}


def test_packs_meet_in_all_partitions(spark, cells, monkeypatch):
    """Not in as few as their size would be left: each row of the sides makes many."""
    monkeypatch.setattr(cover, "row_bound", lambda df: joins.row_bound(df, 0))
    spans = some_spans(spark, random.Random(9), 10).withColumn("day", F.expr("date_add(day, CAST(request_id % 2 AS INT))"))  # a constant is no key
    met = cover.slice_covered(cells, spans)
    assert met._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    assert met.select(F.spark_partition_id()).distinct().count() > 4
