"""Block means from running sums against direct ones, for several block sizes and one stored table."""

import pytest
from pyspark.sql import functions as F

from cellgrid.operators.area import block_means, summed_area
from cellgrid.operators.fields import downsample, field_frames


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Three fields: one whole, one with holes that crosses 180, one of a single cell."""
    folder = str(tmp_path_factory.mktemp("area"))
    lats = spark.range(23).select((F.col("id") * 2.0 - 20).alias("lat"), F.col("id").alias("iy"))
    grid = lats.withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(30))))
    whole = grid.selectExpr("1L AS request_id", "0 AS seg", "lat", "ix * 3.0D AS lon", "sin(iy * 31 + ix) AS value")
    holes = grid.selectExpr("2L AS request_id", "IF(ix > 15, 1, 0) AS seg", "lat", "IF(ix > 15, ix - 196.0D, 165.0D + ix) AS lon",
                            "CASE WHEN (iy * 7 + ix) % 5 < 3 AND iy NOT BETWEEN 4 AND 9 THEN iy * 0.1 + ix END AS value")
    one = spark.sql("SELECT 3L AS request_id, 0 AS seg, 1.0D AS lat, 2.0D AS lon, 5.0D AS value")
    whole.unionByName(holes.where("value IS NOT NULL OR ix % 2 = 0")).unionByName(one).write.parquet(f"{folder}/field")
    field = spark.read.parquet(f"{folder}/field")
    summed_area(field).write.parquet(f"{folder}/areas")
    field_frames(field).write.parquet(f"{folder}/frames")
    return field, spark.read.parquet(f"{folder}/areas"), spark.read.parquet(f"{folder}/frames")


@pytest.mark.parametrize("cap", [(100, 100), (10, 8), (7, 23), (1, 1)])
def test_equal_to_direct_block_means(stored, cap):
    field, areas, frames = stored
    key = lambda r: (r.request_id, r.by, r.bx)
    want = {key(r): r for r in downsample(field, *cap).collect()}
    got = {key(r): r for r in block_means(areas, frames, *cap).collect()}
    assert set(got) == set(want) and len(want) >= 3
    for k, r in got.items():
        assert (r.value is None) == (want[k].value is None)
        assert (r.lat, r.lon, r.value or 0.0) == pytest.approx((want[k].lat, want[k].lon, want[k].value or 0.0), abs=1e-9)


def test_last_place_holds_the_whole_field(stored):
    field, areas, _ = stored
    ends = areas.groupBy("request_id").agg(F.max_by("total", F.struct("iy", "ix")).alias("t"), F.max("held").alias("n"))
    want = field.groupBy("request_id").agg(F.sum("value").alias("t"), F.count("value").alias("n"))
    a, b = ({r.request_id: r for r in x.collect()} for x in (ends, want))
    assert {k: r.n for k, r in a.items()} == {k: r.n for k, r in b.items()}
    assert all(a[k].t == pytest.approx(b[k].t, abs=1e-9) for k in b)


def test_nothing(stored):
    field = stored[0].limit(0)
    assert summed_area(field).count() == 0
