"""Join strategies and the shape of physical plans."""

import datetime as dt
import re

import grids
import pytest
from pyspark.sql import functions as F

from cellgrid.operators import joins, slicing
from cellgrid.plans.grids import GridAnswers
from cellgrid.sources import cells as store


def physical(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 5000)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    many = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"), F.col("id").alias("x"))
    few = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 10).alias("y"))
    plain = many.join(few, "k", how)
    salted = joins.salted_join(many, few, ["k"], how, min_rows=100)
    assert salted.exceptAll(plain).count() == 0 and salted.count() == plain.count()
    with pytest.raises(ValueError):
        joins.salted_join(many, few, ["k"], "full")


def test_lookup_join_goes_by_size(spark):
    many, few = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("y"))
    small = joins.lookup_join(many, few, ["k"], max_rows=50)
    large = joins.lookup_join(many, few, ["k"], max_rows=49)
    assert "BroadcastHashJoin" in physical(small)
    assert large.exceptAll(small).count() == 0 and large.count() == 100


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive"))
    store.write_cells(grids.cells(spark), path)
    return path


def requests(spark):
    rows = [(i, "merra2", "DUEXTTAU", box, "2019-03-11T06:00:00Z", "2019-03-12T23:59:59Z", "daily") for i, box in enumerate(["-20,-10,40,30", "170,-20,-170,20"])]
    return spark.createDataFrame(rows, "request_id INT, source STRING, variable STRING, bbox STRING, t0 STRING, t1 STRING, agg STRING")


def answers(spark, archive, **options):
    return GridAnswers(
        requests(spark), store.read_cells(spark, archive), grids.manifest(spark), dt.date(2027, 1, 1),
        axes=store.read_axes(spark, archive), **options,
    )


def test_request_join_has_no_nested_loop_and_prunes_partitions(spark, archive):
    plan = physical(answers(spark, archive).block_cells())
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "value#" in line]
    assert len(scans) == 2  # day sums, and single steps at the ends of windows
    for scan, read in zip(scans, ("", "time:timestamp_ntz,")):
        filters = re.search(r"PartitionFilters: (.*?), PushedFilters", scan).group(1)
        assert "archive" in scan and filters.count("dynamicpruning") >= 2  # variable and day
        assert re.search(r"ReadSchema: struct<([^>]*)>", scan).group(1) == read + "lat:double,lon:double,value:double"
    # the cells themselves are exchanged only after partial aggregation
    assert plan.index("HashAggregate") < plan.index("BroadcastHashJoin")


def test_every_strategy_avoids_nested_loops(spark, archive):
    for options in ({}, {"broadcast_rows": 0}):
        plan = physical(answers(spark, archive, **options).documents())
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_time_mean_needs_two_exchanges(spark, archive):
    plan = physical(answers(spark, archive).block_cells())
    keyed = [line for line in plan.splitlines() if "Exchange hashpartitioning(request_id" in line]
    assert len(keyed) == 2


def test_literal_boxes_reach_the_scan(spark, archive):
    cells = store.read_cells(spark, archive)
    boxed = slicing.slice_time(slicing.slice_bbox(cells, 150, -40, -120, 20, extent=(-180.0, 180.0)), dt.datetime(2019, 3, 11), dt.datetime(2019, 3, 11, 12))
    plan = physical(boxed)
    assert plan.count("FileScan") == 1
    assert "GreaterThanOrEqual(lat,-40.0)" in plan and "Or(" in plan and re.search(r"PartitionFilters: \[[^\]]*day#", plan)
