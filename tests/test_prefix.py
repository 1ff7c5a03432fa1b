"""Means from running sums against means over all steps."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cellgrid.operators import fields, prefix
from cellgrid.operators.slicing import slice_requests

CELLS = "variable string, time timestamp_ntz, lat double, lon double, value double"


def archive(spark, rng, first, days, variables=("A", "B")):
    """Steps at odd hours, with missing values, days without granule, and cells that begin late."""
    rows = []
    for d in range(days):
        day = first + dt.timedelta(days=d)
        if d % 17 == 5:
            continue
        for v in variables:
            for hour in (0, 9, 23):
                for lat, lon in ((0.0, 0.0), (0.0, 10.0), (10.0, 170.0), (10.0, -170.0)):
                    if lon == 10.0 and d < 40 or rng.random() < 0.2:
                        continue
                    value = rng.choice([None, float("nan"), rng.gauss(0, 3), rng.gauss(0, 3), rng.gauss(0, 3)])
                    rows.append((v, dt.datetime(day.year, day.month, day.day, hour, 30), lat, lon, value))
    return spark.createDataFrame(rows, CELLS).repartition(4)


def some_windows(spark, rng, first, days, n):
    rows = []
    for i in range(n):
        start = dt.datetime.combine(first, dt.time()) + dt.timedelta(days=rng.randrange(-20, days + 20), hours=rng.choice([0, 0, 9, 12]))
        end = start + dt.timedelta(days=rng.choice([0, 1, 6, 30, 61, 300]), hours=rng.choice([0, 12, 23]), seconds=rng.choice([0, 3599]))
        if rng.random() < 0.5:
            start = dt.datetime(start.year, start.month, 1)
        if rng.random() < 0.5:
            end = dt.datetime(end.year, end.month, end.day, 23, 59, 59, 999999)
        rows.append((i, rng.choice("ABC"), -5.0, rng.choice([5.0, 15.0]), 100.0, 180.0, -180.0, rng.choice([-100.0, 180.0]), start, max(start, end), rng.choice(["hourly", "daily", "monthly_mean"])))
    return spark.createDataFrame(rows, "request_id long, variable string, s double, n double, l_lo double, l_hi double, r_lo double, r_hi double, start_time timestamp_ntz, end_time timestamp_ntz, agg string")


def plain(windows, cells):
    """The same means over all steps of each window."""
    days = windows.withColumn("day", F.explode(F.sequence(F.to_date("start_time"), F.to_date("end_time"))))
    steps = slice_requests(cells.withColumn("day", F.to_date("time")), days, True)
    out = {}
    for agg in ("hourly", "daily", "monthly_mean"):
        for r in fields.collapse_time(steps.where(F.col("agg") == agg), agg).where("value is not null").collect():
            out[r.request_id, r.seg, r.lat, r.lon] = r.value
    return out


@pytest.mark.parametrize("cuts", [(), (50, 51, 130)])
def test_any_window_is_the_difference_of_two_days(spark, tmp_path, cuts):
    rng = random.Random(3)
    first, days = dt.date(2023, 11, 20), 220
    cells = archive(spark, rng, first, days).cache()
    edges = [0, *cuts, days]
    for a, b in zip(edges, edges[1:]):
        part = cells.where(F.to_date("time").between(first + dt.timedelta(days=a), first + dt.timedelta(days=b - 1)))
        prefix.write_prefix(part, str(tmp_path), first=a == 0)
    windows = some_windows(spark, rng, first, days, 150)
    found = prefix.prefix_fields(windows, prefix.read_prefix(spark, str(tmp_path)), prefix.read_days(spark, str(tmp_path)), cells)
    got = {(r.request_id, r.seg, r.lat, r.lon): r.value for r in found.collect()}
    want = plain(windows, cells)
    assert got.keys() == want.keys() and len(want) > 150
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_history_is_not_rewritten(spark, tmp_path):
    cells = archive(spark, random.Random(1), dt.date(2024, 1, 1), 12)
    path = str(tmp_path)
    prefix.write_prefix(cells.where("time < '2024-01-08'"), path, first=True)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    prefix.write_prefix(cells.where("time >= '2024-01-08'"), path)
    assert before.items() <= {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}.items()
    rows = prefix.read_prefix(spark, path).count()
    with pytest.raises(ValueError):
        prefix.write_prefix(cells.where("time >= '2024-01-11'"), path)
    # an append that broke off before its days were listed is run again, and counts once
    late = archive(spark, random.Random(2), dt.date(2024, 2, 1), 2)
    listed = prefix.read_days(spark, path).collect()
    prefix.write_prefix(late, path)
    added = prefix.read_prefix(spark, path).count() - rows
    spark.createDataFrame(listed, prefix.DAYS_SCHEMA).coalesce(1).write.parquet(f"{path}/days-before")
    (tmp_path / "days").rename(tmp_path / "days-after")
    (tmp_path / "days-before").rename(tmp_path / "days")
    prefix.write_prefix(late, path)
    assert prefix.read_prefix(spark, path).count() == rows + added


@pytest.mark.parametrize("agg, most", [("hourly", 2), ("daily", 2), ("monthly_mean", 6)])
def test_long_windows_read_a_few_days(spark, agg, most):
    """62 and 1,825 days alike take a few rows of running sums per cell."""
    for length in (62, 1825):
        start = dt.datetime(2015, 3, 12, 12)
        rows = [(1, start, start + dt.timedelta(days=length), agg)]
        windows = spark.createDataFrame(rows, "request_id long, start_time timestamp_ntz, end_time timestamp_ntz, agg string")
        row = prefix.window_reads(windows).first()
        assert 0 < len(row.reads) <= most and len(row.edges) == 2
        assert sum(r.sign for r in row.reads) == 0


def test_other_days_are_pruned(spark, tmp_path):
    cells = archive(spark, random.Random(1), dt.date(2024, 1, 1), 40, ("A",))
    path = str(tmp_path)
    prefix.write_prefix(cells, path, first=True)
    rows = some_windows(spark, random.Random(5), dt.date(2024, 1, 2), 20, 3).withColumns({"variable": F.lit("A"), "agg": F.lit("daily")})
    rows.write.parquet(f"{path}/windows")
    windows = spark.read.parquet(f"{path}/windows")
    found = prefix.prefix_fields(windows, prefix.read_prefix(spark, path), prefix.read_days(spark, path), cells)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_many_windows_meet_only_tiles_with_cells(spark, tmp_path, monkeypatch):
    """Beyond the bound a box of the globe is as many rows as tiles hold cells, not 325; the means are the same."""
    rng = random.Random(8)
    cells = archive(spark, rng, dt.date(2024, 1, 1), 50).cache()
    prefix.write_prefix(cells, str(tmp_path), first=True)
    windows = some_windows(spark, rng, dt.date(2024, 1, 1), 50, 40).withColumns({
        "s": F.lit(-90.0), "n": F.lit(90.0), "l_lo": F.lit(-180.0), "l_hi": F.lit(180.0), **{c: F.lit(None).cast("double") for c in ("r_lo", "r_hi")}})
    monkeypatch.setattr(prefix, "BROADCAST_SPANS", 0)
    met, join = [], prefix.salted_join
    monkeypatch.setattr(prefix, "salted_join", lambda many, *rest, **kw: met.append(many) or join(many, *rest, **kw))
    found = prefix.prefix_fields(windows, prefix.read_prefix(spark, str(tmp_path)), prefix.read_days(spark, str(tmp_path)), cells)
    got = {(r.request_id, r.seg, r.lat, r.lon): r.value for r in found.collect()}
    want = plain(windows, cells)
    assert got.keys() == want.keys() and want and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert met[0].groupBy("request_id", "day", "sums", "slot", "sign").count().agg(F.max("count")).first()[0] <= 8
