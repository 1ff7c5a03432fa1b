"""Chunk references through the data source: the same chunks, fewer files and rows."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from cellgrid.sources import chunk_refs, chunk_source

DAYS = [dt.date(2024, 1, d) for d in range(1, 9)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("references"), random.Random(4)
    for day in DAYS:
        refs = {".zgroup": "{}", "lat/0": "base64:AAAA", "DU/.zarray": "{}", "DU/0.0": ["s3://b/f", 1, 2]}
        for variable in ("DU", "BC", "lat"):
            for _ in range(40):
                t, y, x = rng.randrange(24), rng.randrange(4), rng.randrange(4)
                refs[f"{variable}/{t}.{y}.{x}"] = [f"s3://b/{day}", rng.randrange(10**12), rng.randrange(1000)]
        refs["SU/0.0.0"] = [f"s3://b/{day}"]
        (path / f"M.c.{day:%Y%m%d}.json").write_text(json.dumps({"version": 1, "refs": refs}))
    (path / "undated.json").write_text(json.dumps({"refs": {"DU/0.0.0": ["s3://b/u", 0, 9]}}))
    (path / "empty.20240102.json").write_text("{}")
    (path / "_hidden.20240102.json").write_text("no json")
    (path / "year=2024").mkdir()
    (path / "year=2024" / "day=2024-01-09.json").write_text(json.dumps({"refs": {"BC/1.2.3": ["s3://b/n", 5, 6]}}))
    return str(path)


def rows(df):
    return sorted((r.variable, r.ct, r.cy, r.cx, r.url, r.offset, r.length) for r in df.collect())


def test_all_chunks_as_in_the_index(spark, folder):
    got = chunk_source.read_chunks(spark, folder)
    plain = chunk_refs.chunk_index(chunk_refs.chunk_refs(
        spark.read.text([f"{folder}/{n}" for n in ("M.*.json", "undated.json", "empty*.json", "year=2024")], wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")))
    key = lambda r: tuple(x is None or x for x in r) + tuple(map(str, r))
    mine = sorted(((r.variable, r.ct, r.cy, r.cx, r.url, r.offset, r.length) for r in got.collect()), key=key)
    theirs = sorted(((r.variable, r.ct, r.cy, r.cx, r.url, r.offset, r.length) for r in plain.collect()), key=key)
    assert mine == theirs and len(mine) > 500
    days = {r.day for r in got.select("day").distinct().collect()}
    assert days == {*DAYS, dt.date(2024, 1, 9), None}


@pytest.mark.parametrize("condition", [
    "day BETWEEN DATE'2024-01-03' AND DATE'2024-01-04' AND variable = 'DU' AND ct >= 6 AND ct < 12 AND cy IN (1, 2) AND cx > 1",
    "variable IN ('BC', 'XX') AND ct <= 3",
    "day IS NULL", "day IS NOT NULL AND cx = 0", "variable = 'DU' OR ct = 1", "length > 500 AND variable <> 'DU'",
    "path LIKE '%20240105%'", "day = DATE'2031-01-01'", "variable IS NULL", "day <=> DATE'2024-01-02'", "cy IN (1, NULL)",
])
def test_pushed_conditions_change_no_result(spark, folder, condition):
    everything = spark.createDataFrame(chunk_source.read_chunks(spark, folder).collect(), chunk_source.SCHEMA)
    assert rows(chunk_source.read_chunks(spark, folder).where(condition)) == rows(everything.where(condition))


def test_files_out_of_range_are_not_planned(spark, folder):
    every = chunk_source.read_chunks(spark, folder, partition_bytes=1)
    assert every.rdd.getNumPartitions() == 11  # each file; hidden ones are none
    assert every.where("day BETWEEN DATE'2024-01-03' AND DATE'2024-01-05'").rdd.getNumPartitions() == 3
    assert every.where("day >= DATE'2024-01-09'").rdd.getNumPartitions() == 1
    packed = chunk_source.read_chunks(spark, folder)
    assert packed.rdd.getNumPartitions() == 1
    plan = every.where("variable = 'DU' AND length > 3")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "variable#" not in plan.split("Filter")[1].split("\n")[0]  # only the length is left to Spark


def test_requests_meet_the_chunks_they_need(spark, folder):
    rng, asked = random.Random(9), []
    for k in range(30):
        lo = rng.randrange(20), rng.randrange(300), rng.randrange(500)
        asked.append((k, rng.choice(DAYS[:6]), rng.choice(["DU", "BC"]), lo[0], lo[0] + 3, 1, lo[1], lo[1] + 60, 91, lo[2], lo[2] + 75, 144))
    schema = "request_id INT, day DATE, variable STRING, " + ", ".join(f"{a}_{e} INT" for a in "tyx" for e in ("lo", "hi", "len"))
    ranges = spark.createDataFrame(asked + asked[:3], schema)
    near = chunk_source.within(chunk_source.read_chunks(spark, folder, partition_bytes=1), ranges)
    assert near.rdd.getNumPartitions() <= 7
    got = {r.request_id: (r.n_chunks, r.bytes_to_read) for r in chunk_refs.bytes_to_read(chunk_refs.prune_index(near, ranges, "day")).collect()}
    want = {}
    for c in chunk_source.read_chunks(spark, folder).where("day IS NOT NULL").collect():
        for k, day, variable, *spans in asked:
            inside = all(lo // width <= n <= hi // width for n, lo, hi, width in zip((c.ct, c.cy, c.cx), spans[::3], spans[1::3], spans[2::3]))
            if c.day == day and c.variable == variable and inside:
                n, size = want.get(k, (0, 0))
                want[k] = n + 1, size + c.length
    assert got == want and got
    assert chunk_source.within(chunk_source.read_chunks(spark, folder), ranges.where("false")).count() == 0


def test_dates_in_names():
    assert chunk_source.day_of("a/M.c.20240131.json") == dt.date(2024, 1, 31)
    assert chunk_source.day_of("day=2024-02-30/20240201.json") == dt.date(2024, 2, 1)
    assert chunk_source.day_of("x/120240131.json") is None and chunk_source.day_of("") is None
