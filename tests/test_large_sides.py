"""Sides that ``explode`` makes large: Spark takes them to be small, and they must not pass through the driver."""

import random

import pytest
from pyspark.sql import functions as F

from cellgrid.operators import cover, joins
from cellgrid.sources import chunk_refs, zones
from cellgrid.streaming import limiter
from test_cover import SPANS, some_spans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_joins_sort_both_sides(spark, how):
    many = spark.range(5).select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k"), "id")
    few = spark.range(50).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("v"))
    met = joins.salted_join(many, few, ["k"], how, min_rows=2)
    assert "SortMergeJoin" in plan_of(met) and plan_of(met).count("BroadcastHashJoin") == 2  # the hot keys
    assert met.count() == (250 if how == "inner" else 500)


def test_tiles_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(cover, "row_bound", lambda df: joins.row_bound(df, 0))
    spans = some_spans(spark, random.Random(5), 5)
    cells = spans.select("variable", "day", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.col("start_time").alias("time"))
    assert "SortMergeJoin" in plan_of(cover.tile_pairs(cells, spans))


def test_spans_that_choose_files_are_not_broadcast(spark):
    spans = some_spans(spark, random.Random(6), 5)
    stored = spark.createDataFrame([], zones.ZONE_SCHEMA)
    assert "Broadcast" not in plan_of(zones.zones_met(stored, spans))


RANGES = "request_id INT, path STRING, variable STRING, " + ", ".join(f"{a}_{e} INT" for a in "tyx" for e in ("lo", "hi", "len"))


def test_a_range_is_one_row_until_it_meets_its_chunks(spark):
    """Overlapping, repeated, reversed and incomplete ranges; an index that names a chunk twice."""
    rng, asked = random.Random(7), []
    for k in range(60):
        lo = rng.randrange(-3, 20), rng.randrange(300), rng.randrange(500)
        asked.append((k % 25, rng.choice(["a", "b"]), rng.choice("DE"), lo[0], lo[0] + rng.randrange(-4, 9), 1, lo[1], lo[1] + 60, 91, lo[2], lo[2] + 75, 144))
    asked += asked[:5] + [(90, "a", "D", None, 3, 1, 0, 9, 91, 0, 9, 144), (91, "b", "E", 0, 3, 1, 0, 9, None, 0, 9, 144)]
    chunks = [(p, v, t, y, x, 10) for p in "ab" for v in "DE" for t in range(24) for y in range(4) for x in range(4) if rng.random() < 0.8]
    chunks += chunks[:9]
    index = spark.createDataFrame(chunks, "path STRING, variable STRING, ct INT, cy INT, cx INT, length INT")
    ranges = spark.createDataFrame(asked, RANGES)
    met = chunk_refs.prune_index(index, ranges)
    want = []
    for path, variable, *at, length in chunks:
        found = set()
        for k, p, v, *ends in asked:
            if (p, v) == (path, variable) and None not in ends:
                sides = [sorted((ends[i] // ends[i + 2], ends[i + 1] // ends[i + 2])) for i in (0, 3, 6)]
                if all(lo <= n <= hi for n, (lo, hi) in zip(at, sides)):
                    found.add(k)
        want += [(path, variable, *at, k, length) for k in found]
    assert sorted(map(tuple, met.collect())) == sorted(want) and want
    assert "SortMergeJoin" in plan_of(met)


def test_no_frame_of_the_limiter_ends_at_the_last_row(spark):
    """Such a frame is added up anew at each row, so that a busy stretch costs the square of its rows."""
    log = spark.createDataFrame([(1, "a", 5)], "event_id BIGINT, ip STRING, us BIGINT")
    assert "unboundedfollowing" not in plan_of(limiter.busy_runs(log, 3, 1_000_000)).lower()


def test_names_of_files_are_taken_once_a_file(spark, tmp_path):
    """Rows of a file are counted by its whole path; a pattern matched on every row was most of the writing."""
    cells = spark.range(50).selectExpr(
        "'A' AS variable", "TIMESTAMP_NTZ'2024-01-02 00:30:00' AS time", "CAST(id AS DOUBLE) AS lat", "CAST(id AS DOUBLE) AS lon", "1.0D AS value")
    zones.write_zoned(cells, str(tmp_path / "z"), rows_per_file=20)
    batch = next(p.name for p in (tmp_path / "z" / "cells").iterdir() if p.name.startswith("batch="))
    found = zones._spans(spark, str(tmp_path / "z" / "cells" / batch), batch.removeprefix("batch="))
    per_row = plan_of(found).split("partial_count(1)")[1]
    assert "file_path" in per_row and "regexp" not in per_row and "concat" not in per_row and "substring" not in per_row
    files = {str(p.relative_to(tmp_path / "z" / "cells")) for p in (tmp_path / "z" / "cells").rglob("*.parquet")}
    assert {r.file for r in found.collect()} == files and sum(r.n_rows for r in found.collect()) == 50
