"""Limiter, rates and question cache against plain loops."""

import collections
import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellgrid.operators import joins, traffic
from cellgrid.session import work_folder
from cellgrid.streaming import limiter

START = dt.datetime(2024, 1, 1)


def loop(rows, limit, window_s):
    """What the limiter should decide, request by request."""
    out, kept = {}, collections.defaultdict(list)
    window = dt.timedelta(seconds=window_s)
    for event_id, ip, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        kept[ip] = [t for t in kept[ip] if t > ts - window]
        if len(kept[ip]) < limit:
            kept[ip].append(ts)
            out[event_id] = (True, 0)
        else:
            left = (kept[ip][0] + window - ts) / dt.timedelta(seconds=1)
            out[event_id] = (False, max(1, -int(-left // 1)))
    return out


def make_log(seed, n=4000):
    """Clients of every temper: steady, bursty, idle, hammering, on exact window edges."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        temper = rng.choice(["steady", "burst", "idle", "hammer", "edge"])
        if temper == "steady":
            at = rng.uniform(0, 40_000)
        elif temper == "burst":
            at = rng.randrange(12) * 3000 + rng.expovariate(1 / 20)
        elif temper == "idle":
            at = rng.uniform(0, 4_000_000)
        elif temper == "hammer":
            at = rng.uniform(0, 3000)
        else:
            at = rng.randrange(400) * 15
        rows.append((i, f"{temper}-{rng.randrange(2)}", START + dt.timedelta(microseconds=round(at * 1e6))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id BIGINT, ip STRING, ts TIMESTAMP_NTZ")


@pytest.mark.parametrize("seed, limit, window_s", [(1, 3, 60.0), (2, 1, 60.0), (3, 30, 60.0), (4, 2, 0.05), (5, 5, 600.0)])
def test_batch_limiter_matches_loop(spark, seed, limit, window_s):
    rows = make_log(seed)
    got = {r.event_id: (r.allowed, r.retry_after) for r in limiter.rate_limit(frame(spark, rows), limit, window_s).collect()}
    assert got == loop(rows, limit, window_s)


def test_calm_rows_never_reach_python(spark):
    rows = make_log(6)
    marked = limiter.busy_runs(frame(spark, rows).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), 30, 60_000_000)
    runs = marked.groupBy("ip").agg(F.count_if(F.col("run").isNull()).alias("calm"), F.countDistinct("run").alias("runs")).collect()
    by_ip = {r.ip: r for r in runs}
    assert by_ip["idle-0"].runs == 0 and by_ip["idle-0"].calm > 0
    assert by_ip["burst-0"].runs > 5  # one client's bursts are separate groups


def test_limit_must_be_positive(spark):
    with pytest.raises(ValueError):
        limiter.rate_limit(frame(spark, []), 0)


def test_expiry_is_exclusive_at_one_window(spark):
    rows = [(0, "a", START), (1, "a", START + dt.timedelta(seconds=59.999999)), (2, "a", START + dt.timedelta(seconds=60))]
    got = {r.event_id: (r.allowed, r.retry_after) for r in limiter.rate_limit(frame(spark, rows), 1, 60.0).collect()}
    assert got == {0: (True, 0), 1: (False, 1), 2: (True, 0)}


def test_stream_over_several_files_matches_batch(spark):
    rows = sorted(make_log(7, 1500), key=lambda r: r[2])
    folder = work_folder(spark, "stream-test")
    for i in range(3):  # in time order, a file per micro-batch
        part = rows[i * 500:(i + 1) * 500]
        frame(spark, part).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{folder}/in/{i}")
    source = (
        spark.readStream.schema("event_id BIGINT, ip STRING, ts TIMESTAMP").option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    )
    run = (
        limiter.rate_limit_stream(source, 3, 60.0).writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    got = {r.event_id: (r.allowed, r.retry_after) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == loop(rows, 3, 60.0)


def test_late_stream_rows_stay_with_a_reason(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    files = [  # the third file holds rows within and beyond 10 seconds of the newest before, and one of a new client
        [(1, "a", at(0)), (2, "a", at(1)), (3, "b", at(100))],
        [(4, "b", at(101)), (5, "a", at(120))],
        [(6, "a", at(2)), (7, "b", at(115)), (8, "c", at(3)), (9, "a", at(121)), (10, "a", at(122))],
        [(11, "b", at(200)), (15, "a", at(50))],
        [(12, "b", at(150)), (13, "b", at(201)), (14, "b", at(195))],
    ]
    folder = work_folder(spark, "late-test")
    for i, part in enumerate(files):
        frame(spark, part).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{folder}/in/{i}")
    source = (
        spark.readStream.schema("event_id BIGINT, ip STRING, ts TIMESTAMP").option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    )
    run = (
        limiter.rate_limit_stream(source, 2, 60.0).writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    got = {r.event_id: (r.allowed, r.retry_after, r.reason) for r in spark.read.parquet(f"{folder}/out").collect()}
    late = {6, 8, 12, 15}
    decided = loop([r for part in files for r in part if r[0] not in late], 2, 60.0)
    assert got == {k: (None, None, "late") if k in late else (*decided[k], None) for k in range(1, 16)}


def test_rates(spark):
    rows = make_log(8, 2000)
    got = {r.event_id: r.requests for r in traffic.request_rate(frame(spark, rows), 60.0).collect()}
    window = dt.timedelta(seconds=60)
    by_ip = collections.defaultdict(list)
    for _, ip, ts in rows:
        by_ip[ip].append(ts)
    assert got == {i: sum(ts - window < t <= ts for t in by_ip[ip]) for i, ip, ts in rows}


def test_question_cache(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [
        (1, at(1), "d|", False, "Dust?"), (2, at(2), "d|", True, "dust"), (3, at(3), "d|", True, " DUST! "),
        (4, at(4), "e|", True, "dust"), (5, at(4), "e|", False, "dust"), (6, at(0), "d|", True, "smoke"),
    ]
    asked = spark.createDataFrame(rows, "question_id BIGINT, ts TIMESTAMP_NTZ, scope STRING, ok BOOLEAN, text STRING")
    cached = traffic.question_cache(asked)
    assert {r.question_id: r.hit for r in cached.collect()} == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False}
    assert tuple(traffic.cache_stats(cached).first()) == (2, 4, 3)


def test_question_cache_beyond_the_broadcast_bound(spark, monkeypatch):
    n = 3000
    asked = spark.range(n).select(
        F.col("id").alias("question_id"), F.timestamp_add("SECOND", (F.col("id") * 7919 % n).cast("int"), F.lit(START)).cast("timestamp_ntz").alias("ts"),
        F.lit("d|").alias("scope"), (F.col("id") % 5 != 0).alias("ok"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("q"), (F.col("id") % 40).cast("string"))).alias("text"),
    )
    few = {r.question_id: r.hit for r in traffic.question_cache(asked).collect()}
    monkeypatch.setattr(traffic, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(traffic, "most_frequent", lambda counts, keys: joins.most_frequent(counts, keys, min_rows=500))
    many = {r.question_id: r.hit for r in traffic.question_cache(asked).collect()}
    assert many == few and len(many) == n and any(few.values())


@given(st.lists(st.integers(0, 400), max_size=60), st.integers(1, 4), st.lists(st.integers(1, 59), max_size=3))
def test_decisions_do_not_depend_on_how_rows_are_batched(times, limit, cuts):
    times = np.sort(np.array(times, dtype=np.int64)) * 1_000_000
    whole = limiter.decide(times, collections.deque(), limit, 60_000_000)
    ring, parts = collections.deque(), []
    for piece in np.split(times, sorted(c for c in set(cuts) if c < len(times))):
        parts.append(limiter.decide(piece, ring, limit, 60_000_000))
        assert len(ring) <= limit
    assert np.array_equal(whole[0], np.concatenate([p[0] for p in parts]))
    assert np.array_equal(whole[1], np.concatenate([p[1] for p in parts]))
    expected = loop([(i, "a", START + dt.timedelta(microseconds=int(t))) for i, t in enumerate(times)], limit, 60.0)
    assert [(bool(a), int(w)) for a, w in zip(*whole)] == [expected[i] for i in range(len(times))]


def test_late_rows_of_a_client_keep_the_ring_in_order():
    from collections import deque

    ring, window = deque(), 60_000_000
    allowed = [bool(limiter.decide(np.array([s * 1_000_000]), ring, 2, window)[0][0]) for s in (1000, 995, 1056)]
    assert allowed == [True, True, True] and list(ring) == [1_000_000_000, 1_056_000_000]


def test_rates_of_a_hammering_client_match_counting(spark):
    rng = random.Random(11)
    rows = [(i, "one", START + dt.timedelta(seconds=rng.randrange(3000) / 4)) for i in range(3000)]
    got = {r.event_id: r.requests for r in traffic.request_rate(frame(spark, rows), 60.0).collect()}
    times = np.sort(np.array([(t - START).total_seconds() for _, _, t in rows]))
    for i, _, t in rows:
        now = (t - START).total_seconds()
        assert got[i] == np.searchsorted(times, now, "right") - np.searchsorted(times, now - 60, "right")
