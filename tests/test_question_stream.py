"""The question cache over micro-batches."""

import datetime as dt
import random

import pytest

from cellgrid.operators import traffic
from cellgrid.streaming import keyed_limiter, question_stream

START = dt.datetime(2024, 1, 1)
SCHEMA = "question_id long, ts timestamp, text string, scope string, ok boolean"


def run(spark, folder, batches, **options):
    for rows in batches:
        at = [(i, START + dt.timedelta(seconds=s), text, "all", ok) for i, s, text, ok in rows]
        spark.createDataFrame(at, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, keyed_limiter.ROCKSDB)
    try:
        question_stream.cached_questions(stream, **options).writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return {r.question_id: r.hit for r in spark.read.parquet(f"{folder}/out").collect()}


@pytest.fixture(scope="module")
def batches():
    """Batches in time order, rows within one not; equal times, failures, nulls and a key that never succeeds."""
    rng, made = random.Random(3), 0
    parts = []
    for part in range(4):
        own = []
        for _ in range(80):
            text = rng.choice(["dust", "Dust?", "smoke", "never", None, f"rare {rng.randrange(30)}"])
            own.append((made, part * 100 + rng.randrange(0, 99, 3), text, False if text == "never" else rng.choice([True, False, None])))
            made += 1
        rng.shuffle(own)
        parts.append(own)
    return parts


def test_decisions_as_in_the_batch(spark, tmp_path, batches):
    got = run(spark, tmp_path, batches)
    everything = spark.read.schema(SCHEMA).parquet(str(tmp_path / "log"))
    assert got == {r.question_id: r.hit for r in traffic.question_cache(everything).collect()}
    first, want = {}, {}
    for s, i, text, ok in sorted((s, i, t, ok) for part in batches for i, s, t, ok in part if t is not None):
        key = text.lower().strip("?")
        want[i] = key in first
        if ok:
            first.setdefault(key, i)
    assert {i: got[i] for i in want} == want and set(want.values()) == {True, False}


def test_a_key_is_forgotten_after_its_time(spark, tmp_path):
    other = [(10 + k, 400 + k * 300, f"other {k}", True) for k in range(3)]
    got = run(
        spark, tmp_path, [[(0, 0, "dust", True), (1, 5, "dust", False)], [(2, 50, "dust", False)], other, [(20, 1200, "x", True)], [(3, 1300, "dust", False)]],
        keep="100 seconds", lateness="1 second")
    assert (got[0], got[1], got[2]) == (False, True, True)
    assert got[3] is False  # the success of row 0 ended 100 seconds after row 2


def test_late_rows_are_decided_by_what_is_known(spark, tmp_path):
    got = run(
        spark, tmp_path, [[(0, 1000, "dust", True)], [(1, 2000, "dust", False)], [(2, 10, "dust", True), (3, 20, "dust", False), (4, 2100, "dust", False)]],
        keep="1 day", lateness="1 second")
    assert got == {0: False, 1: True, 2: False, 3: True, 4: True}
