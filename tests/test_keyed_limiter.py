"""Keyed state with timers: the same decisions as the batch, and state that ends by itself."""

import datetime as dt
import random
from collections import deque

import pytest

from cellgrid.streaming import keyed_limiter, limiter

SECOND = 1_000_000
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def stretches():
    """Files in time order; rows within one are not, clients pause, and some rows come far too late."""
    rng = random.Random(8)
    rows, made = [], 0
    for part in range(5):
        own = []
        for _ in range(120):
            client = rng.choice(["a", "a", "b", "c" if part in (0, 4) else "d", None])
            own.append((made, client, part * 400 + rng.randrange(0, 380)))
            made += 1
        if part == 3:
            own += [(made + k, "a", 10 + k) for k in range(3)]
            made += 3
        rng.shuffle(own)
        rows.append(own)
    return rows


def run(spark, folder, stretches, limit, window_s):
    schema = "event_id long, ip string, ts timestamp"
    for own in stretches:
        at = [(i, c, START + dt.timedelta(seconds=s)) for i, c, s in own]
        spark.createDataFrame(at, schema).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, keyed_limiter.ROCKSDB)
    try:
        query = keyed_limiter.limited(stream, limit, window_s).writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{folder}/out")


def plain(stretches, limit, window_s, lateness=10):
    """Decisions, late ids, and clients opened, closed and live by watermark."""
    rings, ends, newest, mark = {}, {}, 0, 0
    decided, late, steps = {}, set(), {}
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    for own in [*stretches, []]:
        if newest:
            mark = (base + newest - lateness) * 1000
        seen = set()
        for i, c, s in sorted(own, key=lambda r: (r[2], r[0])):
            c = c or "unknown"
            if mark and (base + s) * 1000 <= mark:
                late.add(i)
                continue
            seen.add(c)
            if c not in rings:
                rings[c] = deque()
                steps.setdefault(mark, [0, 0])[0] += 1
            ring = rings[c]
            while ring and ring[0] <= s - window_s:
                ring.popleft()
            decided[i] = len(ring) < limit
            if decided[i]:
                ring.append(s)
        for c in seen:
            ends[c] = max((base + max(rings[c], default=0)) * 1000 + window_s * 1000, mark) + 1
        for c in [c for c in rings if ends[c] <= mark]:
            del rings[c]
            steps.setdefault(mark, [0, 0])[1] += 1
        newest = max([newest, *(s for _, _, s in own)])
    live, out = 0, []
    for at, (opened, closed) in sorted(steps.items()):
        live += opened - closed
        out.append((at, opened, closed, live))
    return decided, late, out


def test_decisions_late_rows_and_live_clients(spark, tmp_path, stretches):
    out = run(spark, tmp_path, stretches, 4, 60).cache()
    decided, late, steps = plain(stretches, 4, 60)
    rows = out.where("kind = 'row'").collect()
    assert {r.event_id for r in rows if r.reason == "late"} == late and len(late) >= 3
    assert all(r.allowed is None and r.retry_after is None for r in rows if r.reason == "late")
    assert {r.event_id: r.allowed for r in rows if r.reason is None} == decided and len(rows) == sum(map(len, stretches))
    assert [tuple(r) for r in keyed_limiter.live_clients(out).orderBy("watermark_ms").collect()] == steps
    assert sum(s[2] for s in steps) >= 1


def test_same_as_the_batch(spark, tmp_path, stretches):
    ordered = [[r for r in own if r[2] >= part * 400] for part, own in enumerate(stretches)]
    out = run(spark, tmp_path, ordered, 3, 45.0).where("kind = 'row'")
    log = spark.createDataFrame([(i, c, START + dt.timedelta(seconds=s)) for own in ordered for i, c, s in own], "event_id long, ip string, ts timestamp")
    batch = limiter.rate_limit(log, 3, 45.0)
    want = {r.event_id: (r.ip, r.allowed, r.retry_after) for r in batch.collect()}
    assert {r.event_id: (r.ip, r.allowed, r.retry_after) for r in out.collect()} == want
