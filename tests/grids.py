"""A closed-form grid: two variables, two days, 15 by 46 places, 24 steps a day."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

DAYS = [dt.date(2019, 3, 11), dt.date(2019, 3, 12)]
LATS = np.arange(-84.0, 85.0, 12.0)
LONS = np.arange(-180.0, 181.0, 8.0)


def formula(t, iy, ix, day, offset):
    """t is the step within the day."""
    return 0.002 * t * t + 0.003 * iy * iy + 0.0007 * ix * iy + 0.4 * day + offset


def cells(spark):
    n_lat, n_lon = len(LATS), len(LONS)
    rows = spark.range(2 * 2 * 24 * n_lat * n_lon).select(
        (F.col("id") % n_lon).alias("ix"), (F.floor(F.col("id") / n_lon) % n_lat).alias("iy"),
        (F.floor(F.col("id") / (n_lon * n_lat)) % 24).alias("t"), (F.floor(F.col("id") / (n_lon * n_lat * 24)) % 2).alias("d"),
        F.floor(F.col("id") / (n_lon * n_lat * 48)).alias("v"),
    )
    value = formula(*[F.col(c) for c in ("t", "iy", "ix", "d")], 0.8 * F.col("v"))
    start = F.lit("2019-03-11 00:30:00").cast("timestamp_ntz")
    time = F.timestamp_add("HOUR", (F.col("d") * 24 + F.col("t")).cast("int"), start)
    return rows.select(
        F.when(F.col("v") == 0, "DUEXTTAU").otherwise("TOTEXTTAU").alias("variable"), F.to_date(time).alias("day"),
        time.alias("time"), (F.col("iy") * 12.0 - 84).alias("lat"), (F.col("ix") * 8.0 - 180).alias("lon"),
        value.alias("value"),
    )


def array(variable: str) -> np.ndarray:
    """The same values as (step of 48, lat, lon)."""
    t, iy, ix = np.meshgrid(np.arange(48), np.arange(len(LATS)), np.arange(len(LONS)), indexing="ij")
    return formula(t % 24, iy, ix, t // 24, 0.8 if variable == "TOTEXTTAU" else 0.0)


def times() -> list[dt.datetime]:
    return [dt.datetime(2019, 3, 11, 0, 30) + dt.timedelta(hours=h) for h in range(48)]


def manifest(spark, days=DAYS):
    return spark.createDataFrame([(d, f"{d}.json") for d in days], "day DATE, ref_name STRING")


def expected(variable, box, t0, t1, aggregation, max_nlon=360, max_nlat=180):
    """The answer by plain numpy: (lats, lons, values, steps)."""
    w, s, e, n = box
    keep = [i for i, t in enumerate(times()) if t0 <= t <= t1]
    ys = [i for i, lat in enumerate(LATS) if s <= lat <= n]
    if w <= e:
        xs = [(0, i) for i, lon in enumerate(LONS) if w <= lon <= e]
    else:
        # a piece without width selects nothing
        xs = [(0, i) for i, lon in enumerate(LONS) if lon >= w and w < LONS[-1]] + [(1, i) for i, lon in enumerate(LONS) if lon <= e]
    data = array(variable)[np.ix_(keep, ys, [i for _, i in xs])]
    if aggregation == "hourly":
        field = data.mean(axis=0)
    else:
        label = [times()[i].date() if aggregation == "daily" else times()[i].month for i in keep]
        field = np.mean([data[[j for j, x in enumerate(label) if x == g]].mean(axis=0) for g in sorted(set(label))], axis=0)
    lats = LATS[ys]
    lons = np.array([LONS[i] + (360 if seg else 0) for seg, i in xs])
    fy, fx = -(-len(lats) // max_nlat), -(-len(lons) // max_nlon)
    oy, ox = len(lats) // fy, len(lons) // fx
    field = field[: oy * fy, : ox * fx].reshape(oy, fy, ox, fx).mean(axis=(1, 3))
    lats = lats[: oy * fy].reshape(oy, fy).mean(axis=1)
    lons = lons[: ox * fx].reshape(ox, fx).mean(axis=1)
    turned = np.array([any(seg for seg, _ in xs[b * fx:(b + 1) * fx]) for b in range(ox)])
    lons = np.where(turned & (lons >= 180), lons - 360, lons)
    return lats, lons, field, len(keep)
