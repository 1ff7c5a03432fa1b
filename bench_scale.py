"""One global daily field, and many small ones, from a stored archive at full grid resolution.

Writes ``BENCH_DAYS`` days of one variable (24 steps, 361 by 576 cells) to a new work folder,
then times the requests; prints one JSON line with cells per second and shuffled bytes.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from cellgrid.plans.grids import GridAnswers  # noqa: E402
from cellgrid.session import get_spark, work_folder  # noqa: E402
from cellgrid.sources.cells import read_axes, read_cells, write_cells  # noqa: E402

CPUS, DAYS = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_DAYS", "4"))
START = dt.date(2024, 1, 1)
SCHEMA = "request_id INT, source STRING, variable STRING, bbox STRING, t0 STRING, t1 STRING, agg STRING"


def archive_cells(spark):
    per_step, per_day = 361 * 576, 361 * 576 * 24
    at = spark.range(DAYS * per_day)
    step = F.floor(F.col("id") / per_step).cast("int")
    return at.select(
        F.lit("DUEXTTAU").alias("variable"),
        F.timestamp_add("HOUR", step, F.lit(f"{START} 00:30:00").cast("timestamp_ntz")).alias("time"),
        (F.floor(F.col("id") % per_step / 576) * 0.5 - 90).alias("lat"),
        (F.col("id") % 576 * 0.625 - 180).alias("lon"),
        F.when(F.col("id") % 53 != 0, F.pmod(F.xxhash64("id"), F.lit(10_000)) / 9731.0).alias("value"),
    )


def shuffled(spark) -> int:
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def main() -> None:
    spark = get_spark("cellgrid-scale", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": os.environ.get("BENCH_PARTITIONS", "64"), "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        **({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENTS"]} if "BENCH_EVENTS" in os.environ else {}),
    })
    spark.sparkContext.setLogLevel("ERROR")
    path, out = work_folder(spark, "scale"), {}
    start = time.perf_counter()
    write_cells(archive_cells(spark), path)
    out["write_sec"] = round(time.perf_counter() - start, 2)
    cells, axes = read_cells(spark, path), read_axes(spark, path)
    manifest = axes.where("axis = 'time'").select("day", F.concat(F.col("day").cast("string"), F.lit(".json")).alias("ref_name")).distinct()
    t1 = f"{START + dt.timedelta(days=DAYS - 1)}T23:59:59Z"
    globe = [(1, "merra2", "DUEXTTAU", "-180,-90,180,90", f"{START}T00:00:00Z", t1, "daily")]
    small = [
        (i, "merra2", "DUEXTTAU", f"{-180 + 7 * (i % 50)},{-80 + 5 * (i // 50)},{-180 + 7 * (i % 50) + 16},{-62 + 5 * (i // 50)}",
         f"{START}T{i % 24:02d}:00:00Z", t1, ("daily", "hourly", "monthly_mean")[i % 3])
        for i in range(1000)
    ]
    warm = [(1, "merra2", "DUEXTTAU", "0,0,5,5", f"{START}T00:00:00Z", f"{START}T05:00:00Z", "daily")]
    for name, rows, options in (("warm", warm, {}), ("globe", globe, {}), ("small_24", small[::42], {}), ("small_1000", small, {})):
        before, start = shuffled(spark), time.perf_counter()
        answers = GridAnswers(spark.createDataFrame(rows, SCHEMA), cells, manifest, dt.date(2025, 1, 1), axes=axes, **options)
        answers.documents().write.format("noop").mode("overwrite").save()
        out[f"{name}_sec"] = round(time.perf_counter() - start, 2)
        out[f"{name}_shuffle_mb"] = round((shuffled(spark) - before) / 1e6, 1)
    n_cells = DAYS * 361 * 576 * 24
    print(json.dumps({
        "metric": "global daily field", "value": round(n_cells / out["globe_sec"]), "unit": "cells/sec",
        "cells": n_cells, "days": DAYS, "cpus": int(CPUS), **out,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
