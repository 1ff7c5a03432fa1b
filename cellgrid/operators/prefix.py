"""Time means of any window from running sums: a window is the difference of two days.

The table of running sums has a row per variable, indexed day and cell that was seen up to
that day: what all steps, day means and month means up to the day add up to.  It has one row where
cells have a day's steps, is appended by day, and never rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrid.operators.fields import day_partials, step_totals
from cellgrid.operators.joins import hot_keys, lookup_join, row_bound, salted_join
from cellgrid.operators.slicing import TILE_DEGREES, in_piece, span_tiles, tile_of, with_day
from cellgrid.session import written

CELL = ["variable", "lat", "lon"]
SUMS = ["total", "seen", "day_total", "days_seen", "month_total", "months_seen", "part_total", "part_seen"]
PREFIX_SCHEMA = (
    "variable STRING, day DATE, lat DOUBLE, lon DOUBLE, total DOUBLE, seen LONG, day_total DOUBLE, days_seen LONG, "
    "month_total DOUBLE, months_seen LONG, part_total DOUBLE, part_seen LONG"
)
DAYS_SCHEMA = "variable STRING, day DATE"
BROADCAST_SPANS = 20_000  # each meets all cells of its day in as many tasks as the cells have
BOX = ["s", "n", "l_lo", "l_hi", "r_lo", "r_hi"]


def running_sums(cells: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Rows of ``PREFIX_SCHEMA`` for the days of ``cells``; ``carried`` is the last stored day of each variable.

    ``total, seen`` run over steps, ``day_total, days_seen`` over day means, ``month_total,
    months_seen`` over month means, the last month's as far as it goes (``part_total,
    part_seen`` are its steps).  A cell that was ever seen has a row on each later day,
    so two days are enough for any window.  Sums run per cell over the days of the batch.
    """
    new = day_partials(with_day(cells)).select(*CELL, "day", F.col("total").alias("t"), F.col("seen").alias("k"))
    places = new.select(*CELL)
    if carried is not None:
        places = places.union(carried.select(*CELL))
    # at most one array of calendar days per variable
    days = new.groupBy("variable").agg(F.sort_array(F.collect_set("day")).alias("days"))
    rows = places.distinct().join(F.broadcast(days), "variable").select(*CELL, F.explode("days").alias("day"))
    rows = rows.join(new, [*CELL, "day"], "left").withColumns({"t": F.coalesce("t", F.lit(0.0)), "k": F.coalesce("k", F.lit(0))})
    if carried is None:
        kept = {f"c_{c}": F.lit(0).cast("double" if c.endswith("total") else "long") for c in SUMS}
        rows = rows.withColumns({**kept, "c_day": F.lit(None).cast("date")})
    else:
        last = carried.select(*CELL, F.col("day").alias("c_day"), *[F.col(c).alias(f"c_{c}") for c in SUMS])
        rows = rows.join(last, CELL, "left").na.fill(0, [f"c_{c}" for c in SUMS])
    rows = rows.withColumn("month", F.trunc("day", "month"))
    by_day = Window.partitionBy(*CELL).orderBy("day")
    by_month = Window.partitionBy(*CELL, "month").orderBy("day")

    def run(value: Column, over: Window) -> Column:
        return F.sum(value).over(over.rowsBetween(Window.unboundedPreceding, 0))

    same = F.coalesce(F.trunc("c_day", "month") == F.col("month"), F.lit(False))
    mean = F.when(F.col("part_seen") > 0, F.col("part_total") / F.col("part_seen")).otherwise(0.0)
    carried_mean = F.when(same & (F.col("c_part_seen") > 0), F.col("c_part_total") / F.col("c_part_seen")).otherwise(0.0)
    rows = rows.withColumns({
        "part_total": run(F.col("t"), by_month) + F.when(same, F.col("c_part_total")).otherwise(0.0),
        "part_seen": run(F.col("k"), by_month) + F.when(same, F.col("c_part_seen")).otherwise(0),
    })
    rows = rows.withColumns({"mean": mean, "some": (F.col("part_seen") > 0).cast("long")})
    # a month's mean moves as its days come in: what counts is by how much
    rows = rows.withColumns({
        "moved": F.col("mean") - F.coalesce(F.lag("mean").over(by_month), carried_mean),
        "begun": F.col("some") - F.coalesce(F.lag("some").over(by_month), (same & (F.col("c_part_seen") > 0)).cast("long")),
    })
    day_mean = F.when(F.col("k") > 0, F.col("t") / F.col("k")).otherwise(0.0)
    return rows.select(
        "variable", "day", "lat", "lon",
        (run(F.col("t"), by_day) + F.col("c_total")).alias("total"), (run(F.col("k"), by_day) + F.col("c_seen")).alias("seen"),
        (run(day_mean, by_day) + F.col("c_day_total")).alias("day_total"),
        (run((F.col("k") > 0).cast("long"), by_day) + F.col("c_days_seen")).alias("days_seen"),
        (run(F.col("moved"), by_day) + F.col("c_month_total")).alias("month_total"),
        (run(F.col("begun"), by_day) + F.col("c_months_seen")).alias("months_seen"), "part_total", "part_seen",
    )


def write_prefix(cells: DataFrame, path: str, first: bool = False) -> None:
    """Append the days of ``cells`` to the running sums under ``path``; ``first`` starts them.

    Only the last stored day of each variable is read, and only new days are written.  A day
    counts once it is listed under ``path/days``, which is written last: an append that broke
    off is simply run again, and overwrites its own days alone.  Days that are not later than
    the stored ones of their variable are refused, as they would change history.
    """
    spark = cells.sparkSession
    cells = with_day(cells)
    carried = None
    if not first:
        listed = spark.read.schema(DAYS_SCHEMA).parquet(f"{path}/days")
        last = listed.groupBy("variable").agg(F.max("day").alias("day"))
        fresh = cells.groupBy("variable").agg(F.min("day").alias("oldest"))
        if not fresh.join(last, "variable").where("oldest <= day").isEmpty():
            raise ValueError("days can only be appended after the stored ones of their variable")
        # one row per variable
        carried = read_prefix(spark, path).join(F.broadcast(last), ["variable", "day"], "left_semi")
    rows = running_sums(cells, carried)
    (
        rows.repartition("variable", "day").sortWithinPartitions("variable", "day", "lat", "lon")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variable", "day").parquet(f"{path}/sums")
    )
    cells.select("variable", "day").distinct().coalesce(1).write.mode("append").parquet(f"{path}/days")


def read_prefix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREFIX_SCHEMA).parquet(f"{path}/sums")


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """``(variable, day)`` of the running sums."""
    return spark.read.schema(DAYS_SCHEMA).parquet(f"{path}/days").distinct()


def _latest(days: DataFrame) -> DataFrame:
    """``(variable, target, day)``: for each calendar day between a variable's first and last the
    latest listed one up to it.  One row per variable and calendar day."""
    span = days.groupBy("variable").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    calendar = span.select("variable", F.explode(F.sequence("a", "b")).alias("target"))
    known = calendar.join(days.withColumnRenamed("day", "target").withColumn("day", F.col("target")), ["variable", "target"], "left")
    so_far = Window.partitionBy("variable").orderBy("target").rowsBetween(Window.unboundedPreceding, 0)
    return known.select("variable", "target", F.last("day", ignorenulls=True).over(so_far).alias("day"))


def window_reads(windows: DataFrame) -> DataFrame:
    """``windows`` with ``edges``, the days only partly inside, and ``reads``: which running sum to
    add or subtract on which day, and the month whose mean it belongs to (null: to none).

    Whole days take two reads; whole months of a monthly mean two, and each month that the window
    cuts two more.  However long a window is, it has at most six.
    """
    read = "named_struct('target', {0}, 'sign', {1}, 'sums', '{2}', 'bucket', {3})"

    def between(first: str, last: str, sums: str, bucket: str = "CAST(NULL AS DATE)") -> str:
        return f"array({read.format(last, 1, sums, bucket)}, {read.format(f'date_sub({first}, 1)', -1, sums, bucket)})"

    none = f"slice({between('d0', 'd0', 'steps')}, 1, 0)"
    days = windows.selectExpr(
        "*", "to_date(start_time) AS d0", "to_date(end_time) AS d1",
        "start_time <= CAST(to_date(start_time) AS TIMESTAMP_NTZ) AS whole0",
        "end_time >= CAST(to_date(end_time) AS TIMESTAMP_NTZ) + INTERVAL '23:59:59.999999' HOUR TO SECOND AS whole1",
    ).selectExpr("*", "IF(whole0, d0, date_add(d0, 1)) AS f", "IF(whole1, d1, date_sub(d1, 1)) AS l").selectExpr(
        "*", "trunc(f, 'month') AS fm", "trunc(l, 'month') AS lm",
        "IF(f = trunc(f, 'month'), f, add_months(trunc(f, 'month'), 1)) AS first_month",
        "IF(l = last_day(l), l, date_sub(trunc(l, 'month'), 1)) AS last_month",
    )
    months = ", ".join([
        f"IF(first_month <= last_month, {between('first_month', 'last_month', 'months')}, {none})",
        f"IF(f <> fm, {between('f', 'least(l, last_day(f))', 'steps', 'fm')}, {none})",
        f"IF(l <> last_day(l) AND (f = fm OR lm > fm), {between('greatest(f, lm)', 'l', 'steps', 'lm')}, {none})",
    ])
    reads = (
        f"CASE WHEN f > l THEN {none} WHEN agg = 'hourly' THEN {between('f', 'l', 'steps')} "
        f"WHEN agg = 'daily' THEN {between('f', 'l', 'days')} ELSE concat({months}) END AS reads"
    )
    edges = "array_distinct(concat(IF(whole0, array(), array(d0)), IF(whole1, array(), array(d1)))) AS edges"
    return days.selectExpr(*windows.columns, edges, reads)


def prefix_fields(windows: DataFrame, prefix: DataFrame, days: DataFrame, cells: DataFrame) -> DataFrame:
    """``(request_id, seg, lat, lon, value)``: the time mean of each window at each cell of its box.

    ``windows`` are rows ``request_id, variable, s, n, l_lo, l_hi, r_lo, r_hi, start_time,
    end_time, agg``.  The result equals ``collapse_time`` over all steps, but for cells
    without any value, which have no row; read are at most six days of running sums and the
    steps of two edge days, however long the window.  Reads meet the sums on equal
    (variable, day), so that other days are pruned.
    """
    # a window is little to read and much to work out: files of a few MB would be a few tasks
    planned = written(window_reads(windows.repartition("request_id")), "windows")
    parts = planned.select("request_id", "variable", *BOX, "start_time", "end_time", *_first_buckets(), "reads", "edges")
    reads = parts.select("*", F.explode("reads").alias("r")).select(
        "request_id", "variable", *BOX, "start_time", "end_time", "r.target", "r.sign", "r.sums", _slot(F.col("r.bucket")).alias("slot")
    )
    known = _latest(days)
    last = known.groupBy("variable").agg(F.max("target").alias("newest"))
    # one row per variable; a target before the first day has no row, and nothing to subtract
    reads = reads.join(F.broadcast(last), "variable").withColumn("target", F.least("target", "newest")).drop("newest")
    reads = lookup_join(reads, known, ["variable", "target"], "inner").drop("target")
    edges = parts.select("*", F.explode("edges").alias("day")).select(
        "request_id", "variable", *BOX, "start_time", "end_time", F.lit(0).alias("sign"), F.lit("edge").alias("sums"),
        _slot(F.when(F.col("agg") == "daily", F.col("day")).when(F.col("agg") == "monthly_mean", F.trunc("day", "month"))).alias("slot"), "day",
    )
    spans = written(reads.unionByName(edges), "spans")

    met = _meet(_day_rows(prefix, cells), spans, prefix, known)
    edge = F.col("sums") == "edge"
    inside = "filter(steps, x -> x.time BETWEEN start_time AND end_time)"
    total = F.expr(f"""CASE sums WHEN 'steps' THEN sign * total WHEN 'days' THEN sign * day_total WHEN 'months' THEN sign * month_total
        ELSE aggregate({inside}, 0D, (a, x) -> a + coalesce(x.total, 0D)) END""")
    seen = F.expr(f"""CASE sums WHEN 'steps' THEN sign * seen WHEN 'days' THEN sign * days_seen WHEN 'months' THEN sign * months_seen
        ELSE aggregate({inside}, 0L, (a, x) -> a + x.seen) END""")
    keys = ["request_id", "seg", "lat", "lon"]
    rows = met.select(*keys, "slot", total.alias("t"), seen.alias("k"))
    # slot 0 is a sum of means or steps, the others are each one mean of a day or month; all in one exchange
    sums = rows.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("slot") == i, F.col(c))).alias(f"{c}{i}") for i in range(3) for c in ("t", "k")
    ])
    total, seen = F.coalesce("t0", F.lit(0.0)), F.coalesce("k0", F.lit(0))
    for i in (1, 2):
        total = total + F.when(F.col(f"k{i}") > 0, F.col(f"t{i}") / F.col(f"k{i}")).otherwise(0.0)
        seen = seen + F.when(F.col(f"k{i}") > 0, 1).otherwise(0)
    return sums.select(*keys, total.alias("total"), seen.alias("seen")).where("seen > 0").select(*keys, (F.col("total") / F.col("seen")).alias("value"))


def _first_buckets() -> list[Column]:
    """``agg`` and the first day or month of a window that can have a mean of its own."""
    first = F.when(F.col("agg") == "daily", F.to_date("start_time")).when(F.col("agg") == "monthly_mean", F.trunc("start_time", "month"))
    return [F.col("agg"), first.alias("first_bucket")]


def _slot(bucket: Column) -> Column:
    """0 without a bucket, 1 for that of the window's first day, 2 for that of its last: there are no others."""
    return F.when(bucket.isNull(), 0).when(bucket == F.col("first_bucket"), 1).otherwise(2)


def _day_rows(prefix: DataFrame, cells: DataFrame) -> DataFrame:
    """A row per variable, day and cell with the running sums, and one with the ``steps`` of the day in time."""
    steps = step_totals(with_day(cells)).groupBy("variable", "day", "lat", "lon").agg(
        F.sort_array(F.collect_list(F.struct("time", "total", "seen"))).alias("steps")
    )
    kind = "ARRAY<STRUCT<time: TIMESTAMP_NTZ, total: DOUBLE, seen: BIGINT>>"
    sums = ["total", "seen", "day_total", "days_seen", "month_total", "months_seen"]
    stored = prefix.select("variable", "day", "lat", "lon", F.lit(False).alias("edge"), *sums, F.lit(None).cast(kind).alias("steps"))
    own = steps.select("variable", "day", "lat", "lon", F.lit(True).alias("edge"), *[F.lit(None).cast(prefix.schema[c].dataType).alias(c) for c in sums], F.col("steps").cast(kind).alias("steps"))
    return stored.unionByName(own)


def _meet(rows: DataFrame, spans: DataFrame, prefix: DataFrame, known: DataFrame) -> DataFrame:
    """Each span with the rows of its day and kind whose cell lies in its box, and ``seg``.

    Few spans are broadcast.  Beyond, a span is a row per tile of its box that holds a cell at all,
    which the last stored day of each variable tells: every cell seen so far has a row there.
    """
    spans = spans.withColumn("edge", F.col("sums") == "edge")
    right = in_piece("r_lo", "r_hi")
    keys = ["variable", "day", "edge"]
    if row_bound(spans, BROADCAST_SPANS):
        joined = rows.join(F.broadcast(spans), keys)
    else:
        newest = known.groupBy("variable").agg(F.max("day").alias("day"))
        places = prefix.join(F.broadcast(newest), ["variable", "day"], "left_semi")
        held = places.select("variable", tile_of(F.col("lat"), F.col("lon"), TILE_DEGREES).alias("tile")).distinct()
        tiles = spans.withColumn("tile", F.explode(span_tiles(TILE_DEGREES)))
        # a variable has at most 325 tiles
        tiles = tiles.join(F.broadcast(held), ["variable", "tile"], "left_semi")
        asked = spans.select("variable", "day", "edge").distinct()
        # at most two rows per variable and stored day
        placed = rows.join(F.broadcast(asked), keys, "left_semi").withColumn("tile", tile_of(F.col("lat"), F.col("lon"), TILE_DEGREES))
        hot = written(hot_keys(tiles, [*keys, "tile"]), "hot")
        joined = salted_join(tiles, placed, [*keys, "tile"], spread=F.xxhash64("request_id"), hot=hot).drop("tile")
    return joined.where(F.col("lat").between(F.col("s"), F.col("n")) & (in_piece("l_lo", "l_hi") | right)).withColumn(
        "seg", F.when(right & ~in_piece("l_lo", "l_hi"), 1).otherwise(0)
    )
