"""Grid requests: validation, granule days, coverage.

A request is ``(request_id, source, variable, bbox, t0, t1, agg)``, all text but the id.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.functions import vocab
from cellgrid.functions.scalars import box_error, box_numbers, canonical_variable, computed_once, parse_utc_time
from cellgrid.operators.joins import lookup_join

REJECTED = 422


def _error(reason: str, error_class: str, message: Column) -> Column:
    return F.struct(
        F.lit(reason).alias("reason"), F.lit(error_class).alias("error_class"),
        F.lit(REJECTED).alias("status"), message.alias("message"),
    )


def _quoted(name: str) -> Column:
    return F.concat(F.lit("'"), F.coalesce(F.col(name), F.lit("null")), F.lit("'"))


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def check_requests(requests: DataFrame, today: dt.date, latency_days: int = vocab.ARCHIVE_LATENCY_DAYS) -> DataFrame:
    """Requests with parsed columns and their first broken rule.

    Adds ``variable_name, w, s, e, n, start_time, end_time`` and ``reason, error_class,
    status, message`` (all NULL for a good request).  The rules are tried in a fixed order:
    source, variable, aggregation, box, t0, t1, time order, archive latency.
    """
    newest = today - dt.timedelta(days=max(0, latency_days))
    w, s, e, n = box_numbers("bbox")
    parsed = computed_once(
        requests, variable_name=canonical_variable("variable"), w=w, s=s, e=e, n=n,
        start_time=parse_utc_time("t0"), end_time=parse_utc_time("t1"),
    )

    def fails(rule: Column) -> Column:
        return ~F.coalesce(rule, F.lit(False))

    broken_box = box_error(*[F.col(c) for c in "wsen"])
    first = (
        F.when(
            fails(F.col("source") == vocab.ARCHIVE_SOURCE),
            _error("source", "bad_request", _say("source ", _quoted("source"), " has no gridded archive")),
        )
        .when(
            fails(F.col("variable_name").isin(*vocab.COLUMN_VARIABLES)),
            _error("variable", "unknown_variable",
                   _say("variable ", _quoted("variable"), " is not served; known: ", ", ".join(sorted(vocab.COLUMN_VARIABLES)))),
        )
        .when(
            fails(F.col("agg").isin(*vocab.AGGREGATIONS)),
            _error("aggregation", "bad_request",
                   _say("aggregation ", _quoted("agg"), " is not one of ", ", ".join(vocab.AGGREGATIONS))),
        )
        .when(broken_box == "bbox_format",
              _error("bbox_format", "bad_request", _say("box ", _quoted("bbox"), " is not four numbers w,s,e,n")))
        .when(broken_box == "bbox_longitude",
              _error("bbox_longitude", "bad_request", _say("box longitudes leave -180..180")))
        .when(broken_box == "bbox_latitude",
              _error("bbox_latitude", "bad_request", _say("box latitudes leave -90..90")))
        .when(broken_box == "bbox_order",
              _error("bbox_order", "bad_request", _say("box south is not below north")))
        .when(F.col("start_time").isNull(),
              _error("t0", "bad_request", _say("t0 ", _quoted("t0"), " is not an ISO-8601 time")))
        .when(F.col("end_time").isNull(),
              _error("t1", "bad_request", _say("t1 ", _quoted("t1"), " is not an ISO-8601 time")))
        .when(F.col("end_time") < F.col("start_time"),
              _error("time_order", "bad_request", _say("t1 lies before t0")))
        .when(
            F.to_date("start_time") > F.lit(newest),
            _error("latency", "bad_request",
                   _say("the archive lags several weeks: newest expected day is ", newest.isoformat(),
                        ", the window starts on ", F.to_date("start_time").cast("string"))),
        )
    )
    checked = computed_once(parsed, fault=first)
    return checked.select(
        *parsed.columns, "fault.reason", "fault.error_class", "fault.status", "fault.message"
    )


def good_requests(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNull())


def window_days(good: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per request and calendar ``day`` of its window, at least one per request.

    The window is first cut to the manifest's own first and last day, so even a request for
    a thousand years explodes to no more days than the index spans.  A window that lies
    outside keeps its row with a NULL day.
    """
    first = manifest.agg(F.min("day")).scalar()
    last = manifest.agg(F.max("day")).scalar()
    start, end = F.greatest(F.to_date("start_time"), first), F.least(F.to_date("end_time"), last)
    return good.withColumn("day", F.explode_outer(F.when(start <= end, F.sequence(start, end))))


def granules_for_window(checked: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(request_id, day, ref_name)``: the manifest's days inside each good request's window.

    The window becomes days first, so this is a join on equal days and never a range join.
    """
    days = window_days(good_requests(checked), manifest).select("request_id", "day")
    return lookup_join(days, manifest.select("day", "ref_name"), ["day"], "inner")
