"""Scalar functions on literal values."""

import math

import pytest
from pyspark.sql import functions as F

from cellgrid.functions import colour, scalars, vocab


def apply(spark, rows, schema, *columns):
    """Rows of results, one column per expression, in input order."""
    named = [c.alias(f"c{i}") for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, schema).select(*named).collect()


def one(spark, values, kind, column):
    return [r.c0 for r in apply(spark, [(v,) for v in values], f"x {kind}", column)]


def test_variables(spark):
    names = [" duaod ", "DUEXTTAU", "\ttotaod\n", "foo", None]
    assert one(spark, names, "STRING", scalars.canonical_variable("x")) == ["DUEXTTAU", "DUEXTTAU", "TOTEXTTAU", "FOO", None]
    assert one(spark, names[:4], "STRING", scalars.servable_variable("x")) == [True, True, True, False]
    assert one(spark, ["dueXTTAU", "XYZ"], "STRING", scalars.pretty_variable("x")) == ["Dust AOD", "XYZ"]


@pytest.mark.parametrize("text, value", [
    ("2026-09-01", "2026-09-01 00:00:00"), ("2026-09-01T10:00", "2026-09-01 10:00:00"), ("2026-09-01 10:00:05Z", "2026-09-01 10:00:05"),
    ("2026-09-01T10:00:05.25+02:00", "2026-09-01 08:00:05.25"), ("2026-09-01T00:30-05:30", "2026-09-01 06:00:00"),
    ("2026-09-01T00:30Z", "2026-09-01 00:30:00"), ("2026-13-01", None), ("2026-02-30", None), ("2026", None), ("12:30", None),
    ("20260901", None), ("soon", None), ("", None), (None, None),
])
def test_times(spark, text, value):
    assert one(spark, [text], "STRING", scalars.parse_utc_time("x").cast("string")) == [value]


def test_times_do_not_follow_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        texts = ["2026-07-01", "2026-07-01T10:00:00+02:00"]
        got = one(spark, texts, "STRING", scalars.iso_utc(scalars.parse_utc_time("x")))
        micros = one(spark, texts[:1], "STRING", scalars.micros(scalars.parse_utc_time("x")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2026-07-01T00:00:00Z", "2026-07-01T08:00:00Z"]
    assert micros == [1782864000000000]


def test_boxes(spark):
    texts = ["-17,15,35,32", " 1.5, -2e1 ,3,+7", "170,-40,-120,20", "1,2,3", "a,b,c,d", "1,2,3,4d", "-181,0,1,1", "0,0,1,91", "0,5,1,5", "nan,0,1,1"]
    got = [(r.w, r.error) for r in one(spark, texts, "STRING", scalars.parse_bbox("x"))]
    assert [g[1] for g in got] == [None, None, None, "bbox_format", "bbox_format", "bbox_format", "bbox_longitude", "bbox_latitude", "bbox_order", "bbox_longitude"]
    assert got[0][0] == -17.0


def test_values_and_ticks(spark):
    assert one(spark, [1.23456789, float("nan"), None, 0.12345], "DOUBLE", scalars.grid_value("x")) == [1.2346, None, None, 0.1235]
    values = [0.0065, 2.11, 0.0, 123.456, 1234.5, 0.1, -0.00012345, 1e-7, 2.5e-8, 1e21, float("nan"), float("inf"), None, 999.9, 1.0]
    # texts that end in a half are rounded by the exact value behind them
    values += [1.005, 1.015, 1.125, 2.675, 0.0006785, -1.005, -1.125, 1125.0, 1.125e20, 9.995]
    want = ["0.0065", "2.11", "0", "123", "1230", "0.1", "-0.000123", "1e-7", "2.5e-8", "1e+21", "–", "–", "–", "1000", "1"]
    want += ["1", "1.01", "1.13", "2.67", "0.000678", "-1", "-1.13", "1130", "113000000000000000000", "9.99"]
    assert one(spark, values, "DOUBLE", scalars.format_tick("x")) == want


def test_questions(spark):
    texts = ["  Is it SAFE to run\tin Delhi today?! ", "a , b", "Été à la plage", "x_1-2"]
    assert one(spark, texts, "STRING", scalars.normalize_question("x")) == ["is it safe to run in delhi today", "a  b", "été à la plage", "x_12"]
    keys = apply(spark, [("Dust?", "d|"), ("dust", "d|"), ("dust", "e|")], "x STRING, y STRING", scalars.question_key("x", "y"))
    assert keys[0].c0 == keys[1].c0 != keys[2].c0
    import hashlib
    assert keys[0].c0 == hashlib.sha256(b"dust\x00d|").hexdigest()


def test_clients(spark):
    rows = [("1.2.3.4, 5.6.7.8", "9.9.9.9"), (None, "9.9.9.9"), (" , 5.6.7.8", "9.9.9.9"), (None, None)]
    got = apply(spark, rows, "x STRING, y STRING", scalars.client_ip("x", "y"))
    assert [r.c0 for r in got] == ["1.2.3.4", "9.9.9.9", "9.9.9.9", "unknown"]


def test_titles(spark):
    rows = [("u", "2026-09-01T00:00:00Z", "2026-09-02T00:00:00Z", "daily"), ("u", "2026-09-01T00:00:00Z", "2026-09-01T05:00:00Z", ""), (None, None, None, None)]
    got = apply(spark, rows, "u STRING, a STRING, b STRING, g STRING", scalars.grid_title(*[F.col(c) for c in "uabg"]))
    assert [r.c0 for r in got] == ["u · 2026-09-01 → 2026-09-02 · daily", "u · 2026-09-01", " · "]


def test_colours(spark):
    got = one(spark, ["#fFffcc", "ffffcc", "#12345g", None], "STRING", colour.hex_to_rgb("x"))
    assert tuple(got[0]) == (255, 255, 204, None) and all(g.r is None and g.error for g in got[1:])
    for stops in vocab.RENDER_RAMPS.values():
        ends = one(spark, [-1.0, 0.0, 1.0, 7.0, None], "DOUBLE", colour.sample_colormap(stops, "x"))
        first, last = (tuple(bytes.fromhex(c[1:])) for c in (stops[0][1], stops[-1][1]))
        assert [tuple(e) if e else None for e in ends] == [first, first, last, last, None]
    ramp = ((0.0, "#000000"), (0.5, "#0a0a0a"), (1.0, "#ffffff"))
    assert [c.r for c in one(spark, [0.25, 0.5, 0.75], "DOUBLE", colour.sample_colormap(ramp, "x"))] == [5, 10, math.floor(132.5 + 0.5)]
    assert one(spark, ["DUEXTTAU", "dust_du", "TOTEXTTAU", None], "STRING", colour.colormap_for("x")) == ["dust", "dust", "viridis", "viridis"]
    text = one(spark, ["dust"], "STRING", colour.legend_gradient("x"))[0]
    assert text.startswith("linear-gradient(to right, #ffffcc 0.0%, #ffeda0 12.5%") and text.endswith("#800026 100.0%)")
