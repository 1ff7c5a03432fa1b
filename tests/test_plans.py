"""Places, words, events and plan rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellgrid.functions import vocab
from cellgrid.plans import drafts as plans
from cellgrid.sources import dimensions

T = dt.datetime
SCHEMA = "draft_id INT, intent STRING, level STRING, source STRING, variable STRING, place STRING, time_start TIMESTAMP_NTZ, time_end TIMESTAMP_NTZ, aggregation STRING, error STRING"
WEEK = (T(2026, 8, 1), T(2026, 8, 7, 23, 59, 59))
DRAFTS = [
    (1, "health", "surface", "google", "PM25", "New Delhi", T(2026, 9, 1), T(2026, 9, 1, 23, 59, 59), "hourly", None),
    (2, "plume", "column", "merra2", "duaod", " sahara DESERT ", *WEEK, "daily", None),
    (3, "health", "column", "merra2", "DUEXTTAU", "Delhi", *WEEK, "daily", None),
    (4, "plume", "column", "merra2", "DUEXTTAU", "Atlantis", *WEEK, "daily", None),
    (5, "plume", "column", "merra2", "DUEXTTAU", None, *WEEK, "daily", "need_location"),
    (6, "plume", "column", "merra2", "DUEXTTAU", "  ", *WEEK, "daily", None),
    (7, "plume", "column", "merra2", "DUEXTTAU", "Sahara", T(2026, 8, 2), T(2026, 8, 1), "daily", None),
    (8, "plume", "column", "merra2", "PM25", "Sahara", *WEEK, "daily", None),
    (9, "plume", "surface", "cams", "SSAOD", "Europe", *WEEK, "daily", None),
    (10, "health", "surface", "cams", "BCAOD", "Europe", *WEEK, "daily", None),
    (11, "comparison", None, None, "PM10", "la", *WEEK, None, None),
    (12, "plume", "column", "merra2", "XYZ", "Arctic", T(2026, 1, 1), T(2026, 1, 8), "hourly", None),
    (13, "plume", "column", "merra2", "XYZ", "Arctic", T(2026, 1, 1), T(2026, 1, 7, 23, 59, 59), "hourly", None),
]


@pytest.fixture(scope="module")
def answers(spark):
    drafts = spark.createDataFrame(DRAFTS, SCHEMA)
    out = plans.answer_plans(drafts, dimensions.gazetteer(spark), dimensions.place_aliases(spark))
    return {r.draft_id: r for r in out.collect()}


def test_good_plans(answers):
    assert [i for i, r in sorted(answers.items()) if r.status == 200] == [1, 2, 11, 13]
    delhi, sahara, angeles = answers[1], answers[2], answers[11]
    assert delhi.place_name == "Delhi" and delhi.bbox == [76.8, 28.4, 77.4, 28.9]
    assert delhi.data_url.startswith("google://") and delhi.legend.guideline == "WHO 24h"
    assert sahara.data_url == "/grid?source=merra2&variable=DUEXTTAU&bbox=-17.0,15.0,35.0,32.0&t0=2026-08-01T00:00:00Z&t1=2026-08-07T23:59:59Z&agg=daily"
    assert sahara.caption == "DUEXTTAU over Sahara, 2026-08-01..2026-08-07 (merra2)"
    assert sahara.legend.stops == "aod_sequential" and sahara.style.opacity == 0.65
    assert (angeles.level, angeles.source, angeles.aggregation, angeles.place_name) == ("surface", "cams", "daily", "Los Angeles")


def test_refusals_and_violations(answers):
    text = {i: r.problem for i, r in answers.items()}
    assert "Atlantis" in text[4] and "Amazon Basin, Arctic, Atlanta" in text[4] and "Southeast" not in text[4]
    assert "location" in text[5] and "no place" in text[6] and "time_end" in text[7]
    assert text[3] == plans.VIOLATION_TEXT["health_level"] and text[10] == plans.VIOLATION_TEXT["health_variable"]
    assert text[8] == plans.VIOLATION_TEXT["column_variable"] and text[9] == plans.VIOLATION_TEXT["surface_variable"]
    assert text[12] == plans.VIOLATION_TEXT["window_days"]
    assert all(r.data_url is None and r.caption is None for r in answers.values() if r.status == 422)


@pytest.mark.parametrize("alias, name", list(vocab.PLACE_ALIASES.items())[:6])
def test_aliases(spark, alias, name):
    drafts = spark.createDataFrame([(1, f" {alias.upper()} ")], "draft_id INT, place STRING")
    row = plans.resolve_places(drafts, dimensions.gazetteer(spark), dimensions.place_aliases(spark)).first()
    assert row.place_name == name and row.place_error is None


def test_alias_overrides_name_and_dead_alias_is_dropped(spark):
    places = spark.createDataFrame([("Delta", 0.0, 0.0, 1.0, 1.0), ("Other", 2.0, 2.0, 3.0, 3.0)], dimensions.PLACE_SCHEMA)
    aliases = spark.createDataFrame([("delta", "Other"), ("ghost", "Nowhere")], "alias STRING, canonical STRING")
    drafts = spark.createDataFrame([(1, "DELTA"), (2, "ghost")], "draft_id INT, place STRING")
    got = {r.draft_id: r.place_name for r in plans.resolve_places(drafts, places, aliases).collect()}
    assert got == {1: "Other", 2: None}


def test_words(spark):
    texts = ["Saharan dust over Spain", "dust and smoke", "PM2.5 in Delhi", "industrial ashtray", "Wildfire-smoke?", "AOD", "nothing"]
    asked = spark.createDataFrame(list(enumerate(texts)), "question_id INT, text STRING")
    got = {r.question_id: (r.phrase, r.variable, r.level) for r in plans.tag_aerosol_words(asked).collect()}
    assert got[0] == ("saharan dust", "DUEXTTAU", "column") and got[1][0] == "smoke" and got[2] == ("pm2.5", "PM25", "surface")
    assert got[3][0] is None and got[4][0] == "wildfire smoke" and got[5][1] == "TOTEXTTAU" and got[6] == (None, None, None)


def test_events(spark):
    events = dimensions.event_catalog(spark)
    asked = spark.createDataFrame([(1, "show the August Complex fire"), (2, "Hunga-Tonga and godzilla dust"), (3, "tongan eruption")], "question_id INT, text STRING")
    found = plans.match_events(asked, events)
    assert sorted((r.question_id, r.event_id) for r in found.collect()) == [
        (1, "california-wildfires-2020"), (2, "hunga-tonga-2022"), (2, "sahara-dust-godzilla-2020")]
    suggested = plans.event_plans(found, events).where("question_id = 1").orderBy("position").collect()
    assert [(p.source, p.variable) for p in suggested] == [("merra2", "BCEXTTAU"), ("cams", "PM25")]
    assert suggested[0].time_start == T(2020, 8, 15)


def test_wrapping_boxes_only_on_request(spark):
    events = dimensions.event_catalog(spark).where("id LIKE 'hunga%'")
    plan = events.select(F.lit(1).alias("draft_id"), "bbox", "time_start", "time_end", F.inline("suggested_plans"))
    assert plans.check_plan_schema(plan).first().errors == ["bbox_wrap"]
    assert plans.check_plan_schema(plan, allow_wrap=True).first().errors == []


def test_routes(spark):
    rows = [(1, "surface", T(2026, 9, 1)), (2, "surface", T(2026, 8, 1)), (3, "column", T(2026, 8, 1)), (4, "surface", T(2026, 12, 1)), (5, "column", T(2026, 9, 1))]
    found = plans.route_source(spark.createDataFrame(rows, "draft_id INT, level STRING, time_start TIMESTAMP_NTZ"), dt.date(2026, 9, 15), F.col("draft_id") == 5)
    assert [r.routed_source for r in found.orderBy("draft_id").collect()] == ["google", "cams", "merra2", "google", "merra2"]


def test_exceedance(spark):
    values = spark.createDataFrame([("PM25", 15.0), ("PM25", 15.1), ("PM10", None), ("TOTEXTTAU", 1.0)], "variable STRING, value DOUBLE")
    got = plans.exceedance(values, dimensions.guidelines(spark), "24h").collect()
    assert sorted((r.variable, r.value or 0, r.exceeds) for r in got) == [
        ("PM10", 0, None), ("PM25", 15.0, False), ("PM25", 15.1, True), ("TOTEXTTAU", 1.0, None)]
