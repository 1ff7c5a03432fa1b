"""Small dimensions: from JSON files, or the fixed values that ship with the package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.functions import vocab
from cellgrid.functions.colour import hex_to_rgb
from cellgrid.functions.scalars import parse_utc_time

PLACE_SCHEMA = "name STRING, w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE"
PLAN_FIELDS = "source: STRING, level: STRING, intent: STRING, variable: STRING, aggregation: STRING"
EVENT_SCHEMA = (
    "id STRING, name STRING, aliases ARRAY<STRING>, bbox ARRAY<DOUBLE>, time_start STRING, time_end STRING, "
    f"suggested_plans ARRAY<STRUCT<{PLAN_FIELDS}>>"
)
RAMP_SCHEMA = "MAP<STRING, STRUCT<stops: ARRAY<ARRAY<STRING>>, units: STRING>>"


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """``(name, w, s, e, n)`` from ``{"places": [{"name", "bbox"}]}``."""
    raw = spark.read.schema("places ARRAY<STRUCT<name: STRING, bbox: ARRAY<DOUBLE>>>").json(path, multiLine=True)
    places = raw.select(F.inline("places"))
    return places.select("name", *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate("wsen")])


def read_event_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Events with times decoded and the suggested plans still nested."""
    raw = spark.read.schema(f"events ARRAY<STRUCT<{_nested(EVENT_SCHEMA)}>>").json(path, multiLine=True)
    return _decoded(raw.select(F.inline("events")))


def read_colormaps(spark: SparkSession, path: str) -> DataFrame:
    """``(colormap, position, t, r, g, b, units)`` from ``{name: {"stops": [[t, "#hex"]], "units"}}``."""
    ramps = (
        spark.read.text(path, wholetext=True)
        .select(F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias("colormap", "body"))
        .where(F.col("body").startswith("{"))
        .withColumn("ramp", F.from_json("body", "stops ARRAY<ARRAY<STRING>>, units STRING"))
        .select("colormap", F.col("ramp.units").alias("units"), F.posexplode("ramp.stops").alias("position", "stop"))
    )
    colour = hex_to_rgb(F.get("stop", F.lit(1)))
    return ramps.select(
        "colormap", "position", F.get("stop", F.lit(0)).try_cast("double").alias("t"),
        colour["r"].alias("r"), colour["g"].alias("g"), colour["b"].alias("b"), "units",
    )


def _nested(schema: str) -> str:
    """A column list written for use inside ``STRUCT<...>``."""
    out, depth = [], 0
    for part in schema.split(", "):
        out.append(part.replace(" ", ": ", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ", ".join(out)


def _decoded(events: DataFrame) -> DataFrame:
    return events.withColumn("time_start", parse_utc_time("time_start")).withColumn(
        "time_end", parse_utc_time("time_end")
    )


# --- shipped fixed values -----------------------------------------------------------
def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(vocab.GAZETTEER), PLACE_SCHEMA)


def place_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(vocab.PLACE_ALIASES.items()), "alias STRING, canonical STRING")


def event_catalog(spark: SparkSession) -> DataFrame:
    rows = [(i, n, list(a), list(b), t0, t1, [tuple(p) for p in plans]) for i, n, a, b, t0, t1, plans in vocab.EVENT_CATALOG]
    return _decoded(spark.createDataFrame(rows, EVENT_SCHEMA))


def guidelines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(vocab.GUIDELINES), "variable STRING, period STRING, threshold DOUBLE, unit STRING")


def intent_defaults(spark: SparkSession) -> DataFrame:
    rows = [(intent, *values) for intent, values in vocab.INTENT_DEFAULTS.items()]
    return spark.createDataFrame(
        rows, "intent STRING, default_level STRING, default_source STRING, default_aggregation STRING"
    )


def colormaps(spark: SparkSession) -> DataFrame:
    """Stops of every shipped ramp: ``(colormap, position, t, hex)``."""
    ramps = {**vocab.RENDER_RAMPS, **vocab.LEGEND_RAMPS}
    rows = [(name, i, t, colour) for name, stops in ramps.items() for i, (t, colour) in enumerate(stops)]
    return spark.createDataFrame(rows, "colormap STRING, position INT, t DOUBLE, hex STRING")


def trigger_phrases(spark: SparkSession) -> DataFrame:
    rows = [(phrase, *target) for phrase, target in vocab.TRIGGER_PHRASES.items()]
    return spark.createDataFrame(rows, "phrase STRING, variable STRING, level STRING")
