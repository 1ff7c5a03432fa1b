"""Plan drafts: places, events, vocabulary, rules, links and captions.

A draft is ``(draft_id, intent, level, source, variable, place, time_start, time_end,
aggregation, colormap, mode, opacity, caption, error)``; columns other than the first eight
may be absent and then count as NULL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.functions import vocab
from cellgrid.functions.scalars import (
    box_error, canonical_variable, computed_once, iso_utc, micros, phrase_text, strip,
)
from cellgrid.operators.joins import lookup_join
from cellgrid.operators.traffic import question_cache

OPTIONAL = {"aggregation": "string", "colormap": "string", "mode": "string", "opacity": "double", "caption": "string", "error": "string"}
DAY_MICROS = 86_400_000_000


def with_optional(drafts: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in drafts.columns}
    return drafts.withColumns(missing) if missing else drafts


# --- places -------------------------------------------------------------------------
def known_places(gazetteer: DataFrame, n: int | None = None) -> DataFrame:
    """Place names in order, the first ``n`` of them."""
    names = gazetteer.select("name").distinct().orderBy("name")
    return names if n is None else names.limit(n)


def place_lookup(gazetteer: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(place_key, place_name, w, s, e, n)``: names and aliases in lower case.

    An alias overrides a name that is spelt the same; aliases of unknown places are dropped.
    """
    spot = [F.struct("name", "w", "s", "e", "n").alias("spot")]
    names = gazetteer.select(F.lower("name").alias("place_key"), F.lit(0).alias("rank"), *spot)
    others = aliases.join(gazetteer, aliases["canonical"] == gazetteer["name"]).select(
        F.col("alias").alias("place_key"), F.lit(1).alias("rank"), *spot
    )
    return (
        names.unionByName(others).groupBy("place_key")
        .agg(F.max_by("spot", F.struct("rank", "spot.name")).alias("spot"))
        .select("place_key", F.col("spot.name").alias("place_name"), "spot.w", "spot.s", "spot.e", "spot.n")
    )


def resolve_places(drafts: DataFrame, gazetteer: DataFrame, aliases: DataFrame) -> DataFrame:
    """Drafts with ``place_name, w, s, e, n`` and ``place_error`` for names that are not known."""
    first = known_places(gazetteer, 12).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ")).scalar()
    key = F.lower(strip("place"))
    found = lookup_join(drafts.withColumn("place_key", key), place_lookup(gazetteer, aliases), ["place_key"], "left")
    error = F.concat(F.lit("unknown place '"), strip("place"), F.lit("'; known places include "), first)
    return found.withColumn(
        "place_error", F.when(F.col("place_name").isNull() & F.col("place").isNotNull(), error)
    ).drop("place_key")


# --- words and events in questions --------------------------------------------------
def tag_aerosol_words(questions: DataFrame, text: str = "text") -> DataFrame:
    """Questions with ``phrase, variable, level`` of the longest trigger phrase they contain.

    Phrases match whole words; among equally long ones the first in order wins.  The
    vocabulary is fixed, so the search is one CASE over it, longest phrase first.
    """
    words = phrase_text(text)
    chain = None
    for phrase in sorted(vocab.TRIGGER_PHRASES, key=lambda p: (-len(p), p)):
        hit = words.contains(_plain_words(phrase))
        value = F.lit(phrase)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    tagged = questions.withColumn("phrase", chain)
    pick = lambda i: F.try_element_at(
        F.create_map(*[F.lit(x) for p, target in vocab.TRIGGER_PHRASES.items() for x in (p, target[i])]), F.col("phrase")
    )
    return tagged.withColumns({"variable": pick(0), "level": pick(1)})


def _plain_words(phrase: str) -> str:
    """A fixed phrase in the form of ``phrase_text``."""
    return " " + "".join(c if c.isalnum() else " " for c in phrase.lower()) + " "


def match_events(questions: DataFrame, events: DataFrame, text: str = "text", question: str = "question_id") -> DataFrame:
    """``(question_id, event_id, alias)``: events one of whose aliases occurs in the question.

    Aliases match whole words.  Questions meet aliases on an equal first word and the rest
    is checked on the pair, so no question is compared with every alias.
    """
    aliases = events.select(F.col("id").alias("event_id"), F.explode("aliases").alias("alias")).withColumn(
        "alias_text", phrase_text("alias")
    ).withColumn("word", F.split_part(F.ltrim("alias_text"), F.lit(" "), F.lit(1)))
    asked = questions.select(question, phrase_text(text).alias("asked"))
    words = asked.withColumn("word", F.explode(F.array_distinct(F.split(F.trim("asked"), " "))))
    pairs = lookup_join(words, aliases, ["word"], "inner").where(F.col("asked").contains(F.col("alias_text")))
    return pairs.groupBy(question, "event_id").agg(F.min("alias").alias("alias"))


def event_plans(matches: DataFrame, events: DataFrame, question: str = "question_id") -> DataFrame:
    """The suggested plans of every matched event, one row each."""
    plans = events.select(
        F.col("id").alias("event_id"), "bbox", "time_start", "time_end", F.posexplode("suggested_plans").alias("position", "plan")
    ).select("event_id", "position", "bbox", "time_start", "time_end", "plan.*")
    return lookup_join(matches.select(question, "event_id"), plans, ["event_id"], "inner")


# --- defaults and routing -----------------------------------------------------------
def apply_intent_defaults(drafts: DataFrame) -> DataFrame:
    """Level, source and aggregation by intent, where the draft leaves them open."""
    def default(i: int) -> Column:
        pairs = [F.lit(x) for intent, values in vocab.INTENT_DEFAULTS.items() for x in (intent, values[i])]
        return F.try_element_at(F.create_map(*pairs), F.col("intent"))

    return drafts.withColumns(
        {c: F.coalesce(F.col(c), default(i)) for i, c in enumerate(("level", "source", "aggregation"))}
    )


def route_source(plans: DataFrame, ref_date: dt.date, asks_kind: Column | None = None) -> DataFrame:
    """``routed_source`` by time and level.

    A question for the kind of aerosol always goes to the archive.  Otherwise a window that
    starts within 30 days of the reference date, or after it, is live; an older one is
    ``cams`` at the surface and the archive for the column.
    """
    recent = F.to_date("time_start") >= F.lit(ref_date - dt.timedelta(days=vocab.RECENT_DAYS))
    kind = F.lit(False) if asks_kind is None else asks_kind
    return plans.withColumn(
        "routed_source",
        F.when(kind, "merra2").when(recent, "google").when(F.col("level") == "surface", "cams").otherwise("merra2"),
    )


def style_for(plans: DataFrame, safety_question: Column | None = None) -> DataFrame:
    """``colormap, mode, opacity`` by intent; other intents keep the defaults."""
    safety = F.lit(False) if safety_question is None else safety_question
    return plans.withColumns({
        "colormap": F.when(F.col("intent") == "plume", "aod_sequential").otherwise(vocab.DEFAULT_COLORMAP),
        "mode": F.when((F.col("intent") == "health") & safety, "exceedance").otherwise(vocab.DEFAULT_MODE),
        "opacity": F.lit(vocab.DEFAULT_OPACITY),
    })


def plans_from_drafts(drafts: DataFrame, gazetteer: DataFrame, aliases: DataFrame) -> DataFrame:
    """Drafts with their box and canonical place name, or ``refusal``.

    A draft is refused that asks for the user's location, names no place, or names one that
    is not known.
    """
    resolved = resolve_places(with_optional(drafts), gazetteer, aliases)
    refusal = (
        F.when(F.col("error") == "need_location", "the question needs the user's location")
        .when(F.coalesce(strip("place"), F.lit("")) == "", "the draft names no place")
        .otherwise(F.col("place_error"))
    )
    box = F.when(F.col("place_name").isNotNull(), F.array("w", "s", "e", "n"))
    return resolved.withColumn("refusal", refusal).withColumn("bbox", box).drop(
        "place", "error", "place_error", "w", "s", "e", "n"
    )


# --- rules --------------------------------------------------------------------------
def with_plan_defaults(plans: DataFrame) -> DataFrame:
    """Canonical variable names and the defaults of optional plan fields."""
    return with_optional(plans).withColumns({
        "variable": canonical_variable("variable"),
        "aggregation": F.coalesce("aggregation", F.lit(vocab.DEFAULT_AGGREGATION)),
        "colormap": F.coalesce("colormap", F.lit(vocab.DEFAULT_COLORMAP)),
        "mode": F.coalesce("mode", F.lit(vocab.DEFAULT_MODE)),
        "opacity": F.coalesce("opacity", F.lit(vocab.DEFAULT_OPACITY)),
    })


def schema_errors(plans: DataFrame, allow_wrap: bool = False) -> Column:
    """Codes of all broken field rules of a plan or draft, in field order."""
    def one_of(name: str, allowed: tuple[str, ...]) -> Column:
        return F.when(~F.coalesce(F.col(name).isin(*allowed), F.lit(False)), name)

    rules = [
        one_of("intent", vocab.INTENTS), one_of("level", vocab.LEVELS), one_of("source", vocab.SOURCES),
        F.when(F.col("variable").isNull(), "variable"),
    ]
    if "place" in plans.columns:
        rules.append(F.when(F.col("place").isNotNull() & (strip("place") == ""), "place"))
    if "bbox" in plans.columns:
        w, s, e, n = (F.get("bbox", F.lit(i)) for i in range(4))
        broken = F.when(F.coalesce(F.array_size("bbox"), F.lit(0)) != 4, F.lit("bbox_format")).otherwise(box_error(w, s, e, n))
        if not allow_wrap:
            broken = F.when(broken.isNull() | (broken == "bbox_order"), F.when(~(w < e), "bbox_wrap").otherwise(broken)).otherwise(broken)
        rules.append(broken)
    rules += [
        F.when(F.col("time_start").isNull(), "time_start"),
        F.when(F.col("time_end").isNull() | (F.col("time_end") < F.col("time_start")), "time_end"),
        one_of("aggregation", vocab.AGGREGATIONS), one_of("mode", vocab.VIEW_MODES),
        F.when(~F.coalesce(F.col("opacity").between(0.0, 1.0), F.lit(False)), "opacity"),
    ]
    return F.array_compact(F.array(*rules))


def check_plan_schema(plans: DataFrame, allow_wrap: bool = False) -> DataFrame:
    """Plans (with ``bbox``) or drafts (with ``place``) with defaults filled and ``errors``."""
    filled = with_plan_defaults(plans)
    return filled.withColumn("errors", schema_errors(filled, allow_wrap))


def window_length(start: Column, end: Column) -> Column:
    """Days of a window as whole 24-hour stretches plus one."""
    return (F.floor((micros(end) - micros(start)) / DAY_MICROS) + 1).cast("long")


def plan_violation() -> Column:
    """The first hard rule a plan breaks, as a code; NULL for an executable plan."""
    column = F.col("variable").isin(*vocab.COLUMN_VARIABLES)
    surface = F.col("variable").isin(*vocab.SURFACE_VARIABLES)
    limit = F.create_map(*[F.lit(x) for pair in vocab.MAX_WINDOW_DAYS.items() for x in pair])
    days = window_length(F.col("time_start"), F.col("time_end"))
    return (
        F.when((F.col("intent") == "health") & (F.col("level") != "surface"), "health_level")
        .when((F.col("intent") == "health") & column, "health_variable")
        .when((F.col("level") == "surface") & column, "surface_variable")
        .when((F.col("level") == "column") & surface, "column_variable")
        .when(~F.coalesce(F.col("level").isin(*vocab.LEVELS), F.lit(False)), "level")
        .when(days > F.try_element_at(limit, F.col("aggregation")), "window_days")
    )


VIOLATION_TEXT = {
    "health_level": "a health question needs surface data; column optical depth never answers it",
    "health_variable": "a health question cannot use a column variable",
    "surface_variable": "the variable belongs to the column, not to the surface",
    "column_variable": "the variable belongs to the surface, not to the column",
    "level": "a plan has exactly one level, surface or column",
    "window_days": "the window is too long for its aggregation",
}


def violation_text(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in VIOLATION_TEXT.items() for x in pair]), code)


def validate_plans(plans: DataFrame) -> DataFrame:
    return plans.withColumn("violation", plan_violation())


# --- links, legends, captions -------------------------------------------------------
def data_url() -> Column:
    """Where a plan's data comes from; times carry a ``Z``, which survives a query string."""
    box = F.array_join(F.transform("bbox", lambda x: x.cast("string")), ",")
    grid = F.concat(
        F.lit("/grid?source=merra2&variable="), F.col("variable"), F.lit("&bbox="), box,
        F.lit("&t0="), iso_utc("time_start"), F.lit("&t1="), iso_utc("time_end"), F.lit("&agg="), F.col("aggregation"),
    )
    return (
        F.when(F.col("source") == "google", F.lit("google://heatmapTiles/{z}/{x}/{y}"))
        .when(F.col("source") == "merra2", grid)
        .when(F.col("source") == "cams", F.lit("cams://pending"))
    )


def legend_spec() -> Column:
    """``struct<units, stops, guideline>`` by level."""
    surface = F.col("level") == "surface"
    return F.struct(
        F.when(surface, vocab.LEGEND_UNITS["surface"]).otherwise(vocab.LEGEND_UNITS["column"]).alias("units"),
        F.when(surface, "aqi").otherwise("aod_sequential").alias("stops"),
        F.when(surface, "WHO 24h").alias("guideline"),
    )


def legend_stops(plans: DataFrame, colormaps: DataFrame, plan: str = "draft_id") -> DataFrame:
    """``(draft_id, units, position, t, hex)``: the stops of each plan's legend, in order."""
    named = plans.select(plan, legend_spec().alias("legend")).select(plan, "legend.units", F.col("legend.stops").alias("colormap"))
    return lookup_join(named, colormaps, ["colormap"], "inner").select(plan, "units", "position", "t", "hex")


def auto_caption() -> Column:
    """The caption, or one made of variable, place, days and source where it is empty."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    made = F.concat(
        F.col("variable"), F.lit(" over "), F.coalesce(F.nullif(F.col("place_name"), F.lit("")), F.lit("requested area")), F.lit(", "),
        day("time_start"), F.lit(".."), day("time_end"), F.lit(" ("), F.col("source"), F.lit(")"),
    )
    return F.coalesce(F.nullif(F.col("caption"), F.lit("")), made)


def exceedance(values: DataFrame, guidelines: DataFrame, period: str) -> DataFrame:
    """Values ``(variable, value, ...)`` with ``threshold`` and ``exceeds``; NULL stays NULL."""
    limits = guidelines.where(F.col("period") == period).select("variable", "threshold")
    return lookup_join(values, limits, ["variable"], "left").withColumn("exceeds", F.col("value") > F.col("threshold"))


# --- the whole way ------------------------------------------------------------------
def answer_plans(drafts: DataFrame, gazetteer: DataFrame, aliases: DataFrame) -> DataFrame:
    """Drafts to answers: ``status`` 200 with plan, link, legend and caption, or 422 with ``problem``.

    The first failure counts: refusal, then field rules, then hard rules.  One lookup join;
    everything else is row-wise.
    """
    plans = with_plan_defaults(plans_from_drafts(apply_intent_defaults(with_optional(drafts)), gazetteer, aliases))
    judged = computed_once(plans, errors=schema_errors(plans), violation=plan_violation())
    problem = (
        F.when(F.col("refusal").isNotNull(), F.col("refusal"))
        .when(F.size("errors") > 0, F.concat(F.lit("invalid fields: "), F.array_join("errors", ", ")))
        .otherwise(violation_text(F.col("violation")))
    )
    answered = computed_once(judged, problem=problem)
    good = F.col("problem").isNull()
    return answered.select(
        "draft_id", F.when(good, 200).otherwise(422).alias("status"), "problem",
        "intent", "level", "source", "variable", "bbox", "place_name", "time_start", "time_end", "aggregation",
        F.struct("colormap", "mode", "opacity").alias("style"),
        F.when(good, data_url()).alias("data_url"), F.when(good, legend_spec()).alias("legend"),
        F.when(good, auto_caption()).alias("caption"),
    )


def answer_questions(
    questions: DataFrame,
    drafts: DataFrame,
    gazetteer: DataFrame,
    aliases: DataFrame,
    events: DataFrame,
    ref_date: dt.date,
    asks_kind: Column | None = None,
    safety_question: Column | None = None,
) -> DataFrame:
    """Questions ``(question_id, text, scope, ts, ok)`` with their drafts, to answers.

    ``drafts`` hold the draft of each question under its id.  Adds ``cached`` (an earlier success
    answers it), ``event_ids`` of the catalogue events that the question names, and the plan's
    status, link, legend and caption.  A source that the draft leaves open is routed by time
    and level, an open style follows the intent.  The keys of both sides are unique, so the
    joins have no hot key.
    """
    asked = question_cache(questions).select("question_id", "key", F.col("hit").alias("cached"))
    named = match_events(questions, events).groupBy("question_id").agg(F.sort_array(F.collect_set("event_id")).alias("event_ids"))
    open_drafts = with_optional(drafts).withColumn("given_source", F.col("source"))
    routed = route_source(apply_intent_defaults(open_drafts), ref_date, asks_kind)
    routed = routed.withColumn("source", F.coalesce("given_source", "routed_source")).drop("given_source", "routed_source")
    given = {c: F.col(c).alias(f"given_{c}") for c in ("colormap", "mode", "opacity")}
    styled = style_for(routed.select("*", *given.values()), safety_question)
    styled = styled.withColumns({c: F.coalesce(f"given_{c}", c) for c in given}).drop(*[f"given_{c}" for c in given])
    answers = answer_plans(styled, gazetteer, aliases).withColumnRenamed("draft_id", "question_id")
    return asked.join(named, "question_id", "left").join(answers, "question_id", "left")
