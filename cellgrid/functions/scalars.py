"""Scalar functions: names, boxes, times, questions, addresses and number text."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.functions import vocab

BLANKS = " \t\n\r\x0b\x0c"
NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_MINUTES = r"([T ]\d{2}:\d{2})(Z|[+-]|$)"
ISO_ZONED = r"(Z|[+-]\d{2}:\d{2})$"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.btrim(as_col(value), F.lit(BLANKS))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that the optimizer may not inline into later filters and projections.

    Costly expressions that many rules refer to would otherwise be copied into each of
    them, until the generated code outgrows what the JVM compiles.  A one-row generator is
    a boundary that expressions do not cross.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of a small fixed table, NULL where the key is not in it."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


# --- variables ----------------------------------------------------------------------
def canonical_variable(name: Column | str) -> Column:
    """Trimmed upper-case name with older spellings replaced."""
    upper = F.upper(strip(name))
    return F.coalesce(lookup(upper, vocab.VARIABLE_ALIASES), upper)


def servable_variable(name: Column | str) -> Column:
    """True where the canonical name is one of the served column variables."""
    return canonical_variable(name).isin(*vocab.COLUMN_VARIABLES)


def pretty_variable(name: Column | str) -> Column:
    return F.coalesce(lookup(F.upper(as_col(name)), vocab.DISPLAY_NAMES), as_col(name))


# --- boxes and times ----------------------------------------------------------------
def box_error(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Reason code of the first broken box rule, NULL for a good box (w > e wraps)."""
    return (
        F.when(w.isNull() | s.isNull() | e.isNull() | n.isNull(), F.lit("bbox_format"))
        .when(~(w.between(-180, 180) & e.between(-180, 180)), F.lit("bbox_longitude"))
        .when(~(s.between(-90, 90) & n.between(-90, 90)), F.lit("bbox_latitude"))
        .when(~(s < n), F.lit("bbox_order"))
    )


def box_numbers(text: Column | str) -> tuple[Column, Column, Column, Column]:
    """The four numbers of ``'w,s,e,n'``, NULL where the text is not four numbers."""
    parts = F.split(as_col(text), ",")

    def number(position: int) -> Column:
        part = strip(F.get(parts, position))
        return F.when((F.size(parts) == 4) & part.rlike(NUMBER), part.try_cast("double"))

    return tuple(number(i) for i in range(4))


def parse_bbox(text: Column | str) -> Column:
    """``'w,s,e,n'`` as ``struct<w,s,e,n,error>``."""
    w, s, e, n = box_numbers(text)
    return F.struct(
        w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n"), box_error(w, s, e, n).alias("error")
    )


def parse_utc_time(text: Column | str) -> Column:
    """ISO-8601 text as a UTC ``TIMESTAMP_NTZ``; naive text is UTC, a bare date is midnight.

    The result does not depend on the session time zone.  NULL where the text is not in one
    of the accepted forms (date, optional ``T`` or space time, fraction, ``Z`` or offset).
    """
    text = as_col(text)
    with_seconds = F.regexp_replace(text, ISO_MINUTES, "$1:00$2")
    zoned = (
        F.when(~text.rlike(ISO_TIME), F.lit(None))
        .when(text.rlike(ISO_DATE), F.concat(text, F.lit("T00:00:00Z")))
        .when(text.rlike(ISO_ZONED), with_seconds)
        .otherwise(F.concat(with_seconds, F.lit("Z")))
    )
    local = F.try_to_timestamp(zoned).cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)


def iso_utc(time: Column | str) -> Column:
    """A UTC time as ISO text with a ``Z``, safe inside a query string."""
    return F.date_format(as_col(time), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def micros(time: Column | str) -> Column:
    """Microseconds of a UTC ``TIMESTAMP_NTZ``, whatever the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), as_col(time))


# --- values -------------------------------------------------------------------------
def grid_value(value: Column | str) -> Column:
    """Missing as NULL, otherwise four decimals."""
    value = as_col(value)
    return F.when(~F.isnan(value), F.round(value, 4))


def _exact_product(a: Column, b: Column) -> tuple[Column, Column]:
    """``a * b`` as a rounded product and its rounding error, exactly."""
    def halves(x: Column) -> tuple[Column, Column]:
        wide = x * F.lit(134217729.0)
        high = wide - (wide - x)
        return high, x - high

    product = a * b
    (a_high, a_low), (b_high, b_low) = halves(a), halves(b)
    return product, ((a_high * b_high - product) + a_high * b_low + a_low * b_high) + a_low * b_low


def _below_half(value: Column, four_digits: Column) -> Column:
    """True where a value prints as a half of its third digit but is a little less than that."""
    size = F.abs(value)
    digits = F.regexp_replace(F.regexp_extract(four_digits, r"([0-9.]+)e", 1), r"\.", "").try_cast("double")
    power = F.regexp_extract(four_digits, r"e([+-][0-9]+)$", 1).try_cast("int") - 3
    small, small_error = _exact_product(size, F.pow(F.lit(10.0), -power))
    large, large_error = _exact_product(digits, F.pow(F.lit(10.0), power))
    rest = F.when(power < 0, (small - digits) + small_error).otherwise((size - large) - large_error)
    is_half = (digits % 10 == 5) & (four_digits.try_cast("double") == value) & power.between(-22, 22)
    return F.coalesce(is_half & (rest < 0), F.lit(False))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def format_tick(value: Column | str) -> Column:
    """Three significant digits without trailing zeros; an en dash where not finite.

    Plain decimals run from 1e-6 up to 1e21 and exponent form applies outside, as number
    text does in the browser.
    """
    def rounded(x: Column) -> Column:
        # rounded half up on the exact value: the formatter rounds the shortest decimal text,
        # which lies on the other side only where that text is itself a half
        return _once(F.format_string("%.3e", x), lambda four: F.when(
            _below_half(x, four), F.regexp_replace(four, "5e", "e")
        ).otherwise(F.format_string("%.2e", x)))

    def spelled(short: Column, power: Column) -> Column:
        mantissa = F.regexp_replace(F.regexp_extract(short, r"^(-?[0-9.]+)e", 1), r"\.?0+$", "")
        plain = F.regexp_replace(
            F.regexp_replace(F.format_string("%.10f", short.try_cast("double")), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""
        )
        signed = F.concat(F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.abs(power).cast("string"))
        return F.when((power < -6) | (power > 20), F.concat(mantissa, F.lit("e"), signed)).otherwise(plain)

    def tick(x: Column) -> Column:
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
        power = lambda short: F.regexp_extract(short, r"e([+-][0-9]+)$", 1).try_cast("int")
        text = _once(rounded(x), lambda short: spelled(short, power(short)))
        return F.when(~finite, F.lit("–")).when(x == 0, F.lit("0")).otherwise(text)

    return _once(as_col(value).cast("double"), tick)


# --- questions and clients ----------------------------------------------------------
def normalize_question(text: Column | str) -> Column:
    """Lower case, trimmed, white space runs collapsed, then punctuation dropped.

    Word characters are letters, digits and underscore of any script; a plain ``\\w`` would
    be ASCII only here.
    """
    spaced = F.regexp_replace(strip(F.lower(as_col(text))), r"[\s\p{Z}]+", " ")
    return F.regexp_replace(spaced, r"[^\p{L}\p{N}_\s]", "")


def question_key(text: Column | str, scope: Column | str) -> Column:
    """Hash of the normalised question and its date-and-place scope."""
    return F.sha2(F.concat(normalize_question(text), F.char(F.lit(0)), as_col(scope)), 256)


def phrase_text(text: Column | str) -> Column:
    """Text as `` word word ``: lower-case words with one blank around each."""
    return F.concat(
        F.lit(" "), F.regexp_replace(F.lower(as_col(text)), r"[^\p{L}\p{N}]+", " "), F.lit(" ")
    )


def client_ip(forwarded_for: Column | str, peer: Column | str) -> Column:
    """First forwarded address, else the peer, else ``unknown``."""
    first = strip(F.get(F.split(as_col(forwarded_for), ","), 0))
    return F.coalesce(F.nullif(first, F.lit("")), as_col(peer), F.lit("unknown"))


def grid_title(units: Column, start: Column, end: Column, aggregation: Column) -> Column:
    """``units · d0 → d1 · aggregation``, leaving out an equal or missing second day."""
    first = F.substring(F.coalesce(start, F.lit("")), 1, 10)
    last = F.substring(F.coalesce(end, F.lit("")), 1, 10)
    span = F.when((last == "") | (last == first), first).otherwise(F.concat(first, F.lit(" → "), last))
    tail = F.when(F.coalesce(aggregation, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit(" · "), aggregation)
    )
    return F.concat(F.coalesce(units, F.lit("")), F.lit(" · "), span, tail)
