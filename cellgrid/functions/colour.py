"""Colour ramps as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.functions import vocab
from cellgrid.functions.scalars import as_col, computed_once

Stops = Sequence[tuple[float, str]]
HEX_COLOUR = r"(?i)^#[0-9a-f]{6}$"


def hex_to_rgb(text: Column | str) -> Column:
    """``#rrggbb`` as ``struct<r,g,b,error>``; the error names text that is no colour."""
    text = as_col(text)
    good = text.rlike(HEX_COLOUR)

    def channel(start: int) -> Column:
        return F.when(good, F.conv(F.substring(text, start, 2), 16, 10).cast("int"))

    return F.struct(
        channel(2).alias("r"), channel(4).alias("g"), channel(6).alias("b"),
        F.when(~F.coalesce(good, F.lit(False)), F.concat(F.lit("not a colour: "), F.coalesce(text, F.lit("null"))))
        .alias("error"),
    )


def _channels(colour: str) -> tuple[int, ...]:
    return tuple(bytes.fromhex(colour[1:]))


def _clamped(t: Column) -> Column:
    return F.when(t.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _mix(levels: Column, at: Column, share: Column) -> Column:
    """Level between two neighbouring stops, rounded half up."""
    low = F.get(levels, at)
    return F.floor(low + (F.get(levels, at + 1) - low) * share + 0.5).cast("int")


def sample_colormap(stops: Stops, t: Column | str) -> Column:
    """Colour at ``t`` (clamped to 0..1) on one ramp, as ``struct<r,g,b>``; NULL for NULL."""
    x = _clamped(as_col(t))
    positions = _numbers([position for position, _ in stops])
    # how many inner stops lie before x is the number of its interval
    at = F.size(F.filter(_numbers([position for position, _ in stops[1:-1]]), lambda p: p < x))
    low, high = F.get(positions, at), F.get(positions, at + 1)
    share = F.coalesce((x - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
    rgb = zip(*[_channels(colour) for _, colour in stops])
    return F.when(
        x.isNotNull(), F.struct(*[_mix(_numbers(levels), at, share).alias(name) for name, levels in zip("rgb", rgb)])
    )


def with_ramp_colour(df: DataFrame, colormap: Column, t: Column, ramps: Mapping[str, Stops] = vocab.RENDER_RAMPS) -> DataFrame:
    """Adds ``r, g, b`` at ``t`` on the ramp named in ``colormap``; NULL where ``t`` is NULL.

    All ramps share one array per channel, and the position in it is worked out in steps
    that are each computed once.  One expression would repeat those steps at every use, in
    a method too long for the JIT.
    """
    stops = [stop for ramp in ramps.values() for stop in ramp]
    first, before, offset = None, None, 0
    for name, ramp in ramps.items():
        passed = sum((F.when(F.col("ramp_x") > F.lit(p), 1).otherwise(0) for p, _ in ramp[1:-1]), F.lit(offset))
        first = F.when(colormap == name, F.lit(offset)) if first is None else first.when(colormap == name, F.lit(offset))
        is_ramp = F.col("ramp_first") == offset
        before = F.when(is_ramp, passed) if before is None else before.when(is_ramp, passed)
        offset += len(ramp)
    positions = _numbers([position for position, _ in stops])
    found = computed_once(df, ramp_x=_clamped(t), ramp_first=first)
    found = computed_once(found, ramp_at=F.when(F.col("ramp_x").isNotNull(), before))
    low, high = F.get(positions, F.col("ramp_at")), F.get(positions, F.col("ramp_at") + 1)
    share = F.coalesce((F.col("ramp_x") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
    found = computed_once(found, ramp_share=share)
    rgb = zip(*[_channels(colour) for _, colour in stops])
    mixed = [_mix(_numbers(levels), F.col("ramp_at"), F.col("ramp_share")).alias(c) for c, levels in zip("rgb", rgb)]
    return found.select(*df.columns, *mixed)


def colormap_for(variable: Column | str) -> Column:
    """``dust`` for dust variables, ``viridis`` otherwise."""
    return F.when(F.upper(as_col(variable)).contains("DU"), F.lit("dust")).otherwise(F.lit("viridis"))


def gradient_text(stops: Stops) -> str:
    """A ramp as gradient text with one-decimal percent positions."""
    parts = ", ".join(f"{colour} {position * 100:.1f}%" for position, colour in stops)
    return f"linear-gradient(to right, {parts})"


def legend_gradient(colormap: Column | str) -> Column:
    """Gradient text of a named ramp; unknown names get the default ramp."""
    chain = None
    for name, stops in vocab.RENDER_RAMPS.items():
        text = F.lit(gradient_text(stops))
        chain = F.when(as_col(colormap) == name, text) if chain is None else chain.when(as_col(colormap) == name, text)
    return chain.otherwise(F.lit(gradient_text(vocab.RENDER_RAMPS["viridis"])))
