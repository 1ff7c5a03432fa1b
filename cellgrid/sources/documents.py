"""Nested grid documents and their inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.functions import vocab
from cellgrid.functions.scalars import grid_value


def _dense(entries: str, position: str, size: str, payload: str, filler: str) -> str:
    """SQL of sparse ``(position, payload)`` entries as an array of ``size``, gaps filled.

    A full row, the usual case, is only sorted; a sparse one looks its entries up.
    """
    table = f"map_from_entries(transform({entries}, q -> struct(q.{position}, q.{payload})))"
    return (
        f"IF(size({entries}) = {size}, transform(sort_array({entries}), q -> q.{payload}), "
        f"transform(sequence(0, {size} - 1), i -> coalesce(try_element_at({table}, i), {filler})))"
    )


def grid_values(block_cells: DataFrame, request: str = "request_id") -> DataFrame:
    """``(request_id, rows)`` from ``(request_id, by, bx, value)``: rows collected in two levels.

    A group is one row of a capped field, then the rows of one field: 360 by 180 values at
    the default cap, whatever the size of the input.
    """
    return (
        block_cells.groupBy(request, "by")
        .agg(F.collect_list(F.struct("bx", grid_value("value").alias("value"))).alias("cells"))
        .groupBy(request)
        .agg(F.collect_list(F.struct("by", "cells")).alias("rows"))
    )


def grid_documents(block_cells: DataFrame, blocks: DataFrame, request: str = "request_id") -> DataFrame:
    """One nested document per field.

    ``blocks`` holds a row per request with the coarse axes (``out_lats``, ``out_lons``,
    ``oy``, ``ox``, ``downsampled``) and the request's own columns ``variable, agg, start_time,
    end_time, time_steps_used``.  Latitude ascends, longitude keeps slice order, values have
    four decimals and NULL where missing.
    """
    docs = blocks.join(grid_values(block_cells, request), request, "left")
    # a grid row without any cell is an empty list of cells, which fills up with NULLs
    cells = "array<struct<bx:int,value:double>>"
    docs = docs.withColumn("rows", F.expr(f"coalesce(rows, CAST(array() AS array<struct<by:int,cells:{cells}>>))"))
    dense_rows = _dense("rows", "by", "oy", "cells", f"CAST(array() AS {cells})")
    values = f"transform({dense_rows}, c -> {_dense('c', 'bx', 'ox', 'value', 'CAST(NULL AS DOUBLE)')})"
    iso = "yyyy-MM-dd\'T\'HH:mm:ss\'Z\'"
    return docs.selectExpr(
        request, "variable", f"'{vocab.FIELD_UNITS}' AS units", "transform(out_lats, x -> round(x, 4)) AS lats",
        "transform(out_lons, x -> round(x, 4)) AS lons", f"{values} AS values", "ox AS nx", "oy AS ny",
        f'date_format(start_time, "{iso}") AS time_start', f'date_format(end_time, "{iso}") AS time_end',
        "time_steps_used", "agg AS aggregation", "downsampled", f"'{vocab.ARCHIVE_SOURCE}' AS source",
    )


def document_json(docs: DataFrame, request: str = "request_id") -> DataFrame:
    """Documents as JSON text with explicit nulls, ready for a text sink."""
    body = [c for c in docs.columns if c != request]
    return docs.select(request, F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("document"))


def document_error(lats: Column, lons: Column, values: Column) -> Column:
    """What is wrong with a document's shape, NULL if nothing is."""
    odd = F.filter(
        F.transform(values, lambda row, i: F.struct(i.alias("row"), F.coalesce(F.array_size(row), F.lit(0)).alias("n"))),
        lambda x: x["n"] != F.size(lons),
    )
    first = F.get(odd, 0)
    return (
        F.when(lats.isNull() | lons.isNull() | values.isNull(), F.lit("document needs lats, lons and values"))
        .when(
            F.size(values) != F.size(lats),
            F.format_string("values has %d rows, expected %d", F.size(values), F.size(lats)),
        )
        .when(
            F.size(odd) > 0,
            F.format_string("values row %d has %d columns, expected %d", first["row"], first["n"], F.size(lons)),
        )
    )


def explode_grid_documents(docs: DataFrame, request: str = "request_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents back to cells ``(request_id, iy, ix, lat, lon, value, error)`` and kept columns.

    A document of the wrong shape gives a single row that holds the error.
    """
    checked = docs.withColumn("error", document_error(F.col("lats"), F.col("lons"), F.col("values")))
    rows = F.when(F.col("error").isNull(), F.col("values"))
    return (
        checked.select(request, *keep, "lats", "lons", "error", F.posexplode_outer(rows).alias("iy", "row"))
        .select(request, *keep, "lats", "lons", "error", "iy", F.posexplode_outer("row").alias("ix", "value"))
        .select(
            request, *keep, "iy", "ix", F.get("lats", F.col("iy")).alias("lat"), F.get("lons", F.col("ix")).alias("lon"),
            "value", "error",
        )
    )
