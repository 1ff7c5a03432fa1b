"""Helpers that several text operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.session import work_folder

# The six characters that separate words: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` of ``docs``, whatever its other columns are named; a null text is empty."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


SLICE_BYTES = 1 << 22
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Whole texts pass between Spark and Python in batches of some ``SLICE_BYTES``, or of one row.

    Spark's own bounds (10,000 rows, 64 MB) let a batch of texts take tens of MB, which each task holds
    in its executor and again in its Python worker, and memory once taken is hardly given back.
    A value that the session has set itself stays.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(SLICE_BYTES))


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``most`` bytes of ``text``, or of one row."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(low, high - low)
        low = high


def map_batches(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], Iterator[dict[str, list]] | dict[str, list]],
    schema: str,
    sliced: bool = False,
) -> DataFrame:
    """``function`` on each Arrow batch of ``df``; it returns columns by name, once or several times.

    With ``sliced`` it gets few texts at a time, for output that is much larger than its input.
    """
    spark = df.sparkSession
    small_batches(spark)
    arrow = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch) if sliced else [batch]:
                made = function(part)
                for columns in [made] if isinstance(made, dict) else made:
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def built(shared: Broadcast, build: Callable[[dict], object]) -> object:
    """``build`` of a broadcast dict of plain values, once per Python worker.

    Functions travel by value, but a broadcast is unpickled where this package may be missing, so
    it must hold no class of it.
    """
    plain = shared.value
    if "_built" not in plain:
        plain["_built"] = build(plain)
    return plain["_built"]


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared work folder and read back: lineage ends here."""
    path = f"{work_folder(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A file of the installed public vocabularies."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
