"""Chunk reference files: which bytes of which file hold which chunk of which variable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrid.functions import vocab
from cellgrid.operators.joins import salted_join

REMOTE_ENTRY = r'^\s*\["[^"]*"(\s*,\s*\d+\s*,\s*\d+)?\s*\]\s*$'
CHUNK_KEY = r"^([^/]+)/(\d+)\.(\d+)\.(\d+)$"
RANGES_IN_PART = 20_000  # ranges of one file and variable beyond which they are split; each is compared with all chunks there
ZARRAY = "shape ARRAY<BIGINT>, chunks ARRAY<BIGINT>, dtype STRING"


def chunk_refs(texts: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """Reference JSON texts as ``(path, position, key, inline, url, offset, length)``.

    An entry is inline text or ``[url, offset, length]``; ``position`` keeps the file's order.
    """
    entries = texts.select(
        F.col(path).alias("path"),
        F.posexplode(F.from_json(text, "refs MAP<STRING, STRING>")["refs"]).alias("position", "key", "entry"),
    )
    remote = F.col("entry").rlike(REMOTE_ENTRY)
    parts = F.from_json("entry", "ARRAY<STRING>")
    return entries.select(
        "path", "position", "key",
        F.when(~remote, F.col("entry")).alias("inline"),
        F.when(remote, F.get(parts, 0)).alias("url"),
        F.when(remote, F.get(parts, 1).try_cast("long")).alias("offset"),
        F.when(remote, F.get(parts, 2).try_cast("long")).alias("length"),
    )


def read_chunk_refs(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return chunk_refs(texts)


def remote_scheme(refs: DataFrame, collection: str = "collection") -> DataFrame:
    """``(collection, scheme)``: ``https`` or ``s3`` by the first remote target, NULL if all are local."""
    found = F.regexp_extract(F.coalesce("url", "inline"), r"^(s3|https?)://", 1)
    scheme = F.when(found == "s3", "s3").when(found != "", "https")
    return refs.groupBy(collection).agg(
        F.min_by(scheme, F.when(scheme.isNotNull(), F.struct("path", "position"))).alias("scheme")
    )


def item_size(dtype: Column) -> Column:
    """Bytes per value; the byte-order mark is ignored and unknown types count as 4."""
    table = F.create_map(*[F.lit(x) for pair in vocab.ITEM_SIZES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.regexp_replace(dtype, r"^[<>|=]", "")), F.lit(4)).cast("long")


def chunk_report(refs: DataFrame) -> DataFrame:
    """Chunk sizes of every data variable of every reference file."""
    product = lambda values: F.aggregate(values, F.lit(1).cast("long"), lambda a, x: a * x)
    arrays = (
        refs.where(F.col("key").endswith("/.zarray") & F.col("inline").isNotNull())
        .withColumn("variable", F.split_part("key", F.lit("/"), F.lit(1)))
        .where(~F.col("variable").isin(*vocab.COORDINATE_NAMES))
        .withColumn("meta", F.from_json("inline", ZARRAY))
    )
    counts = F.zip_with("meta.shape", "meta.chunks", lambda s, c: F.ceil(s / c).cast("long"))
    return (
        arrays.withColumn("chunk_bytes", item_size(F.col("meta.dtype")) * product(F.col("meta.chunks")))
        .withColumn("n_chunks", product(counts))
        .select(
            "path", "variable", F.array_join(F.col("meta.chunks").cast("array<string>"), "x").alias("chunks"),
            "chunk_bytes", "n_chunks", (F.col("chunk_bytes") * F.col("n_chunks") / 1e6).alias("total_mb"),
        )
    )


def chunk_index(refs: DataFrame) -> DataFrame:
    """Remote chunks with the variable and chunk numbers read from keys ``VAR/t.y.x``."""
    part = lambda i: F.regexp_extract("key", CHUNK_KEY, i)
    return refs.where(F.col("key").rlike(CHUNK_KEY) & F.col("url").isNotNull()).select(
        "path", part(1).alias("variable"), part(2).cast("int").alias("ct"), part(3).cast("int").alias("cy"),
        part(4).cast("int").alias("cx"), "url", "offset", "length",
    )


def prune_chunks(refs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Chunks that each request has to fetch.

    ``ranges`` has ``request_id, path, variable``, inclusive index ranges ``t_lo..t_hi, y_lo..y_hi,
    x_lo..x_hi`` and chunk lengths ``t_len, y_len, x_len``.  A range becomes the chunk numbers it
    touches, which is exactly the answer; it meets the references of its file and variable.
    """
    return prune_index(chunk_index(refs), ranges)


def prune_index(index: DataFrame, ranges: DataFrame, file: str = "path") -> DataFrame:
    """``prune_chunks`` for an index of chunks, whose column ``file`` says where they are, as in ``ranges``.

    A range meets the chunks of its file and variable, and the chunk numbers are compared there: it
    is one row, however many chunks it touches.  Only a request with several ranges in a file and
    variable may ask for a chunk twice; those are taken apart, chunk by chunk, and put together.
    """
    keys, numbers = [file, "variable"], ["ct", "cy", "cx"]
    ends = [f"{c}_{end}" for c in numbers for end in ("lo", "hi")]
    touched = {f"c{a}_{end}": F.floor(F.col(f"{a}_{end}") / F.col(f"{a}_len")).cast("int") for a in "tyx" for end in ("lo", "hi")}
    asked = ranges.withColumns(touched).select("request_id", *keys, *ends).dropna(subset=ends).distinct()
    asked = asked.withColumn("ranges", F.count(F.lit(1)).over(Window.partitionBy("request_id", *keys)))
    apart = asked.where("ranges > 1")
    for c in numbers:
        apart = apart.withColumn(c, F.explode(F.sequence(f"{c}_lo", f"{c}_hi")))
    apart = apart.select("request_id", *keys, *numbers).distinct()
    apart = apart.select("request_id", *keys, *[F.col(c).alias(f"{c}_{end}") for c in numbers for end in ("lo", "hi")])
    wanted = asked.where("ranges = 1").select("request_id", *keys, *ends).unionByName(apart)
    met = salted_join(wanted, index, keys, spread=F.xxhash64("request_id"), min_rows=RANGES_IN_PART)
    for c in numbers:
        low, high = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        met = met.where(F.col(c).between(F.least(low, high), F.greatest(low, high)))
    return met.select(*keys, *numbers, "request_id", *[c for c in index.columns if c not in (*keys, *numbers)])


def bytes_to_read(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("length").alias("bytes_to_read")
    )
