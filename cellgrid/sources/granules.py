"""Granule listings and the index manifest: ``(day, ref_name)``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.functions import vocab
from cellgrid.functions.scalars import as_col

MANIFEST_SCHEMA = "collection STRING, prefix STRING, files MAP<STRING, STRING>"


def granule_url(day: Column | str, base: str, collection: str) -> Column:
    """``<base>/YYYY/MM/<prefix>.<collection>.YYYYMMDD.nc4`` of a day."""
    day = as_col(day)
    return F.concat(
        F.lit(f"{base.rstrip('/')}/"), F.date_format(day, "yyyy/MM"),
        F.lit(f"/{vocab.GRANULE_PREFIX}.{collection}."), F.date_format(day, "yyyyMMdd"), F.lit(vocab.GRANULE_SUFFIX),
    )


def calendar_days(first: Column, last: Column) -> Column:
    """Days ``first..last``, both included; no day where the range is empty."""
    return F.explode(F.when(first <= last, F.sequence(first, last)))


def granule_calendar(spark: SparkSession, base: str, collection: str, start: dt.date, end: dt.date) -> DataFrame:
    """One granule URL per day, both ends included, without listing any storage."""
    days = spark.range(1).select(calendar_days(F.lit(start), F.lit(end)).alias("day"))
    return days.withColumn("url", granule_url("day", base, collection))


def list_granules(
    spark: SparkSession, prefix: str, limit: int | None = None, pattern: str = f"*{vocab.GRANULE_SUFFIX}"
) -> DataFrame:
    """Files below ``prefix`` in path order, the first ``limit`` of them: ``(path, length)``.

    Only file metadata is selected, so no file is opened.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(prefix).select("path", "length")
    )
    return first_n_granules(files, limit) if limit is not None else files.orderBy("path")


def first_n_granules(files: DataFrame, n: int) -> DataFrame:
    """The first ``n`` files by path (each task keeps its own first n, then they merge)."""
    return files.orderBy("path").limit(n)


def granule_date(path: Column | str) -> Column:
    """Day in the file name, NULL where there is none or it is no date."""
    digits = F.regexp_extract(as_col(path), vocab.GRANULE_DATE_PATTERN, 1)
    return F.when(digits != "", F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd"))))


def with_granule_date(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("day", granule_date(path))


def reference_name(path: Column | str) -> Column:
    """Name of the reference file of a granule: its stem with ``.json``."""
    return F.concat(F.regexp_extract(as_col(path), r"([^/]*?)(\.[^./]*)?$", 1), F.lit(".json"))


# --- manifest -----------------------------------------------------------------------
ISO_KEY = r"^\d{4}-\d{2}-\d{2}$"


def manifest_entries(texts: DataFrame, text: str = "value") -> DataFrame:
    """``(key, ref_name)`` of manifest JSON texts."""
    return texts.select(F.explode(F.from_json(text, MANIFEST_SCHEMA)["files"]).alias("key", "ref_name"))


def manifest_rows(texts: DataFrame, text: str = "value") -> DataFrame:
    """``(day, ref_name)`` of manifest JSON texts; keys that are no ISO date are skipped."""
    files = manifest_entries(texts, text)
    return (
        files.withColumn("day", F.when(F.col("key").rlike(ISO_KEY), F.col("key").try_cast("date")))
        .where(F.col("day").isNotNull()).select("day", "ref_name")
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_rows(spark.read.text(path, wholetext=True))


def pending_granules(candidates: DataFrame, indexed: DataFrame) -> DataFrame:
    """Candidates ``(url)`` whose reference file is not among ``indexed (ref_name)`` yet."""
    return candidates.withColumn("ref_name", reference_name("url")).join(
        indexed.select("ref_name").distinct(), "ref_name", "left_anti"
    )


def manifest_key(url: Column | str) -> Column:
    """ISO day of a granule, or its URL where the name holds no date."""
    return F.coalesce(granule_date(url).cast("string"), as_col(url))


def merge_manifest(manifest: DataFrame, built: DataFrame) -> DataFrame:
    """Manifest ``(key, ref_name)`` with ``built (url, ref_name, position)`` put in.

    A built entry replaces one with the same key, and a later one replaces an earlier one.
    One aggregation with map-side combine; no window over a key's history.
    """
    old = manifest.select("key", "ref_name", F.lit(0).alias("is_new"), F.lit(0).cast("long").alias("position"))
    new = built.select(
        manifest_key("url").alias("key"), "ref_name", F.lit(1).alias("is_new"), F.col("position").cast("long")
    )
    return old.unionByName(new).groupBy("key").agg(
        F.max_by("ref_name", F.struct("is_new", "position", "ref_name")).alias("ref_name")
    )


def write_manifest(entries: DataFrame, path: str, collection: str, prefix: str) -> None:
    """``(key, ref_name)`` as JSON ``{collection, prefix, files}`` under ``path``, replacing what is there.

    One file per year of ISO keys, and 64 for all other keys, so that no file or task holds a
    long index whole; ``read_manifest`` takes them together.
    """
    part = F.when(F.col("key").rlike(ISO_KEY), F.substring("key", 1, 4)).otherwise(
        F.concat(F.lit("other-"), F.pmod(F.hash("key"), F.lit(64)).cast("string"))
    )
    files = F.map_from_entries(F.collect_list(F.struct("key", "ref_name"))).alias("files")
    texts = entries.groupBy(part.alias("part")).agg(files).select(
        "part", F.to_json(F.struct(F.lit(collection).alias("collection"), F.lit(prefix).alias("prefix"), "files")).alias("value")
    )
    texts.write.mode("overwrite").partitionBy("part").text(path)


def build_index(
    candidates: DataFrame,
    old_path: str | None,
    new_path: str,
    collection: str,
    prefix: str,
    build: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """One resumable step of an index: returns the ``(url, ref_name)`` that had to be built.

    Candidates ``(url)`` without a reference file in the manifest at ``old_path`` go to ``build``,
    which writes their reference files; then all candidates are merged into the manifest and
    it is written to ``new_path``, another folder, so that a run that fails leaves the old
    one as it was.
    """
    spark = candidates.sparkSession
    if old_path is None:
        old = spark.createDataFrame([], "key STRING, ref_name STRING")
    else:
        old = manifest_entries(spark.read.text(old_path, wholetext=True))
    pending = pending_granules(candidates.select("url").distinct(), old)
    if build is not None:
        build(pending)
    named = candidates.select("url", reference_name("url").alias("ref_name"), F.lit(0).alias("position"))
    write_manifest(merge_manifest(old, named), new_path, collection, prefix)
    return pending
