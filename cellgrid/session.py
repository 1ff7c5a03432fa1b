"""Session settings the operators are written for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def get_spark(app_name: str = "cellgrid", master: str | None = None, **conf: str) -> SparkSession:
    """Session in UTC with ANSI mode and adaptive execution on.

    On a cluster pass no ``master``: it comes from spark-submit.  The number of shuffle
    partitions is only a ceiling there, since adaptive execution coalesces small ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables and stream checkpoints.

    It lies under the shared folder that the cluster names in ``spark.checkpoint.dir``, so
    that a lost executor loses nothing.  Where that is unset, a session on one machine (tests, a
    laptop) takes a local temporary folder; on a cluster its executors would each write to a
    disk of their own, so there it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        return tempfile.mkdtemp(prefix=f"cellgrid-{name}-")
    return f"{shared.rstrip('/')}/cellgrid-{name}-{uuid.uuid4()}"


def written(df: DataFrame, name: str, seen: Observation | None = None, **metrics: Column) -> DataFrame:
    """``df`` as a table in a new work folder: computed once, with a short plan and known size.

    For tables that several parts of a plan share and that are small beside the cells.
    ``metrics`` are collected into ``seen`` while the table is written, at no extra job.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark, name)}/table"
    rows = df if seen is None else df.observe(seen, *[value.alias(key) for key, value in metrics.items()])
    rows.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
