"""Chunk references as a data source: files that a filter excludes are not planned, chunks not parsed into rows."""

from __future__ import annotations

import datetime as dt
import json
import operator
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

NAME = "chunk_refs"
SCHEMA = "path STRING, day DATE, variable STRING, ct INT, cy INT, cx INT, url STRING, offset BIGINT, length BIGINT"
ARROW = pa.schema([
    ("path", pa.string()), ("day", pa.date32()), ("variable", pa.string()), ("ct", pa.int32()), ("cy", pa.int32()),
    ("cx", pa.int32()), ("url", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
CHUNK_KEY = re.compile(r"([^/]+)/(\d+)\.(\d+)\.(\d+)")
DAY = re.compile(r"(?<!\d)(\d{4})-?(\d{2})-?(\d{2})(?!\d)")
PARTITION_BYTES = 32 << 20  # reference files of about so many bytes are one partition
BATCH_ROWS = 50_000
COMPARE = {
    ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge,
    ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le, ds.In: lambda x, values: x in values,
}
PER_FILE, PER_CHUNK = ("path", "day"), ("variable", "ct", "cy", "cx")


def day_of(name: str) -> dt.date | None:
    """The first date in a file's path below the folder that was loaded."""
    for found in DAY.findall(name):
        try:
            return dt.date(*map(int, found))
        except ValueError:
            continue
    return None


@dataclass
class Files(ds.InputPartition):
    files: list[tuple[str, dt.date | None]]


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


class ChunkRefReader(ds.DataSourceReader):
    """``day`` and ``path`` are decided per file while the scan is planned, the rest per chunk."""

    def __init__(self, path: str, partition_bytes: int) -> None:
        self.path, self.partition_bytes = path, partition_bytes
        self.tests: dict[str, list[tuple[type, object]]] = {}

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for given in filters:
            column = given.attribute[0] if len(getattr(given, "attribute", ())) == 1 else None
            if isinstance(given, ds.IsNotNull) and column in PER_CHUNK:
                continue  # never null
            if type(given) in COMPARE and column in PER_FILE + PER_CHUNK:
                self.tests.setdefault(column, []).append((type(given), given.value))
            else:
                yield given

    def passes(self, column: str, value: object) -> bool:
        """Whether every pushed condition on ``column`` holds; a missing value meets none."""
        tests = self.tests.get(column, ())
        return all(value is not None and COMPARE[kind](value, bound) for kind, bound in tests)

    def partitions(self) -> list[Files]:
        """Reference files that may hold wanted chunks, packed by size.

        The driver lists the folder, as it does for any table of files; it opens none.
        """
        system, root = file_system(self.path)
        kept, size = [Files([])], 0
        for info in sorted(system.get_file_info(pafs.FileSelector(root, recursive=True)), key=lambda f: f.path):
            below = info.path[len(root):].lstrip("/")
            hidden = any(part.startswith(("_", ".")) for part in below.split("/"))
            day = day_of(below)
            if not info.is_file or hidden or not self.passes("day", day) or not self.passes("path", info.path):
                continue
            if kept[-1].files and size + info.size > self.partition_bytes:
                kept.append(Files([]))
                size = 0
            kept[-1].files.append((info.path, day))
            size += info.size
        return kept

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        columns: list[list] = [[] for _ in ARROW.names]
        wanted: dict[str, bool] = {}
        for path, day in partition.files:
            with system.open_input_stream(path) as stream:
                refs = json.loads(stream.read()).get("refs") or {}
            for key, entry in refs.items():
                found = CHUNK_KEY.fullmatch(key)
                if not found or not isinstance(entry, list) or not entry or not isinstance(entry[0], str):
                    continue
                variable = found.group(1)
                if variable not in wanted:
                    wanted[variable] = self.passes("variable", variable)
                if not wanted[variable]:
                    continue
                at = [int(n) for n in found.groups()[1:]]
                if not all(map(self.passes, ("ct", "cy", "cx"), at)):
                    continue
                offset, length = entry[1:3] if len(entry) == 3 else (None, None)
                for column, value in zip(columns, (path, day, variable, *at, entry[0], offset, length)):
                    column.append(value)
                if len(columns[0]) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types)], schema=ARROW)
                    columns = [[] for _ in ARROW.names]
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types)], schema=ARROW)


class ChunkRefSource(ds.DataSource):
    """``spark.read.format("chunk_refs").load(folder)``: remote chunks ``VAR/t.y.x`` of reference files.

    ``day`` is the first date in a file's path below the folder, NULL where there is none.
    Option ``partitionBytes`` bounds the reference text of one partition (one file at least).
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChunkRefReader:
        return ChunkRefReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))


def read_chunks(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Chunks of the reference files under ``path`` through the data source, with pushed filters on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkRefSource)
    return spark.read.format(NAME).option("partitionBytes", partition_bytes).load(path)


def within(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """``chunks`` that some request's variable, days and chunk numbers could meet, as pushed filters.

    ``ranges`` are as for ``chunk_refs.prune_chunks``, with ``day`` in place of ``path``.  One row of
    bounds reaches the driver, and the variables asked for (as many as the archive has at most).
    """
    floor = lambda axis, end: F.floor(F.col(f"{axis}_{end}") / F.col(f"{axis}_len")).cast("int")
    asked = ranges.agg(
        F.min("day").alias("first"), F.max("day").alias("last"), F.collect_set("variable").alias("variables"),
        *[F.min(floor(a, "lo")).alias(f"{a}_lo") for a in "tyx"], *[F.max(floor(a, "hi")).alias(f"{a}_hi") for a in "tyx"],
    ).first()
    if asked["first"] is None:
        return chunks.where("false")
    near = F.col("day").between(F.lit(asked["first"]), F.lit(asked["last"])) & F.col("variable").isin(asked["variables"])
    for axis in "tyx":
        near &= F.col(f"c{axis}").between(asked[f"{axis}_lo"], asked[f"{axis}_hi"])
    return chunks.where(near)
