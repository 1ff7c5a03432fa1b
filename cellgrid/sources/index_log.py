"""The granule index as a log of commits: several builders add to it at once and none loses entries."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.sources.granules import manifest_key, pending_granules

ENTRY_SCHEMA = "key STRING, ref_name STRING, position BIGINT"
COMMIT_SCHEMA = "version BIGINT, kind STRING, folder STRING, as_of BIGINT, writer STRING, epoch BIGINT"
COMPACT_EVERY = 50  # commits; a snapshot opens at most about so many folders


@dataclass(frozen=True)
class Commit:
    """``folder`` holds entries: what was added at ``as_of``, or all of the index up to it."""

    version: int
    kind: str  # 'add' or 'compact'
    folder: str
    as_of: int
    writer: str | None = None
    epoch: int | None = None


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a whole small file unless ``path`` exists; False where it does.

    The text goes to a file of its own name first and gets its final name by a step that fails
    if that is taken: a hard link on a local disk, a rename without overwriting elsewhere.  The
    latter is atomic on HDFS and what Spark's own stream logs rely on; an object store whose
    rename is a copy needs a committing connector.
    """
    spare = f"{path}.{uuid.uuid4()}.new"
    local = re.fullmatch(r"(?:file:)?(/.*)", path)
    if local:
        path, spare = local.group(1), re.sub(r"^file:", "", spare)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(spare, "w", encoding="utf-8") as file:
            file.write(text)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(spare, path)
        except FileExistsError:
            return False
        finally:
            os.remove(spare)
        return True
    return _renamed(spark, path, spare, text)


def _renamed(spark: SparkSession, path: str, spare: str, text: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(spare), hadoop.Path(path)
    files = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(source, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    kind = getattr(hadoop, "Options$Rename")
    try:
        files.rename(source, target, spark.sparkContext._gateway.new_array(kind, 0))
    except Exception:  # a Java error of any file system; only a taken name is an answer
        system.delete(source, False)
        if system.exists(target):
            return False
        raise
    return True


class IndexLog:
    """An index ``key -> ref_name`` under ``path``: folders of entries, and the commits that name them.

    A commit is the file of the next version number, which only one builder can create; the
    other reads what came meanwhile and takes the next one.  Entries are never rewritten, so a
    snapshot of an earlier version stays readable, and a folder that no commit names (of a
    builder that failed) is never read.
    """

    def __init__(self, spark: SparkSession, path: str, compact_every: int = COMPACT_EVERY) -> None:
        self.spark, self.path, self.compact_every = spark, path.rstrip("/"), compact_every

    def commits(self, version: int | None = None) -> list[Commit]:
        """Commits in order, up to ``version``; none where the index does not exist yet."""
        try:
            rows = self.spark.read.schema(COMMIT_SCHEMA).option("pathGlobFilter", "*.json").json(f"{self.path}/log").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        found = sorted((Commit(*row) for row in rows), key=lambda c: c.version)
        return [c for c in found if version is None or c.version <= version]

    def version(self) -> int:
        """Number of the last commit, 0 for an empty index."""
        return max((c.version for c in self.commits()), default=0)

    def snapshot(self, version: int | None = None) -> DataFrame:
        """``(key, ref_name)`` as of ``version``: of equal keys the latest commit and position wins."""
        commits = self.commits(version)
        base = max((c for c in commits if c.kind == "compact"), key=lambda c: c.as_of, default=None)
        since = base.as_of if base else 0
        used = ([base] if base else []) + [c for c in commits if c.kind == "add" and c.as_of > since]
        return self._rows(used).groupBy("key").agg(F.max_by("ref_name", F.struct("as_of", "position", "ref_name")).alias("ref_name"))

    def _rows(self, used: list[Commit]) -> DataFrame:
        if not used:
            return self.spark.createDataFrame([], f"{ENTRY_SCHEMA}, as_of BIGINT")
        rows = self.spark.read.schema(ENTRY_SCHEMA).parquet(*[f"{self.path}/entries/{c.folder}" for c in used])
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/entries/([^/]+)/", 1)
        order = F.create_map(*[F.lit(x) for c in used for x in (c.folder, c.as_of)])
        return rows.withColumn("as_of", F.element_at(order, folder).cast("long"))

    def add(self, entries: DataFrame, writer: str | None = None, epoch: int | None = None) -> int:
        """Commit ``entries (key, ref_name, position)`` and give their version.

        With a ``writer`` and an ``epoch`` it happens once: if the log has that pair already, its
        version is returned and nothing is added.
        """
        done = self._of_epoch(writer, epoch)
        return done or self._commit("add", self._written(entries), writer=writer, epoch=epoch)

    def build(
        self, candidates: DataFrame, build: Callable[[DataFrame], None] | None = None,
        writer: str | None = None, epoch: int | None = None,
    ) -> int:
        """Build what the index lacks of ``candidates (url)`` and commit it.

        Candidates whose reference file the snapshot names are left out; the rest are written as
        entries, once, and given to ``build`` as a table ``(key, ref_name, position)``, which
        writes their reference files.  An error in it leaves the index as it was.
        """
        done = self._of_epoch(writer, epoch)
        if done:
            return done
        pending = pending_granules(candidates.select("url").distinct(), self.snapshot())
        folder = self._written(pending.select(manifest_key("url").alias("key"), "ref_name", F.lit(0).alias("position")))
        if build is not None:
            build(self.spark.read.schema(ENTRY_SCHEMA).parquet(f"{self.path}/entries/{folder}"))
        return self._commit("add", folder, writer=writer, epoch=epoch)

    def compact(self) -> int:
        """Put the index as it is now into one folder, for later snapshots to start from."""
        as_of = self.version()
        rows = self.snapshot(as_of).withColumn("position", F.lit(0))
        return self._commit("compact", self._written(rows), as_of)

    def _of_epoch(self, writer: str | None, epoch: int | None) -> int | None:
        if writer is None or epoch is None:
            return None
        return next((c.version for c in self.commits() if (c.writer, c.epoch) == (writer, epoch)), None)

    def _written(self, entries: DataFrame) -> str:
        folder = str(uuid.uuid4())
        entries.select("key", "ref_name", F.col("position").cast("long")).write.parquet(f"{self.path}/entries/{folder}")
        return folder

    def _commit(self, kind: str, folder: str, as_of: int | None = None, writer: str | None = None, epoch: int | None = None) -> int:
        while True:
            commits = self.commits()
            twin = [c.version for c in commits if epoch is not None and (c.writer, c.epoch) == (writer, epoch)]
            if twin:  # another attempt at this epoch was faster
                return twin[0]
            version = max((c.version for c in commits), default=0) + 1
            record = Commit(version, kind, folder, version if as_of is None else as_of, writer, epoch)
            if put_if_absent(self.spark, f"{self.path}/log/{version:020d}.json", json.dumps(record.__dict__)):
                break
        if kind == "add" and version % self.compact_every == 0:
            self.compact()
        return version
