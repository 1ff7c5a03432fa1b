"""The index log: builders at once, snapshots, and listings as a stream."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from cellgrid.sources import index_log
from cellgrid.sources.index_log import IndexLog, put_if_absent
from cellgrid.streaming.listing import index_listing


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), "key STRING, ref_name STRING, position BIGINT")


def urls(spark, *names):
    return spark.createDataFrame([(f"s3://b/{n}.nc4",) for n in names], "url STRING")


def content(log, version=None):
    return {row.key: row.ref_name for row in log.snapshot(version).collect()}


def test_only_one_creates_a_file(spark, tmp_path):
    path = str(tmp_path / "log" / "1.json")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: put_if_absent(spark, path, f"text {k}"), range(16)))
    assert won.count(True) == 1
    assert (tmp_path / "log" / "1.json").read_text() == f"text {won.index(True)}"
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["1.json"]


def test_a_rename_does_not_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/1.json"
    assert index_log._renamed(spark, path, f"{path}.a.new", "first")
    assert not index_log._renamed(spark, path, f"{path}.b.new", "second")
    assert (tmp_path / "1.json").read_text() == "first"
    assert not list(tmp_path.glob("*.new"))


def test_an_empty_index(spark, tmp_path):
    log = IndexLog(spark, str(tmp_path / "none"))
    assert log.version() == 0 and content(log) == {}
    assert log.add(entries(spark)) == 1 and content(log) == {}


def test_latest_commit_then_position_wins(spark, tmp_path):
    log = IndexLog(spark, str(tmp_path))
    log.add(entries(spark, ("a", "a9", 9), ("b", "b1", 1), ("b", "b2", 2), ("b", "b2", 2)))
    log.add(entries(spark, ("a", "a0", 0), (None, "n", 0)))
    assert content(log) == {"a": "a0", "b": "b2", None: "n"}
    assert content(log, 1) == {"a": "a9", "b": "b2"}


def test_builders_at_once_lose_nothing(spark, tmp_path):
    def builder(name):
        log = IndexLog(spark, str(tmp_path))
        return [log.add(entries(spark, (f"{name}{k}", f"{name}{k}.json", 0))) for k in range(4)]

    with ThreadPoolExecutor(3) as pool:
        versions = [v for own in pool.map(builder, "xyz") for v in own]
    assert sorted(versions) == list(range(1, 13))
    assert set(content(IndexLog(spark, str(tmp_path)))) == {f"{n}{k}" for n in "xyz" for k in range(4)}


def test_a_builder_keeps_what_another_commits_while_it_builds(spark, tmp_path):
    mine, other = IndexLog(spark, str(tmp_path)), IndexLog(spark, str(tmp_path))
    mine.build(urls(spark, "a.20240101", "b.20240102"), lambda table: other.build(urls(spark, "c.20240103", "loose")))
    assert content(mine) == {
        "2024-01-01": "a.20240101.json", "2024-01-02": "b.20240102.json", "2024-01-03": "c.20240103.json", "s3://b/loose.nc4": "loose.json"}
    seen = []
    mine.build(urls(spark, "a.20240101", "d.20240104"), lambda table: seen.extend(r.key for r in table.collect()))
    assert seen == ["2024-01-04"]


def test_a_taken_version_is_tried_again(spark, tmp_path, monkeypatch):
    log, tried = IndexLog(spark, str(tmp_path)), []

    def raced(spark, path, text):
        if not tried:  # another builder takes the version between reading the log and this call
            put_if_absent(spark, path, json.dumps({**json.loads(text), "folder": IndexLog(spark, str(tmp_path))._written(entries(spark, ("z", "z", 0)))}))
        tried.append(path)
        return put_if_absent(spark, path, text)

    monkeypatch.setattr(index_log, "put_if_absent", raced)
    assert log.add(entries(spark, ("a", "a", 0))) == 2
    assert len(tried) == 2 and content(log) == {"a": "a", "z": "z"}


def test_compacting_changes_no_snapshot(spark, tmp_path):
    log = IndexLog(spark, str(tmp_path), compact_every=3)
    for k in range(5):
        log.add(entries(spark, (f"k{k}", f"v{k}", 5), ("same", f"v{k}", -k)))
    kinds = [c.kind for c in log.commits()]
    assert kinds == ["add", "add", "add", "compact", "add", "add", "compact"]
    assert content(log) == {**{f"k{k}": f"v{k}" for k in range(5)}, "same": "v4"}
    assert content(log, 2) == {"k0": "v0", "k1": "v1", "same": "v1"}
    files = {f.split("/entries/")[1].split("/")[0] for f in log.snapshot().inputFiles()}
    assert len(files) == 1  # the last compacted folder alone


def test_an_add_during_compaction_stays_newer(spark, tmp_path):
    log = IndexLog(spark, str(tmp_path))
    log.add(entries(spark, ("a", "old", 0)))
    folder = log._written(log.snapshot(1).selectExpr("key", "ref_name", "0 AS position"))
    log.add(entries(spark, ("a", "new", 0)))
    log._commit("compact", folder, as_of=1)
    assert content(log) == {"a": "new"} and log.version() == 3


def test_an_epoch_is_committed_once(spark, tmp_path):
    log = IndexLog(spark, str(tmp_path))
    built = []
    for _ in range(2):
        version = log.build(urls(spark, "a"), lambda table: built.append(table.count()), writer="w", epoch=0)
    assert version == 1 and built == [1] and log.version() == 1
    assert log.build(urls(spark, "b"), writer="other", epoch=0) == 2
    assert log.add(entries(spark, ("c", "c", 0)), writer="w", epoch=0) == 1


def test_a_listing_goes_on_after_a_failed_batch(spark, tmp_path):
    for part in (["a", "b"], ["b", "c"], ["c", "d", "a"]):
        urls(spark, *part).coalesce(1).write.mode("append").parquet(str(tmp_path / "listing"))
    log, built, failing = IndexLog(spark, str(tmp_path / "index")), [], [True]

    def build(table):
        names = sorted(r.ref_name for r in table.collect())
        if built and failing:
            failing.clear()
            raise ValueError("no disk")
        built.append(names)

    def run():
        stream = spark.readStream.schema("url STRING").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "listing"))
        index_listing(stream, log, str(tmp_path / "state"), build=build).awaitTermination()

    with pytest.raises(Exception, match="no disk"):
        run()
    assert log.version() == 1
    run()
    assert sorted(n for names in built for n in names) == ["a.json", "b.json", "c.json", "d.json"]
    assert sorted(content(log).values()) == ["a.json", "b.json", "c.json", "d.json"]
    assert [(c.writer, c.epoch) for c in log.commits()] == [("listing", k) for k in range(3)]
