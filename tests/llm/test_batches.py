"""Size of the batches in which whole texts pass between Spark and Python."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellgrid.llm import secret_scan, toxicity
from cellgrid.llm.common import BATCH_BYTES, SLICE_BYTES, map_batches, slices

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def as_given(spark):
    spark.conf.unset(BATCH_BYTES)
    yield
    spark.conf.unset(BATCH_BYTES)


def many_texts(spark):
    """30 MB of texts in one partition, in fewer rows than Spark's own bound of a batch."""
    return spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 950).alias("text"))


def test_mapped_batches_are_small(spark):
    def run(batch: pa.RecordBatch) -> dict[str, list]:
        return {"n": [batch.num_rows], "size": [batch.nbytes]}

    found = map_batches(many_texts(spark), run, "n long, size long").collect()
    assert sum(r.n for r in found) == 3000
    assert max(r.size for r in found) <= 2 * SLICE_BYTES


def test_scored_batches_are_small(spark, monkeypatch):
    def checked(batch):
        assert batch.nbytes <= 2 * SLICE_BYTES
        return slices(batch)

    monkeypatch.setattr(toxicity, "slices", checked)
    none = (np.zeros(0, np.int64), np.zeros(0))
    kept = toxicity.ordinary_only(many_texts(spark), toxicity.SpellingModel([none, none]), threshold=2.0)
    assert kept.agg(F.sum(F.length("text"))).first()[0] == 3000 * 950 * 11


def test_masked_batches_are_small(spark):
    model = secret_scan.MarkovModel(np.zeros((secret_scan.STATES, secret_scan.STATES)))
    secret_scan.redact(many_texts(spark), model)
    assert int(spark.conf.get(BATCH_BYTES)) == SLICE_BYTES


def test_the_sessions_own_value_stays(spark):
    spark.conf.set(BATCH_BYTES, "32m")
    map_batches(many_texts(spark), lambda batch: {"n": [1]}, "n long")
    assert spark.conf.get(BATCH_BYTES) == "32m"


def test_batches_do_not_change_the_pipeline(spark):
    found = []
    for size in ("64m", "20000"):
        spark.conf.set(BATCH_BYTES, size)
        found.append(sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())))
    assert found[0] and found[0] == found[1]
