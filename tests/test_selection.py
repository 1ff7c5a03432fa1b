"""Percentiles by brackets against numpy, with ties, hot values and many rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.operators import selection
from cellgrid.operators.render import exact_range, normalize_range
from cellgrid.operators.selection import exact_percentiles


@pytest.fixture(scope="module")
def groups(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    values = {
        "smooth": rng.normal(size=30_000), "skewed": np.exp(rng.normal(size=20_000) * 4),
        "third": np.where(rng.random(30_000) < 0.34, 7.0, rng.normal(size=30_000) * 10),
        "two": np.repeat([1.0, 2.0], 10_000), "same": np.full(5_000, -3.0), "one": np.array([4.5]), "pair": np.array([1.0, 2.0]),
    }
    path = str(tmp_path_factory.mktemp("groups"))
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("none", None), ("one", None)]
    spark.createDataFrame(rows, "k string, x double").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), values


@pytest.mark.parametrize("bracket_rows", [10**9, 500, 1])
def test_equal_to_numpy(groups, bracket_rows):
    rows, values = groups
    quantiles = (0.0, 0.02, 0.5, 0.98, 1.0)
    got = {(r.k, r.q): r.percentile for r in exact_percentiles(rows, "k", "x", quantiles, bracket_rows).collect()}
    assert set(got) == {(k, q) for k in values for q in quantiles}
    for (k, q), found in got.items():
        assert found == pytest.approx(np.quantile(values[k], q), abs=1e-9, rel=1e-12), (k, q)


def test_a_cut_narrows_and_is_confirmed(groups):
    rows, values = groups
    rows = rows.select("k", F.col("x").alias("v")).where("v IS NOT NULL AND k = 'smooth'")
    start = selection._start(rows, "k", (0.02, 0.98))
    for r in selection._cut(rows, start, "k").collect():
        inside = values["smooth"][(values["smooth"] >= r.lo) & (values["smooth"] <= r.hi)]
        assert r.held == len(inside) < 300 and r.below == (values["smooth"] < r.lo).sum()
        assert r.below <= r["first"] and r.below + r.held > r["last"]


def test_a_wrong_sketch_changes_nothing(groups, monkeypatch):
    """Bounds that do not hold the percentile are refused by the count."""
    rows, values = groups
    monkeypatch.setattr(selection.F, "percentile_approx", lambda v, shares, accuracy: F.array(*[F.max(v)] * (selection.GRID + 1)))
    got = {r.q: r.percentile for r in exact_percentiles(rows.where("k = 'smooth'"), "k", "x", (0.02, 0.5), 500).collect()}
    assert got == {q: pytest.approx(np.quantile(values["smooth"], q), rel=1e-12) for q in (0.02, 0.5)}


def test_range_as_of_small_fields(spark, groups):
    odd = spark.createDataFrame([("inf", float("inf")), ("inf", 1.0), ("nan", float("nan"))], "request_id string, value double")
    field = groups[0].toDF("request_id", "value").unionByName(odd)
    want = {r.request_id: r for r in normalize_range(field).collect()}
    got = {r.request_id: r for r in exact_range(field, bracket_rows=500).collect()}
    assert set(got) == set(want) and {k for k, r in got.items() if r.empty} == {"none", "nan"}
    for k, r in got.items():
        assert tuple(r)[1:4] == pytest.approx(tuple(want[k])[1:4], abs=1e-9)
    assert exact_range(field.limit(0)).count() == 0
