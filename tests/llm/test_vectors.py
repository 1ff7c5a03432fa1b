"""Searches over vectors against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.llm import hard_negatives as hn
from cellgrid.llm.topk_search import best_of_tile, search
from cellgrid.llm.vectors import products

SCHEMA = "vec_id long, embedding array<float>, label int, row string, deal int, v string, shard int"


def odd_vectors(spark, rng, n, size=6):
    """Ties, copies, repeated ids, zero vectors, other lengths, nulls and non-finite components."""
    rows = []
    for i in range(n):
        x = [float(np.float32(rng.gauss(0, 1))) for _ in range(size)]
        x = rng.choice([x, x, [1.0] * size, [0.0] * size, [c * 10 for c in x], [round(c) / 4 for c in x], x[:3]])
        rows.append((i, x, rng.choice([0, 1, 1, 2, 9])))
    rows += [rows[3], (7, rows[8][1], 1), (None, [1.0] * size, 1), (100 * n, None, 1), (100 * n + 100, [None] * size, 1), (40, [], 1)]
    rows += [(200 * n, [float("nan")] + [0.0] * (size - 1), 0), (300 * n, [float("-inf")] * size, 0), (11, [2.0] * size, None)]
    return rows, spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(7)


def taking_part(rows, factor, labelled):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    return [(i, [int(np.floor(factor * x)) for x in v], label) for i, v, label in ok if not labelled or label is not None]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 3, "shard_rows": 5, "fan": 2}])
def test_topk_matches_all_pairs(spark, sizes):
    rows, df = odd_vectors(spark, random.Random(1), 90)
    known = taking_part(rows, 64, False)
    want = []
    for at, (i, v, _) in enumerate(known):
        if i % 5 == 0:
            best = sorted((-dot(v, w), j) for k, (j, w, _) in enumerate(known) if k != at and len(w) == len(v))[:8]
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    got = search(df, F.col("vec_id") % 5 == 0, 8, **sizes)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert search(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def plain_negatives(known, every, k, positives):
    want = []
    for at, (i, v, label) in enumerate(known):
        if i % every:
            continue
        near = [(-dot(v, w), j, other) for n, (j, w, other) in enumerate(known) if n != at and len(w) == len(v)]
        for s, j, _ in sorted(x for x in near if x[2] == label)[:positives]:
            inside = sorted(x[:2] for x in near if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:k]
            want += [(i, j, rank, other, -s, -t) for rank, (t, other) in enumerate(inside, 1)]
    return sorted(want)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 3, "shard_rows": 5, "fan": 2}])
def test_hard_negatives_match_all_pairs(spark, sizes):
    rows, df = odd_vectors(spark, random.Random(2), 120)
    want = plain_negatives(taking_part(rows, 256, True), 3, 4, 3)
    got = hn.hard_negatives(df, F.col("vec_id") % 3 == 0, F.col("label"), 4, 3, **sizes)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert hn.hard_negatives(df.limit(0), F.col("vec_id") % 3 == 0, F.col("label")).count() == 0


def test_coordinate_ranges_prune_and_lose_nothing():
    """In clusters most products are skipped, and what is found equals all pairs."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = np.floor(256 * (centres[rng.integers(0, 40, 6000)] + rng.normal(scale=0.02, size=(6000, 16)))).astype(np.int64)
    rows[::10] *= rng.integers(1, 4, 600)[:, None]
    ids, labels = rng.permutation(6000), rng.integers(0, 3, 6000)
    anchors, anchor_labels = rows[:50], labels[:50]
    scores = anchors @ rows.T
    low, high = scores.max(1) * 6 // 10, scores.max(1) * 9 // 10
    slots = hn.Slots(np.arange(50), low, high, 10)
    verified, all_pairs = hn.mine(anchors, anchor_labels, slots, rows, ids, labels, True, bucket_rows=500)
    for a in range(50):
        fit = (labels != anchor_labels[a]) & (scores[a] >= low[a]) & (scores[a] <= high[a])
        want = sorted(zip(-scores[a][fit], ids[fit]))[:10]
        assert list(zip(-slots.scores[a], slots.ids[a])) == want
    assert verified < 0.5 * all_pairs


def test_products_are_exact_at_any_size():
    for bound in (10, 10**5, 10**8, 3 * 10**8):
        a = np.random.default_rng(0).integers(-bound, bound, (5, 7))
        assert products(a, a).tolist() == [[dot(x, y) for y in a.tolist()] for x in a.tolist()]
    big = np.full((1, 2), 1 << 31)
    assert products(big, big[:, ::-1] * np.array([1, -1])).tolist() == [[0]]
    with pytest.raises(OverflowError):
        products(big, big)


def test_partial_selection_keeps_the_first_of_ties():
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 4, (200, 30))
    for k in (1, 5, 29, 30, 40):
        want = [sorted(sorted(range(30), key=lambda j: (-row[j], j))[:k]) for row in scores.tolist()]
        assert best_of_tile(scores, k).tolist() == want
