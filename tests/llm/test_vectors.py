"""Clustering and hard negatives against plain versions in whole numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from portrel.llm import clustering, hard_negatives

TOP = 2**63 - 1


def _clean(v, dims=None):
    return v is not None and len(v) > 0 and (dims is None or len(v) == dims) and all(x is not None and math.isfinite(x) for x in v)


def _lloyd(rows, k, dims, rounds=10, scale=1024):
    kept = [(i, [max(-(2**53), min(2**53, math.floor(scale * x))) for x in v]) for i, v in rows if _clean(v, dims)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    total = {c: sum(d for _, n, d in out if n == c) for c in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, n, min(TOP, d), min(TOP, total[n]), min(TOP, sum(total.values())), sha[n]) for i, n, d in out), key=str)


def _vectors(seed=5, n=240, dims=6):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=dims) + 3 * (i % 4)).tolist()) for i in range(n)]
    rows += [(n + i, [0.25] * dims) for i in range(n)]  # half of all rows are one vector
    rows += [(3, rows[9][1]), (None, rows[8][1]), (None, [9.0] * dims), (5, rows[5][1])]  # ids that repeat, no id, a repeated row
    return rows + [(9001, None), (9002, []), (9003, [None] * dims), (9004, [float("nan")] * dims), (9005, [float("inf")] * dims), (9006, [1.0] * (dims + 1))]


@pytest.mark.parametrize("k", [1, 3, 8])
def test_clusters(spark, k):
    rows = _vectors()
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<double>, v int, cluster string, n double").repartition(5)
    got, cents = clustering.cluster(df, k, 6)
    assert len(cents) == k
    assert sorted((tuple(r) for r in got.collect()), key=str) == _lloyd(rows, k, 6)


@pytest.mark.parametrize("size", [1e5, 1e9, 1e300])
def test_clusters_of_large_components(spark, size):
    """Exact beyond what a double can hold; distances that no long can hold are its greatest value."""
    rows = [(i, [size * ((i * 7) % 5 - 2), float(i), -size * i]) for i in range(40)]
    got, _ = clustering.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4, 3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _lloyd(rows, 4, 3)


def test_clusters_of_few_and_none(spark):
    assert clustering.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"))[0].count() == 0
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    got, _ = clustering.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 8, 2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _lloyd(rows, 8, 2)


def _mine(rows, positives=5, negatives=3):
    clean = [(i, la, [max(-(2**1023), math.floor(256 * x)) if abs(x) < 1e300 else int(x) for x in v]) for i, la, v in rows if i is not None and la is not None and _clean(v)]
    score = lambda a, b: max(-TOP, min(TOP, sum(x * y for x, y in zip(a, b, strict=True))))
    out = []
    anchors = {}
    for i, la, v in clean:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (v, la)), (v, la))
    for a, (v, la) in anchors.items():
        scored = sorted((-score(v, w), j, lb) for j, lb, w in clean if j != a and len(w) == len(v))
        for p, j, _ in [x for x in scored if x[2] == la][:positives]:
            fits = [(n, m) for n, m, lb in scored if lb != la and 50 * -p <= 100 * -n <= 95 * -p][:negatives]
            out += [(a, j, r, m, -p, -n) for r, (n, m) in enumerate(fits, 1)]
    return sorted(out)


def _labelled(seed, n, dims, labels, spread=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(labels)), (spread * rng.normal(size=dims) + (i % 3)).tolist()) for i in range(n)]
    rows += [(n + i, 1, rows[4][2]) for i in range(n // 3)]  # ties
    rows += [(7, 1, rows[7][2]), (100, 0, rows[3][2]), (None, 1, rows[1][2]), (20001, None, rows[1][2]), (20002, 1, None), (20003, 1, []), (20050, 1, [float("nan")] * dims), (20100, 1, [None] * dims)]
    return rows + [(20150, 1, [1.0, 0.5]), (20151, 1, [1.0, 0.25]), (20152, 0, [0.5, 0.25])]  # other lengths


@pytest.mark.parametrize(("dims", "labels", "group"), [(1, 3, 64), (6, 2, 1), (16, 40, 2)])
def test_hard_negatives(spark, monkeypatch, dims, labels, group):
    monkeypatch.setattr(hard_negatives, "VECTOR_BLOCK", 32)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    monkeypatch.setattr(hard_negatives, "LABEL_PARTS", 4)
    rows = _labelled(dims, 320, dims, labels)
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "vec_id long, label int, embedding array<double>, part int, ids string").repartition(4)
    got = hard_negatives.mine(df, F.col("vec_id") % 50 == 0, F.col("label"))
    assert sorted(map(tuple, got.collect())) == _mine(rows)


@pytest.mark.parametrize("size", [1e4, 1e9, 1e307])
def test_hard_negatives_of_large_components(spark, size):
    rows = [(i, i % 3, [size * math.sin(i) if i % 5 == 0 else math.sin(i), math.cos(3 * i)]) for i in range(120)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 50 == 0, F.col("label"))
    assert sorted(map(tuple, got.collect())) == _mine(rows)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(df, F.col("vec_id") % 50 == 0, F.col("label")).count() == 0
    alone = spark.createDataFrame([(50, 1, [1.0]), (51, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(alone, F.col("vec_id") % 50 == 0, F.col("label")).count() == 0


def test_planes_keep_what_qualifies():
    """Intervals never lose a pair, whatever the bounds and signs."""
    rng = np.random.default_rng(1)
    for turn in range(60):
        q, x = (np.floor(rng.normal(size=(n, 5)) * 10 ** (turn % 5)) for n in (7, 150))
        score = (q @ x.T).astype(np.int64)
        floor, ceiling = np.sort(rng.choice(score.ravel(), (2, 7)), axis=0)
        alive = rng.random(score.shape) < (0.9 if turn % 2 else 0.1)
        a, c, s = hard_negatives.sliced(q, x, alive.copy(), floor, ceiling)
        want = alive & (score >= floor[:, None]) & (score <= ceiling[:, None])
        assert set(zip(a.tolist(), c.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True)) and (s == score[a, c]).all()
        a, c, s = hard_negatives.sliced(q, x, alive.copy(), np.full(7, -TOP - 1), np.full(7, TOP), 4)
        for row in range(7):
            assert sorted(s[a == row])[-4:] == sorted(score[row][alive[row]])[-4:]
