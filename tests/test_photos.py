"""Whole-image operators and the frontier against plain versions: sizes, borders, strips, beams and faults."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from portrel.operators import contours, frontier, strips

KEY = ["image"]


def image_lines(spark, images, *names):
    """Lines of {image: (channels, height, width) array}."""
    rows = [(k, y, v.shape[1], *[v[c, y].tolist() for c in range(len(names))]) for k, v in images.items() for y in range(v.shape[1])]
    return spark.createDataFrame(rows, "image int, y int, height int, " + ", ".join(f"{n} array<double>" for n in names)).repartition(5)


def back(lines, name):
    out = {}
    for r in lines.orderBy("image", "y").collect():
        out.setdefault(r["image"], []).append(r[name])
    return {k: np.array(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(2)
    return {k: rng.normal(size=(1, h, w)) for k, (h, w) in enumerate([(1, 1), (1, 9), (7, 3), (40, 56), (70, 20), (33, 1)])}


def _at(j, n):
    """A place outside, reflected at the borders as often as it takes."""
    if n == 1:
        return 0
    j %= 2 * n - 2
    return j if j < n else 2 * n - 2 - j


@pytest.mark.parametrize(("sigma", "strip"), [(0.65, 32), (3.0, 4)])
def test_blur(spark, images, sigma, strip):
    kernel = strips.gaussian(sigma)
    radius = len(kernel) // 2
    got = back(strips.blurred(image_lines(spark, images, "v"), KEY, {"b": "v"}, sigma, strip), "b")
    for k, v in images.items():
        h, w = v[0].shape
        fold = lambda n: np.array([[sum(kernel[d + radius] for d in range(-radius, radius + 1) if _at(i + d, n) == j) for j in range(n)] for i in range(n)])
        assert np.allclose(got[k], fold(h) @ v[0] @ fold(w).T)


@pytest.mark.parametrize("radius", [0, 1, 8])
def test_erosion(spark, images, radius):
    got = back(strips.eroded(image_lines(spark, {k: v + 5 for k, v in images.items()}, "v"), KEY, "v", radius, strip=8), "eroded")
    for k, v in images.items():
        wide = np.pad(v[0] + 5, radius)
        h, w = v[0].shape
        assert np.allclose(got[k], [[wide[y : y + 2 * radius + 1, x : x + 2 * radius + 1].min() for x in range(w)] for y in range(h)])


def test_slopes_and_samples(spark, images):
    some = {k: v for k, v in images.items() if min(v[0].shape) > 1}
    lines = image_lines(spark, some, "v")
    slope = strips.slopes(lines, KEY, "v", 16)
    rng = np.random.default_rng(5)
    points = [(k, i, float(x), float(y)) for k, v in some.items() for i, (x, y) in enumerate(rng.uniform(-3, 1.1 * max(v[0].shape), (40, 2)))]
    got = strips.sampled(lines, spark.createDataFrame(points, "image int, id int, px double, py double"), KEY, ["v"], ["id"])
    found = {(r["image"], r["id"]): r["v"] for r in got.collect()}
    dy, dx = back(slope, "dy"), back(slope, "dx")
    for k, v in some.items():
        own = np.gradient(v[0])
        assert np.allclose(dy[k], own[0]) and np.allclose(dx[k], own[1])
    for k, i, x, y in points:
        v = some[k][0]
        x, y = min(max(x, 0), v.shape[1] - 1.000001), min(max(y, 0), v.shape[0] - 1.000001)
        near = sum(v[yy, xx] * (1 - abs(x - xx)) * (1 - abs(y - yy)) for yy in (int(y), int(y) + 1) for xx in (int(x), int(x) + 1))
        assert abs(found[k, i] - near) < 1e-9
    assert len(found) == len(points)


def test_no_lines(spark):
    none = image_lines(spark, {}, "v")
    assert strips.blurred(none, KEY, {"v": "v"}, 1.0).count() == 0


def test_crossings(spark):
    rows = [([1.0, -1.0, 0.0, 2.0],), ([],), ([0.0],), ([0.0, 0.0, 3.0, -1.0],), ([1.0, 1.0],)]
    got = spark.createDataFrame(rows, "v array<double>").select(strips.crossings(F.col("v")).alias("c")).collect()
    assert [r["c"] for r in got] == [[0.5, 2.0, 2.0], [], [], [1.0, 2.75], []]


def test_nearest_points(spark):
    rng = np.random.default_rng(8)
    a = [(k, i, *map(float, rng.uniform(0, s, 2))) for k, s in ((0, 3), (1, 400)) for i in range(40)] + [(2, 1, 5.0, 5.0), (3, 7, 1e6, -1e6)]
    b = [(k, i, *map(float, rng.uniform(0, s, 2))) for k, s in ((0, 3), (1, 400)) for i in range(25)] + [(3, 4, 0.0, 0.0), (3, 3, 0.0, 0.0)]
    frame = lambda r: spark.createDataFrame(r, "image int, id int, x double, y double")
    got = {(r["image"], r["id"]): (r["far"], r["other"]) for r in contours.nearest_points(frame(a), frame(b), KEY, 1.0).collect()}
    for k, i, x, y in a:
        best = min((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for g, j, u, v in b if g == k) if any(g == k for g, *_ in b) else (None, None)
        assert got[k, i] == (pytest.approx(best[0]) if best[0] is not None else None, best[1])
    assert contours.nearest_points(frame(a[:0]), frame(b), KEY).count() == 0
    plan = contours.nearest_points(frame(a), frame(b), KEY, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def _choices(groups):
    return itertools.product(*[[None, *g] for g in groups])


def test_frontier_exact_and_beam():
    rng = np.random.default_rng(4)
    for turn in range(12):
        rows = [(g, e, int(rng.integers(1, 4)), float(rng.integers(0, 5)), float(rng.integers(-6, 7)), float(rng.integers(-6, 7))) for g in range(5) for e in range(int(rng.integers(1, 4)))]
        states = {}
        for taken in _choices([[r for r in rows if r[0] == g] for g in range(5)]):
            taken = [t for t in taken if t]
            total = tuple(sum(t[c] for t in taken) for c in (2, 3, 4, 5))
            if total[0] <= 8 and total[1] <= 9:
                changes = tuple((t[0], t[1]) for t in taken)
                states[total] = min(states.get(total, changes), changes)
        best = {t: c for t, c in states.items() if not any(o[0] == t[0] and o != t and all(x <= y for x, y in zip(o[1:], t[1:], strict=True)) for o in states)}
        got = frontier.fold(rows, 8, 9.0, None)
        as_rows = lambda f: {s[:4]: s[4] for s in f}
        assert as_rows(got) == best
        few = frontier.fold(rows, 8, 9.0, 2)
        assert all(sum(s[0] == n for s in few) <= 2 for n in range(9)) and set(as_rows(few)) <= set(states)
        assert as_rows(frontier.fold(rows, 8, 9.0, 10_000)) == best


def test_beam_keeps_least_error_and_least_credit():
    states = [(1, 5.0 - i, float(i), 0.0, ((0, i),)) for i in range(5)]
    assert frontier.pruned(states[::-1]) == states
    assert frontier.within_beam(states, 3) == [states[i] for i in (0, 4, 1)]
    assert frontier.pruned([(1, 1.0, 0.0, 0.0, ()), (1, 1.0 - 1e-8, 0.0, 0.0, ((1, 1),))]) == [(1, 1.0 - 1e-8, 0.0, 0.0, ((1, 1),))]


@pytest.mark.parametrize("row", [(1, 1, 0, 0.0, 0.0, 0.0, 5, 1.0), (1, 1, 1, -1.0, 0.0, 0.0, 5, 1.0), (1, 1, 1, 0.0, None, 0.0, 5, 1.0), (1, 1, 1, 0.0, 0.0, float("nan"), 5, 1.0), (1, 1, 1, 0.0, 0.0, 0.0, -1, 1.0)])
def test_frontier_faults(spark, row):
    names = "output int, grp long, endpoint long, freed long, credit_lost double, face double, hair double, most_freed long, most_lost double"
    with pytest.raises(Exception, match="output 3: "):
        frontier.donor_frontier(spark.createDataFrame([(3, *row)], names), "output").collect()
