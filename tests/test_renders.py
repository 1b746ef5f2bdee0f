"""Renderings, synthesis influence and colour profiles against plain versions."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from portrel.operators import influence, resample, tiles
from portrel.plans import colours
from portrel.sources import profiles
from tests.test_photos import KEY, back, image_lines


def _plain_render(v, height, width, a):
    lanczos = lambda t: 0.0 if abs(t) >= 3 else 1.0 if t == 0 else math.sin(math.pi * t) * math.sin(math.pi * t / 3) / (math.pi**2 * t * t / 3)
    wide, tall = max(1.0, math.hypot(a[0], a[2])), max(1.0, math.hypot(a[1], a[3]))
    out = np.zeros((height, width))
    for oy in range(height):
        for ox in range(width):
            sx, sy = a[0] * ox + a[2] * oy + a[4], a[1] * ox + a[3] * oy + a[5]
            if 0 <= sx <= v.shape[1] - 1 and 0 <= sy <= v.shape[0] - 1:
                wx, wy = (np.array([lanczos((p - s) / k) for p in range(n)]) for s, k, n in ((sx, wide, v.shape[1]), (sy, tall, v.shape[0])))
                out[oy, ox] = wy @ v @ wx / (wx.sum() * wy.sum())
    return out


MAPS = [(30, 20, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)), (9, 70, (0.5, 0.0, 0.0, 3.7, 0.2, -4.0)), (25, 25, (0.8, 0.7, -0.7, 0.8, 12.0, -3.0)), (12, 12, (0.0, 2.0, 3.0, 0.0, 1.0, 0.0)), (3, 3, (1.0, 0.0, 0.0, 1.0, 900.0, 900.0)), (0, 4, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)), (5, 8, (-1.0, 0.0, 0.0, -1.0, 20.0, 30.0))]


@pytest.mark.parametrize("tile", [7, 64])
def test_render(spark, tile):
    rng = np.random.default_rng(3)
    images = {k: rng.normal(size=(1, 40, 36)) for k in range(len(MAPS))}
    plans = spark.createDataFrame([(k, h, w, *a) for k, (h, w, a) in enumerate(MAPS)], "image int, out_height int, out_width int, " + ", ".join(f"{m} double" for m in resample.MAP))
    got = back(resample.rendered(image_lines(spark, images, "v"), plans, KEY, ["v"], tile), "v")
    assert sorted(got) == [k for k, (h, _, _) in enumerate(MAPS) if h]
    for k, v in got.items():
        assert np.allclose(v, _plain_render(images[k][0], *MAPS[k])), MAPS[k]


@pytest.mark.parametrize(("level", "high_x", "high_y"), [(1, False, True), (2, True, False), (3, False, False), (5, True, True)])
def test_influence(spark, level, high_x, high_y):
    """Equal to synthesising each coefficient alone, by the inverse of the analysis matrix."""
    rng = np.random.default_rng(level)
    masks = {k: (rng.random((1, h, w)) < 0.4).astype(float) for k, (h, w) in enumerate([(64, 32), (32, 64)])}
    lines = image_lines(spark, masks, "m")
    out = influence.influence(lines, KEY, "m", level, high_x, high_y, 4)
    total, share = back(out, "total"), back(out, "share")
    for k, m in masks.items():
        rows, columns = (np.linalg.inv(tiles.lifting_levels(n, level)) for n in m[0].shape)
        pick = lambda s, n, high: np.square(s[:, n >> level : n >> (level - 1)] if high else s[:, : n >> level])
        v, h = pick(rows, m[0].shape[0], high_y), pick(columns, m[0].shape[1], high_x)
        assert np.allclose(share[k], v.T @ m[0] @ h, atol=1e-9)
        assert np.allclose(total[k], v.sum(axis=0)[:, None] * h.sum(axis=0)[None, :])


def test_influence_of_odd_and_single_lines(spark):
    masks = {0: np.ones((1, 1, 5)), 1: np.ones((1, 7, 1)), 2: np.ones((1, 13, 9))}
    for high_x, high_y in ((False, False), (True, True)):
        out = influence.influence(image_lines(spark, masks, "m"), KEY, "m", 1, high_x, high_y)
        share, total = back(out, "share"), back(out, "total")
        for k, m in masks.items():
            size = [n // 2 if high else (n + 1) // 2 for n, high in zip(m[0].shape, (high_y, high_x), strict=True)]
            assert (k in share) == all(size) and (k not in share or share[k].shape == tuple(size) and np.allclose(share[k], total[k]))


def test_profile_faults(spark):
    """Each made profile has the one error that was put into it; nulls, empty bytes and cuts anywhere give an error and no crash."""
    cases = colours.cases()
    whole = cases[0][0].replace(b"\x0f\x0f", b"\x02\x00")
    rows = [(i, data, "x", 1) for i, (data, _) in enumerate(cases)] + [(1000, None, "x", 1), (1001, b"", "x", 1)] + [(2000 + n, whole[:n], "x", 1) for n in range(0, len(whole), 23)]
    rows += [(3000 + n, struct.pack(">I", n) + whole[4:n], "x", 1) for n in range(132, len(whole), 16)]
    got = {r["id"]: r["error"] for r in profiles.parsed(spark.createDataFrame(rows, "id int, data binary, name string, place int"), "id").collect()}
    assert len(got) == len(rows)
    for i, (_, error) in enumerate(cases):
        assert got[i] == error, i
    assert {e for i, e in got.items() if 1000 <= i < 3000} == {profiles.SIZE}
    assert all(e for i, e in got.items() if i >= 3000)


def test_profile_values(spark):
    """Curves and matrix of a good profile; white stays white and an sRGB profile changes nothing."""
    data = [(0, colours.cases()[2][0]), (1, colours.made(colours.WIDE, colours.table_curve(0, 9000, 32000, 65535)))]
    told = profiles.parsed(spark.createDataFrame(data, "id int, data binary"), "id").select("id", "describes_srgb", "curves", "matrix", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    out = profiles.converted(F.col("v"), F.col("v"), F.col("v"), F.col("matrix"), F.col("curves"))
    got = {(r["id"], r["v"]): (r["r"], r["g"], r["b"], r["describes_srgb"]) for r in told.select("id", "v", "describes_srgb", *[c.alias(n) for c, n in zip(out, "rgb", strict=True)]).collect()}
    assert all(got[0, v] == (v, v, v, True) for v in range(256))
    assert got[1, 255][:3] == (255, 255, 255) and got[1, 0][:3] == (0, 0, 0) and got[1, 128][3] is False
    line = np.interp(128 / 255 * 3, range(4), [0, 9000, 32000, 65535]) / 65535
    grey = round(255 * (1.055 * line ** (1 / 2.4) - 0.055))
    assert all(abs(c - grey) <= 1 for c in got[1, 128][:3])
