"""Edges of whole images: equal to one pass over the whole image, whatever the strips."""

from __future__ import annotations

import numpy as np
import pytest

from portrel.operators import edges, raster, strips, tiles
from tests.test_photos import KEY, back, image_lines


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(6)
    made = {k: rng.normal(size=(1, h, w)) for k, (h, w) in enumerate([(40, 56), (17, 9), (1, 30), (64, 5)])}
    y, x = np.mgrid[:70, :70]
    spiral = np.sin(np.hypot(y - 35, x - 35) + np.arctan2(y - 35, x - 35))  # one edge that winds through all strips
    return made | {9: spiral[None] * 3, 10: np.zeros((1, 20, 20))}


@pytest.mark.parametrize(("strip", "low", "high"), [(4, 0.8, 1.8), (32, 0.5, 3.0)])
def test_canny(spark, images, strip, low, high):
    blur = raster.gaussian_kernel(1.0)
    out = edges.canny(image_lines(spark, images, "v"), KEY, "v", blur, low, high, strip)
    edge, segment = back(out, "edge"), back(out, "segment")
    assert sorted(edge) == sorted(images)
    for k, v in images.items():
        smooth = edges.correlated(v[0], blur)
        thin = tiles.thin(*(edges.correlated(smooth, s)[None] for s in (raster.SOBEL_X, raster.SOBEL_Y)), low)[0]
        label = tiles.labels((thin > 0)[None])[0]
        strong = {int(n) for n in np.unique(label[thin >= high])} - {-1}
        kept = np.isin(label, sorted(strong)) & (label >= 0)
        assert np.allclose(edge[k], np.where(kept, thin, 0.0))
        sizes = {n: (label == n).sum() for n in strong}
        assert (segment[k] == [[n if n in strong and sizes[n] >= 3 else -1 for n in row] for row in label.tolist()]).all()


def test_stencils_reach_over_strips(spark, images):
    kernels = {"g": raster.gabor_kernel(30.0), "l": raster.log_kernel(1.4)}
    out = edges.stencils(image_lines(spark, images, "v"), KEY, "v", kernels, strip=8)
    for n, kernel in kernels.items():
        got = back(out, n)
        for k, v in images.items():
            h, w = v[0].shape
            plain = np.array([[sum(c * v[0][y + dy, x + dx] for dy, dx, c in kernel if 0 <= y + dy < h and 0 <= x + dx < w) for x in range(w)] for y in range(h)]) if h * w < 400 else None
            assert plain is None or np.allclose(got[k], plain)
            assert np.allclose(got[k], edges.correlated(v[0], kernel))


def test_strip_memory_is_bounded(spark):
    """A task of a 420 x 560 image gets its strip and the halo, no more."""
    image = {0: np.zeros((1, 420, 560))}
    y = strips.F.col("y")
    parts = strips.grouped(image_lines(spark, image, "v"), KEY, ["v"], strips.F.floor((y - 10) / 32), strips.F.floor((y + 10) / 32), strips.F.ceil(strips.F.col("height") / 32))
    assert max(r[0] for r in parts.select(strips.F.size("block")).collect()) == 32 + 2 * 10
