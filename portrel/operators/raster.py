"""Raster operators in row form: a pixel is a row (image keys, y, x, v).

Stencils aggregate over neighbours that are looked up by position, never over pairs of all pixels. Kernels are small literal
arrays, so a convolution is one explode, one shuffle on (image, y, x) and one sum.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Kernel = list[tuple[int, int, float]]


def gaussian_kernel(sigma: float) -> Kernel:
    """(dy, dx, weight), normalised; the side is 6 sigma + 1, made odd."""
    side = int(6 * sigma + 1) | 1
    half = side // 2
    raw = [(y, x, math.exp(-(x * x + y * y) / (2 * sigma * sigma))) for y in range(-half, half + 1) for x in range(-half, half + 1)]
    total = sum(w for _, _, w in raw)
    return [(y, x, w / total) for y, x, w in raw]


def log_kernel(sigma: float) -> Kernel:
    """Laplacian of Gaussian, shifted to sum to zero."""
    side = int(6 * sigma + 1) | 1
    half, s2 = side // 2, sigma * sigma
    raw = [(y, x, -1 / (math.pi * s2 * s2) * (1 - (x * x + y * y) / (2 * s2)) * math.exp(-(x * x + y * y) / (2 * s2))) for y in range(-half, half + 1) for x in range(-half, half + 1)]
    mean = sum(w for _, _, w in raw) / len(raw)
    return [(y, x, w - mean) for y, x, w in raw]


def gabor_kernel(degrees: float, side: int = 21, sigma: float = 5.0, wave: float = 10.0, aspect: float = 0.5) -> Kernel:
    """Zero mean, unit L2 norm; exponents under -20 count as 0."""
    half, t = side // 2, math.radians(degrees)
    raw = []
    for y in range(-half, half + 1):
        for x in range(-half, half + 1):
            u, v = x * math.cos(t) + y * math.sin(t), -x * math.sin(t) + y * math.cos(t)
            e = -(u * u + aspect * aspect * v * v) / (2 * sigma * sigma)
            raw.append((y, x, math.exp(e) * math.cos(2 * math.pi * u / wave) if e >= -20 else 0.0))
    mean = sum(w for _, _, w in raw) / len(raw)
    norm = math.sqrt(sum((w - mean) ** 2 for _, _, w in raw))
    return [(y, x, (w - mean) / norm) for y, x, w in raw]


SOBEL_X: Kernel = [(-1, -1, -1.0), (-1, 1, 1.0), (0, -1, -2.0), (0, 1, 2.0), (1, -1, -1.0), (1, 1, 1.0)]
SOBEL_Y: Kernel = [(-1, -1, -1.0), (-1, 0, -2.0), (-1, 1, -1.0), (1, -1, 1.0), (1, 0, 2.0), (1, 1, 1.0)]


def correlate(pixels: DataFrame, keys: Sequence[str], kernels: dict[str, Kernel], value: str = "v") -> DataFrame:
    """(keys, y, x, one column for each kernel): zero-padded correlation. Each pixel is sent to the places whose stencil it
    is under; only places that are pixels stay."""
    taps: dict[tuple[int, int], dict[str, float]] = {}
    for name, kernel in kernels.items():
        for dy, dx, w in kernel:
            taps.setdefault((dy, dx), {})[name] = w
    taps.setdefault((0, 0), {})
    tap = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), *[F.lit(float(ws.get(n, 0.0))).alias(n) for n in kernels]) for (dy, dx), ws in sorted(taps.items())])
    sent = pixels.select(*keys, F.col("y").alias("y0"), F.col("x").alias("x0"), F.col(value).alias("v0"), F.explode(tap).alias("t"))
    at = sent.select(*keys, (F.col("y0") - F.col("t.dy")).alias("y"), (F.col("x0") - F.col("t.dx")).alias("x"), ((F.col("t.dy") == 0) & (F.col("t.dx") == 0)).alias("own"), *[(F.col("v0") * F.col(f"t.{n}")).alias(n) for n in kernels])
    out = at.groupBy(*keys, "y", "x").agg(F.max("own").alias("own"), *[F.sum(n).alias(n) for n in kernels])
    return out.where("own").drop("own")


def cosine_basis(size: int = 8) -> list[list[float]]:
    return [[math.sqrt((1 if k == 0 else 2) / size) * math.cos((2 * n + 1) * k * math.pi / (2 * size)) for n in range(size)] for k in range(size)]


def dct8(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, i, j, c): orthonormal DCT-II of 8x8 tiles, rows then columns."""
    basis = F.array(*[F.array(*map(F.lit, row)) for row in cosine_basis()])
    along = pixels.select(*keys, "y", F.posexplode(F.transform(basis, lambda b: F.get(b, F.col("x")) * F.col("v"))).alias("j", "t"))
    rows = along.groupBy(*keys, "y", "j").agg(F.sum("t").alias("t"))
    down = rows.select(*keys, "j", F.posexplode(F.transform(basis, lambda b: F.get(b, F.col("y")) * F.col("t"))).alias("i", "c"))
    return down.groupBy(*keys, "i", "j").agg(F.sum("c").alias("c"))


def high_frequency(coefficients: DataFrame, keys: Sequence[str], above: int = 2) -> DataFrame:
    """(keys, high, total, ratio) of squared coefficients; those with i + j over ``above`` are high. Flat tiles: ratio 0."""
    power = F.col("c") * F.col("c")
    e = coefficients.groupBy(*keys).agg(F.sum(F.when(F.col("i") + F.col("j") > above, power).otherwise(0.0)).alias("high"), F.sum(power).alias("total"))
    return e.withColumn("ratio", F.coalesce(F.try_divide("high", "total"), F.lit(0.0)))


def histogram(values: DataFrame, keys: Sequence[str], bins: int = 50, value: str = "v") -> DataFrame:
    """(keys, bin, n, share): equal-width bins from least to most, all of them listed; a constant image is all in bin 0."""
    ends = values.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = values.join(ends, list(keys)).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = ends.select(*keys, "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = every.join(counted, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("share", F.col("n") / F.col("total")).select(*keys, "bin", "n", "share")


#: Lifting steps of the 9/7 wavelet.
ALPHA, BETA, GAMMA, DELTA, K_LOW, K_HIGH = -1.586134342, -0.05298011854, 0.8829110762, 0.4435068522, 0.8128930655, 1.230174106


# Regions as predicates of a pixel's place.


def in_rectangle(x: Column, y: Column, left: int, top: int, width: int, height: int) -> Column:
    return (x >= left) & (x < left + width) & (y >= top) & (y < top + height)


def in_circle(x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius


def in_ellipse_grid(x: Column, y: Column, cx: float, cy: float, rx: float, ry: float) -> Column:
    return F.pow((x - cx) / rx, 2) + F.pow((y - cy) / ry, 2) <= 1


def first_hit(regions: Sequence[tuple[str, float]], otherwise: float = 0.0) -> Column:
    """The value of the first region (a boolean column) that holds."""
    return F.coalesce(*[F.when(F.col(name), F.lit(value)) for name, value in regions], F.lit(otherwise))


def tile_of(y: Column, x: Column, height: int, width: int, image_width: int) -> Column:
    """Number of the tile that a pixel is in, row by row."""
    return (F.floor(y / height) * -(-image_width // width) + F.floor(x / width)).cast("int")


def to_level(v: Column, most: int = 255) -> Column:
    """A value between 0 and 1 as the nearest whole level."""
    return F.floor(v * most + 0.5).cast("long")


def halves(boxes: DataFrame, image_w: int, image_h: int, padding: float = 0.2) -> DataFrame:
    """Boxes (x, y, w, h) padded and clipped to the image in whole pixels, with ``half``, the width of each mirrored half, and
    whether a middle column is dropped."""
    edge = lambda p, s, side: (F.greatest(F.floor(F.col(p) - padding * F.col(s)), F.lit(0)), F.least(F.ceil(F.col(p) + (1 + padding) * F.col(s)), F.lit(side)))
    (x0, x1), (y0, y1) = edge("x", "w", image_w), edge("y", "h", image_h)
    cut = boxes.withColumns({"_x": x0.cast("long"), "_y": y0.cast("long"), "_w": (x1 - x0).cast("long"), "_h": (y1 - y0).cast("long")}).drop("x", "y", "w", "h").withColumnsRenamed({"_x": "x", "_y": "y", "_w": "w", "_h": "h"})
    return cut.withColumns({"half": F.floor(F.col("w") / 2), "dropped": F.col("w") % 2 == 1})
