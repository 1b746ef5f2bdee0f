"""Lanczos rendering of whole images through an affine map, in output tiles.

A plan gives an image's output size and the map from output to source, as row vectors: (x, y, 1) goes to (a0 x + a2 y + a4, a1 x + a3 y + a5). The window is
three source pixels to each side, and wider by the factor by which an axis shrinks. Each output tile gets the part of the source
lines under it and its windows, so a task holds a tile and its surroundings, whatever the image's size and the map's angle. Where the
map doesn't turn, a tile is two products with small matrices (along the lines, then across them); else each pixel's window is summed.

Weights over the pixels that are there add up to one; output pixels whose place is outside of the source are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrel.operators import strips

LOBES = 3
TILE = 64
#: Values gathered at a time where the map turns.
GATHERED = 1 << 20
MAP = ("a0", "a1", "a2", "a3", "a4", "a5")


def window(t: np.ndarray) -> np.ndarray:
    return np.where(np.abs(t) < LOBES, np.sinc(t) * np.sinc(t / LOBES), 0.0)


def reach(along: float, across: float) -> float:
    """By how much a window is wider: the source pixels that an output pixel spans on an axis, 1 at least."""
    return max(1.0, float(np.hypot(along, across)))


def _straight(block: np.ndarray, xs: np.ndarray, ys: np.ndarray, sx: np.ndarray, sy: np.ndarray, wide: float, tall: float) -> np.ndarray:
    """Two passes: along the lines, then across them."""
    along, across = (window((places[None, :] - centres[:, None]) / size) for places, centres, size in ((xs, sx, wide), (ys, sy, tall)))
    return (across / across.sum(axis=1, keepdims=True)) @ block @ (along / along.sum(axis=1, keepdims=True)).T


def _turned(block: np.ndarray, x0: int, y0: int, sx: np.ndarray, sy: np.ndarray, wide: float, tall: float) -> np.ndarray:
    """Each place's own window, a bounded number of values at a time."""
    out = np.empty(len(sx))
    rx, ry = int(np.ceil(LOBES * wide)), int(np.ceil(LOBES * tall))
    dx, dy = np.arange(-rx, rx + 2), np.arange(-ry, ry + 2)
    for some in np.array_split(np.arange(len(sx)), max(1, len(sx) * len(dx) * len(dy) // GATHERED)):
        px, py = np.floor(sx[some]).astype(int)[:, None] + dx, np.floor(sy[some]).astype(int)[:, None] + dy
        wx, wy = window((px - sx[some][:, None]) / wide), window((py - sy[some][:, None]) / tall)
        wx *= (px >= x0) & (px < x0 + block.shape[1])
        wy *= (py >= y0) & (py < y0 + block.shape[0])
        values = block[np.clip(py - y0, 0, block.shape[0] - 1)[:, :, None], np.clip(px - x0, 0, block.shape[1] - 1)[:, None, :]]
        out[some] = np.einsum("ny,nyx,nx->n", wy, values, wx) / (wx.sum(axis=1) * wy.sum(axis=1))
    return out


def rendered(image: DataFrame, plans: DataFrame, keys: Sequence[str], channels: Sequence[str], tile: int = TILE) -> DataFrame:
    """Lines of the images of ``plans`` (keys, out_height, out_width, a0 to a5). Sizes below one give no lines."""
    keys, channels = list(keys), list(channels)
    about = image.where("y = 0").select(*keys, F.col("height").alias("_height"), F.size(channels[0]).alias("_width"))
    tiles = plans.where("out_height > 0 and out_width > 0").join(about, keys)
    numbers = lambda c: F.sequence(F.lit(0), F.floor((F.col(c) - 1) / tile).cast("int"))
    tiles = tiles.withColumn("strip", F.explode(numbers("out_height"))).withColumn("_tx", F.explode(numbers("out_width")))
    # The source box under a tile: the map's least and greatest values are at its corners.
    corner = lambda n, size: (F.col(n) * tile, F.least((F.col(n) + 1) * tile, F.col(size)) - 1)
    places = {}
    for axis, (u, v, w, size) in {"x": ("a0", "a2", "a4", "_width"), "y": ("a1", "a3", "a5", "_height")}.items():
        at = [F.col(u) * ox + F.col(v) * oy + F.col(w) for ox in corner("_tx", "out_width") for oy in corner("strip", "out_height")]
        far = LOBES * F.greatest(F.lit(1.0), F.sqrt(F.col(u) ** 2 + F.col(v) ** 2)) + 1
        places[f"_{axis}0"] = F.greatest(F.floor(F.least(*at) - far), F.lit(0)).cast("int")
        places[f"_{axis}1"] = F.least(F.ceil(F.greatest(*at) + far), F.col(size) - 1).cast("int")
    tiles = tiles.withColumns(places)
    held = [*keys, "strip", "_tx", "_x0", "_y0", "out_height", "out_width", "_height", "_width", *MAP]
    lines = strips.matched(tiles.where("_x0 <= _x1 and _y0 <= _y1").withColumn("y", F.explode(F.sequence("_y0", "_y1"))), image.drop("height"), [*keys, "y"])
    parts = lines.select(*held, "y", *[F.slice(c, F.col("_x0") + 1, F.col("_x1") - F.col("_x0") + 1).alias(c) for c in channels])
    marks = tiles.select(*held, F.lit(-1).alias("y"), *[F.array().cast("array<double>").alias(c) for c in channels])  # tiles outside of their source have no lines
    grouped = parts.unionByName(marks).groupBy(*held).agg(F.sort_array(F.collect_list(F.struct("y", *channels))).alias("block")).withColumn("height", F.col("out_height"))

    def step(row: dict, ys: np.ndarray, block: dict[str, np.ndarray]) -> tuple[int, dict[str, np.ndarray]]:
        a = [row[c] for c in MAP]
        oy = np.arange(row["strip"] * tile, min((row["strip"] + 1) * tile, row["out_height"]))
        ox = np.arange(row["_tx"] * tile, min((row["_tx"] + 1) * tile, row["out_width"]))
        sx, sy = (a[i] * ox[None, :] + a[i + 2] * oy[:, None] + a[i + 4] for i in (0, 1))
        inside = (sx >= 0) & (sx <= row["_width"] - 1) & (sy >= 0) & (sy <= row["_height"] - 1)
        wide, tall = reach(a[0], a[2]), reach(a[1], a[3])
        out = {c: np.zeros(inside.shape) for c in channels}
        if inside.any():
            for c in channels:
                if a[1] == 0 and a[2] == 0:
                    rows, columns = inside.any(axis=1), inside.any(axis=0)
                    xs = row["_x0"] + np.arange(block[c].shape[1])
                    out[c][np.ix_(rows, columns)] = _straight(block[c], xs, ys, sx[0, columns], sy[rows, 0], wide, tall)
                else:
                    out[c][inside] = _turned(block[c], row["_x0"], row["_y0"], sx[inside], sy[inside], wide, tall)
        return int(oy[0]), out

    made = strips.mapped(grouped, [*keys, "_tx", "strip", "_x0", "_y0", "out_height", "out_width", "_height", "_width", *MAP], channels, step)
    whole = made.groupBy(*keys, "y", "height").agg(F.sort_array(F.collect_list(F.struct("_tx", *channels))).alias("_t"))
    flat = lambda c: F.flatten(F.transform("_t", lambda t: t[c])).alias(c)
    return whole.select(*keys, "y", "height", *map(flat, channels))
