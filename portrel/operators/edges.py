"""Stencils and edges of whole images of any size, in strips with halos; what is connected across strips is stitched at their borders.

A task holds a strip and its halo. Components of edge pixels are found within each strip; where two strips meet, pixels that touch tie
their components together, and only those ties of an image (at most a few for each pixel along the borders of its strips) come
together to be joined up. What an image's components are then goes back to its strips.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrel.operators import raster, strips, tiles

#: Pixels that an edge segment has at least.
LEAST_SEGMENT = 3


def correlated(values: np.ndarray, kernel: raster.Kernel, above: int = 0, below: int = 0) -> np.ndarray:
    """A zero-padded correlation of a block: sums of shifted products, one for each tap. ``above`` and ``below`` don't matter: lines of
    the halo that aren't there are outside of the image, and the halo's own results are not used."""
    ry, rx = max(abs(dy) for dy, _, _ in kernel), max(abs(dx) for _, dx, _ in kernel)
    wide = np.pad(values, ((ry, ry), (rx, rx)))
    out = np.zeros_like(values)
    for dy, dx, w in kernel:
        out += w * wide[ry + dy : ry + dy + values.shape[0], rx + dx : rx + dx + values.shape[1]]
    return out


def reach(kernel: raster.Kernel) -> int:
    return max(abs(dy) for dy, _, _ in kernel)


def stencils(image: DataFrame, keys: Sequence[str], channel: str, kernels: dict[str, raster.Kernel], strip: int = strips.STRIP) -> DataFrame:
    """Lines of one correlation for each kernel."""
    return strips.with_halo(image, keys, [channel], list(kernels), max(map(reach, kernels.values())), lambda b, above, below: {n: correlated(b[channel], k) for n, k in kernels.items()}, strip)


def texture(image: DataFrame, keys: Sequence[str], channel: str, strip: int = strips.STRIP) -> DataFrame:
    """Lines of ``mean_step``, ``max_step`` (to the neighbours there are) and ``variance`` (of the three by three pixels around, clipped at the borders)."""

    def step(block: dict[str, np.ndarray], above: int, below: int) -> dict[str, np.ndarray]:
        v = block[channel]
        found = tiles.neighbour_steps(v[None], *v.shape) | tiles.window_variance(v[None], *v.shape)
        return {n: a[0] for n, a in found.items()}

    return strips.with_halo(image, keys, [channel], ["mean_step", "max_step", "variance"], 1, step, strip)


def thinned(image: DataFrame, keys: Sequence[str], channel: str, blur: raster.Kernel, low: float, strip: int = strips.STRIP) -> DataFrame:
    """Lines of ``edge``: gradient magnitudes of the blurred image that aren't under a neighbour's along the gradient and are at least ``low``; else 0."""
    halo = reach(blur) + 2

    def step(block: dict[str, np.ndarray], above: int, below: int) -> dict[str, np.ndarray]:
        smooth = correlated(block[channel], blur)
        # Lines next to the image's border are correlated with nothing outside, as the block ends there.
        gx, gy = (correlated(smooth, k) for k in (raster.SOBEL_X, raster.SOBEL_Y))
        return {"edge": tiles.thin(gx[None], gy[None], low)[0]}

    return strips.with_halo(image, keys, [channel], ["edge"], halo, step, strip)


def _labelled(image: DataFrame, keys: Sequence[str], strip: int) -> DataFrame:
    """Lines of ``edge`` and ``label``: the number (line times width and place) of the first pixel of an edge pixel's component within its strip, else -1."""

    def step(block: dict[str, np.ndarray], above: int, below: int) -> dict[str, np.ndarray]:
        found = tiles.labels((block["edge"] > 0)[None])[0]
        return {"edge": block["edge"], "label": found}

    local = strips.with_halo(image, keys, ["edge"], ["edge", "label"], 0, step, strip)
    base = F.floor(F.col("y") / strip) * strip * F.size("edge")
    return local.withColumn("label", F.transform("label", lambda v: F.when(v >= 0, (v + base).cast("long")).otherwise(F.lit(-1).cast("long"))))


def _roots(ties: pd.DataFrame) -> dict[int, int]:
    """Least label that is reachable from each label of the ties (a, b)."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in zip(ties["a"].tolist(), ties["b"].tolist(), strict=True):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in list(parent)}


def canny(image: DataFrame, keys: Sequence[str], channel: str, blur: raster.Kernel, low: float, high: float, strip: int = strips.STRIP) -> DataFrame:
    """Lines of ``edge``, the magnitude of edge pixels tied to one of at least ``high``, else 0, and ``segment``, the number of the first pixel of
    an edge's component if that has ``LEAST_SEGMENT`` pixels, else -1."""
    keys = list(keys)
    labelled = strips.kept(_labelled(thinned(image, keys, channel, blur, low, strip), keys, strip))
    # Lines on both sides of a border between strips, and which of their pixels touch.
    last = labelled.where(F.col("y") % strip == strip - 1).select(*keys, (F.col("y") + 1).alias("y"), F.col("label").alias("up"))
    pair = strips.matched(labelled.where(F.col("y") % strip == 0).select(*keys, "y", "label"), last, [*keys, "y"])
    touch = F.flatten(F.transform("label", lambda b, i: F.transform(F.array(*[F.get("up", i + d) for d in (-1, 0, 1)]), lambda a: F.struct(a.alias("a"), b.alias("b")))))
    ties = pair.select(*keys, F.explode(F.array_distinct(F.filter(touch, lambda t: (t["a"] >= 0) & (t["b"] >= 0)))).alias("t")).select(*keys, "t.a", "t.b")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in image.select(*keys).schema.fields)

    def joined(some: pd.DataFrame) -> pd.DataFrame:
        roots = _roots(some)
        out = pd.DataFrame({"label": list(roots), "root": list(roots.values())})
        for k in reversed(keys):
            out.insert(0, k, some[k].iloc[0])
        return out

    roots = strips.kept(ties.groupBy(*keys).applyInPandas(joined, f"{schema}, label long, root long"))
    number = F.floor(F.col("y") / strip).cast("int")
    dots = F.explode(F.filter(F.arrays_zip("label", "edge"), lambda p: p["label"] >= 0)).alias("p")
    sizes = labelled.select(*keys, number.alias("strip"), dots).groupBy(*keys, "strip", "p.label").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("p.edge") >= high).alias("strong"))
    told = strips.kept(strips.matched(sizes, roots, [*keys, "label"], "left").withColumn("root", F.coalesce("root", "label")))
    whole = told.groupBy(*keys, "root").agg(F.sum("n").alias("n"), F.max("strong").alias("strong")).where("strong")
    kept = strips.matched(told.select(*keys, "strip", "label", "root"), whole, [*keys, "root"])
    maps = kept.groupBy(*keys, "strip").agg(F.map_from_entries(F.collect_list(F.struct("label", F.when(F.col("n") >= LEAST_SEGMENT, F.col("root")).otherwise(F.lit(-1))))).alias("_segments"))  # of one strip
    with_maps = strips.matched(labelled.withColumn("strip", number), maps, [*keys, "strip"], "left")
    segment = F.transform("label", lambda v: F.try_element_at("_segments", v))
    marked = with_maps.withColumn("_s", F.coalesce(segment, F.transform("label", lambda _: F.lit(None).cast("long"))))
    edge = F.zip_with("edge", "_s", lambda m, s: F.when(s.isNotNull(), m).otherwise(F.lit(0.0))).alias("edge")
    return marked.select(*keys, "y", "height", edge, F.transform("_s", lambda s: F.coalesce(s, F.lit(-1).cast("long"))).alias("segment"))
