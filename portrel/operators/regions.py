"""Statistics by region: moments, entropy, guarded correlation, upper medians, ellipses and hulls."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entropy16(pixels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, entropy) in bits, of 16 equal bins over 0..255."""
    bins = pixels.groupBy(*keys, F.floor(F.col(value) / 16).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys))
    p = bins.withColumn("p", F.col("n") / total)
    return p.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def guarded_corr(pixels: DataFrame, keys: Sequence[str], a: str, b: str, least: float = 1e-12) -> DataFrame:
    """(keys, defined, corr): population correlation from sums, in [-1, 1]; under two rows or without variance: not defined, 0."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"), F.avg(x * y).alias("xy"))
    vx, vy = F.col("xx") - F.col("mx") * F.col("mx"), F.col("yy") - F.col("my") * F.col("my")
    ok = (F.col("n") >= 2) & (vx > least) & (vy > least)
    c = F.try_divide(F.col("xy") - F.col("mx") * F.col("my"), F.sqrt(F.greatest(vx * vy, F.lit(0.0))))
    return s.select(*keys, ok.alias("defined"), F.when(ok, F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))).otherwise(0.0).alias("corr"))


def upper_median(rows: DataFrame, keys: Sequence[str], value: str, *ties: str) -> DataFrame:
    """(keys, median): the value at n div 2 of the sorted ones, counted from 0."""
    w = W.partitionBy(*keys)
    ranked = rows.withColumn("turn", F.row_number().over(w.orderBy(value, *ties)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("turn") == F.floor(F.col("n") / 2)).select(*keys, F.col(value).alias("median"))


def covariance_ellipse(points: DataFrame, keys: Sequence[str], scale: float = 2.5) -> DataFrame:
    """(keys, cx, cy, major, minor, angle): axes from the eigenvalues of the population covariance, in degrees."""
    s = points.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"))
    half, det = (F.col("vx") + F.col("vy")) / 2, F.col("vx") * F.col("vy") - F.col("vxy") * F.col("vxy")
    root = F.sqrt(F.greatest(half * half - det, F.lit(0.0)))
    axis = lambda e: F.sqrt(F.greatest(e, F.lit(0.0))) * scale * 2
    return s.select(*keys, "cx", "cy", axis(half + root).alias("major"), axis(half - root).alias("minor"), F.degrees(0.5 * F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy"))).alias("angle"))


def with_hull(lists: DataFrame, points: str, ring: str = "ring") -> DataFrame:
    """Adds the corners of the convex hull of an array of points (x, y), ordered by x then y, each once: a monotone chain as two folds
    over the sorted array. Meant for the few points of one face or region, an array in one row."""
    kind = lists.schema[points].dataType.simpleString()

    def turns(s: Column, p: Column) -> Column:
        o, a = F.get(s, F.size(s) - 2), F.get(s, F.size(s) - 1)
        return (a["x"] - o["x"]) * (p["y"] - o["y"]) - (a["y"] - o["y"]) * (p["x"] - o["x"])

    def chain(sorted_points: Column) -> Column:
        def push(stack: Column, p: Column) -> Column:
            popped = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(stack), F.lit(1))), stack, lambda s, _: F.when((F.size(s) >= 2) & (turns(s, p) <= 0), F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s))
            return F.concat(popped, F.array(p))

        return F.aggregate(sorted_points, F.array().cast(kind), push)

    both = lists.withColumn("_p", F.array_sort(F.array_distinct(points))).withColumns({"_lower": chain(F.col("_p")), "_upper": chain(F.reverse("_p"))})
    joined = F.concat(F.slice("_lower", F.lit(1), F.size("_lower") - 1), F.slice("_upper", F.lit(1), F.size("_upper") - 1))
    return both.withColumn(ring, joined).drop("_p", "_lower", "_upper")


def hull_mask(rings: DataFrame, keys: Sequence[str], margin: str) -> DataFrame:
    """(keys, y, x) of the pixels whose middle is in the hull ``ring`` or within ``margin`` of its edges; hulls of less than three
    corners have none. One hull's pixels are computed at a time."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rings.select(*keys).schema.fields] + ["y int", "x int"])

    def pixels(ring: list[dict], m: float) -> tuple[np.ndarray, np.ndarray]:
        a = np.array([(p["x"], p["y"]) for p in ring], np.float64).reshape(-1, 2)
        d = np.roll(a, -1, axis=0) - a
        low, high = np.floor(a.min(axis=0) - m), np.ceil(a.max(axis=0) + m)
        y, x = np.mgrid[int(low[1]) : int(high[1]), int(low[0]) : int(high[0])]
        inside, near = np.ones(y.shape, bool), np.zeros(y.shape, bool)
        for (ax, ay), (dx, dy) in zip(a, d, strict=True):
            px, py = x + 0.5 - ax, y + 0.5 - ay
            inside &= dx * py - dy * px >= 0
            part = np.clip((px * dx + py * dy) / (dx * dx + dy * dy), 0, 1)
            near |= (px - part * dx) ** 2 + (py - part * dy) ** 2 <= m * m
        return y[inside | near], x[inside | near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (ring, m) in enumerate(zip(batch.column("ring").to_pylist(), batch.column(margin).to_pylist(), strict=True)):
                y, x = pixels(ring, float(m))
                own = [batch.column(k).take(pa.array(np.full(len(y), i))) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32))], [*keys, "y", "x"])

    return rings.where(F.size("ring") > 2).select(*keys, "ring", margin).mapInArrow(run, schema)


def hull_area(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, corners, area) of each group's convex hull."""
    r = with_hull(points.groupBy(*keys).agg(F.collect_list(F.struct("x", "y")).alias("p")), "p")
    nxt = F.concat(F.slice("ring", F.lit(2), F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", F.lit(1), F.lit(1)))
    area = F.aggregate(F.arrays_zip(F.col("ring").alias("a"), nxt.alias("b")), F.lit(0.0), lambda t, e: t + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2
    return r.select(*keys, F.size("ring").alias("corners"), area.alias("area"))


def improvement(before: Sequence[Column], after: Sequence[Column]) -> Column:
    """By how much a pixel's squared error fell, mean over its channels."""
    parts = [b - a for b, a in zip(before, after, strict=True)]
    return sum(parts[1:], parts[0]) / len(parts)
