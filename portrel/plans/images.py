"""Queries over tiles and pixels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from portrel.functions import geometry as g
from portrel.operators import raster, regions, tiles
from portrel.plans.registry import query, r6
from portrel.sources import relations as rel

TILE = ["vec_id"]
_SOBEL_MAPS = {"gx": tiles.stencil(raster.SOBEL_X), "gy": tiles.stencil(raster.SOBEL_Y)}

_BASIS = "basis AS (SELECT k, n, CASE WHEN k = 0 THEN sqrt(0.125e0) ELSE 0.5e0 END * cos((2 * n + 1) * k * pi() / 16) AS w FROM range(8) a(k), range(8) b(n))"
_DCT = f"{_BASIS}, dct_rows AS (SELECT vec_id, y, k AS j, sum(w * v) AS t FROM blocks8 JOIN basis ON n = x GROUP BY vec_id, y, k), dct AS (SELECT vec_id, k AS i, j, sum(w * t) AS c FROM dct_rows JOIN basis ON n = y GROUP BY vec_id, k, j)"


def _kernel_sql(name: str, kernel: raster.Kernel) -> str:
    return f"{name}(dy, dx, w) AS (VALUES " + ", ".join(f"({y}, {x}, {w!r}e0)" if "e" not in repr(w) else f"({y}, {x}, {w!r})" for y, x, w in kernel) + ")"


@query(f"WITH {_DCT}, e AS (SELECT vec_id, sum(CASE WHEN i + j > 2 THEN c * c ELSE 0 END) AS high, sum(c * c) AS total FROM dct GROUP BY vec_id) SELECT vec_id, round(high, 6) + 0.0 AS high, round(total, 6) + 0.0 AS total, round(CASE WHEN total = 0 THEN 0 ELSE high / total END, 6) + 0.0 AS ratio FROM e")
def dct_high_frequency_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tiles.linear(rel.tiles(spark, sf_dir), TILE, {"c": tiles.cosine()})
    return c.select("vec_id", *[r6(e).alias(n) for n, e in tiles.high_part().items()])


@query(f"WITH {_DCT}, r AS (SELECT label, vec_id % 3 AS region, sum(CASE WHEN i + j > 2 THEN c * c ELSE 0 END) AS high, sum(c * c) AS total FROM dct JOIN embeddings USING (vec_id) GROUP BY label, vec_id % 3) SELECT label, round(sum(high * CASE WHEN region = 1 THEN 2 ELSE 1 END) / sum(total * CASE WHEN region = 1 THEN 2 ELSE 1 END), 6) + 0.0 AS weighted_ratio FROM r GROUP BY label")
def dct_region_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tiles.linear(rel.tiles(spark, sf_dir), ["vec_id", "label"], {"c": tiles.cosine()})
    w = F.when(F.col("vec_id") % 3 == 1, 2).otherwise(1)
    e = c.select("label", *[(tiles.high_part()[n] * w).alias(n) for n in ("high", "total")])
    return e.groupBy("label").agg(r6(F.sum("high") / F.sum("total")).alias("weighted_ratio"))


@query("SELECT image_id, label, count(*) AS n, round(avg(r), 6) + 0.0 AS mean_r, round(avg(g), 6) + 0.0 AS mean_g, round(avg(b), 6) + 0.0 AS mean_b, round(var_pop(r), 4) + 0.0 AS var_r, round(var_pop(g), 4) + 0.0 AS var_g FROM pixels GROUP BY image_id, label")
def region_channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rel.pixels(spark, sf_dir)
    return p.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(c)).alias(f"mean_{c}") for c in "rgb"], *[(F.round(F.var_pop(c), 4) + 0.0).alias(f"var_{c}") for c in "rg"])


@query("WITH c AS (SELECT image_id, label, g // 16 AS bin, count(*) AS n FROM pixels GROUP BY ALL), p AS (SELECT image_id, label, n / CAST(sum(n) OVER (PARTITION BY image_id, label) AS DOUBLE) AS p FROM c) SELECT image_id, label, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY image_id, label")
def region_entropy16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.entropy16(rel.pixels(spark, sf_dir), ["image_id", "label"], "g").select("image_id", "label", r6("entropy").alias("entropy"))


@query("WITH s AS (SELECT image_id, label, count(*) AS n, avg(CAST(r AS DOUBLE)) AS mx, avg(CAST(b AS DOUBLE)) AS my, avg(CAST(r * r AS DOUBLE)) AS xx, avg(CAST(b * b AS DOUBLE)) AS yy, avg(CAST(r * b AS DOUBLE)) AS xy FROM pixels GROUP BY image_id, label) SELECT image_id, label, n >= 2 AND xx - mx * mx > 1e-12 AND yy - my * my > 1e-12 AS defined, round(CASE WHEN n >= 2 AND xx - mx * mx > 1e-12 AND yy - my * my > 1e-12 THEN least(greatest((xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)), -1.0e0), 1.0e0) ELSE 0 END, 6) + 0.0 AS corr FROM s")
def region_corr_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = regions.guarded_corr(rel.pixels(spark, sf_dir), ["image_id", "label"], "r", "b")
    return c.select("image_id", "label", "defined", r6("corr").alias("corr"))


@query("WITH l(label) AS (VALUES ('A'), ('N'), ('R'), ('U')), i AS (SELECT DISTINCT image_id FROM pixels), c AS (SELECT image_id, label, count(*) AS n, sum(r) AS s FROM pixels GROUP BY image_id, label) SELECT i.image_id, l.label, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(CAST(s AS DOUBLE) / n, 0), 6) + 0.0 AS mean_r FROM i CROSS JOIN l LEFT JOIN c ON c.image_id = i.image_id AND c.label = l.label")
def region_all_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rel.pixels(spark, sf_dir)
    every = p.select("image_id").distinct().withColumn("label", F.explode(F.array(*map(F.lit, "ANRU"))))
    c = p.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"))
    return every.join(c, ["image_id", "label"], "left").select("image_id", "label", F.coalesce("n", F.lit(0).cast("long")).alias("n"), r6(F.coalesce("m", F.lit(0.0))).alias("mean_r"))


@query("WITH n AS (SELECT image_id, r, row_number() OVER (PARTITION BY image_id ORDER BY r, i) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM pixels) SELECT image_id, r AS median FROM n WHERE k = n // 2")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.upper_median(rel.pixels(spark, sf_dir), ["image_id"], "r", "i")


@query("WITH e AS (SELECT vec_id, min(v) AS lo, max(v) AS hi, count(*) AS total FROM blocks8 GROUP BY vec_id), c AS (SELECT b.vec_id, CASE WHEN hi > lo THEN least(CAST(floor((v - lo) / ((hi - lo) / 50)) AS INTEGER), 49) ELSE 0 END AS bin, count(*) AS n FROM blocks8 b JOIN e ON b.vec_id = e.vec_id GROUP BY ALL) SELECT e.vec_id, CAST(k AS INTEGER) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) / CAST(total AS DOUBLE), 6) + 0.0 AS share FROM e CROSS JOIN range(50) t(k) LEFT JOIN c ON c.vec_id = e.vec_id AND c.bin = k")
def histogram50(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = raster.histogram(rel.blocks8(spark, sf_dir), TILE)
    return h.select("vec_id", "bin", "n", r6("share").alias("share"))


@query("WITH m AS (SELECT vec_id, avg(v) AS m FROM blocks8 GROUP BY vec_id), c AS (SELECT b.vec_id, avg(pow(v - m, 2)) AS m2, avg(pow(v - m, 4)) AS m4, max(abs(v)) AS peak FROM blocks8 b JOIN m ON b.vec_id = m.vec_id GROUP BY b.vec_id) SELECT vec_id, round(m2, 6) + 0.0 AS variance, round(CASE WHEN sqrt(m2) < 1e-4 THEN 0 ELSE m4 / (m2 * m2) - 3 END, 6) + 0.0 AS kurtosis, round(peak, 6) + 0.0 AS peak FROM c")
def moments_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.blocks8(spark, sf_dir).groupBy("vec_id").agg(F.var_pop("v").alias("m2"), F.kurtosis("v").alias("k"), F.max(F.abs("v")).alias("peak"))
    return s.select("vec_id", r6("m2").alias("variance"), r6(F.when(F.sqrt("m2") < 1e-4, 0.0).otherwise(F.col("k"))).alias("kurtosis"), r6("peak").alias("peak"))


@query("WITH s AS (SELECT vec_id, avg(v) AS mean, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi FROM blocks8 GROUP BY vec_id), n AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS k FROM blocks8) SELECT s.vec_id, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(v, 6) + 0.0 AS median, round(hi - lo, 6) + 0.0 AS dynamic_range, sd > 0.01 AS has_contrast FROM s JOIN n ON n.vec_id = s.vec_id AND k = 33")
def image_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = rel.blocks8(spark, sf_dir)
    s = b.groupBy("vec_id").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    j = s.join(regions.upper_median(b, TILE, "v"), "vec_id")
    return j.select("vec_id", r6("mean").alias("mean"), r6("sd").alias("sd"), r6("median").alias("median"), r6(F.col("hi") - F.col("lo")).alias("dynamic_range"), (F.col("sd") > 0.01).alias("has_contrast"))


@query("WITH z AS (SELECT vec_id, y, x, v, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM blocks8 WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, y, x, round((v - m) / s, 6) + 0.0 AS z FROM z WHERE s >= 1e-4")
def zscore_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("vec_id")
    z = rel.blocks8(spark, sf_dir).withColumns({"m": F.avg("v").over(w), "s": F.stddev_pop("v").over(w)})
    return z.where(F.col("s") >= 1e-4).select("vec_id", "y", "x", r6((F.col("v") - F.col("m")) / F.col("s")).alias("z"))


_NEAR = "near AS (SELECT a.vec_id, a.y, a.x, abs(a.v - b.v) AS d FROM blocks8 a JOIN blocks8 b ON a.vec_id = b.vec_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1)"


@query(f"WITH {_NEAR} SELECT vec_id, y, x, round(avg(d), 6) + 0.0 AS mean_step, round(max(d), 6) + 0.0 AS max_step FROM near GROUP BY vec_id, y, x")
def gradient4(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tiles.cells(tiles.map_tiles(rel.tiles(spark, sf_dir), TILE, 64, ["mean_step", "max_step"], tiles.neighbour_steps), TILE, ["mean_step", "max_step"])
    return n.select("vec_id", "y", "x", r6("mean_step").alias("mean_step"), r6("max_step").alias("max_step"))


@query("WITH w AS (SELECT a.vec_id, a.y, a.x, var_pop(b.v) AS variance FROM blocks8 a JOIN blocks8 b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.vec_id, a.y, a.x) SELECT vec_id, y, x, round(variance, 6) + 0.0 AS variance FROM w")
def local_var3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tiles.cells(tiles.map_tiles(rel.tiles(spark, sf_dir), TILE, 64, ["variance"], tiles.window_variance), TILE, ["variance"])
    return n.select("vec_id", "y", "x", r6("variance").alias("variance"))


def _stencil_sql(name: str, kernel: raster.Kernel, out: str) -> str:
    return f"{_kernel_sql('k_' + name, kernel)}, {name} AS (SELECT a.vec_id, a.y, a.x, sum(w * b.v) AS {out} FROM blocks8 a CROSS JOIN k_{name} JOIN blocks8 b ON b.vec_id = a.vec_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.vec_id, a.y, a.x)"


_SOBEL = _stencil_sql("sx", raster.SOBEL_X, "gx") + ", " + _stencil_sql("sy", raster.SOBEL_Y, "gy") + ", sobel AS (SELECT sx.vec_id, sx.y, sx.x, gx, gy, sqrt(gx * gx + gy * gy) AS m FROM sx JOIN sy ON sx.vec_id = sy.vec_id AND sx.y = sy.y AND sx.x = sy.x)"


@query(f"WITH {_SOBEL} SELECT vec_id, y, x, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy, round(m, 6) + 0.0 AS magnitude FROM sobel")
def sobel_mag(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tiles.cells(tiles.linear(rel.tiles(spark, sf_dir), TILE, _SOBEL_MAPS), TILE, ["gx", "gy"])
    return s.select("vec_id", "y", "x", r6("gx").alias("gx"), r6("gy").alias("gy"), r6(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("magnitude"))


@query(f"""WITH {_SOBEL}, t AS (SELECT *, CASE WHEN degrees(atan2(gy, gx)) < 0 THEN degrees(atan2(gy, gx)) + 180 WHEN degrees(atan2(gy, gx)) >= 180 THEN degrees(atan2(gy, gx)) - 180 ELSE degrees(atan2(gy, gx)) END AS a FROM sobel WHERE m >= 0.01),
d AS (SELECT *, CASE WHEN a < 22.5 OR a >= 157.5 THEN 0 ELSE 1 END AS dy, CASE WHEN a < 22.5 OR a >= 157.5 THEN 1 WHEN a < 67.5 THEN 1 WHEN a < 112.5 THEN 0 ELSE -1 END AS dx FROM t)
SELECT d.vec_id, d.y, d.x, round(d.m, 6) + 0.0 AS magnitude FROM d JOIN sobel p ON p.vec_id = d.vec_id AND p.y = d.y + d.dy AND p.x = d.x + d.dx JOIN sobel q ON q.vec_id = d.vec_id AND q.y = d.y - d.dy AND q.x = d.x - d.dx WHERE d.m >= p.m AND d.m >= q.m""")
def gradient_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(v: np.ndarray) -> dict[str, np.ndarray]:
        gx, gy = ((v @ m.T).reshape(-1, 8, 8) for m in _SOBEL_MAPS.values())
        return {"magnitude": tiles.thin(gx, gy, 0.01)}

    m = tiles.cells(tiles.map_tiles(rel.tiles(spark, sf_dir), TILE, 64, ["magnitude"], step), TILE, ["magnitude"])
    return m.where("magnitude > 0").select("vec_id", "y", "x", r6("magnitude").alias("magnitude"))


_GAUSS, _LOG = raster.gaussian_kernel(1.4), raster.log_kernel(1.4)


@query(f"WITH {_stencil_sql('ga', _GAUSS, 'c')} SELECT vec_id, y, x, round(c, 6) + 0.0 AS blurred FROM ga")
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tiles.cells(tiles.linear(rel.tiles(spark, sf_dir), TILE, {"c": tiles.stencil(_GAUSS)}), TILE, ["c"])
    return c.select("vec_id", "y", "x", r6("c").alias("blurred"))


@query(f"WITH {_stencil_sql('lg', _LOG, 'c')} SELECT vec_id, round(var_pop(c), 6) + 0.0 AS variance, round(max(abs(c)), 6) + 0.0 AS peak FROM lg GROUP BY vec_id")
def log_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tiles.stencil(_LOG)

    def step(v: np.ndarray) -> dict[str, np.ndarray]:
        c = v @ m.T
        return {"found": np.stack([c.var(axis=1), np.abs(c).max(axis=1)], axis=1)}

    c = tiles.map_tiles(rel.tiles(spark, sf_dir), TILE, 64, ["found"], step)
    return c.select("vec_id", r6(F.get("found", F.lit(0))).alias("variance"), r6(F.get("found", F.lit(1))).alias("peak"))


@query("SELECT a.vec_id, round(avg(abs(abs(a.v) - abs(b.v))), 6) + 0.0 AS difference, round(CASE WHEN avg((abs(a.v) + abs(b.v)) / 2) < 0.001 THEN 0 ELSE least(greatest((avg(abs(abs(a.v) - abs(b.v))) / avg((abs(a.v) + abs(b.v)) / 2) - 0.8e0) / 1.2e0, 0), 1) END, 6) + 0.0 AS asymmetry FROM blocks8 a JOIN blocks8 b ON a.vec_id = b.vec_id AND a.y = b.y AND b.x = 7 - a.x AND a.x < 4 GROUP BY a.vec_id")
def mirror_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.least(F.col("x"), 7 - F.col("x"))
    pair = rel.blocks8(spark, sf_dir).groupBy("vec_id", "y", half.alias("h")).agg(F.sum(F.when(F.col("x") < 4, F.abs("v"))).alias("a"), F.sum(F.when(F.col("x") >= 4, F.abs("v"))).alias("b"))
    s = pair.groupBy("vec_id").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("d"), F.avg((F.col("a") + F.col("b")) / 2).alias("m"))
    ratio = F.when(F.col("m") < 0.001, 0.0).otherwise(g.clamp((F.try_divide("d", "m") - 0.8) / 1.2, 0.0, 1.0))
    return s.select("vec_id", r6("d").alias("difference"), r6(ratio).alias("asymmetry"))


@query("SELECT vec_id, count(*) AS n, round(var_pop(v), 6) + 0.0 AS variance FROM blocks8 WHERE pow((x - 3.5e0) / 3, 2) + pow((y - 3.5e0) / 4, 2) <= 1 GROUP BY vec_id")
def in_ellipse_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = F.lit
    inside = g.in_ellipse(F.col("x").cast("double"), F.col("y").cast("double"), lit(3.5), lit(3.5), lit(3.0), lit(4.0), lit(0.0))
    return rel.blocks8(spark, sf_dir).where(inside).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), r6(F.var_pop("v")).alias("variance"))


def _grown(spark: SparkSession, sf_dir: str, grow: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    found = tiles.map_tiles(rel.tiles(spark, sf_dir), TILE, 64, ["inside"], lambda v: {"inside": grow(v.reshape(-1, 8, 8))})
    return tiles.cells(found, TILE, ["inside"]).where("inside > 0").select("vec_id", "y", "x")


_GROW = "WITH RECURSIVE {open}, grown AS (SELECT o.vec_id, o.y, o.x FROM o WHERE {seed} UNION SELECT o.vec_id, o.y, o.x FROM grown r JOIN o ON o.vec_id = r.vec_id AND {near}) SELECT vec_id, y, x FROM grown"


@query(_GROW.format(open="o AS (SELECT vec_id, y, x, v FROM blocks8 WHERE abs(v) <= 0.15)", seed="o.y IN (0, 7) OR o.x IN (0, 7)", near="abs(o.y - r.y) + abs(o.x - r.x) = 1"))
def flood_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    border = np.zeros((8, 8), bool)
    border[[0, 7]] = border[:, [0, 7]] = True
    return _grown(spark, sf_dir, lambda t: tiles.grow(np.abs(t) <= 0.15, np.broadcast_to(border, t.shape)))


@query(_GROW.format(open="o AS (SELECT vec_id, y, x, v FROM blocks8 WHERE abs(v) >= 0.1)", seed="abs(o.v) >= 0.25", near="abs(o.y - r.y) <= 1 AND abs(o.x - r.x) <= 1"))
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grown(spark, sf_dir, lambda t: tiles.grow(np.abs(t) >= 0.1, np.abs(t) >= 0.25, eight=True))


def _lift_sql() -> str:
    steps, source = [], "SELECT vec_id, y, x, v AS s FROM blocks8"
    for n, (factor, odd) in enumerate(((raster.ALPHA, 1), (raster.BETA, 0), (raster.GAMMA, 1), (raster.DELTA, 0))):
        steps.append(f"l{n} AS (SELECT vec_id, y, x, CASE WHEN x % 2 = {odd} THEN s + ({factor!r}e0) * (coalesce(lag(s) OVER w, lead(s) OVER w) + coalesce(lead(s) OVER w, lag(s) OVER w)) ELSE s END AS s FROM ({source}) WINDOW w AS (PARTITION BY vec_id, y ORDER BY x))")
        source = f"SELECT * FROM l{n}"
    return "WITH " + ", ".join(steps) + f" SELECT vec_id, y, CASE WHEN x % 2 = 0 THEN 'low' ELSE 'high' END AS band, CAST(x // 2 AS INTEGER) AS k, round(s * CASE WHEN x % 2 = 0 THEN {raster.K_LOW!r}e0 ELSE {raster.K_HIGH!r}e0 END, 6) + 0.0 AS c FROM l3"


@query(_lift_sql())
def wavelet97_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tiles.cells(tiles.linear(rel.tiles(spark, sf_dir), TILE, {"c": np.kron(np.eye(8), tiles.lifting(8))}), TILE, ["c"])
    low = F.col("x") < 4
    return c.select("vec_id", "y", F.when(low, "low").otherwise("high").alias("band"), (F.col("x") % 4).alias("k"), r6("c").alias("c"))


@query("SELECT vec_id, y, x, CAST(CASE WHEN v < 0 THEN -1 ELSE 1 END * floor(abs(v) * 128) AS BIGINT) AS q FROM blocks8")
def deadzone_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.blocks8(spark, sf_dir).select("vec_id", "y", "x", (F.when(F.col("v") < 0, -1).otherwise(1) * F.floor(F.abs("v") * 128)).cast("long").alias("q"))


@query("SELECT image_id, i, round(0.299e0 * r + 0.587e0 * g + 0.114e0 * b, 6) + 0.0 AS luma, round(-0.16875e0 * r - 0.33126e0 * g + 0.5e0 * b, 6) + 0.0 AS cb, round(0.5e0 * r - 0.41869e0 * g - 0.08131e0 * b, 6) + 0.0 AS cr, round((0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b) / 255, 6) + 0.0 AS gray709 FROM pixels")
def colour_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, gr, b = F.col("r"), F.col("g"), F.col("b")
    return rel.pixels(spark, sf_dir).select("image_id", "i", r6(0.299 * r + 0.587 * gr + 0.114 * b).alias("luma"), r6(-0.16875 * r - 0.33126 * gr + 0.5 * b).alias("cb"), r6(0.5 * r - 0.41869 * gr - 0.08131 * b).alias("cr"), r6((0.2126 * r + 0.7152 * gr + 0.0722 * b) / 255).alias("gray709"))


@query("SELECT image_id, label, count(*) AS n, round(avg(pow(r - g, 2)), 6) + 0.0 AS mse, round(CASE WHEN sum(pow(r - g, 2)) = 0 THEN NULL ELSE 10 * log10(65025 / avg(pow(r - g, 2))) END, 6) + 0.0 AS psnr, count(*) FILTER (WHERE r <> g) AS changed FROM pixels GROUP BY image_id, label")
def region_error_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = ((F.col("r") - F.col("g")) * (F.col("r") - F.col("g"))).cast("double")
    s = rel.pixels(spark, sf_dir).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"), F.avg(square).alias("m"), F.count_if(F.col("r") != F.col("g")).alias("changed"))
    return s.select("image_id", "label", "n", r6("m").alias("mse"), r6(F.when(F.col("m") > 0, 10 * F.log10(F.try_divide(F.lit(65025.0), "m")))).alias("psnr"), "changed")
