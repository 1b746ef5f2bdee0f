"""Queries over whole tiles: edges, filter banks, masks, resampling, wavelet synthesis."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portrel.operators import raster, tiles
from portrel.plans.images import _GAUSS, _kernel_sql
from portrel.plans.registry import query, r6
from portrel.sources import relations as rel

TILE = ["vec_id"]


def _stencil(name: str, source: str, column: str, kernel: raster.Kernel | None, out: str) -> str:
    """A common table expression of a correlation over (vec_id, y, x, column)."""
    head = f"{_kernel_sql('k_' + name, kernel)}, " if kernel else ""
    return f"{head}{name} AS (SELECT a.vec_id, a.y, a.x, sum(w * b.{column}) AS {out} FROM {source} a CROSS JOIN k_{name} JOIN {source} b ON b.vec_id = a.vec_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.vec_id, a.y, a.x)"


_THIN = """{sobel}, t AS (SELECT *, CASE WHEN degrees(atan2(gy, gx)) < 0 THEN degrees(atan2(gy, gx)) + 180 WHEN degrees(atan2(gy, gx)) >= 180 THEN degrees(atan2(gy, gx)) - 180 ELSE degrees(atan2(gy, gx)) END AS turn FROM sobel WHERE m >= 0.1),
d AS (SELECT *, CASE WHEN turn < 22.5 OR turn >= 157.5 THEN 0 ELSE 1 END AS dy, CASE WHEN turn < 22.5 OR turn >= 157.5 THEN 1 WHEN turn < 67.5 THEN 1 WHEN turn < 112.5 THEN 0 ELSE -1 END AS dx FROM t),
e AS (SELECT d.vec_id, d.y, d.x, d.m FROM d JOIN sobel p ON p.vec_id = d.vec_id AND p.y = d.y + d.dy AND p.x = d.x + d.dx JOIN sobel q ON q.vec_id = d.vec_id AND q.y = d.y - d.dy AND q.x = d.x - d.dx WHERE d.m >= p.m AND d.m >= q.m)"""
_CANNY_SOBEL = ", ".join([_stencil("blurred", "blocks8", "v", _GAUSS, "b"), _stencil("sx", "blurred", "b", raster.SOBEL_X, "gx"), _stencil("sy", "blurred", "b", raster.SOBEL_Y, "gy"), "sobel AS (SELECT sx.vec_id, sx.y, sx.x, gx, gy, sqrt(gx * gx + gy * gy) AS m FROM sx JOIN sy ON sx.vec_id = sy.vec_id AND sx.y = sy.y AND sx.x = sy.x)"])


@query(f"""WITH RECURSIVE {_THIN.format(sobel=_CANNY_SOBEL)},
kept AS (SELECT vec_id, y, x, m FROM e WHERE m >= 0.2 UNION SELECT e.vec_id, e.y, e.x, e.m FROM kept k JOIN e ON e.vec_id = k.vec_id AND abs(e.y - k.y) <= 1 AND abs(e.x - k.x) <= 1),
linked AS (SELECT vec_id, y * 8 + x AS root, y, x, m FROM kept UNION SELECT k.vec_id, l.root, k.y, k.x, k.m FROM linked l JOIN kept k ON k.vec_id = l.vec_id AND abs(k.y - l.y) <= 1 AND abs(k.x - l.x) <= 1),
labelled AS (SELECT vec_id, y, x, any_value(m) AS m, min(root) AS segment FROM linked GROUP BY vec_id, y, x),
long AS (SELECT vec_id, segment, count(*) AS n FROM labelled GROUP BY vec_id, segment HAVING count(*) >= 3),
counts AS (SELECT vec_id, count(*) AS edges, round(avg(m), 6) + 0.0 AS strength FROM labelled GROUP BY vec_id)
SELECT c.vec_id, edges, strength, CAST((SELECT count(*) FROM long l WHERE l.vec_id = c.vec_id) AS BIGINT) AS segments, CAST(coalesce((SELECT sum(n) FROM long l WHERE l.vec_id = c.vec_id), 0) AS BIGINT) AS in_segments FROM counts c""")
def canny_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge pixels, their mean strength, and connected segments of at least three, of each tile with edges."""
    blur = tiles.stencil(_GAUSS)
    found = tiles.map_tiles(rel.tiles(spark, sf_dir), TILE, 64, ["edge", "segment"], lambda v: {n: a.reshape(len(v), -1) for n, a in tiles.canny(v, blur, 0.1, 0.2).items()})
    edges, segment = F.filter("edge", lambda m: m > 0), F.filter("segment", lambda s: s >= 0)
    one = found.select("vec_id", F.size(edges).cast("long").alias("edges"), r6(F.aggregate(edges, F.lit(0.0), lambda a, m: a + m) / F.size(edges)).alias("strength"), F.size(F.array_distinct(segment)).cast("long").alias("segments"), F.size(segment).cast("long").alias("in_segments"))
    return one.where("edges > 0")


_ANGLES = (0.0, 22.5, 45.0, 67.5, 90.0)
_BANK = """raw AS (SELECT deg, CAST(dy AS BIGINT) AS dy, CAST(dx AS BIGINT) AS dx, CASE WHEN -(u * u + 0.25e0 * v * v) / 50 >= -20 THEN exp(-(u * u + 0.25e0 * v * v) / 50) * cos(2 * pi() * u / 10) ELSE 0 END AS g
FROM (SELECT deg, dy, dx, dx * cos(radians(deg)) + dy * sin(radians(deg)) AS u, -dx * sin(radians(deg)) + dy * cos(radians(deg)) AS v FROM (VALUES (0e0), (22.5e0), (45e0), (67.5e0), (90e0)) k(deg), range(-10, 11) a(dy), range(-10, 11) b(dx))),
level AS (SELECT deg, avg(g) AS m FROM raw GROUP BY deg), norm AS (SELECT r.deg, any_value(l.m) AS m, sqrt(sum(pow(g - l.m, 2))) AS n FROM raw r JOIN level l ON l.deg = r.deg GROUP BY r.deg),
bank AS (SELECT r.deg, dy, dx, (g - m) / n AS w FROM raw r JOIN norm USING (deg) WHERE abs(dy) < 8 AND abs(dx) < 8),
answers AS (SELECT a.vec_id, k.deg, a.y, a.x, sum(k.w * b.v) AS c FROM blocks8 a CROSS JOIN bank k JOIN blocks8 b ON b.vec_id = a.vec_id AND b.y = a.y + k.dy AND b.x = a.x + k.dx GROUP BY a.vec_id, k.deg, a.y, a.x)"""


def _gabor_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, asymmetry): for each angle of the bank, the mean difference of both halves' answers, the right one mirrored."""
    maps = {f"a{i}": tiles.stencil(raster.gabor_kernel(d)) for i, d in enumerate(_ANGLES)}

    def step(v: np.ndarray) -> dict[str, np.ndarray]:
        found = []
        for m in maps.values():
            t = np.abs((v @ m.T).reshape(-1, 8, 8))
            found.append(np.abs(t[:, :, :4] - t[:, :, :3:-1]).mean(axis=(1, 2)))
        return {"asymmetry": np.stack(found, axis=1)}

    return tiles.map_tiles(rel.tiles(spark, sf_dir), TILE, 64, ["asymmetry"], step)


@query(f"WITH {_BANK} SELECT l.vec_id, CAST(l.deg AS DOUBLE) AS degrees, round(avg(abs(abs(l.c) - abs(r.c))), 6) + 0.0 AS difference FROM answers l JOIN answers r ON r.vec_id = l.vec_id AND r.deg = l.deg AND r.y = l.y AND r.x = 7 - l.x WHERE l.x < 4 GROUP BY l.vec_id, l.deg")
def gabor_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _gabor_asymmetry(spark, sf_dir).select("vec_id", F.posexplode("asymmetry").alias("i", "d"))
    return each.select("vec_id", F.element_at(F.array(*map(F.lit, _ANGLES)), F.col("i") + 1).alias("degrees"), r6("d").alias("difference"))


@query(f"WITH {_BANK}, d AS (SELECT l.vec_id, l.deg, avg(abs(abs(l.c) - abs(r.c))) AS d FROM answers l JOIN answers r ON r.vec_id = l.vec_id AND r.deg = l.deg AND r.y = l.y AND r.x = 7 - l.x WHERE l.x < 4 GROUP BY l.vec_id, l.deg) SELECT vec_id, round(avg(d) FILTER (deg IN (0, 90)), 6) + 0.0 AS illumination, round(avg(d) FILTER (deg NOT IN (0, 90)), 6) + 0.0 AS pose FROM d GROUP BY vec_id")
def symmetry_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upright and level answers tell of illumination, slanted ones of pose."""
    at = lambda *which: sum((F.get("asymmetry", F.lit(i)) for i in which[1:]), F.get("asymmetry", F.lit(which[0]))) / len(which)
    return _gabor_asymmetry(spark, sf_dir).select("vec_id", r6(at(0, 4)).alias("illumination"), r6(at(1, 2, 3)).alias("pose"))


@query(f"WITH {_stencil('lg', 'blocks8', 'v', raster.log_kernel(1.4), 'c')} SELECT vec_id, count(*) AS n, round(var_pop(c), 6) + 0.0 AS variance FROM lg WHERE pow((x - 3.5e0) / 3, 2) + pow((y - 3.5e0) / 4, 2) <= 1 GROUP BY vec_id")
def elliptical_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of the Laplacian of Gaussian inside of an ellipse: filtered first, masked then."""
    inside = np.array([((x - 3.5) / 3) ** 2 + ((y - 3.5) / 4) ** 2 <= 1 for y in range(8) for x in range(8)])
    m = tiles.stencil(raster.log_kernel(1.4))[inside]
    c = tiles.map_tiles(rel.tiles(spark, sf_dir), TILE, 64, ["found"], lambda v: {"found": np.stack([np.full(len(v), inside.sum()), (v @ m.T).var(axis=1)], axis=1)})
    return c.select("vec_id", F.get("found", F.lit(0)).cast("long").alias("n"), r6(F.get("found", F.lit(1))).alias("variance"))


@query("""WITH near AS (SELECT a.vec_id, a.y, a.x, avg(abs(a.v - b.v)) AS step FROM blocks8 a JOIN blocks8 b ON a.vec_id = b.vec_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY a.vec_id, a.y, a.x),
wide AS (SELECT a.vec_id, a.y, a.x, var_pop(b.v) AS variance FROM blocks8 a JOIN blocks8 b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.vec_id, a.y, a.x)
SELECT vec_id, count(*) FILTER (step <= 0.1e0 AND variance <= 0.01e0) AS low_texture, count(*) FILTER (step > 0.1e0) AS over_step FROM near JOIN wide USING (vec_id, y, x) GROUP BY vec_id""")
def low_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels whose mean step to their neighbours and whose variance around are both small."""
    step = lambda v: {**tiles.neighbour_steps(v), **tiles.window_variance(v)}
    both = tiles.map_tiles(rel.tiles(spark, sf_dir), TILE, 64, ["mean_step", "variance"], step)
    pairs = F.arrays_zip("mean_step", "variance")
    few = F.filter(pairs, lambda p: (p["mean_step"] <= 0.1) & (p["variance"] <= 0.01))
    return both.select("vec_id", F.size(few).cast("long").alias("low_texture"), F.size(F.filter("mean_step", lambda s: s > 0.1)).cast("long").alias("over_step"))


@query("SELECT vec_id, y, x, round(v, 6) + 0.0 AS v FROM blocks8")
def wavelet_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels of analysis in two dimensions, then synthesis: the pixels come back."""
    forward = tiles.wavelet(8, 3)
    coefficients = tiles.linear(rel.tiles(spark, sf_dir), TILE, {"v": forward})
    back = tiles.linear(coefficients, TILE, {"v": np.linalg.inv(forward)})
    return tiles.cells(back, TILE, ["v"]).select("vec_id", "y", "x", r6("v").alias("v"))


def _levels_sql() -> str:
    steps, source, n = [], "(SELECT vec_id, y, x, v AS s FROM blocks8)", 0
    for level in range(3):
        for factor, odd in ((raster.ALPHA, 1), (raster.BETA, 0), (raster.GAMMA, 1), (raster.DELTA, 0)):
            steps.append(f"l{n} AS (SELECT vec_id, y, x, CASE WHEN x % 2 = {odd} THEN s + ({factor!r}e0) * (coalesce(lag(s) OVER w, lead(s) OVER w) + coalesce(lead(s) OVER w, lag(s) OVER w)) ELSE s END AS s FROM {source} WINDOW w AS (PARTITION BY vec_id, y ORDER BY x))")
            source, n = f"l{n}", n + 1
        steps.append(f"low{level} AS (SELECT vec_id, y, x // 2 AS x, s * {raster.K_LOW!r}e0 AS s FROM {source} WHERE x % 2 = 0)")
        steps.append(f"high{level} AS (SELECT vec_id, y, {8 >> (level + 1)} + x // 2 AS k, s * {raster.K_HIGH!r}e0 AS s FROM {source} WHERE x % 2 = 1)")
        source = f"low{level}"
    every = " UNION ALL ".join([f"SELECT vec_id, y, k, s FROM high{i}" for i in range(3)] + ["SELECT vec_id, y, x AS k, s FROM low2"])
    return f"WITH {', '.join(steps)} SELECT vec_id, y, CAST(k AS INTEGER) AS k, round(s, 6) + 0.0 AS c FROM ({every})"


@query(_levels_sql())
def wavelet97_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels along each line: the low band's four, two and one halves in front of the high bands."""
    rows = np.kron(np.eye(8), tiles.lifting_levels(8, 3))
    c = tiles.cells(tiles.linear(rel.tiles(spark, sf_dir), TILE, {"c": rows}), TILE, ["c"])
    return c.select("vec_id", "y", F.col("x").alias("k"), r6("c").alias("c"))


@query("""WITH m AS (SELECT vec_id, y, x FROM blocks8 WHERE abs(v) >= 0.2), c AS (SELECT k, CASE WHEN k < 4 THEN 2 * k ELSE 2 * (k - 4) + 1 END AS pos, CASE WHEN k < 4 THEN 3 ELSE 4 END AS reach FROM range(8) t(k))
SELECT m.vec_id, m.y, CAST(k AS INTEGER) AS k FROM m, c WHERE least(abs(x - pos), abs(x + pos), abs(x - (14 - pos))) <= reach GROUP BY m.vec_id, m.y, k""")
def region_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of one level along lines that a region's pixels need: where the filters' supports, mirrored at the borders, reach."""
    found = tiles.map_tiles(rel.tiles(spark, sf_dir), TILE, 64, ["needed"], lambda v: {"needed": tiles.needed(np.abs(v) >= 0.2)})
    return tiles.cells(found, TILE, ["needed"]).where("needed > 0").select("vec_id", "y", F.col("x").alias("k"))


_CHIP = (0.8, 0.15, -0.15, 0.8, 0.9, -0.4)


def _weight_sql(t: str) -> str:
    return f"CASE WHEN abs({t}) <= 1 THEN 1.5e0 * pow(abs({t}), 3) - 2.5e0 * pow(abs({t}), 2) + 1 WHEN abs({t}) < 2 THEN -0.5e0 * (pow(abs({t}), 3) - 5 * pow(abs({t}), 2) + 8 * abs({t}) - 4) ELSE 0 END"


@query(f"""WITH o AS (SELECT CAST(oy AS INTEGER) AS oy, CAST(ox AS INTEGER) AS ox, 0.8e0 * ox - 0.15e0 * oy + 0.9e0 AS sx, 0.15e0 * ox + 0.8e0 * oy - 0.4e0 AS sy FROM range(9) a(oy), range(9) b(ox)),
t AS (SELECT oy, ox, y, x, ({_weight_sql('sx - x')}) * ({_weight_sql('sy - y')}) AS w FROM o, range(8) a(y), range(8) b(x) WHERE sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7 AND x BETWEEN floor(sx) - 1 AND floor(sx) + 2 AND y BETWEEN floor(sy) - 1 AND floor(sy) + 2),
s AS (SELECT b.vec_id, t.oy, t.ox, sum(w * (128 + 200 * b.v)) / sum(w) AS g FROM t JOIN blocks8 b ON b.y = t.y AND b.x = t.x GROUP BY b.vec_id, t.oy, t.ox)
SELECT e.vec_id, o.oy AS y, o.ox AS x, CASE WHEN g IS NULL THEN 128 ELSE round(least(greatest(g, 0), 255), 4) + 0.0 END AS grey FROM embeddings e CROSS JOIN o LEFT JOIN s ON s.vec_id = e.vec_id AND s.oy = o.oy AND s.ox = o.ox""")
def bicubic_chip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as grey values, resampled to 9x9 through an affine map; what maps outside is grey 128."""
    m, outside = tiles.bicubic(8, 8, 9, 9, _CHIP)
    chip = lambda v: {"grey": np.where(outside, 128.0, np.clip((128 + 200 * v) @ m.T, 0, 255))}
    c = tiles.cells(tiles.map_tiles(rel.tiles(spark, sf_dir), TILE, 64, ["grey"], chip), TILE, ["grey"], 9)
    return c.select("vec_id", "y", "x", (F.round("grey", 4) + 0.0).alias("grey"))


@query("""SELECT vec_id, count(*) FILTER (r) AS rectangle, count(*) FILTER (c) AS circle, count(*) FILTER (e AND NOT c AND NOT r) AS ellipse_only, count(*) FILTER (NOT r AND NOT c AND NOT e) AS outside, round(sum(CASE WHEN r THEN v WHEN c THEN 2 * v WHEN e THEN 3 * v ELSE 0 END), 6) + 0.0 AS first_hit
FROM (SELECT *, y BETWEEN 1 AND 3 AND x BETWEEN 2 AND 4 AS r, pow(x - 4, 2) + pow(y - 4, 2) <= 6.25 AS c, pow((x - 3.5e0) / 4, 2) + pow((y - 3.5e0) / 2, 2) <= 1 AS e FROM blocks8) GROUP BY vec_id""")
def region_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangle, circle and ellipse as masks, and the first of them that a pixel is in."""
    x, y = F.col("x"), F.col("y")
    b = rel.blocks8(spark, sf_dir).withColumns({"r": raster.in_rectangle(x, y, 2, 1, 3, 3), "c": raster.in_circle(x, y, 4.0, 4.0, 2.5), "e": raster.in_ellipse_grid(x, y, 3.5, 3.5, 4.0, 2.0)})
    first = raster.first_hit([("r", 1.0), ("c", 2.0), ("e", 3.0)])
    return b.groupBy("vec_id").agg(F.count_if("r").alias("rectangle"), F.count_if("c").alias("circle"), F.count_if(F.col("e") & ~F.col("c") & ~F.col("r")).alias("ellipse_only"), F.count_if(~F.col("r") & ~F.col("c") & ~F.col("e")).alias("outside"), r6(F.sum(F.col("v") * first)).alias("first_hit"))


@query("SELECT vec_id, count(*) FILTER (head) AS head, count(*) FILTER (head AND NOT face) AS hair, count(*) FILTER (NOT face) AS outside, count(*) FILTER (head OR face) AS either, bool_or(face AND y = 3 AND x = 4) AS holds_centre FROM (SELECT *, v > -0.05 AS head, v > 0.1 AS face FROM blocks8) GROUP BY vec_id")
def mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks by threshold, their differences and unions, counted."""
    head, face = F.col("v") > -0.05, F.col("v") > 0.1
    return rel.blocks8(spark, sf_dir).groupBy("vec_id").agg(
        F.count_if(head).alias("head"), F.count_if(head & ~face).alias("hair"), F.count_if(~face).alias("outside"), F.count_if(head | face).alias("either"), F.bool_or(face & (F.col("y") == 3) & (F.col("x") == 4)).alias("holds_centre"),
    )


@query("SELECT g.vec_id, CAST(wy AS INTEGER) AS y, CAST(wx AS INTEGER) AS x, round(coalesce(b.v, 0), 6) + 0.0 AS v FROM (SELECT vec_id, wy, wx FROM embeddings, range(5) a(wy), range(6) b(wx)) g LEFT JOIN blocks8 b ON b.vec_id = g.vec_id AND b.y = wy - 2 AND b.x = wx + 4")
def window_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 5x6 window that begins two rows above and four columns into the tile; what is not on the tile is zero."""
    m = np.zeros((30, 64))
    for i in range(30):
        y, x = i // 6 - 2, i % 6 + 4
        if 0 <= y < 8 and 0 <= x < 8:
            m[i, y * 8 + x] = 1
    w = tiles.cells(tiles.linear(rel.tiles(spark, sf_dir), TILE, {"v": m}), TILE, ["v"], 6)
    return w.select("vec_id", "y", "x", r6("v").alias("v"))


@query("""WITH c AS (SELECT image_id, det_id, greatest(floor(x - 0.2e0 * w), 0) AS x0, greatest(floor(y - 0.2e0 * h), 0) AS y0, least(ceil(x + 1.2e0 * w), 96) AS x1, least(ceil(y + 1.2e0 * h), 96) AS y1 FROM boxes)
SELECT image_id, det_id, CAST(x0 AS BIGINT) AS x, CAST(y0 AS BIGINT) AS y, CAST(x1 - x0 AS BIGINT) AS w, CAST(y1 - y0 AS BIGINT) AS h, CAST(floor((x1 - x0) / 2) AS BIGINT) AS half, (x1 - x0) % 2 = 1 AS dropped FROM c""")
def face_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces padded by a fifth, clipped to the image, and how wide each mirrored half is; an odd column in the middle is dropped."""
    return raster.halves(rel.boxes(spark, sf_dir), 96, 96, 0.2).select("image_id", "det_id", "x", "y", "w", "h", "half", "dropped")


@query("SELECT vec_id, CAST((y // 3) * 3 + x // 3 AS INTEGER) AS tile, count(*) AS n, sum(CAST(floor(v * 255 + 0.5e0) AS BIGINT)) AS level FROM blocks8 GROUP BY vec_id, CAST((y // 3) * 3 + x // 3 AS INTEGER)")
def tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels dealt into 3x3 tiles, the last ones smaller, as whole levels."""
    b = rel.blocks8(spark, sf_dir)
    return b.groupBy("vec_id", raster.tile_of(F.col("y"), F.col("x"), 3, 3, 8).alias("tile")).agg(F.count(F.lit(1)).alias("n"), F.sum(raster.to_level(F.col("v"))).alias("level"))
