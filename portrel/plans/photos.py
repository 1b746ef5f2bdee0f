"""Queries over whole images: blurs, morphology, sampling, contours and what is measured along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portrel.operators import contours, edges, influence, raster, resample, strips
from portrel.plans.registry import query, r6
from portrel.sources import relations as rel

KEY = ["image_id"]
WIDTH = 8 * rel.TILES_WIDE


def _reflected(place: str, size: str) -> str:
    around = f"((({place}) % (2 * ({size}) - 2) + 2 * ({size}) - 2) % (2 * ({size}) - 2))"
    return f"CASE WHEN {around} < {size} THEN {around} ELSE 2 * ({size}) - 2 - {around} END"


def _blur_sql(name: str, source: str, channels: dict[str, str], sigma: float) -> str:
    """Common table expressions of a separable blur by joins with its kernel: name(image_id, y, x, height, channels)."""
    kernel = strips.gaussian(sigma)
    rows = ", ".join(f"({k - len(kernel) // 2}, {w!r}e0)" if "e" not in repr(float(w)) else f"({k - len(kernel) // 2}, {w!r})" for k, w in enumerate(map(float, kernel)))
    along = ", ".join(f"sum(k.w * s.{c}) AS {n}" for n, c in channels.items())
    across = ", ".join(f"sum(k.w * s.{n}) AS {n}" for n in channels)
    place = "a.image_id, a.y, a.x, a.height"
    return (
        f"{name}_k(d, w) AS (VALUES {rows}), {name}_h AS MATERIALIZED (SELECT {place}, {along} FROM {source} a CROSS JOIN {name}_k k JOIN {source} s ON s.image_id = a.image_id AND s.y = a.y AND s.x = {_reflected('a.x + k.d', str(WIDTH))} GROUP BY {place}), "
        f"{name} AS MATERIALIZED (SELECT {place}, {across} FROM {name}_h a CROSS JOIN {name}_k k JOIN {name}_h s ON s.image_id = a.image_id AND s.x = a.x AND s.y = {_reflected('a.y + k.d', 'a.height')} GROUP BY {place})"
    )


_WEIGHED = "round(sum({0} * (x + 1)), 6) + 0.0 AS {1}"


@query(f"WITH {_blur_sql('bl', 'mosaics', {'v': 'v', 'w': 'w'}, 1.5)} SELECT image_id, y, {_WEIGHED.format('v', 'v')}, {_WEIGHED.format('w', 'w')} FROM bl GROUP BY image_id, y")
def photo_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separable blur with reflected borders, in strips with a halo of three sigmas; each line summed by place."""
    b = strips.blurred(rel.mosaics(spark, sf_dir), KEY, {"v": "v", "w": "w"}, 1.5)
    weighed = lambda c: r6(F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)).alias(c)
    return b.select("image_id", "y", weighed("v"), weighed("w"))


@query(f"WITH m AS (SELECT image_id, y, x, height, v + 1 AS v FROM mosaics), e AS (SELECT a.image_id, a.y, a.x, CASE WHEN a.y < 5 OR a.x < 5 OR a.y >= a.height - 5 OR a.x >= {WIDTH - 5} THEN 0 ELSE min(s.v) END AS v FROM m a JOIN m s ON s.image_id = a.image_id AND s.y BETWEEN a.y - 5 AND a.y + 5 AND s.x BETWEEN a.x - 5 AND a.x + 5 GROUP BY a.image_id, a.y, a.x, a.height) SELECT image_id, y, {_WEIGHED.format('v', 'v')} FROM e GROUP BY image_id, y")
def photo_erosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey erosion by the square of eleven pixels, nothing outside the image; each line summed by place."""
    m = rel.mosaics(spark, sf_dir).select("image_id", "y", "height", F.transform("v", lambda v: v + 1).alias("v"))
    e = strips.eroded(m, KEY, "v", 5)
    return e.select("image_id", "y", r6(F.aggregate(F.transform("eroded", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)).alias("v"))


_OPPONENT_SQL = ", ".join([
    "oo AS (SELECT image_id, y, x, height, r - g AS o, cr - cg AS c FROM photos)", _blur_sql("ob", "oo", {"o": "o", "c": "c"}, contours.OPPONENT),
    "pairs AS (SELECT image_id, y, x, o, c, lead(o) OVER w AS o2, lead(c) OVER w AS c2 FROM ob WINDOW w AS (PARTITION BY image_id, y ORDER BY x))",
    "hits AS (SELECT image_id, y, 0 AS kind, x - o / (o2 - o) AS spot FROM pairs WHERE o * o2 <= 0 AND abs(o2 - o) > 1e-9 UNION ALL SELECT image_id, y, 1, x - c / (c2 - c) FROM pairs WHERE c * c2 <= 0 AND abs(c2 - c) > 1e-9)",
    "inside AS (SELECT h.*, CAST(spot > center AS INTEGER) AS side FROM hits h JOIN necklines n ON n.image_id = h.image_id AND h.y BETWEEN first_row AND last_row AND spot <> center)",
    "spots AS (SELECT n.image_id, s.side, m.y FROM necklines n JOIN (SELECT DISTINCT image_id, y FROM mosaics) m ON m.image_id = n.image_id AND m.y BETWEEN first_row AND last_row CROSS JOIN (VALUES (0), (1)) s(side))",
    "contour AS MATERIALIZED (SELECT p.image_id, p.side, p.y, CASE WHEN p.side = 0 THEN max(spot) ELSE min(spot) END AS position FROM spots p LEFT JOIN inside i ON i.kind = 0 AND i.image_id = p.image_id AND i.side = p.side AND i.y = p.y GROUP BY p.image_id, p.side, p.y)",
    "anchored AS MATERIALIZED (SELECT c.image_id, c.side, c.y, c.position, arg_min(i.spot, (abs(i.spot - c.position), i.spot)) AS now FROM contour c LEFT JOIN inside i ON i.kind = 1 AND i.image_id = c.image_id AND i.side = c.side AND i.y = c.y AND abs(i.spot - c.position) <= 8 GROUP BY ALL)",
])


@query(f"WITH {_OPPONENT_SQL} SELECT image_id, side, y, round(position, 6) + 0.0 AS source, round(now, 6) + 0.0 AS candidate FROM anchored")
def contour_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's contours, and the candidate's nearest to them."""
    source, candidate = rel.photos(spark, sf_dir)
    regions = rel.necklines(spark, sf_dir)
    own = strips.kept(contours.contours(source, regions, KEY))
    now = contours.contours(candidate, regions, KEY, own)
    return strips.matched(own, now.withColumnRenamed("position", "now"), ["image_id", "side", "y"]).select("image_id", "side", "y", r6("position").alias("source"), r6("now").alias("candidate"))


_DISTANCE_SQL = f"""WITH {_OPPONENT_SQL}, d AS (SELECT a.image_id, a.side, a.y, min(sqrt((a.now - b.position) * (a.now - b.position) + (a.y - b.y) * (a.y - b.y))) AS far FROM anchored a JOIN contour b ON a.image_id = b.image_id AND b.position IS NOT NULL WHERE a.now IS NOT NULL GROUP BY a.image_id, a.side, a.y)
SELECT image_id, count(*) AS n, round(quantile_cont(far, 0.5), 6) + 0.0 AS median, round(quantile_cont(far, 0.95), 6) + 0.0 AS p95, round(max(far), 6) + 0.0 AS most FROM d GROUP BY image_id"""


@query(_DISTANCE_SQL)
def contour_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the candidate's contour points are from the nearest of the source's, by cells that widen."""
    source, candidate = rel.photos(spark, sf_dir)
    regions = rel.necklines(spark, sf_dir)
    own = strips.kept(contours.contours(source, regions, KEY))
    now = contours.contours(candidate, regions, KEY, own)
    point = lambda c: c.where("position is not null").select("image_id", (F.col("y") * 2 + F.col("side")).alias("id"), F.col("position").alias("x"), F.col("y").cast("double").alias("y"))
    d = contours.nearest_points(point(now), point(own), KEY, 0.25)
    half, high = F.percentile("far", F.lit(0.5)), F.percentile("far", F.lit(0.95))
    return d.groupBy("image_id").agg(F.count("far").alias("n"), r6(half).alias("median"), r6(high).alias("p95"), r6(F.max("far")).alias("most"))


_STEP = f"{2 * contours.REACH / (contours.PLACES - 1)!r}e0"
_bilinear = lambda c: f"(1 - fy) * ((1 - fx) * a.{c} + fx * b.{c}) + fy * ((1 - fx) * d.{c} + fx * e.{c}) AS {c}"
_CHANNELS = ("r", "g", "b", "cr", "cg", "cb")
_PROFILE_SQL = ", ".join([
    "whole AS (SELECT image_id FROM contour GROUP BY image_id HAVING count(*) = count(position))",
    "turned AS (SELECT *, 1 / sqrt(1 + slope * slope) AS nx, -slope / sqrt(1 + slope * slope) AS ny FROM (SELECT *, CASE WHEN before IS NULL THEN behind - position WHEN behind IS NULL THEN position - before ELSE (behind - before) / 2 END AS slope FROM (SELECT *, lag(position) OVER w AS before, lead(position) OVER w AS behind FROM contour JOIN whole USING (image_id) WINDOW w AS (PARTITION BY image_id, side ORDER BY y))))",
    f"dots AS (SELECT t.image_id, side, t.y, CAST(k AS INTEGER) AS k, position + nx * (k * {_STEP} - 12) AS px, t.y + ny * (k * {_STEP} - 12) AS py, h.height FROM turned t JOIN (SELECT DISTINCT image_id, height FROM mosaics) h ON h.image_id = t.image_id, range({contours.PLACES}) r(k))",
    f"near AS (SELECT *, CAST(floor(qx) AS INTEGER) AS x0, CAST(floor(qy) AS INTEGER) AS y0, qx - floor(qx) AS fx, qy - floor(qy) AS fy FROM (SELECT *, least(greatest(px, 0), {WIDTH} - 1.000001e0) AS qx, least(greatest(py, 0), height - 1.000001e0) AS qy FROM dots))",
    f"seen AS MATERIALIZED (SELECT n.image_id, n.side, n.y, n.k, {', '.join(map(_bilinear, _CHANNELS))} FROM near n " + " ".join(f"JOIN photos {t} ON {t}.image_id = n.image_id AND {t}.y = n.y0 + {dy} AND {t}.x = n.x0 + {dx}" for t, dy, dx in (("a", 0, 0), ("b", 0, 1), ("d", 1, 0), ("e", 1, 1))) + ")",
    "means AS (SELECT image_id, side, y, " + ", ".join(f"avg({c}) FILTER (WHERE k < 12) AS {c}0, avg({c}) FILTER (WHERE k >= 85) AS {c}1" for c in _CHANNELS) + " FROM seen GROUP BY image_id, side, y)",
    "way AS (SELECT s.image_id, s.side, s.y, s.k, v.kind, CASE WHEN kind = 0 THEN (r - g - (r0 - g0)) / (CASE WHEN abs(r1 - g1 - r0 + g0) > 1e-9 THEN r1 - g1 - r0 + g0 ELSE 1 END) ELSE (cr - cg - (cr0 - cg0)) / (CASE WHEN abs(cr1 - cg1 - cr0 + cg0) > 1e-9 THEN cr1 - cg1 - cr0 + cg0 ELSE 1 END) END AS v FROM seen s JOIN means m ON m.image_id = s.image_id AND m.side = s.side AND m.y = s.y CROSS JOIN (VALUES (0), (1)) v(kind))",
    f"met AS (SELECT image_id, side, y, kind, level, (k + (-p / (q - p))) * {_STEP} - 12 AS o FROM (SELECT w.*, l.level, v - level AS p, lead(v) OVER (PARTITION BY image_id, side, y, kind, level ORDER BY k) - level AS q FROM way w CROSS JOIN (VALUES (0.1e0), (0.9e0)) l(level)) WHERE p * q <= 0 AND abs(q - p) > 1e-9)",
    "best AS (SELECT image_id, side, y, kind, level, arg_min(o, (abs(o), o)) AS o FROM met GROUP BY ALL)",
    "widths AS MATERIALIZED (SELECT m.image_id, m.side, m.y, " + ", ".join(f"(SELECT abs(max(o) FILTER (WHERE level > 0.5) - max(o) FILTER (WHERE level < 0.5)) FROM best b WHERE b.image_id = m.image_id AND b.side = m.side AND b.y = m.y AND b.kind = {k}) AS w{k}" for k in (0, 1)) + " FROM means m)",
])


@query(f"WITH {_OPPONENT_SQL}, {_PROFILE_SQL} SELECT image_id, side, y, round(w0, 6) + 0.0 AS source, round(w1, 6) + 0.0 AS candidate FROM widths")
def transition_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How wide the edge is on each line of both sides, along normals of the source's contours, between pixels; images whose
    contours are whole."""
    source, candidate = rel.photos(spark, sf_dir)
    own = strips.kept(contours.contours(source, rel.necklines(spark, sf_dir), KEY))
    whole = own.groupBy("image_id").agg(F.max(F.col("position").isNull()).alias("lost")).where("not lost").select("image_id")
    points = contours.profiles(strips.told(own, whole, KEY), KEY)
    both = strips.matched(contours.sampled_profiles(source, points, KEY), contours.sampled_profiles(candidate, points, KEY, "c_"), ["image_id", "side", "y"])
    opponent = lambda p: F.zip_with(p + "r", p + "g", lambda r, g: r - g)
    wide = contours.with_width(contours.with_width(both.withColumns({"o": opponent(""), "c": opponent("c_")}), "o", "source"), "c", "candidate")
    return wide.select("image_id", "side", "y", r6("source").alias("source"), r6("candidate").alias("candidate"))


_RED, _GREEN, _BLUE = contours.LUMA
_light = lambda p: f"{_RED} * {p}r + {_GREEN} * {p}g + {_BLUE} * {p}b"
_gradient = lambda c, over, n: f"CASE WHEN lag({c}) OVER {over} IS NULL THEN lead({c}) OVER {over} - {c} WHEN lead({c}) OVER {over} IS NULL THEN {c} - lag({c}) OVER {over} ELSE (lead({c}) OVER {over} - lag({c}) OVER {over}) / 2 END AS {n}"
_METRICS_SQL = ", ".join([
    _OPPONENT_SQL, _PROFILE_SQL, _blur_sql("sm", "photos", {c: c for c in _CHANNELS}, contours.SMOOTH),
    "chroma AS (SELECT image_id, y, x, height, cr - cg - (r - g) AS rg, cb - cg - (b - g) AS bg FROM photos)", _blur_sql("ch", "chroma", {"rg": "rg", "bg": "bg"}, contours.CHROMA),
    "cloth AS MATERIALIZED (SELECT s.image_id, y, x, height, CAST(g - r > 20 AND y >= first_row - 30 AS INTEGER) AS c FROM sm s JOIN necklines n ON n.image_id = s.image_id)",
    f"interior AS MATERIALIZED (SELECT a.image_id, a.y, a.x FROM cloth a JOIN cloth s ON s.image_id = a.image_id AND s.y BETWEEN a.y - 8 AND a.y + 8 AND s.x BETWEEN a.x - 8 AND a.x + 8 WHERE a.c = 1 AND a.y >= 8 AND a.x >= 8 AND a.y < a.height - 8 AND a.x < {WIDTH - 8} GROUP BY a.image_id, a.y, a.x HAVING min(s.c) = 1)",
    f"light AS (SELECT image_id, y, x, {_light('')} AS l, {_light('c')} AS m FROM sm)",
    f"grad AS MATERIALIZED (SELECT image_id, y, x, {_gradient('l', 'v', 'dy')}, {_gradient('l', 'h', 'dx')}, {_gradient('m', 'v', 'ey')}, {_gradient('m', 'h', 'ex')} FROM light WINDOW v AS (PARTITION BY image_id, x ORDER BY y), h AS (PARTITION BY image_id, y ORDER BY x))",
    "deep AS MATERIALIZED (SELECT g.*, sqrt(dy * dy + dx * dx) AS steep, greatest(0.5e0, quantile_cont(sqrt(dy * dy + dx * dx), 0.9) OVER (PARTITION BY g.image_id)) AS lev FROM grad g JOIN interior i ON i.image_id = g.image_id AND i.y = g.y AND i.x = g.x)",
    "fabric AS (SELECT d.image_id, count(*) AS n, count(*) FILTER (WHERE steep >= lev) AS seams, sqrt(avg((ey - dy) * (ey - dy) + (ex - dx) * (ex - dx)) FILTER (WHERE steep >= lev)) AS seam, sqrt(avg(rg * rg + bg * bg) / 2) AS blotch FROM deep d JOIN ch c ON c.image_id = d.image_id AND c.y = d.y AND c.x = d.x GROUP BY d.image_id)",
    "off AS (SELECT image_id, side, y, now - position AS v, row_number() OVER (PARTITION BY image_id, side ORDER BY y) - 1 AS i, count(*) OVER (PARTITION BY image_id, side) AS n FROM anchored)",
    "al_k(d, w) AS (VALUES " + ", ".join(f"({k - 6}, {float(w)!r}" + ("" if "e" in repr(float(w)) else "e0") + ")" for k, w in enumerate(strips.gaussian(contours.ALONG))) + ")",
    f"rough AS (SELECT a.image_id, a.side, a.i, a.v - sum(k.w * b.v) AS v FROM off a CROSS JOIN al_k k JOIN off b ON b.image_id = a.image_id AND b.side = a.side AND b.i = {_reflected('a.i + k.d', 'a.n')} GROUP BY a.image_id, a.side, a.i, a.v)",
    "spot AS (SELECT image_id, count(*) - count(v) AS lost, count(*) AS n, CASE WHEN count(*) = count(v) THEN sqrt(avg(v * v)) END AS rms, CASE WHEN count(*) = count(v) THEN quantile_cont(abs(v), 0.95) END AS p95 FROM off GROUP BY image_id)",
    "wid AS (SELECT image_id, CASE WHEN count(*) = count(w1 - w0) THEN sqrt(avg((w1 - w0) * (w1 - w0))) END AS rms, count(*) - count(w1 - w0) AS lost, count(*) - count(w0) AS open FROM widths GROUP BY image_id)",
    "con AS (SELECT image_id, sqrt(avg((pow((cr1 - cr0) - (r1 - r0), 2) + pow((cg1 - cg0) - (g1 - g0), 2) + pow((cb1 - cb0) - (b1 - b0), 2)) / (pow(r1 - r0, 2) + pow(g1 - g0, 2) + pow(b1 - b0, 2)))) AS rms FROM means GROUP BY image_id)",
    f"lum AS (SELECT image_id, side, y, k, {_light('')} AS l, {_light('c')} AS m FROM seen)",
    f"hal AS (SELECT image_id, sqrt(avg(pow(greatest(lo - m, 0) + greatest(m - hi, 0), 2)) FILTER (WHERE abs(k * {_STEP} - 12) <= 6)) AS rms FROM (SELECT *, min(l) OVER (PARTITION BY image_id, side, y) AS lo, max(l) OVER (PARTITION BY image_id, side, y) AS hi FROM lum) GROUP BY image_id)",
    "col AS (SELECT image_id, sqrt(avg((pow(cr - r, 2) + pow(cg - g, 2) + pow(cb - b, 2)) / 3)) AS rms FROM seen GROUP BY image_id)",
    f"edge AS (SELECT image_id, max(CAST(px < 0 OR px >= {WIDTH - 1} OR py < 0 OR py >= height - 1 AS INTEGER)) AS out FROM dots GROUP BY image_id)",
    """state AS (SELECT n.image_id, CASE WHEN h.height IS NULL OR last_row >= h.height OR center <= 0 OR first_row >= last_row THEN 'Neckline rows and center must fit the source.' WHEN last_row - first_row < 12 THEN 'Neckline measurements require at least 13 consecutive source rows.'
    WHEN w.image_id IS NULL THEN 'The source neckline needs a reviewed region or different color-boundary model.' WHEN e.out = 1 THEN 'Normal edge profiles require complete source-pixel support.' WHEN d.open > 0 THEN 'The source neckline needs complete 10%-90% transition support.'
    WHEN coalesce(f.n, 0) < 100 THEN 'The source clothing region is too small for the color-detail measurement.' WHEN f.seams < 10 THEN 'Source clothing has insufficient measured seam/fold gradient support.' END AS error FROM necklines n LEFT JOIN (SELECT DISTINCT image_id, height FROM mosaics) h ON h.image_id = n.image_id
    LEFT JOIN whole w ON w.image_id = n.image_id LEFT JOIN edge e ON e.image_id = n.image_id LEFT JOIN wid d ON d.image_id = n.image_id LEFT JOIN fabric f ON f.image_id = n.image_id)""",
])
_rounded = lambda c, n: f"CASE WHEN error IS NULL THEN round({c}, 6) + 0.0 END AS {n}"
_counted = lambda c, n: f"CASE WHEN error IS NULL THEN CAST({c} AS BIGINT) END AS {n}"


@query(f"""WITH {_METRICS_SQL}, rg AS (SELECT image_id, sqrt(avg(v * v)) AS rms FROM rough GROUP BY image_id) SELECT s.image_id, error, {_counted('p.lost', 'missing_rows')}, {_counted('p.n', 'samples')}, {_rounded('p.rms', 'position_rms')}, {_rounded('p.p95', 'position_p95')}, CASE WHEN error IS NULL AND p.lost = 0 THEN round(rg.rms, 6) + 0.0 END AS jaggedness_rms,
{_rounded('d.rms', 'width_rms')}, {_counted('d.lost', 'width_missing')}, {_rounded('c.rms', 'contrast_rms')}, {_rounded('col.rms', 'profile_rms')}, {_rounded('hal.rms', 'halo_rms')}, {_rounded('f.seam', 'seam_rms')}, {_rounded('f.blotch', 'blotch_rms')}, {_counted('f.n', 'interior_pixels')}, {_counted('f.seams', 'seam_pixels')}
FROM state s LEFT JOIN spot p ON p.image_id = s.image_id LEFT JOIN rg ON rg.image_id = s.image_id LEFT JOIN wid d ON d.image_id = s.image_id LEFT JOIN con c ON c.image_id = s.image_id LEFT JOIN col ON col.image_id = s.image_id LEFT JOIN hal ON hal.image_id = s.image_id LEFT JOIN fabric f ON f.image_id = s.image_id""")
def contour_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All differences of a candidate's edges and clothing from its source's, or why the source can't be measured by."""
    source, candidate = rel.photos(spark, sf_dir)
    m = contours.measured(source, candidate, rel.necklines(spark, sf_dir), KEY)
    return m.select("image_id", "error", *[r6(c).alias(c) if c.endswith(("_rms", "_p95")) else c for c in m.columns if c not in ("image_id", "error")])


#: Output size and map of the two renderings: a reduced one, and one that is turned by thirty degrees and enlarged.
_REDUCED = (20, 30, 3.2, 0.0, 0.0, 3.1, 0.4, 1.2)
_TURNED = (28, 36, 1.2990381, 0.75, -0.5, 0.8660254, 20.5, 4.25)


def _pick(i: int) -> str:
    return f"CASE WHEN image_id % 2 = 0 THEN {_REDUCED[i]!r} ELSE {_TURNED[i]!r} END" if i < 2 else f"CASE WHEN image_id % 2 = 0 THEN {_REDUCED[i]!r}e0 ELSE {_TURNED[i]!r}e0 END"


_sinc = lambda t: f"CASE WHEN abs({t}) >= 3 THEN 0 WHEN abs({t}) < 1e-12 THEN 1 ELSE sin(pi() * ({t})) / (pi() * ({t})) * sin(pi() * ({t}) / 3) / (pi() * ({t}) / 3) END"


@query(f"""WITH im AS (SELECT image_id, max(height) AS height, {", ".join(f"{_pick(i)} AS p{i}" for i in range(8))} FROM mosaics GROUP BY image_id),
c AS (SELECT *, p2 * ox + p4 * oy + p6 AS sx, p3 * ox + p5 * oy + p7 AS sy, greatest(1, sqrt(p2 * p2 + p4 * p4)) AS kx, greatest(1, sqrt(p3 * p3 + p5 * p5)) AS ky FROM im, range(28) a(oy), range(36) b(ox) WHERE oy < p0 AND ox < p1),
w AS (SELECT c.image_id, oy, ox, v, {_sinc('(m.x - sx) / kx')} * {_sinc('(m.y - sy) / ky')} AS w FROM c JOIN mosaics m ON m.image_id = c.image_id AND m.y BETWEEN sy - 3 * ky AND sy + 3 * ky AND m.x BETWEEN sx - 3 * kx AND sx + 3 * kx WHERE sx BETWEEN 0 AND {WIDTH - 1} AND sy BETWEEN 0 AND c.height - 1),
s AS (SELECT image_id, oy, ox, sum(v * w) / sum(w) AS v FROM w GROUP BY image_id, oy, ox)
SELECT c.image_id, CAST(c.oy AS INTEGER) AS y, round(sum(coalesce(v, 0) * (c.ox + 1)), 6) + 0.0 AS v FROM c LEFT JOIN s ON s.image_id = c.image_id AND s.oy = c.oy AND s.ox = c.ox GROUP BY c.image_id, c.oy""")
def photo_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanczos renderings, reduced or turned: windows of three pixels, wider where the image shrinks; each line summed by place."""
    m = rel.mosaics(spark, sf_dir)
    choose = lambda i: F.when(F.col("image_id") % 2 == 0, F.lit(_REDUCED[i])).otherwise(F.lit(_TURNED[i]))
    plans = m.where("y = 0").select("image_id", *[choose(i).alias(n) for i, n in enumerate(("out_height", "out_width", *resample.MAP))])
    out = resample.rendered(m, plans, KEY, ["v"], 16)
    return out.select("image_id", "y", r6(F.aggregate(F.transform("v", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)).alias("v"))


def _level_sql(name: str, size: str) -> str:
    """(name: n, high, c, i, v): what each coefficient of one level makes of a line of n, by lifting over neighbours."""
    steps = [f"{name}0 AS (SELECT n, high, c, i, CASE WHEN i = 2 * c + high THEN 1e0 / CASE WHEN high = 1 THEN {raster.K_HIGH!r} ELSE {raster.K_LOW!r} END ELSE 0e0 END AS v FROM {size}, (VALUES (0), (1)) h(high), range(n) a(i), range(n) b(c) WHERE 2 * c + high < n)"]
    for k, (factor, odd) in enumerate(((raster.DELTA, 0), (raster.GAMMA, 1), (raster.BETA, 0), (raster.ALPHA, 1)), 1):
        near = "coalesce(lag(v) OVER w, lead(v) OVER w, 0) + coalesce(lead(v) OVER w, lag(v) OVER w, 0)"
        steps.append(f"{name}{k if k < 4 else ''} AS {'MATERIALIZED ' if k == 4 else ''}(SELECT n, high, c, i, CASE WHEN i % 2 = {odd} THEN v - {factor!r} * ({near}) ELSE v END AS v FROM {name}{k - 1} WINDOW w AS (PARTITION BY n, high, c ORDER BY i))")
    return ", ".join(steps)


@query(f"""WITH sizes AS (SELECT DISTINCT height AS n FROM mosaics UNION SELECT {WIDTH}), halves AS (SELECT DISTINCT (n + 1) // 2 AS n FROM sizes), {_level_sql('one', 'sizes')}, {_level_sql('half', 'halves')},
resp AS MATERIALIZED (SELECT n, 1 AS level, high, c, i, v * v AS q FROM one WHERE v <> 0 UNION ALL SELECT a.n, 2, b.high, b.c, a.i, pow(sum(a.v * b.v), 2) FROM one a JOIN half b ON a.high = 0 AND b.n = (a.n + 1) // 2 AND b.i = a.c GROUP BY a.n, b.high, b.c, a.i),
bands(level, hx, hy) AS (VALUES (1, 1, 0), (1, 1, 1), (2, 0, 0), (2, 0, 1)),
along AS MATERIALIZED (SELECT m.image_id, m.y, m.height, b.level, b.hx, b.hy, r.c AS x, sum(r.q * CASE WHEN m.v > 0.05 THEN 1 ELSE 0 END) AS p, sum(r.q) AS t FROM mosaics m CROSS JOIN bands b JOIN resp r ON r.n = {WIDTH} AND r.level = b.level AND r.high = b.hx AND r.i = m.x GROUP BY ALL),
band AS (SELECT a.image_id, a.level, a.hx, a.hy, r.c AS y, a.x, sum(r.q * a.p) AS share, sum(r.q * a.t) AS total FROM along a JOIN resp r ON r.n = a.height AND r.level = a.level AND r.high = a.hy AND r.i = a.y GROUP BY ALL)
SELECT image_id, level, hx, hy, CAST(y AS INTEGER) AS y, round(sum(total * (x + 1)), 6) + 0.0 AS total, round(sum(share * (x + 1)), 6) + 0.0 AS share FROM band GROUP BY image_id, level, hx, hy, y""")
def synthesis_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of the coefficients of four bands, and how much of it falls on a masked region; each line of coefficients summed by place."""
    mask = rel.mosaics(spark, sf_dir).select("image_id", "y", "height", F.transform("v", lambda v: F.when(v > 0.05, 1.0).otherwise(0.0)).alias("m"))
    weighed = lambda c: r6(F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)).alias(c)
    out = None
    for level, hx, hy in ((1, 1, 0), (1, 1, 1), (2, 0, 0), (2, 0, 1)):
        band = influence.influence(mask, KEY, "m", level, bool(hx), bool(hy), 8)
        one = band.select("image_id", F.lit(level).alias("level"), F.lit(hx).alias("hx"), F.lit(hy).alias("hy"), "y", weighed("total"), weighed("share"))
        out = one if out is None else out.unionByName(one)
    return out


_LEVELS = (0.0, 0.3, 0.5, 0.63, 0.7, 1.0)


@query("WITH " + ", ".join(_blur_sql(f"l{i}", "mosaics", {"v": "v"}, 2 * level) for i, level in enumerate(_LEVELS) if level) + " SELECT image_id, level, round(avg(v), 6) + 0.0 AS mean, round(var_pop(v), 6) + 0.0 AS variance FROM (SELECT image_id, 0e0 AS level, v FROM mosaics" + "".join(f" UNION ALL SELECT image_id, {level!r}e0, v FROM l{i}" for i, level in enumerate(_LEVELS) if level) + ") GROUP BY image_id, level")
def blurred_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image blurred at six levels (sigma is twice the level): mean and variance of its pixels, which falls with the level."""
    m = rel.mosaics(spark, sf_dir)
    out = None
    for level in _LEVELS:
        b = strips.blurred(m, KEY, {"b": "v"}, 2 * level) if level else m.withColumn("b", F.col("v"))
        one = b.select("image_id", F.lit(level).alias("level"), F.explode("b").alias("v")).groupBy("image_id", "level").agg(r6(F.avg("v")).alias("mean"), r6(F.var_pop("v")).alias("variance"))
        out = one if out is None else out.unionByName(one)
    return out


_SMOOTH = raster.gaussian_kernel(1.0)


def _stencil_sql(name: str, source: str, column: str, kernel: raster.Kernel, out: str) -> str:
    rows = ", ".join(f"({dy}, {dx}, {float(w)!r}" + ("" if "e" in repr(float(w)) else "e0") + ")" for dy, dx, w in kernel)
    inside = f"s.y - k.dy BETWEEN 0 AND s.height - 1 AND s.x - k.dx BETWEEN 0 AND {WIDTH - 1}"
    return f"{name}_k(dy, dx, w) AS (VALUES {rows}), {name} AS MATERIALIZED (SELECT s.image_id, s.y - k.dy AS y, s.x - k.dx AS x, s.height, sum(k.w * s.{column}) AS {out} FROM {source} s CROSS JOIN {name}_k k WHERE {inside} GROUP BY s.image_id, s.y - k.dy, s.x - k.dx, s.height)"


_EDGES_SQL = ", ".join([
    _stencil_sql("smooth", "mosaics", "v", _SMOOTH, "b"), _stencil_sql("sx", "smooth", "b", raster.SOBEL_X, "gx"), _stencil_sql("sy", "smooth", "b", raster.SOBEL_Y, "gy"),
    "sobel AS MATERIALIZED (SELECT sx.image_id, sx.y, sx.x, gx, gy, sqrt(gx * gx + gy * gy) AS m FROM sx JOIN sy ON sx.image_id = sy.image_id AND sx.y = sy.y AND sx.x = sy.x)",
    "tn AS (SELECT *, CASE WHEN degrees(atan2(gy, gx)) < 0 THEN degrees(atan2(gy, gx)) + 180 WHEN degrees(atan2(gy, gx)) >= 180 THEN degrees(atan2(gy, gx)) - 180 ELSE degrees(atan2(gy, gx)) END AS turn FROM sobel WHERE m >= 0.25)",
    "dr AS (SELECT *, CASE WHEN turn < 22.5 OR turn >= 157.5 THEN 0 ELSE 1 END AS dy, CASE WHEN turn < 22.5 OR turn >= 157.5 THEN 1 WHEN turn < 67.5 THEN 1 WHEN turn < 112.5 THEN 0 ELSE -1 END AS dx FROM tn)",
    "ed AS MATERIALIZED (SELECT d.image_id, d.y, d.x, d.m FROM dr d JOIN sobel p ON p.image_id = d.image_id AND p.y = d.y + d.dy AND p.x = d.x + d.dx JOIN sobel q ON q.image_id = d.image_id AND q.y = d.y - d.dy AND q.x = d.x - d.dx WHERE d.m >= p.m AND d.m >= q.m)",
    f"ln AS (SELECT image_id, y * {WIDTH} + x AS root, y, x FROM ed UNION SELECT k.image_id, l.root, k.y, k.x FROM ln l JOIN ed k ON k.image_id = l.image_id AND k.y BETWEEN l.y - 1 AND l.y + 1 AND k.x BETWEEN l.x - 1 AND l.x + 1)",
    "lb AS (SELECT l.image_id, l.y, l.x, any_value(e.m) AS m, min(root) AS root FROM ln l JOIN ed e ON e.image_id = l.image_id AND e.y = l.y AND e.x = l.x GROUP BY l.image_id, l.y, l.x)",
    "sz AS (SELECT image_id, root, count(*) AS n FROM lb GROUP BY image_id, root HAVING max(m) >= 0.35)",
])


@query(f"""WITH RECURSIVE {_EDGES_SQL}, ys AS (SELECT DISTINCT image_id, y FROM mosaics)
SELECT ys.image_id, ys.y, CAST(count(z.n) AS INTEGER) AS edges, round(coalesce(sum(b.m * (b.x + 1)) FILTER (WHERE z.n IS NOT NULL), 0), 6) + 0.0 AS strength, CAST(count(DISTINCT z.root) FILTER (WHERE z.n >= 3) AS INTEGER) AS segments, CAST(coalesce(sum(z.root) FILTER (WHERE z.n >= 3), 0) AS BIGINT) AS numbers
FROM ys LEFT JOIN lb b ON b.image_id = ys.image_id AND b.y = ys.y LEFT JOIN sz z ON z.image_id = b.image_id AND z.root = b.root GROUP BY ys.image_id, ys.y""")
def photo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of whole images over strips that are stitched: edge pixels of each line, their magnitudes by place, and their segments."""
    e = edges.canny(rel.mosaics(spark, sf_dir), KEY, "v", _SMOOTH, 0.25, 0.35, 16)
    on, far = F.filter("edge", lambda m: m > 0), F.filter("segment", lambda s: s >= 0)
    weighed = F.aggregate(F.transform("edge", lambda m, i: m * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return e.select("image_id", "y", F.size(on).alias("edges"), r6(weighed).alias("strength"), F.size(F.array_distinct(far)).alias("segments"), F.aggregate(far, F.lit(0).cast("long"), lambda a, v: a + v).alias("numbers"))


_ANGLES = (0.0, 22.5, 45.0, 67.5, 90.0)


@query("WITH " + ", ".join(_stencil_sql(f"g{i}", "mosaics", "v", raster.gabor_kernel(d), "c") for i, d in enumerate(_ANGLES)) + f""", every AS ({" UNION ALL ".join(f"SELECT {d!r}e0 AS degrees, image_id, y, x, c FROM g{i}" for i, d in enumerate(_ANGLES))})
SELECT l.image_id, l.degrees, round(avg(abs(abs(l.c) - abs(r.c))), 6) + 0.0 AS asymmetry FROM every l JOIN every r ON r.image_id = l.image_id AND r.degrees = l.degrees AND r.y = l.y AND r.x = {WIDTH - 1} - l.x WHERE l.x < {WIDTH // 2} GROUP BY l.image_id, l.degrees""")
def photo_filter_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bank of filters (21 by 21, five angles) over whole images: how much the answers of the left half differ from those of
    the right one, mirrored."""
    found = edges.stencils(rel.mosaics(spark, sf_dir), KEY, "v", {f"g{i}": raster.gabor_kernel(d) for i, d in enumerate(_ANGLES)})
    half = WIDTH // 2
    differ = lambda c: F.aggregate(F.zip_with(F.slice(c, 1, half), F.slice(F.reverse(c), 1, half), lambda a, b: F.abs(F.abs(a) - F.abs(b))), F.lit(0.0), lambda s, v: s + v)
    each = found.select("image_id", F.explode(F.array(*[F.struct(F.lit(d).alias("degrees"), differ(f"g{i}").alias("d")) for i, d in enumerate(_ANGLES)])).alias("a")).select("image_id", "a.*")
    return each.groupBy("image_id", "degrees").agg(r6(F.sum("d") / (F.count(F.lit(1)) * half)).alias("asymmetry"))


@query("WITH " + _stencil_sql("lg", "mosaics", "v", raster.log_kernel(1.4), "c") + f" SELECT lg.image_id, count(*) AS n, round(var_pop(c), 6) + 0.0 AS variance FROM lg WHERE pow((x - {(WIDTH - 1) / 2}e0) / 30, 2) + pow((y - (height - 1) / 2e0) / (height * 0.4e0), 2) <= 1 GROUP BY lg.image_id")
def photo_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of the Laplacian of Gaussian inside of an ellipse of each image: filtered first, masked then."""
    found = edges.stencils(rel.mosaics(spark, sf_dir), KEY, "v", {"c": raster.log_kernel(1.4)})
    y = (F.col("y") - (F.col("height") - 1) / 2) / (F.col("height") * 0.4)
    inside = F.filter(F.transform("c", lambda c, i: F.when(((i - (WIDTH - 1) / 2) / 30) ** 2 + y**2 <= 1, c)), lambda c: c.isNotNull())
    return found.select("image_id", F.explode(inside).alias("c")).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), r6(F.var_pop("c")).alias("variance"))


@query("""WITH near AS (SELECT a.image_id, a.y, a.x, avg(abs(a.v - b.v)) AS step FROM mosaics a JOIN mosaics b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY a.image_id, a.y, a.x),
wide AS (SELECT a.image_id, a.y, a.x, var_pop(b.v) AS variance FROM mosaics a JOIN mosaics b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY a.image_id, a.y, a.x)
SELECT image_id, y, count(*) FILTER (step <= 0.1e0 AND variance <= 0.01e0) AS low_texture, count(*) FILTER (step > 0.1e0) AS over_step FROM near JOIN wide USING (image_id, y, x) GROUP BY image_id, y""")
def photo_low_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each line whose mean step to their neighbours and whose variance around are both small, over whole images."""
    t = edges.texture(rel.mosaics(spark, sf_dir), KEY, "v", 16)
    few = F.filter(F.arrays_zip("mean_step", "variance"), lambda p: (p["mean_step"] <= 0.1) & (p["variance"] <= 0.01))
    return t.select("image_id", "y", F.size(few).cast("long").alias("low_texture"), F.size(F.filter("mean_step", lambda s: s > 0.1)).cast("long").alias("over_step"))
