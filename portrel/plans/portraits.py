"""Queries of portrait geometry, over faces of 68 landmarks that vary with the embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portrel.functions import geometry as g
from portrel.functions import portrait as p
from portrel.operators import regions
from portrel.plans.registry import query, r6
from portrel.sources import relations as rel

W, H = 1000, 1200


def _face() -> list[tuple[float, float]]:
    """A level face: jaw, brows, nose, eyes and mouth as arcs and lines."""
    arc = lambda n, cx, cy, rx, ry, turn: [(cx + rx * math.cos(turn * i), cy + ry * math.sin(turn * i)) for i in range(n)]
    jaw = [(500 - 200 * math.cos(i * math.pi / 16), 460 + 340 * math.sin(i * math.pi / 16)) for i in range(17)]
    brows = [(350.0 + 25 * i, 475.0) for i in range(5)] + [(550.0 + 25 * i, 475.0) for i in range(5)]
    nose = [(500.0, 530.0 + 35 * i) for i in range(4)] + [(460.0 + 20 * i, 650.0) for i in range(5)]
    return jaw + brows + nose + arc(6, 410, 520, 25, 12, math.pi / 3) + arc(6, 590, 520, 25, 12, math.pi / 3) + arc(12, 500, 700, 65, 28, math.pi / 6) + arc(8, 500, 700, 35, 10, math.pi / 4)


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(face_id, points): a face for each embedding, moved, scaled and uneven by its components."""
    e = lambda i: F.get("embedding", i if isinstance(i, Column) else F.lit(i)).cast("double")
    base = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in _face()])
    scale, dx, dy = 1 + e(0) * 1.2, 150 * e(1), 100 * e(2)
    moved = lambda b, i: F.struct((500 + (b["x"] - 500) * scale + dx + 20 * e(i % 64)).alias("x"), (600 + (b["y"] - 600) * scale + dy + 20 * e((i * 7 + 3) % 64)).alias("y"))
    return rel.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("face_id"), F.transform(base, moved).alias("points"))


_BASE = "base(idx, u0, v0) AS (VALUES " + ", ".join(f"({i}, {x!r}e0, {y!r}e0)" if "e" not in f"{x!r}{y!r}" else f"({i}, {x!r}, {y!r})" for i, (x, y) in enumerate(_face())) + ")"
rel.SQL["faces"] = (
    f"{_BASE}, faces AS (SELECT vec_id AS face_id, idx, 500 + (u0 - 500) * (1 + CAST(embedding[1] AS DOUBLE) * 1.2e0) + 150 * CAST(embedding[2] AS DOUBLE) + 20 * CAST(embedding[idx % 64 + 1] AS DOUBLE) AS x, "
    "600 + (v0 - 600) * (1 + CAST(embedding[1] AS DOUBLE) * 1.2e0) + 100 * CAST(embedding[3] AS DOUBLE) + 20 * CAST(embedding[(idx * 7 + 3) % 64 + 1] AS DOUBLE) AS y FROM embeddings, base)"
)
rel.SQL["shapes"] = (
    "shapes AS (SELECT face_id, min(x) FILTER (idx < 17) AS jl, max(x) FILTER (idx < 17) AS jr, min(y) FILTER (idx < 17) AS jt, max(y) FILTER (idx < 17) AS jb, min(y) FILTER (idx BETWEEN 17 AND 26) AS brow, "
    "avg(x) FILTER (idx BETWEEN 27 AND 30) AS nose_x, avg(x) FILTER (idx IN (48, 51, 54, 57)) AS mouth_x, avg(x) FILTER (idx BETWEEN 36 AND 41) AS lx, avg(y) FILTER (idx BETWEEN 36 AND 41) AS ly, "
    "avg(x) FILTER (idx BETWEEN 42 AND 47) AS rx, avg(y) FILTER (idx BETWEEN 42 AND 47) AS ry, max(y) FILTER (idx = 8) AS chin, max(x) FILTER (idx = 30) AS tip_x, max(y) FILTER (idx = 30) AS tip_y, "
    "max(x) FILTER (idx = 0) AS t0, max(x) FILTER (idx = 16) AS t16, max(x) FILTER (idx = 48) AS m0x, max(y) FILTER (idx = 48) AS m0y, max(x) FILTER (idx = 54) AS m1x, max(y) FILTER (idx = 54) AS m1y, "
    "bool_and(x >= 0 AND y >= 0 AND x <= 1000 AND y <= 1200) AS inside, sqrt(pow(lx - rx, 2) + pow(ly - ry, 2)) AS eyes, (nose_x + mouth_x) / 2 AS aa, (ly + ry) / 2 AS bb, jr - jl AS cc FROM faces GROUP BY face_id)"
)


@query("WITH t AS (SELECT *, least(jt, brow - (jb - jt) * 0.3e0) AS top FROM shapes) SELECT face_id, inside AS valid, CAST(floor(greatest(jl - cc * 0.15e0, 0)) AS BIGINT) AS x, CAST(floor(greatest(top - (jb - top) * 0.15e0, 0)) AS BIGINT) AS y, CAST(ceil(cc * 1.3e0) AS BIGINT) AS w, CAST(ceil((jb - top) * 1.3e0) AS BIGINT) AS h FROM t")
def face_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = p.face_region(F.col("points"))
    return faces(spark, sf_dir).select("face_id", p.valid(F.col("points"), F.lit(W), F.lit(H)).alias("valid"), *[c.alias(n) for n, c in box.items()])


_CODES = "list_filter([CASE WHEN abs(aa - 500) > 10 THEN 'centre' END, CASE WHEN abs(nose_x - mouth_x) > 8 THEN 'alignment' END, CASE WHEN fb < 0.5 THEN 'eyes low' END, CASE WHEN fb > 0.7 THEN 'eyes high' END, CASE WHEN NOT ok THEN 'width ratio' END, CASE WHEN NOT ok THEN 'width over' END, CASE WHEN cc < 240 THEN 'head narrow' END], lambda c: c IS NOT NULL)"


@query(f"WITH t AS (SELECT *, (1200 - bb) / 1200 AS fb, 1000 / cc >= 1.749 AS ok FROM shapes), u AS (SELECT *, {_CODES} AS issues, ok AND cc >= 240 AS screen FROM t) SELECT face_id, round(aa, 6) + 0.0 AS aa, round(bb, 6) + 0.0 AS bb, round(cc, 6) + 0.0 AS cc, round(eyes, 6) + 0.0 AS eyes, array_to_string(issues, ',') AS issues, CASE WHEN len(issues) >= 3 THEN 'Critical' WHEN NOT screen THEN 'High' WHEN fb NOT BETWEEN 0.5 AND 0.7 THEN 'Medium' ELSE 'Low' END AS severity FROM u")
def line_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = faces(spark, sf_dir)
    ls = p.lines(F.col("points"))
    f = f.select("face_id", *[c.alias(n) for n, c in ls.items()])
    v = p.line_validation({n: F.col(n) for n in ls}, F.lit(W), F.lit(H))
    return f.select("face_id", *[r6(n).alias(n) for n in ("aa", "bb", "cc", "eyes")], F.array_join(v["issues"], ",").alias("issues"), v["severity"].alias("severity"))


@query("SELECT face_id, round(sqrt(pow(rx - lx, 2) + pow(ry - ly, 2)), 6) + 0.0 AS length, round((lx + rx) / 2, 6) + 0.0 AS mid_x, round((ly + ry) / 2, 6) + 0.0 AS mid_y, abs(degrees(atan2(ry - ly, rx - lx))) <= 1 OR abs(degrees(atan2(ry - ly, rx - lx))) >= 179 AS level, abs(abs(degrees(atan2(chin - tip_y, tip_x - aa))) - 90) <= 5 AS upright FROM shapes")
def line_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.col("points")
    left, right = p.centre(points, p.LEFT_EYE), p.centre(points, p.RIGHT_EYE)
    f = faces(spark, sf_dir).select("face_id", left[0].alias("lx"), left[1].alias("ly"), right[0].alias("rx"), right[1].alias("ry"), p.lines(points)["aa"].alias("aa"), p.at(points, 30).alias("tip"), p.at(points, 8).alias("chin"))
    eyes = [F.col(c) for c in ("lx", "ly", "rx", "ry")]
    down = p.line_angle(F.col("aa"), F.col("tip.y"), F.col("tip.x"), F.col("chin.y"))
    return f.select("face_id", r6(g.distance(*eyes)).alias("length"), r6((eyes[0] + eyes[2]) / 2).alias("mid_x"), r6((eyes[1] + eyes[3]) / 2).alias("mid_y"), p.is_horizontal(p.line_angle(*eyes), 1.0).alias("level"), p.is_vertical(down).alias("upright"))


@query("""WITH t AS (SELECT *, abs(t16 - t0) / 1000 AS r, abs((lx + rx + tip_x) / 3 - 500) / 1000 AS ox, abs((ly + ry + chin) / 3 - 600) / 1200 AS oy FROM shapes)
SELECT face_id, round(greatest(0, least(1, CASE WHEN r < 0.35 THEN r / 0.35 WHEN r > 0.5 THEN 0.5 / r ELSE 1 - abs(r - 0.425) / 0.075 * 0.2 END)), 6) + 0.0 AS head_size,
round(((CASE WHEN ox <= 0.1 THEN 1 ELSE 1 - least((ox - 0.1) * 2, 0.8) END) + (CASE WHEN oy <= 0.1 THEN 1 ELSE 1 - least((oy - 0.1) * 2, 0.8) END)) / 2, 6) + 0.0 AS centring,
round(CASE WHEN eyes < 90 THEN eyes / 90 WHEN eyes > 180 THEN 180 / eyes ELSE 1 END, 6) + 0.0 AS eye_distance FROM t""")
def scored_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.col("points")
    return faces(spark, sf_dir).select("face_id", r6(p.head_size_score(points, F.lit(W), 0.35, 0.5)).alias("head_size"), r6(p.centring_score(points, F.lit(W), F.lit(H))).alias("centring"), r6(p.eye_distance_score(p.lines(points)["eyes"], 90.0, 180.0)).alias("eye_distance"))


@query("""WITH b AS (SELECT image_id, det_id, x, y, w, h, CAST(x - 20 AS DOUBLE) AS deg, cos(radians(x - 20)) AS c, sin(radians(x - 20)) AS s FROM boxes),
k AS (SELECT *, CAST(ceil(round(200 * abs(c) + 160 * abs(s), 9)) AS BIGINT) AS rw, CAST(ceil(round(200 * abs(s) + 160 * abs(c), 9)) AS BIGINT) AS rh FROM b),
m AS (SELECT *, 48e0 / w AS kx, 64e0 / h AS ky, rw / 2.0e0 - (100 * c - 80 * s) - x AS tx, rh / 2.0e0 - (100 * s + 80 * c) - y AS ty FROM k),
o AS (SELECT image_id, det_id, i, CAST(i % 3 > 0 AS INTEGER) * w AS ox, CAST(i > 1 AS INTEGER) * h AS oy, c, s, tx, ty FROM m, range(4) t(i))
SELECT image_id, det_id, CAST(i AS INTEGER) AS corner, round(c * (ox - tx) + s * (oy - ty), 6) + 0.0 AS x, round(-s * (ox - tx) + c * (oy - ty), 6) + 0.0 AS y FROM o""")
def output_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the corners of the rotated, cropped and resized output lie on the source."""
    b = rel.boxes(spark, sf_dir).withColumn("deg", F.col("x") - 20)
    w, h = F.lit(200.0), F.lit(160.0)
    m = p.render_map(w, h, F.col("deg"), g.expanded_canvas(w, h, F.col("deg")), {c: F.col(c) for c in "xywh"}, F.lit(48.0), F.lit(64.0))
    b = b.select("image_id", "det_id", *[c.alias(f"m{i}") for i, c in enumerate(m)])
    back = g.affine_inverse(*[F.col(f"m{i}") for i in range(6)])
    b = b.select("image_id", "det_id", *[c.alias(f"i{i}") for i, c in enumerate(back)])
    return b.select("image_id", "det_id", F.posexplode(p.corners([F.col(f"i{i}") for i in range(6)], 48, 64)).alias("corner", "at")).select("image_id", "det_id", "corner", r6("at.x").alias("x"), r6("at.y").alias("y"))


@query("""WITH a AS (SELECT face_id, lx, ly, rx, ry, tip_x AS nx, tip_y AS ny, jl - 20 AS b0, brow - 40 AS b1, cc + 40 AS bw, jb - brow + 60 AS bh, (rx - lx) / eyes AS ex, (ry - ly) / eyes AS ey, (m0x - m1x) / sqrt(pow(m1x - m0x, 2) + pow(m1y - m0y, 2)) AS mx, (m0y - m1y) / sqrt(pow(m1x - m0x, 2) + pow(m1y - m0y, 2)) AS my FROM shapes),
h AS (SELECT *, (ex + mx) / sqrt(pow(ex + mx, 2) + pow(ey + my, 2)) AS hx, (ey + my) / sqrt(pow(ex + mx, 2) + pow(ey + my, 2)) AS hy FROM a),
c AS (SELECT face_id, i, any_value(hx) AS hx, any_value(hy) AS hy, any_value(nx) AS nx, any_value(ny) AS ny, (b0 + bw * (i % 2) - nx) * hx + (b1 + bh * (i // 2) - ny) * hy AS u, (b1 + bh * (i // 2) - ny) * hx - (b0 + bw * (i % 2) - nx) * hy AS v FROM h, range(4) t(i) GROUP BY ALL),
q AS (SELECT face_id, any_value(hx) AS hx, any_value(hy) AS hy, greatest(max(u) - min(u), max(v) - min(v)) * 1.1e0 AS side, any_value(nx) + any_value(hx) * (max(u) + min(u)) / 2 - any_value(hy) * (max(v) + min(v)) / 2 AS cx, any_value(ny) + any_value(hy) * (max(u) + min(u)) / 2 + any_value(hx) * (max(v) + min(v)) / 2 AS cy FROM c GROUP BY face_id)
SELECT face_id, CAST(i AS INTEGER) AS corner, round(cx + hx * side * sx / 2 - hy * side * sy / 2, 6) + 0.0 AS x, round(cy + hy * side * sx / 2 + hx * side * sy / 2, 6) + 0.0 AS y FROM q, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) k(i, sx, sy)""")
def chip_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of the normalised face chip on the source. This face's mouth runs from landmark 54, on the left, to 48."""
    points = F.col("points")
    xs, brow, bottom = p.pick(points, p.JAW, "x"), F.array_min(p.pick(points, p.BROWS, "y")), F.array_max(p.pick(points, p.JAW, "y"))
    mid = lambda which: F.struct(*[c.alias(a) for a, c in zip("xy", p.centre(points, which), strict=True)])
    f = faces(spark, sf_dir).select("face_id", mid(p.LEFT_EYE).alias("left_eye"), mid(p.RIGHT_EYE).alias("right_eye"), *[p.at(points, i).alias(n) for n, i in (("nose", 30), ("left_mouth", 54), ("right_mouth", 48))], F.array_min(xs).alias("left"), F.array_max(xs).alias("right"), brow.alias("brow"), bottom.alias("bottom"))
    f = f.withColumns({"x": F.col("left") - 20, "y": F.col("brow") - 40, "w": F.col("right") - F.col("left") + 40, "h": F.col("bottom") - F.col("brow") + 60})
    f = p.with_chip_map(f)
    f = f.select("face_id", *[c.alias(f"i{i}") for i, c in enumerate(g.affine_inverse(*[F.col(f"m{i}") for i in range(6)]))])
    return f.select("face_id", F.posexplode(p.corners([F.col(f"i{i}") for i in range(6)], 112, 112)).alias("corner", "at")).select("face_id", "corner", r6("at.x").alias("x"), r6("at.y").alias("y"))


@query("""WITH r AS (SELECT s.*, k.ratio, floor(cc / ratio / 3) * 3 AS cw, floor(cc / ratio / 3) * 4 AS ch, brow - (chin - brow) * 0.8e0 AS crown FROM shapes s, (VALUES (0.4e0), (0.48e0), (0.56e0)) k(ratio)),
o AS (SELECT *, CAST(least(greatest(round_even(least(greatest(aa - cw / 2, 0), greatest(1000 - cw, 0)), 0), 0), greatest(1000 - cw, 0)) AS BIGINT) AS x, CAST(least(greatest(round_even(least(greatest(bb - ch * 0.45e0, 0), greatest(1200 - ch, 0)), 0), 0), greatest(1200 - ch, 0)) AS BIGINT) AS y FROM r),
m AS (SELECT *, 480 / cw AS scale, cc / cw AS accepted, (bb - y) / ch AS eye FROM o)
SELECT face_id, ratio, x, y, CAST(cw AS BIGINT) AS w, CAST(ch AS BIGINT) AS h, round(accepted, 6) + 0.0 AS head_ratio, round(eye, 6) + 0.0 AS eye_line,
CASE WHEN cc <= 0 THEN 'no width' WHEN cw < 480 OR ch < 640 THEN 'enlargement' WHEN cw > 1000 OR ch > 1200 THEN 'source area' WHEN (jl - cc * 0.1 - x) * scale < 10 OR (x + cw - jr - cc * 0.1) * scale < 10 OR (crown - y) * scale < 20 THEN 'margins'
WHEN accepted < 0.4 OR accepted > 4e0 / 7 THEN 'head ratio' WHEN cc < 240 OR cc * scale < 240 THEN 'width evidence' WHEN (chin - crown) * scale <= 0 OR (chin - crown) * scale > 512 OR (chin - y) * 640 / ch > 630 THEN 'head height'
WHEN eye < 0.3 OR eye > 0.5 THEN 'eye line' WHEN abs((nose_x - mouth_x) * scale) > 8 OR abs(((nose_x + mouth_x) / 2 - x) * scale - 240) > 10 THEN 'centre line' END AS reason FROM m""")
def portrait_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each face's crops for three wanted head widths, with the first rule that a crop breaks."""
    ladder = faces(spark, sf_dir).withColumn("ratio", F.explode(F.array(*map(F.lit, (0.4, 0.48, 0.56)))))
    return p.with_candidate(ladder, W, H).select("face_id", "ratio", "x", "y", "w", "h", r6("head_ratio").alias("head_ratio"), r6("eye_line").alias("eye_line"), "reason")


@query("SELECT face_id, round(cc * 480 / 600, 6) + 0.0 AS head_width, round((chin - (brow - (chin - brow) * 0.8e0)) * 480 / 600, 6) + 0.0 AS head_height, 'Estimated' AS status FROM shapes")
def geometry_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = faces(spark, sf_dir).select("face_id", p.evidence(F.col("points"), F.lit(600.0)).alias("e"))
    return e.select("face_id", r6("e.head_width.output").alias("head_width"), r6("e.head_height.output").alias("head_height"), F.col("e.head_width.status").alias("status"))


_PLANES = "(VALUES (-1, 0, -2.5e0), (0, -1, -1.25e0), (1, 0, 30e0), (0, 1, 28e0), (1, 1, 40e0), (-1, 1, 22e0), (1, -2, 18e0)) k(a, b, m)"


@query(f"""WITH q AS (SELECT c_custkey AS id, c_custkey % 40 - 5 AS px, c_custkey * 7 % 37 - 5 AS py FROM customer), g AS (SELECT CAST(gx AS BIGINT) AS x, CAST(gy AS BIGINT) AS y FROM range(0, 45) a(gx), range(0, 45) b(gy) WHERE NOT EXISTS (SELECT 1 FROM {_PLANES} WHERE a * gx + b * gy > m + 0.0001)),
d AS (SELECT id, min(pow(g.x - px, 2) + pow(g.y - py, 2)) AS away FROM q, g GROUP BY id) SELECT id, round(away, 6) + 0.0 AS away FROM d""")
def nearest_feasible_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the closest whole crop origin is that all half planes allow, from the wanted one. The polygon is the same for all,
    so it is cut once, in a row of its own that all others meet."""
    planes = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(m)).alias("m")) for a, b, m in ((-1, 0, -2.5), (0, -1, -1.25), (1, 0, 30), (0, 1, 28), (1, 1, 40), (-1, 1, 22), (1, -2, 18))])
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (44, 0), (44, 44), (0, 44))])
    c = F.col("c_custkey")
    wanted = rel.dealt(rel.table(spark, sf_dir, "customer").select(c.alias("id"), (c % 40 - 5).cast("double").alias("px"), (c * 7 % 37 - 5).cast("double").alias("py")))
    b = wanted.crossJoin(F.broadcast(spark.range(1).select(p.clip_all(square, planes).alias("polygon"))))
    best = b.select("id", "px", "py", p.nearest_feasible(F.col("polygon"), planes, F.col("px"), F.col("py")).alias("at"))
    return best.select("id", r6(F.pow(F.col("at.x") - F.col("px"), 2) + F.pow(F.col("at.y") - F.col("py"), 2)).alias("away"))


@query("SELECT image_id, det_id, round(least(640 / (w * 10), 640 / (h * 12)), 6) + 0.0 AS scale, CAST(floor(w * 10 * least(640 / (w * 10), 640 / (h * 12)) + 1e-9) AS BIGINT) AS new_w, CAST(floor((640 - floor(w * 10 * least(640 / (w * 10), 640 / (h * 12)) + 1e-9)) / 2) AS BIGINT) AS pad_x FROM boxes")
def letterbox_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = p.letterbox(F.col("w") * 10, F.col("h") * 12)
    return rel.boxes(spark, sf_dir).select("image_id", "det_id", r6(fit["scale"]).alias("scale"), fit["new_w"].alias("new_w"), fit["pad_x"].alias("pad_x"))


@query("SELECT image_id, det_id, abs(w / 50 - 1) > 0.01 AS scaled, abs(x - 20) > 0.1 AS turned, CAST(round_even(w * (h / 50), 0) AS BIGINT) AS new_w, round(50 / h, 6) + 0.0 AS inverse, round((w / 50) * (h / 50), 6) + 0.0 AS combined, abs((w / h) / 0.75 - 1) <= 0.1 AS consistent FROM boxes")
def plan_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale arithmetic, which steps of a plan matter, and whether its shape is within a tenth of the target's."""
    x, w, h = (F.col(c) for c in "xwh")
    return rel.boxes(spark, sf_dir).select(
        "image_id", "det_id", g.significant_scale(w / 50).alias("scaled"), g.significant_angle(x - 20).alias("turned"), F.bround(g.scaled(w, h / 50)).cast("long").alias("new_w"), r6(g.inverse_scale(h / 50)).alias("inverse"),
        r6((w / 50) * (h / 50)).alias("combined"), g.shape_consistent(w / h, F.lit(0.75)).alias("consistent"),
    )


@query("""WITH f AS (SELECT face_id, idx, x / 20 AS x, y / 20 AS y FROM faces), m AS (SELECT face_id, ceil((max(x) FILTER (idx < 17) - min(x) FILTER (idx < 17)) * 0.03e0) AS pad, min(x) - 3 AS x0, max(x) + 3 AS x1, min(y) - 3 AS y0, max(y) + 3 AS y1 FROM f GROUP BY face_id),
e AS (SELECT a.face_id, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM f a JOIN f b ON a.face_id = b.face_id AND a.idx <> b.idx WHERE NOT EXISTS (SELECT 1 FROM f c WHERE c.face_id = a.face_id AND c.idx <> a.idx AND c.idx <> b.idx AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)),
p AS (SELECT face_id, px, py, pad FROM m, range(-20, 80) a(px), range(-20, 90) b(py) WHERE px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1),
d AS (SELECT p.face_id, px, py, bool_and(dx * (py + 0.5 - ay) - dy * (px + 0.5 - ax) >= 0) AS inside, bool_or(pow(px + 0.5 - ax - t * dx, 2) + pow(py + 0.5 - ay - t * dy, 2) <= pad * pad) AS near
FROM (SELECT p.*, ax, ay, dx, dy, least(greatest(((px + 0.5 - ax) * dx + (py + 0.5 - ay) * dy) / (dx * dx + dy * dy), 0), 1) AS t FROM p JOIN e ON e.face_id = p.face_id) p GROUP BY p.face_id, px, py)
SELECT face_id, count(*) AS pixels, CAST(sum(px) AS BIGINT) AS sum_x, CAST(sum(py) AS BIGINT) AS sum_y FROM d WHERE inside OR near GROUP BY face_id""")
def anatomical_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hull of all landmarks with a margin of three hundredths of the jaw, in pixels of a small frame."""
    f = faces(spark, sf_dir).withColumn("points", F.transform("points", lambda q: F.struct((q["x"] / 20).alias("x"), (q["y"] / 20).alias("y"))))
    x = p.pick(F.col("points"), p.JAW, "x")
    f = f.withColumn("pad", F.ceil((F.array_max(x) - F.array_min(x)) * 0.03))
    mask = regions.hull_mask(regions.with_hull(f, "points").select("face_id", "ring", "pad"), ["face_id"], "pad")
    return mask.groupBy("face_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


@query("SELECT image_id, det_id, CAST(i AS INTEGER) AS i, round(((x / 640 + (i - 2) * 0.3e0 * 0.1e0 * 0.05e0) * 640 - 16) / 0.8e0, 6) + 0.0 AS px, round(((y / 640 + (i % 2) * 0.4e0 * 0.1e0 * 0.05e0) * 640 - 0) / 0.8e0, 6) + 0.0 AS py FROM boxes, range(5) t(i)")
def five_point_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = [(F.lit((i - 2) * 0.3), F.lit((i % 2) * 0.4)) for i in range(5)]
    points = g.five_points(F.col("x") / 640, F.col("y") / 640, F.lit(0.05), offsets, 640, F.lit(16), F.lit(0), F.lit(0.8))
    return rel.boxes(spark, sf_dir).select("image_id", "det_id", F.posexplode(points).alias("i", "q")).select("image_id", "det_id", "i", r6("q.x").alias("px"), r6("q.y").alias("py"))


@query("""WITH c AS (SELECT image_id, det_id, greatest(floor(x - 0.1e0 * w), 0) AS x0, greatest(floor(y - 0.1e0 * h), 0) AS y0, least(ceil(x + 1.1e0 * w), 90) AS x1, least(ceil(y + 1.1e0 * h), 80) AS y1 FROM boxes),
s AS (SELECT *, greatest(x1 - x0, y1 - y0) AS side FROM c) SELECT image_id, det_id, CAST(side AS BIGINT) AS side, round(0.25e0 * side - floor((side - (x1 - x0)) / 2) + x0, 6) + 0.0 AS px, round(0.75e0 * side - floor((side - (y1 - y0)) / 2) + y0, 6) + 0.0 AS py FROM s""")
def landmark_crop_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a point of the landmark network's square lies on the image."""
    crop = g.landmark_crop(*[F.col(c) for c in "xywh"], F.lit(90), F.lit(80))
    px, py = g.from_crop(F.lit(0.25), F.lit(0.75), crop)
    return rel.boxes(spark, sf_dir).select("image_id", "det_id", crop["side"].cast("long").alias("side"), r6(px).alias("px"), r6(py).alias("py"))
