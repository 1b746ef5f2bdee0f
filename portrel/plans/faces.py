"""Queries over detections and landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from portrel.functions import geometry as g
from portrel.operators import detect, regions
from portrel.plans.registry import query, r6
from portrel.sources import relations as rel

_IOU = "CASE WHEN least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) < 0 OR least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) < 0 THEN 0 ELSE (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / (a.w * a.h + b.w * b.h - (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))) END"


@query(f"SELECT a.image_id, a.det_id AS det_a, b.det_id AS det_b, round({_IOU}, 12) + 0.0 AS iou FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.det_id < b.det_id")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = rel.boxes(spark, sf_dir).select("image_id", "det_id", F.struct("x", "y", "w", "h").alias("b"))
    pair = b.select("image_id", F.col("det_id").alias("det_a"), F.col("b").alias("a")).join(b.withColumnRenamed("det_id", "det_b"), "image_id").where("det_a < det_b")
    return pair.select("image_id", "det_a", "det_b", (F.round(g.iou(F.col("a"), F.col("b")), 12) + 0.0).alias("iou"))


@query(f"""WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS k FROM boxes),
steps AS (SELECT image_id, 1 AS k, [det_id] AS kept FROM ranked WHERE k = 1
UNION ALL SELECT a.image_id, CAST(s.k + 1 AS INTEGER), CASE WHEN EXISTS (SELECT 1 FROM ranked b WHERE b.image_id = a.image_id AND list_contains(s.kept, b.det_id) AND {_IOU} > 0.4) THEN s.kept ELSE list_append(s.kept, a.det_id) END FROM steps s JOIN ranked a ON a.image_id = s.image_id AND a.k = s.k + 1),
last AS (SELECT image_id, arg_max(kept, k) AS kept FROM steps GROUP BY image_id) SELECT image_id, unnest(kept) AS det_id FROM last""")
def nms_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.non_max_suppression(rel.boxes(spark, sf_dir))


_PRIORS = "priors AS (SELECT f.o + c.c * 2 + k.k AS i, (c.c % f.n + 0.5e0) * f.step / 640 AS cx, (c.c // f.n + 0.5e0) * f.step / 640 AS cy, CAST(CASE WHEN k.k = 0 THEN f.s0 ELSE f.s1 END AS DOUBLE) / 640 AS s FROM (VALUES (8, 80, 0, 16, 32), (16, 40, 12800, 64, 128), (32, 20, 16000, 256, 512)) f(step, n, o, s0, s1), range(6400) c(c), range(2) k(k) WHERE c.c < f.n * f.n)"


@query(f"WITH {_PRIORS} SELECT CAST(i AS BIGINT) AS i, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(s, 6) + 0.0 AS s FROM priors")
def prior_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.priors(spark).select("i", r6("cx").alias("cx"), r6("cy").alias("cy"), r6("s").alias("s"))


@query(f"WITH {_PRIORS}, f AS (SELECT vec_id % 16800 AS i, vec_id, CAST(embedding[1] AS DOUBLE) AS dx, CAST(embedding[2] AS DOUBLE) AS dy, CAST(embedding[3] AS DOUBLE) AS dw, CAST(embedding[4] AS DOUBLE) AS dh FROM embeddings) SELECT vec_id, round((cx + dx * 0.1e0 * s) * 640 - s * exp(dw * 0.2e0) * 320, 6) + 0.0 AS x, round((cy + dy * 0.1e0 * s) * 640 - s * exp(dh * 0.2e0) * 320, 6) + 0.0 AS y, round(s * exp(dw * 0.2e0) * 640, 6) + 0.0 AS w, round(s * exp(dh * 0.2e0) * 640, 6) + 0.0 AS h FROM f JOIN priors USING (i)")
def prior_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.table(spark, sf_dir, "embeddings")
    found = e.select((F.col("vec_id") % 16800).alias("i"), "vec_id", *[F.get("embedding", k).cast("double").alias(n) for k, n in enumerate(("dx", "dy", "dw", "dh"))])
    d = detect.decode(found, detect.priors(spark))
    return d.select("vec_id", r6("px").alias("x"), r6("py").alias("y"), r6("pw").alias("w"), r6("ph").alias("h"))


@query("WITH c AS (SELECT image_id, count(*) AS n FROM boxes WHERE conf >= 0.9 GROUP BY image_id) SELECT i.image_id, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'no_face' WHEN n > 1 THEN 'multiple_faces' END AS code FROM (SELECT DISTINCT image_id FROM boxes) i LEFT JOIN c ON c.image_id = i.image_id")
def single_face_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = rel.boxes(spark, sf_dir)
    return detect.exactly_one(b, b.where(F.col("conf") >= 0.9))


@query("SELECT image_id, det_id, round(conf, 6) + 0.0 AS conf FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS k FROM boxes) WHERE k = 1")
def best_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = rel.boxes(spark, sf_dir).groupBy("image_id").agg(F.min(F.struct((-F.col("conf")).alias("o"), "det_id", "conf")).alias("b"))
    return best.select("image_id", "b.det_id", r6("b.conf").alias("conf"))


@query("SELECT image_id, det_id, CAST(k AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS k FROM boxes WHERE w >= 50 AND h >= 50) WHERE k <= 2")
def keep_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rel.boxes(spark, sf_dir).where("w >= 50 AND h >= 50")
    return detect.top(kept, ["image_id"], 2, F.col("conf").desc(), "det_id").select("image_id", "det_id", "turn")


@query("SELECT image_id, det_id, greatest(x - 10, 0) AS x0, greatest(y - 10, 0) AS y0, least(x + w + 10, 90) AS x1, least(y + h + 10, 90) AS y1, w > 0 AND h > 0 AND conf > 0.5 AND w * h > 100 AS valid, CASE WHEN least(x + w + 10, 90) - greatest(x - 10, 0) < 60 THEN 'too_narrow' WHEN least(y + h + 10, 90) - greatest(y - 10, 0) < 60 THEN 'too_low' END AS code FROM boxes")
def box_clamp_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = (F.col(c) for c in "xywh")
    b = rel.boxes(spark, sf_dir).withColumns({"x0": F.greatest(x - 10, F.lit(0.0)), "y0": F.greatest(y - 10, F.lit(0.0)), "x1": F.least(x + w + 10, F.lit(90.0)), "y1": F.least(y + h + 10, F.lit(90.0))})
    code = F.when(F.col("x1") - F.col("x0") < 60, "too_narrow").when(F.col("y1") - F.col("y0") < 60, "too_low")
    return b.select("image_id", "det_id", "x0", "y0", "x1", "y1", ((w > 0) & (h > 0) & (F.col("conf") > 0.5) & (w * h > 100)).alias("valid"), code.alias("code"))


_EYES = "eyes AS (SELECT vec_id, avg(x) FILTER (WHERE idx BETWEEN 16 AND 20) AS lx, avg(y) FILTER (WHERE idx BETWEEN 16 AND 20) AS ly, avg(x) FILTER (WHERE idx BETWEEN 21 AND 25) AS rx, avg(y) FILTER (WHERE idx BETWEEN 21 AND 25) AS ry FROM landmarks GROUP BY vec_id)"


def _eyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda c, a, b: F.avg(F.when(F.col("idx").between(a, b), F.col(c)))
    return rel.landmarks(spark, sf_dir).groupBy("vec_id").agg(mean("x", 16, 20).alias("lx"), mean("y", 16, 20).alias("ly"), mean("x", 21, 25).alias("rx"), mean("y", 21, 25).alias("ry"))


@query(f"WITH {_EYES} SELECT vec_id, round(-degrees(atan2(ry - ly, rx - lx)), 6) + 0.0 AS rotation, round(least(greatest(-degrees(atan2(ry - ly, rx - lx)), -5), 5), 6) + 0.0 AS clamped, round(sqrt(pow(rx - lx, 2) + pow(ry - ly, 2)), 6) + 0.0 AS eye_distance FROM eyes")
def eye_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lx, ly, rx, ry = (F.col(c) for c in ("lx", "ly", "rx", "ry"))
    turn = g.eye_rotation(lx, ly, rx, ry)
    return _eyes(spark, sf_dir).select("vec_id", r6(turn).alias("rotation"), r6(g.clamp(turn, -5.0, 5.0)).alias("clamped"), r6(g.distance(lx, ly, rx, ry)).alias("eye_distance"))


@query(f"WITH {_EYES}, t AS (SELECT vec_id, -degrees(atan2(ry - ly, rx - lx)) AS a FROM eyes) SELECT vec_id, CAST(ceil(round(480 * abs(cos(radians(a))) + 640 * abs(sin(radians(a))), 9)) AS BIGINT) AS width, CAST(ceil(round(480 * abs(sin(radians(a))) + 640 * abs(cos(radians(a))), 9)) AS BIGINT) AS height FROM t")
def expanded_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = g.eye_rotation(*(F.col(c) for c in ("lx", "ly", "rx", "ry")))
    w, h = g.expanded_canvas(F.lit(480), F.lit(640), F.col("a"))
    return _eyes(spark, sf_dir).select("vec_id", turn.alias("a")).select("vec_id", w.alias("width"), h.alias("height"))


@query("SELECT o_orderkey AS id, round(CASE WHEN ((o_totalprice % 720 - 360) % 360 + 360) % 360 > 180 THEN ((o_totalprice % 720 - 360) % 360 + 360) % 360 - 360 ELSE ((o_totalprice % 720 - 360) % 360 + 360) % 360 END, 6) + 0.0 AS angle FROM orders")
def angle_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), r6(g.normalise_angle(F.col("o_totalprice") % 720 - 360)).alias("angle"))


@query("WITH m AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) + 1 AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) + 1 AS d, CAST(embedding[5] AS DOUBLE) * 100 AS tx, CAST(embedding[6] AS DOUBLE) * 100 AS ty FROM embeddings) SELECT vec_id, round(d / (a * d - b * c), 6) + 0.0 AS ia, round(-b / (a * d - b * c), 6) + 0.0 AS ib, round(-c / (a * d - b * c), 6) + 0.0 AS ic, round(a / (a * d - b * c), 6) + 0.0 AS id, round((c * ty - d * tx) / (a * d - b * c), 6) + 0.0 AS itx, round((b * tx - a * ty) / (a * d - b * c), 6) + 0.0 AS ity FROM m WHERE a * d - b * c <> 0")
def affine_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.table(spark, sf_dir, "embeddings")
    at = lambda k: F.get("embedding", k).cast("double")
    m = e.select("vec_id", (at(0) + 1).alias("a"), at(1).alias("b"), at(2).alias("c"), (at(3) + 1).alias("d"), (at(4) * 100).alias("tx"), (at(5) * 100).alias("ty"))
    inverse = g.affine_inverse(*(F.col(c) for c in ("a", "b", "c", "d", "tx", "ty")))
    out = m.select("vec_id", *[r6(v).alias(n) for v, n in zip(inverse, ("ia", "ib", "ic", "id", "itx", "ity"), strict=True)])
    return out.where(F.col("ia").isNotNull())


@query("WITH s AS (SELECT vec_id, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS vxy FROM landmarks GROUP BY vec_id), e AS (SELECT *, (vx + vy) / 2 AS h, sqrt(greatest(pow((vx + vy) / 2, 2) - (vx * vy - vxy * vxy), 0)) AS r FROM s) SELECT vec_id, round(cx, 4) + 0.0 AS cx, round(cy, 4) + 0.0 AS cy, round(sqrt(h + r) * 5, 4) + 0.0 AS major, round(sqrt(greatest(h - r, 0)) * 5, 4) + 0.0 AS minor, round(degrees(0.5e0 * atan2(2 * vxy, vx - vy)), 4) + 0.0 AS angle FROM e")
def cov_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = regions.covariance_ellipse(rel.landmarks(spark, sf_dir), ["vec_id"])
    return e.select("vec_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("cx", "cy", "major", "minor", "angle")])


@query("SELECT vec_id, round(min(x), 6) + 0.0 AS x0, round(max(x), 6) + 0.0 AS x1, round(min(y), 6) + 0.0 AS y0, round(max(y), 6) + 0.0 AS y1, arg_min(idx, struct_pack(x := x, idx := idx)) AS leftmost, round(avg(x), 6) + 0.0 AS cx FROM landmarks WHERE idx <= 16 GROUP BY vec_id")
def jaw_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    jaw = rel.landmarks(spark, sf_dir).where("idx <= 16")
    return jaw.groupBy("vec_id").agg(r6(F.min("x")).alias("x0"), r6(F.max("x")).alias("x1"), r6(F.min("y")).alias("y0"), r6(F.max("y")).alias("y1"), F.min_by("idx", F.struct("x", "idx")).alias("leftmost"), r6(F.avg("x")).alias("cx"))


@query("WITH d AS (SELECT vec_id, idx, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM landmarks WINDOW w AS (PARTITION BY vec_id ORDER BY idx)) SELECT vec_id, round(sum(d), 6) + 0.0 AS length FROM d GROUP BY vec_id")
def segment_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("vec_id").orderBy("idx")
    d = rel.landmarks(spark, sf_dir).withColumn("d", g.distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w)))
    return d.groupBy("vec_id").agg(r6(F.sum("d")).alias("length"))


@query("WITH n AS (SELECT vec_id, idx, x - 240 AS v, lead(x - 240) OVER (PARTITION BY vec_id ORDER BY idx) AS nv FROM landmarks) SELECT vec_id, idx, round(idx + v / (v - nv), 6) + 0.0 AS at FROM n WHERE v * nv < 0")
def zero_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("vec_id").orderBy("idx")
    n = rel.landmarks(spark, sf_dir).withColumn("v", F.col("x") - 240).withColumn("nv", F.lead("v").over(w))
    return n.where(F.col("v") * F.col("nv") < 0).select("vec_id", "idx", r6(F.col("idx") + F.col("v") / (F.col("v") - F.col("nv"))).alias("at"))


@query("""WITH e AS (SELECT a.vec_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM landmarks a JOIN landmarks b ON a.vec_id = b.vec_id AND a.idx <> b.idx
WHERE NOT EXISTS (SELECT 1 FROM landmarks c WHERE c.vec_id = a.vec_id AND c.idx <> a.idx AND c.idx <> b.idx AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0))
SELECT vec_id, CAST(count(*) AS INTEGER) AS corners, round(sum(x1 * y2 - x2 * y1) / 2, 6) + 0.0 AS area FROM e GROUP BY vec_id""")
def convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.hull_area(rel.landmarks(spark, sf_dir), ["vec_id"]).select("vec_id", "corners", r6("area").alias("area"))
