"""Queries of validators, planning geometry, strings and remaining ledger arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from portrel.functions import geometry as g
from portrel.functions import gates, validate
from portrel.operators import raster
from portrel.plans.images import _SOBEL, TILE
from portrel.plans.registry import query, r6
from portrel.sources import relations as rel


@query("SELECT o.o_orderkey AS id, CAST(coalesce(l.n, 0) AS BIGINT) AS estimate FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey")
def lookup_default_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = rel.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("estimate"))
    o = rel.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return o.join(n, "id", "left").select("id", F.coalesce("estimate", F.lit(0).cast("long")).alias("estimate"))


@query("SELECT image_id, det_id, CASE WHEN x < 0 OR y < 0 THEN 'position' WHEN w <= 0 OR h <= 0 THEN 'size' WHEN conf < 0 OR conf > 1 THEN 'confidence' WHEN conf < 0.05 THEN 'weak' END AS code, CASE WHEN conf >= 0.05 THEN round(conf * 100, 4) + 0.0 END AS percent, round((2 * (conf - 0.05e0)) / (2 * 0.95e0), 6) + 0.0 AS ratio FROM boxes")
def value_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = validate.first_error(
        ((F.col("x") < 0) | (F.col("y") < 0), validate.error("position", "negative")), ((F.col("w") <= 0) | (F.col("h") <= 0), validate.error("size", "not positive")),
        ((F.col("conf") < 0) | (F.col("conf") > 1), validate.error("confidence", "not in 0..1")), (F.col("conf") < 0.05, validate.error("weak", "too low")),
    )
    b = rel.boxes(spark, sf_dir).withColumn("error", e)
    return b.select("image_id", "det_id", F.col("error.code").alias("code"), F.when(F.col("error").isNull(), F.round(F.col("conf") * 100, 4) + 0.0).alias("percent"), r6((2 * (F.col("conf") - 0.05)) / (2 * 0.95)).alias("ratio"))


@query("SELECT id, CASE WHEN head < 35 THEN 'head size ' || printf('%.1f', head) || '% is under 35.0%' WHEN head > 80 THEN 'head size ' || printf('%.1f', head) || '% is over 80.0%' END AS message, concat_ws('; ', CASE WHEN symmetry < 0.5 THEN 'asymmetric' END, CASE WHEN sharpness < 0.3 THEN 'blurred' END, CASE WHEN geometry < 0.4 THEN 'off centre' END, CASE WHEN ipd < 60 THEN 'eyes close' END) AS issues, NOT (symmetry < 0.3 OR sharpness < 0.2) AND round(0.3e0 * symmetry + 0.3e0 * sharpness + 0.4e0 * geometry, 9) >= 0.7 AS iso FROM assessments")
def rejection_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("head") < 35, F.format_string("head size %.1f%% is under 35.0%%", "head")).when(F.col("head") > 80, F.format_string("head size %.1f%% is over 80.0%%", "head"))
    rules = (("symmetry", 0.5, "asymmetric"), ("sharpness", 0.3, "blurred"), ("geometry", 0.4, "off centre"), ("ipd", 60, "eyes close"))
    issues = validate.kept(*[F.when(F.col(c) < t, F.lit(m)) for c, t, m in rules])
    total = F.round(0.3 * F.col("symmetry") + 0.3 * F.col("sharpness") + 0.4 * F.col("geometry"), 9)
    return rel.assessments(spark, sf_dir).select("id", head.alias("message"), F.array_join(issues, "; ").alias("issues"), (~((F.col("symmetry") < 0.3) | (F.col("sharpness") < 0.2)) & (total >= 0.7)).alias("iso"))


@query("WITH p AS (SELECT event_id AS id, value - 45 AS yaw, user_id % 60 - 30 AS pitch, event_id % 80 - 40 AS roll FROM events) SELECT id, abs(yaw) <= 15 AND abs(pitch) <= 15 AND abs(roll) <= 15 AS frontal, round(greatest(abs(yaw), abs(pitch), abs(roll)), 6) + 0.0 AS worst FROM p")
def frontal_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rel.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("value") - 45).alias("yaw"), (F.col("user_id") % 60 - 30).cast("double").alias("pitch"), (F.col("event_id") % 80 - 40).cast("double").alias("roll"))
    frontal, worst = gates.frontal(F.col("yaw"), F.col("pitch"), F.col("roll"))
    return p.select("id", frontal.alias("frontal"), r6(worst).alias("worst"))


@query("SELECT id, CASE WHEN w < 50 THEN 'width' WHEN len < 1 THEN 'empty' WHEN len > cap THEN 'over cap' WHEN rest <> 0 THEN 'not closed' END AS first_failure, least(len, cap) AS taken FROM (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity AS w, l_partkey % 300 AS len, l_suppkey % 250 + 40 AS cap, l_partkey % 3 - 1 AS rest FROM lineitem)")
def encoder_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = rel.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("w"), (F.col("l_partkey") % 300).alias("len"), (F.col("l_suppkey") % 250 + 40).alias("cap"), (F.col("l_partkey") % 3 - 1).alias("rest"))
    first = gates.encoder_failure(*[F.col(c) for c in ("w", "len", "cap", "rest")])
    return li.select("id", first.alias("first_failure"), F.least("len", "cap").alias("taken"))


@query(f"WITH {_SOBEL}, e AS (SELECT vec_id, count(*) FILTER (WHERE m >= 1) AS strong, count(*) FILTER (WHERE m >= 0.3 AND m < 1) AS weak, avg(m) FILTER (WHERE m >= 0.3) AS mean FROM sobel GROUP BY vec_id) SELECT vec_id, strong, weak, round((strong + weak) * 1e6 / 64, 6) + 0.0 AS per_megapixel, round(coalesce(mean, 0), 6) + 0.0 AS mean_magnitude, round(CASE WHEN strong + weak = 0 THEN 0 ELSE strong / CAST(strong + weak AS DOUBLE) END, 6) + 0.0 AS strong_share FROM e")
def edge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raster.correlate(rel.blocks8(spark, sf_dir), TILE, {"gx": raster.SOBEL_X, "gy": raster.SOBEL_Y}).withColumn("m", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    e = s.groupBy("vec_id").agg(F.count_if(F.col("m") >= 1).alias("strong"), F.count_if((F.col("m") >= 0.3) & (F.col("m") < 1)).alias("weak"), F.avg(F.when(F.col("m") >= 0.3, F.col("m"))).alias("mean"))
    n = F.col("strong") + F.col("weak")
    return e.select("vec_id", "strong", "weak", r6(n * 1e6 / 64).alias("per_megapixel"), r6(F.coalesce("mean", F.lit(0.0))).alias("mean_magnitude"), r6(F.coalesce(F.try_divide("strong", n), F.lit(0.0))).alias("strong_share"))


@query("WITH m AS (SELECT image_id, i, r, g, b FROM pixels), c AS (SELECT image_id, count(*) AS n, avg(r) AS cr, avg(g) AS cg, avg(b) AS cb FROM m GROUP BY image_id) SELECT m.image_id, c.n, round(greatest(0, least(1, 1 - sum(abs(r - cr) + abs(g - cg) + abs(b - cb)) / (3 * c.n * 128.0e0))), 6) + 0.0 AS consistency FROM m JOIN c ON c.image_id = m.image_id GROUP BY m.image_id, c.n HAVING c.n >= 100")
def candidate_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rel.pixels(spark, sf_dir)
    c = m.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"c{x}") for x in "rgb"]).where("n >= 100")
    off = sum((F.abs(F.col(x) - F.col(f"c{x}")) for x in "gb"), F.abs(F.col("r") - F.col("cr")))
    s = m.join(c, "image_id").groupBy("image_id", "n").agg(F.sum(off).alias("off"))
    return s.select("image_id", "n", r6(g.clamp(1 - F.col("off") / (3 * F.col("n") * 128.0), 0.0, 1.0)).alias("consistency"))


@query("SELECT image_id, i, CASE WHEN label = 'A' THEN 'face' WHEN r > 200 THEN 'foreground' WHEN g <= 128 AND b <= 128 THEN 'candidate' ELSE 'unknown' END AS region FROM pixels")
def label_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = gates.region_label(F.col("label") == "A", F.col("r") > 200, (F.col("g") <= 128) & (F.col("b") <= 128))
    return rel.pixels(spark, sf_dir).select("image_id", "i", region.alias("region"))


@query("WITH b AS (SELECT vec_id, min(x) FILTER (WHERE idx <= 16) AS jx0, max(x) FILTER (WHERE idx <= 16) AS jx1, max(y) FILTER (WHERE idx <= 16) AS chin, avg(y) FILTER (WHERE idx BETWEEN 17 AND 20) AS brow, avg(x) AS cx, avg(y) AS cy FROM landmarks GROUP BY vec_id) SELECT vec_id, round(brow - 0.8e0 * (chin - brow), 6) + 0.0 AS crown, round((jx1 - jx0) * 0.9e0, 6) + 0.0 AS oval_width, round(greatest(0.85e0 * (chin - brow), 1.3e0 * (jx1 - jx0) * 0.9e0), 6) + 0.0 AS oval_height, round(greatest(0, 1 - sqrt(pow(cx - 240, 2) + pow(cy - 320, 2)) / 400) * 100, 6) + 0.0 AS centring FROM b")
def head_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda f, c, a, b: f(F.when(F.col("idx").between(a, b), F.col(c)))
    b = rel.landmarks(spark, sf_dir).groupBy("vec_id").agg(at(F.min, "x", 0, 16).alias("x0"), at(F.max, "x", 0, 16).alias("x1"), at(F.max, "y", 0, 16).alias("chin"), at(F.avg, "y", 17, 20).alias("brow"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    h = g.head_oval(F.col("brow"), F.col("chin"), F.col("x1") - F.col("x0"))
    centring = g.centring_percent(F.col("cx"), F.col("cy"), F.lit(480), F.lit(640))
    return b.select("vec_id", r6(h["crown"]).alias("crown"), r6(h["width"]).alias("oval_width"), r6(h["height"]).alias("oval_height"), r6(centring).alias("centring"))


@query("SELECT vec_id, idx, round((x - 240) * cos(radians(10)) - (y - 320) * sin(radians(10)) + 240, 6) + 0.0 AS rx, round((x - 240) * sin(radians(10)) + (y - 320) * cos(radians(10)) + 320, 6) + 0.0 AS ry, round((x - 40) * 1.5e0, 6) + 0.0 AS sx FROM landmarks")
def landmark_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotated by ten degrees about the centre, and cropped and scaled."""
    x, y = g.rotated(F.col("x"), F.col("y"), F.lit(240.0), F.lit(320.0), F.lit(10.0))
    return rel.landmarks(spark, sf_dir).select("vec_id", "idx", r6(x).alias("rx"), r6(y).alias("ry"), r6(g.cropped(F.col("x"), F.lit(40.0), F.lit(1.5))).alias("sx"))


@query("SELECT p_partkey AS id, least(1, 1654 / CAST(greatest(p_size * 90, 480) AS DOUBLE)) AS scale, CAST(round_even(p_size * 90 * least(1, 1654 / CAST(greatest(p_size * 90, 480) AS DOUBLE)), 0) AS INTEGER) AS width, CAST(floor(p_retailprice / 25.4e0 * 300 + 0.5e0) AS BIGINT) AS printed FROM part")
def canvas_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = F.greatest(F.col("p_size") * 90, F.lit(480))
    scale = F.least(F.lit(1.0), 1654 / edge)
    return rel.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scale.alias("scale"), F.bround(F.col("p_size") * 90 * scale, 0).cast("int").alias("width"), F.floor(F.col("p_retailprice") / 25.4 * 300 + 0.5).cast("long").alias("printed"))


@query("SELECT l_orderkey AS block, l_linenumber AS b, CAST(l_partkey % 3 AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_suppkey % 4 AS VARCHAR) AS name, CAST(l_partkey % 3 AS INTEGER) AS tile, CAST(l_suppkey % 4 AS INTEGER) AS band FROM lineitem")
def block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names t-r-b written and read back by a pattern."""
    name = F.concat_ws("-", (F.col("l_partkey") % 3).cast("string"), F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 4).cast("string"))
    n = rel.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("b"), name.alias("name"))
    pattern = r"^(\d+)-(\d+)-(\d+)$"
    return n.where(F.col("name").rlike(pattern)).select("block", "b", "name", F.regexp_extract("name", pattern, 1).cast("int").alias("tile"), F.regexp_extract("name", pattern, 3).cast("int").alias("band"))


@query("SELECT vec_id, y, x, CAST(CASE WHEN v > 0.1 THEN CAST(floor(abs(v) * 128) AS BIGINT) * 16 ELSE CAST(floor(abs(v) * 128) AS BIGINT) END AS BIGINT) AS scaled FROM blocks8")
def roi_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes under a mask shifted by four planes."""
    q = F.floor(F.abs("v") * 128).cast("long")
    return rel.blocks8(spark, sf_dir).select("vec_id", "y", "x", F.when(F.col("v") > 0.1, F.shiftleft(q, 4)).otherwise(q).alias("scaled"))


@query("WITH d AS (SELECT vec_id, y, x, CAST(floor(v * 100) AS BIGINT) AS s FROM blocks8), h AS (SELECT vec_id, y, x, CASE WHEN x % 2 = 1 THEN s - CAST(floor((coalesce(lag(s) OVER w, lead(s) OVER w) + coalesce(lead(s) OVER w, lag(s) OVER w)) / 2.0e0) AS BIGINT) ELSE s END AS s FROM d WINDOW w AS (PARTITION BY vec_id, y ORDER BY x)), l AS (SELECT vec_id, y, x, CASE WHEN x % 2 = 0 THEN s + CAST(floor((coalesce(lag(s) OVER w, lead(s) OVER w) + coalesce(lead(s) OVER w, lag(s) OVER w) + 2) / 4.0e0) AS BIGINT) ELSE s END AS s FROM h WINDOW w AS (PARTITION BY vec_id, y ORDER BY x)) SELECT vec_id, y, x, s AS c FROM l")
def wavelet53_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level of the reversible 5/3 wavelet in integers, samples left in place."""
    w = W.partitionBy("vec_id", "y").orderBy("x")
    s = rel.blocks8(spark, sf_dir).withColumn("s", F.floor(F.col("v") * 100).cast("long"))

    def near():  # noqa: ANN202
        left, right = F.lag("s").over(w), F.lead("s").over(w)
        return F.coalesce(left, right) + F.coalesce(right, left)

    s = s.withColumn("near", near()).withColumn("s", F.when(F.col("x") % 2 == 1, F.col("s") - F.floor(F.col("near") / 2).cast("long")).otherwise(F.col("s")))
    s = s.withColumn("near", near()).withColumn("s", F.when(F.col("x") % 2 == 0, F.col("s") + F.floor((F.col("near") + 2) / 4).cast("long")).otherwise(F.col("s")))
    return s.select("vec_id", "y", "x", F.col("s").alias("c"))


@query("SELECT output_id, CAST(sum(payload) AS BIGINT) AS payload, CAST(floor(sum(face * 0.97e0)) AS BIGINT) AS credited, abs(sum(payload) - (sum(face) + sum(shared) + sum(outside))) <= greatest(1, sum(payload)) * 1e-12 AS conserved FROM subbands GROUP BY output_id HAVING sum(payload) > 0")
def attribution_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates are summed as doubles and floored once. Which doubles come out depends on their order where the sum is next to a whole
    number, so each output's bands are summed in the order of the table's files, whatever its partitions."""
    part = F.when(F.col("face").isNotNull(), F.struct("file", "place", (F.col("face") * 0.97).alias("credit")))
    s = rel.subbands(spark, sf_dir).groupBy("output_id").agg(F.sum("payload").alias("payload"), F.array_sort(F.collect_list(part)).alias("bands"), (F.sum("face") + F.sum("shared") + F.sum("outside")).alias("parts"))  # an output's bands
    s = s.withColumn("credit", F.when(F.size("bands") > 0, F.aggregate("bands", F.lit(0.0), lambda a, b: a + b["credit"])))
    near = F.abs(F.col("payload") - F.col("parts")) <= F.greatest(F.lit(1), F.col("payload")) * 1e-12
    return s.where("payload > 0").select("output_id", "payload", F.floor("credit").cast("long").alias("credited"), near.alias("conserved"))


@query("SELECT doc_id, lower(lang) = 'en' AS known, CASE lang WHEN 'en' THEN 'Accepted' WHEN 'fr' THEN 'Review' ELSE 'Unknown' END AS status, '{\"id\":' || CAST(doc_id AS VARCHAR) || ',\"lang\":\"' || lang || '\"}' AS json FROM documents WHERE regexp_matches(source, '^src[0-9]+$')")
def status_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rel.table(spark, sf_dir, "documents").where(F.col("source").rlike("^src[0-9]+$"))
    status = F.when(F.col("lang") == "en", "Accepted").when(F.col("lang") == "fr", "Review").otherwise("Unknown")
    return d.select("doc_id", (F.lower("lang") == "en").alias("known"), status.alias("status"), F.to_json(F.struct(F.col("doc_id").alias("id"), "lang")).alias("json"))
