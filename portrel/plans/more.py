"""Further queries: region tilings, Gabor responses, colour tables, planning arithmetic, comparisons to a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from portrel.functions import gates
from portrel.operators import ledger, raster
from portrel.plans.images import TILE, _kernel_sql
from portrel.plans.registry import query, r6
from portrel.sources import relations as rel

_SMALL_GABOR = raster.gabor_kernel(45, side=5, sigma=1.5, wave=4.0)


@query(f"WITH {_kernel_sql('k', _SMALL_GABOR)}, g AS (SELECT a.vec_id, a.y, a.x, abs(sum(w * b.v)) AS m FROM blocks8 a CROSS JOIN k JOIN blocks8 b ON b.vec_id = a.vec_id AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.y BETWEEN 2 AND 5 AND a.x BETWEEN 2 AND 5 GROUP BY a.vec_id, a.y, a.x) SELECT vec_id, round(sum(m) / 64, 6) + 0.0 AS mean_response FROM g GROUP BY vec_id")
def gabor_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only places whose whole stencil lies inside respond; the border counts as zeros."""
    c = raster.correlate(rel.blocks8(spark, sf_dir), TILE, {"c": _SMALL_GABOR})
    inside = F.col("y").between(2, 5) & F.col("x").between(2, 5)
    return c.groupBy("vec_id").agg(r6(F.sum(F.when(inside, F.abs("c")).otherwise(0.0)) / 64).alias("mean_response"))


@query("SELECT vec_id, CAST(ry AS INTEGER) AS region_y, CAST(rx AS INTEGER) AS region_x, count(*) AS n, round(avg(v), 6) + 0.0 AS mean FROM blocks8, range(3) a(ry), range(3) b(rx) WHERE y >= ry * 8 // 3 AND y < (ry + 1) * 8 // 3 + 1 AND x >= rx * 8 // 3 AND x < (rx + 1) * 8 // 3 + 1 GROUP BY ALL")
def region_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirds by integer division, one cell wider than exact, so that neighbours overlap."""
    def touched(c: str):  # noqa: ANN202
        return F.filter(F.sequence(F.lit(0), F.lit(2)), lambda r: (F.col(c) >= F.floor(r * 8 / 3)) & (F.col(c) < F.floor((r + 1) * 8 / 3) + 1))

    b = rel.blocks8(spark, sf_dir).withColumn("region_y", F.explode(touched("y"))).withColumn("region_x", F.explode(touched("x")))
    return b.groupBy("vec_id", "region_y", "region_x").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("v")).alias("mean"))


@query("SELECT vec_id, round(sum(CASE WHEN y < 4 THEN v ELSE 0 END) - sum(CASE WHEN y >= 4 THEN v ELSE 0 END), 6) + 0.0 AS vertical, round(sqrt(avg(v * v)), 6) + 0.0 AS rms, round(quantile_cont(abs(v), 0.95), 6) + 0.0 AS p95 FROM blocks8 GROUP BY vec_id")
def rms_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.sum(F.when(F.col("y") < 4, F.col("v")).otherwise(0.0)) - F.sum(F.when(F.col("y") >= 4, F.col("v")).otherwise(0.0))
    return rel.blocks8(spark, sf_dir).groupBy("vec_id").agg(r6(top).alias("vertical"), r6(F.sqrt(F.avg(F.col("v") * F.col("v")))).alias("rms"), r6(F.percentile(F.abs("v"), F.lit(0.95))).alias("p95"))


@query("WITH n AS (SELECT vec_id, y, x, v, row_number() OVER (PARTITION BY vec_id ORDER BY y, x) - 1 AS i, count(*) OVER (PARTITION BY vec_id) AS n FROM blocks8 WHERE pow((x - 3.5e0) / 4, 2) + pow((y - 3.5e0) / 4, 2) <= 1) SELECT vec_id, i // CAST(ceil(sqrt(n)) AS BIGINT) AS row, i % CAST(ceil(sqrt(n)) AS BIGINT) AS col, round(v, 6) + 0.0 AS v FROM n")
def ellipse_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of an ellipse in page order, packed row by row into the smallest square."""
    x, y = (F.col("x") - 3.5) / 4, (F.col("y") - 3.5) / 4
    w = W.partitionBy("vec_id")
    c = rel.blocks8(spark, sf_dir).where(x * x + y * y <= 1).withColumn("i", (F.row_number().over(w.orderBy("y", "x")) - 1).cast("long")).withColumn("side", F.ceil(F.sqrt(F.count(F.lit(1)).over(w))).cast("long"))
    return c.select("vec_id", F.floor(F.col("i") / F.col("side")).alias("row"), (F.col("i") % F.col("side")).alias("col"), r6("v").alias("v"))


@query("SELECT image_id, i, CAST(round(greatest(least(pow(r / 255.0e0, 2.2e0) * 0.4e0 + pow(g / 255.0e0, 2.2e0) * 0.4e0 + pow(b / 255.0e0, 2.2e0) * 0.2e0, 1), 0) * 255) AS INTEGER) AS red FROM pixels")
def matrix_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tone curve by table of 256 entries and a row of a 3x3 matrix; halves round away from zero."""
    curve = F.array(*[F.lit((i / 255.0) ** 2.2) for i in range(256)])
    at = lambda c: F.get(curve, F.col(c).cast("int"))
    linear = at("r") * 0.4 + at("g") * 0.4 + at("b") * 0.2
    return rel.pixels(spark, sf_dir).select("image_id", "i", F.round(F.greatest(F.least(linear, F.lit(1.0)), F.lit(0.0)) * 255).cast("int").alias("red"))


@query("WITH a AS (SELECT l_orderkey % 500 AS block, CAST(sum(l_linenumber) AS BIGINT) AS endpoint FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey % 500 AS block, CAST(sum(l_linenumber + CASE WHEN l_partkey % 400 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS endpoint FROM lineitem WHERE l_orderkey % 500 <> 7 GROUP BY 1) SELECT block, a.endpoint AS left_value, b.endpoint AS right_value, CASE WHEN b.endpoint IS NULL THEN 'left only' ELSE 'differs' END AS kind FROM a LEFT JOIN b USING (block) WHERE a.endpoint IS DISTINCT FROM b.endpoint")
def baseline_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = rel.table(spark, sf_dir, "lineitem")
    block = (F.col("l_orderkey") % 500).alias("block")
    a = li.groupBy(block).agg(F.sum("l_linenumber").alias("endpoint"))
    b = li.where("l_orderkey % 500 <> 7").groupBy(block).agg(F.sum(F.col("l_linenumber") + F.when(F.col("l_partkey") % 400 == 0, 1).otherwise(0)).alias("endpoint"))
    return ledger.mismatches(a, b, ["block"], "endpoint")


@query("SELECT image_id, i, CAST(least(greatest(g + (r - 128) + (b - 128), 0), 255) AS BIGINT) AS predicted FROM pixels")
def composed_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline plus the sum of changes, clipped to a byte."""
    v = F.col("g") + (F.col("r") - 128) + (F.col("b") - 128)
    return rel.pixels(spark, sf_dir).select("image_id", "i", F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("long").alias("predicted"))


@query("WITH c AS (SELECT image_id, label, sum(CAST(r - g AS DOUBLE)) AS rg, sum(CAST((r - g) * (r - g) AS DOUBLE)) AS own, sum(CAST((g - b) * (g - b) AS DOUBLE)) AS other, sum(CAST((r - b) * (r - b) AS DOUBLE)) AS whole FROM pixels GROUP BY image_id, label) SELECT image_id, label, own, other, whole - own - other AS crossed, whole FROM c")
def cross_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error of a sum of two changes as the two alone and what they do to each other."""
    square = lambda a, b: F.sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))).cast("double"))
    s = rel.pixels(spark, sf_dir).groupBy("image_id", "label").agg(square("r", "g").alias("own"), square("g", "b").alias("other"), square("r", "b").alias("whole"))
    return s.select("image_id", "label", "own", "other", (F.col("whole") - F.col("own") - F.col("other")).alias("crossed"), "whole")


@query("SELECT p_partkey AS id, gcd(480, p_size * 16) AS unit, 480 // gcd(480, p_size * 16) AS units_w, p_size * 16 // gcd(480, p_size * 16) AS units_h FROM part")
def crop_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest common divisor by Euclid's steps as a fold over a fixed number of them (enough for 32-bit sides)."""
    h = (F.col("p_size") * 16).cast("long")
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1).cast("long"))).alias("b")))
    unit = F.aggregate(F.sequence(F.lit(1), F.lit(47)), F.struct(F.lit(480).cast("long").alias("a"), h.alias("b")), step)["a"]
    p = rel.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), h.alias("h"), unit.alias("unit"))
    return p.select("id", "unit", F.floor(480 / F.col("unit")).alias("units_w"), F.floor(F.col("h") / F.col("unit")).alias("units_h"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 THEN 'icc' WHEN o_custkey % 4 = 1 THEN 'exif' ELSE 'assumed' END AS colour, CASE WHEN o_orderstatus = 'F' THEN 'Measured' ELSE 'Estimated' END AS evidence FROM orders")
def colour_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey") % 4
    return rel.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), gates.colour_basis(c == 0, c == 1).alias("colour"), gates.evidence_status(F.col("o_orderstatus") == "F").alias("evidence"))


@query("WITH l(metric, w) AS (VALUES ('0', 1.25e0), ('1', 1e0), ('2', 1e0)) SELECT component, round(sum(payload * w), 6) + 0.0 AS weighted FROM subbands JOIN l ON CAST(component AS VARCHAR) = metric GROUP BY component")
def subband_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma weighs a quarter more than chroma."""
    return rel.subbands(spark, sf_dir).groupBy("component").agg(r6(F.sum(F.col("payload") * F.when(F.col("component") == 0, 1.25).otherwise(1.0))).alias("weighted"))


@query("SELECT c_custkey AS plan, n_name AS region, CAST(rank() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC NULLS LAST) AS INTEGER) AS place, c_acctbal >= 0 AND isfinite(c_acctbal) AS eligible FROM customer JOIN nation ON c_nationkey = n_nationkey")
def candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = rel.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    c = rel.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    finite = ~F.isnan("c_acctbal") & (F.abs("c_acctbal") < float("inf"))
    return c.select(F.col("c_custkey").alias("plan"), "region", F.rank().over(W.partitionBy("region").orderBy(F.col("c_acctbal").desc_nulls_last())).alias("place"), ((F.col("c_acctbal") >= 0) & finite).alias("eligible"))


@query("SELECT e.image_id, b.level, b.sigma FROM (SELECT DISTINCT image_id FROM pixels) e CROSS JOIN (VALUES (0e0, 0e0), (0.3e0, 0.6e0), (0.5e0, 1.0e0), (0.63e0, 1.26e0), (0.7e0, 1.4e0), (1.0e0, 2.0e0)) b(level, sigma)")
def blur_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image at six blur levels; sigma is twice the level."""
    levels = F.explode(F.array(*map(F.lit, (0.0, 0.3, 0.5, 0.63, 0.7, 1.0)))).alias("level")
    return rel.pixels(spark, sf_dir).select("image_id").distinct().select("image_id", levels).withColumn("sigma", F.round(F.col("level") * 2, 6))


@query("""WITH b AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey), c AS (SELECT o.o_orderkey AS plan, o.o_custkey AS subject, o.o_totalprice <= r.o_totalprice AND isfinite(o.o_totalprice) AS eligible, o.o_orderpriority[1] = '1' AS exact, CASE WHEN o.o_orderkey % 7 > 0 THEN o.o_totalprice END AS score FROM orders o JOIN b ON b.o_custkey = o.o_custkey JOIN orders r ON r.o_orderkey = b.o_orderkey)
SELECT plan, subject, eligible, CAST(row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN NOT eligible THEN 0 WHEN exact THEN 3 WHEN score IS NULL THEN 1 ELSE 2 END DESC, CASE WHEN eligible AND NOT exact THEN score END DESC NULLS LAST, plan) AS INTEGER) AS place FROM c""")
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates against their subject's baseline: eligible if finite and no larger; exact ones first, ineligible ones last."""
    o = rel.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan"), F.col("o_custkey").alias("subject"), F.col("o_totalprice").alias("size"), F.startswith("o_orderpriority", F.lit("1")).alias("exact"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice")).alias("score"))
    first = o.groupBy("subject").agg(F.min_by("size", "plan").alias("baseline"))
    c = o.join(first, "subject").withColumn("eligible", gates.finite(F.col("size")) & (F.col("size") <= F.col("baseline")))
    c = c.withColumn("key", gates.sort_key(F.col("score"), F.col("exact"), F.col("eligible")))
    return c.select("plan", "subject", "eligible", F.row_number().over(W.partitionBy("subject").orderBy(F.col("key").desc(), "plan")).alias("place"))
