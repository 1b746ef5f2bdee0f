"""Queries over assessments, candidates, ledgers and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from portrel.functions import geometry as g
from portrel.functions import gates
from portrel.functions import validate
from portrel.operators import ledger, quality, strips
from portrel.plans.registry import query, r6
from portrel.sources import relations as rel

_RULES = "rules(mode, min_symmetry, min_sharpness, min_head, max_head, min_ipd, max_ipd) AS (VALUES ('input', 0.40, 0.15, 25, 85, 60, 200), ('output', 0.60, 0.25, 35, 80, 90, 120))"


def _moded(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = rel.assessments(spark, sf_dir)
    return a.withColumn("standard", F.when(F.col("id") % 3 == 0, "piv").otherwise("unknown")).withColumn("mode", F.when(F.col("id") % 2 == 0, "input").otherwise("output"))


@query(f"WITH {_RULES} SELECT a.id, r.mode, (r.mode = 'input' OR symmetry >= min_symmetry) AND sharpness >= min_sharpness AND head BETWEEN min_head AND max_head AND (r.mode = 'input' OR ipd BETWEEN min_ipd AND max_ipd) AS compliant, concat_ws(',', CASE WHEN r.mode <> 'input' AND symmetry < min_symmetry THEN 'symmetry' END, CASE WHEN sharpness < min_sharpness THEN 'sharpness' END, CASE WHEN head < min_head THEN 'head_low' WHEN head > max_head THEN 'head_high' END, CASE WHEN r.mode <> 'input' AND ipd < min_ipd THEN 'ipd_low' WHEN r.mode <> 'input' AND ipd > max_ipd THEN 'ipd_high' END) AS failed FROM assessments a JOIN rules r ON r.mode = CASE WHEN a.id % 2 = 0 THEN 'input' ELSE 'output' END")
def rules_join_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = quality.gated(_moded(spark, sf_dir), quality.rules(spark))
    return gated.select("id", "mode", "compliant", F.array_join("failed", ",").alias("failed"))


_LEVEL = "SELECT id, '{m}' AS metric, CASE WHEN {m} < {c} THEN 'Critical' ELSE 'Major' END AS severity FROM assessments WHERE {m} < {j}"


@query(" UNION ALL ".join(_LEVEL.format(m=m, c=c, j=j) for m, c, j in (("symmetry", 0.3, 0.6), ("sharpness", 0.2, 0.5), ("geometry", 0.4, 0.7))))
def violations_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.violations(rel.assessments(spark, sf_dir))


@query("SELECT id, round(0.3e0 * symmetry + 0.3e0 * sharpness + 0.4e0 * geometry, 6) + 0.0 AS overall FROM assessments")
def overall_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.assessments(spark, sf_dir).select("id", r6(quality.overall(F.col("symmetry"), F.col("sharpness"), F.col("geometry"))).alias("overall"))


@query("WITH o AS (SELECT id, sharpness, round(0.3e0 * symmetry + 0.3e0 * sharpness + 0.4e0 * geometry, 9) AS overall FROM assessments) SELECT id, CASE WHEN id % 2 = 0 AND sharpness < 0.2 THEN 'not_compliant' WHEN overall < 0.5 THEN 'below_threshold' ELSE 'accepted' END AS verdict FROM o")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.round(quality.overall(F.col("symmetry"), F.col("sharpness"), F.col("geometry")), 9)
    verdict = F.when((F.col("id") % 2 == 0) & (F.col("sharpness") < 0.2), "not_compliant").when(total < 0.5, "below_threshold").otherwise("accepted")
    return rel.assessments(spark, sf_dir).select("id", verdict.alias("verdict"))


@query("SELECT id, round(1 / (1 + exp(8 * (symmetry - 0.2e0))), 6) + 0.0 AS symmetry_quality, round(1 / (1 + exp(-(sharpness / 100 - 0.0008e0) * 2500)), 6) + 0.0 AS variance_score, round(least(geometry / 100 * 294, 1), 6) + 0.0 AS sharpness_score FROM assessments")
def sigmoid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.assessments(spark, sf_dir).select("id", r6(g.falling_sigmoid(F.col("symmetry"))).alias("symmetry_quality"), r6(g.variance_sigmoid(F.col("sharpness") / 100)).alias("variance_score"), r6(g.sharpness_scale(F.col("geometry") / 100)).alias("sharpness_score"))


@query("SELECT id, head BETWEEN 35 AND 80 AS inside, round(CASE WHEN head < 35 THEN (35 - head) / 35 WHEN head > 80 THEN (head - 80) / 80 ELSE 0 END, 6) + 0.0 AS deviation, least(greatest(ipd, 90), 120) AS clamped FROM assessments")
def range_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.assessments(spark, sf_dir).select("id", F.col("head").between(35, 80).alias("inside"), r6(g.deviation(F.col("head"), F.lit(35.0), F.lit(80.0))).alias("deviation"), g.clamp(F.col("ipd"), 90.0, 120.0).alias("clamped"))


@query("SELECT id, CASE WHEN symmetry < 0.1 THEN 'symmetry' WHEN sharpness < 0.1 THEN 'sharpness' WHEN geometry < 0.1 THEN 'geometry' END AS code, CASE WHEN least(symmetry, sharpness, geometry) >= 0.1 THEN round((symmetry + sharpness + geometry) / 3, 6) + 0.0 END AS value FROM assessments")
def error_first_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = rel.assessments(spark, sf_dir)
    e = validate.first_error(*[(F.col(c) < 0.1, validate.error(c, "too low")) for c in ("symmetry", "sharpness", "geometry")])
    rows = a.withColumn("error", e)
    return rows.select("id", F.col("error.code").alias("code"), F.when(F.col("error").isNull(), r6((F.col("symmetry") + F.col("sharpness") + F.col("geometry")) / 3)).alias("value"))


_LADDER = "ladder(ord, ratio) AS (VALUES (0, 0.57e0), (1, 0.55e0), (2, 0.52e0), (3, 0.5e0))"


@query(f"WITH {_LADDER}, c AS (SELECT o_orderkey AS id, ord, (o_totalprice * ratio) % 7 < 2 AS ok, 'ratio ' || CAST(ord AS VARCHAR) || ' fails' AS reason FROM orders, ladder), f AS (SELECT id, min(ord) FILTER (WHERE ok) AS chosen FROM c GROUP BY id) SELECT f.id, f.chosen, coalesce(string_agg(c.reason, '; ' ORDER BY c.ord) FILTER (WHERE f.chosen IS NULL OR c.ord < f.chosen), '') AS trace FROM f JOIN c ON c.id = f.id GROUP BY f.id, f.chosen")
def first_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(r).alias("ratio")) for i, r in enumerate((0.57, 0.55, 0.52, 0.5))])
    c = rel.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", F.explode(steps).alias("s"))
    c = c.select("id", F.col("s.ord").alias("ord"), ((F.col("o_totalprice") * F.col("s.ratio")) % 7 < 2).alias("ok"), F.concat(F.lit("ratio "), F.col("s.ord").cast("string"), F.lit(" fails")).alias("reason"))
    return quality.first_feasible(c, "id", "ord", "ok", "reason")


@query("SELECT output_id, CAST(sum(payload) AS BIGINT) AS payload, CAST(sum(face) AS BIGINT) AS face, CAST(sum(shared) AS BIGINT) AS shared, CAST(sum(outside) AS BIGINT) AS outside, sum(payload) = sum(face) + sum(shared) + sum(outside) AS closes FROM subbands GROUP BY output_id")
def ledger_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.closure(rel.subbands(spark, sf_dir), ["output_id"], "payload", ["face", "shared", "outside"])


_SUMMED = "s AS (SELECT output_id, tile, component, resolution, subband, CAST(sum(payload) AS BIGINT) AS payload FROM subbands GROUP BY ALL), a AS (SELECT * FROM s WHERE payload % 13 <> 0), b AS (SELECT output_id, tile, component, resolution, subband, CASE WHEN payload % 11 = 0 THEN payload + 1 ELSE payload END AS payload FROM s WHERE payload % 17 <> 0)"


@query(f"WITH {_SUMMED} SELECT output_id, tile, component, resolution, subband, a.payload AS left_value, b.payload AS right_value, CASE WHEN b.payload IS NULL THEN 'left only' WHEN a.payload IS NULL THEN 'right only' ELSE 'differs' END AS kind FROM a FULL JOIN b USING (output_id, tile, component, resolution, subband) WHERE a.payload IS DISTINCT FROM b.payload")
def ledger_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["output_id", *ledger.KEY]
    s = rel.subbands(spark, sf_dir).groupBy(*keys).agg(F.sum("payload").alias("payload"))
    a = s.where("payload % 13 <> 0")
    b = s.where("payload % 17 <> 0").withColumn("payload", F.when(F.col("payload") % 11 == 0, F.col("payload") + 1).otherwise(F.col("payload")))
    return ledger.mismatches(a, b, keys, "payload")


@query("WITH s AS (SELECT output_id, count(*) * 4000 AS area, CAST(sum(face) AS BIGINT) AS face FROM subbands GROUP BY output_id) SELECT output_id, area, face, 3 * area AS raw, CAST(ceil(3 * area / 24.0) AS BIGINT) AS allowed, CASE WHEN face <= 0 THEN 'unavailable' WHEN face >= ceil(3 * area / 24.0) THEN 'satisfied' ELSE 'over compressed' END AS status FROM s")
def regional_24to1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.subbands(spark, sf_dir).groupBy("output_id").agg((F.count(F.lit(1)) * 4000).alias("area"), F.sum("face").alias("face"))
    return ledger.regional_ratio(s, "area", "face")


@query("SELECT tile, component, resolution, subband, count(*) AS blocks, CAST(sum(payload) AS BIGINT) AS payload, CAST(sum(least(face, payload)) AS BIGINT) AS face, CAST(sum(CASE WHEN outside = 0 THEN payload ELSE 0 END) AS BIGINT) AS inside_only FROM subbands GROUP BY ALL")
def payload_by_subband(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.subbands(spark, sf_dir)
    return s.groupBy(*ledger.KEY).agg(F.count(F.lit(1)).alias("blocks"), F.sum("payload").alias("payload"), F.sum(F.least("face", "payload")).alias("face"), F.sum(F.when(F.col("outside") == 0, F.col("payload")).otherwise(0)).alias("inside_only"))


@query("SELECT output_id, tile, component, resolution, subband, count(*) AS times FROM subbands WHERE payload >= 0 GROUP BY ALL HAVING count(*) > 1 OR bool_or(outside < 0)")
def payload_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.subbands(spark, sf_dir).where("payload >= 0")
    d = s.groupBy("output_id", *ledger.KEY).agg(F.count(F.lit(1)).alias("times"), F.bool_or(F.col("outside") < 0).alias("bad"))
    return d.where((F.col("times") > 1) | F.col("bad")).drop("bad")


_DIPPED = "dipped AS (SELECT block_id, pass_no, rate - CASE WHEN pass_no % 3 = 0 THEN 40 ELSE 0 END AS rate, dist FROM rd), kept AS (SELECT * FROM (SELECT *, min(rate) OVER (PARTITION BY block_id ORDER BY pass_no DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM dipped) WHERE least IS NULL OR rate < least), steps AS (SELECT block_id, pass_no, rate, dist, rate - coalesce(lag(rate) OVER w, 0) AS bytes, dist - coalesce(lag(dist) OVER w, 0) AS gain FROM kept WINDOW w AS (PARTITION BY block_id ORDER BY pass_no))"


def _dipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.rd(spark, sf_dir).withColumn("rate", F.col("rate") - F.when(F.col("pass_no") % 3 == 0, 40).otherwise(0))


@query(f"WITH {_DIPPED} SELECT block_id, pass_no, rate, dist, bytes, gain FROM steps")
def prefix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.prefix_intervals(_dipped(spark, sf_dir))


@query(f"WITH {_DIPPED} SELECT block_id, round(sum(CASE WHEN gain > 0 THEN bytes * least(1, (gain // 3) / CAST(gain AS DOUBLE)) ELSE 0 END), 6) + 0.0 AS credit FROM steps GROUP BY block_id")
def interval_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = ledger.prefix_intervals(_dipped(spark, sf_dir))
    share = F.least(F.lit(1.0), F.try_divide(F.floor(F.col("gain") / 3), F.col("gain")))
    return steps.groupBy("block_id").agg(r6(F.sum(F.when(F.col("gain") > 0, F.col("bytes") * share).otherwise(0.0))).alias("credit"))


@query("SELECT l_orderkey AS block_id, k AS pass_no, round(sum(greatest(l_tax - 0.02e0, 0)) OVER w, 6) + 0.0 AS gain FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def pass_running_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    return rel.lines(spark, sf_dir).select(F.col("l_orderkey").alias("block_id"), F.col("k").alias("pass_no"), r6(F.sum(F.greatest(F.col("l_tax") - 0.02, F.lit(0.0))).over(w)).alias("gain"))


@query("WITH p AS (SELECT block_id, rate, dist, pass_no FROM rd UNION ALL SELECT DISTINCT block_id, 0, 0, 0 FROM rd) SELECT b.block_id, b.pass_no, b.rate, b.dist FROM rd b WHERE NOT EXISTS (SELECT 1 FROM p a JOIN p c ON a.block_id = c.block_id WHERE a.block_id = b.block_id AND a.rate < b.rate AND c.rate > b.rate AND (b.dist - a.dist) * (c.rate - a.rate) <= (c.dist - a.dist) * (b.rate - a.rate)) AND NOT EXISTS (SELECT 1 FROM p a WHERE a.block_id = b.block_id AND a.rate = b.rate AND a.dist > b.dist)")
def rd_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.hull(rel.rd(spark, sf_dir))


@query("WITH g AS (SELECT l AS \"lambda\", block_id, rate, dist, dist - l * rate AS worth FROM rd, (VALUES (5e0), (10e0), (14e0), (20e0)) t(l)), b AS (SELECT *, row_number() OVER (PARTITION BY \"lambda\", block_id ORDER BY worth DESC, rate) AS k FROM g WHERE worth > 0) SELECT \"lambda\", CAST(sum(rate) AS BIGINT) AS rate, CAST(sum(dist) AS BIGINT) AS dist, count(*) AS blocks FROM b WHERE k = 1 GROUP BY \"lambda\"")
def lambda_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.best_at(rel.rd(spark, sf_dir), [5.0, 10.0, 14.0, 20.0])


def _bisection_sql(rounds: int = 6) -> str:
    """The same search spelled out: in each round sixteen trade-offs between the bounds, all blocks at their best point for each."""
    best = lambda t: f"(SELECT {t} AS t, block_id, arg_max(struct_pack(rate := rate, dist := dist), (dist - {t} * rate, -rate)) AS b FROM {{0}} CROSS JOIN rd WHERE dist - {t} * rate > 0 GROUP BY {t}, block_id)"
    parts = ["bud AS (SELECT sum(m) // 2 AS budget FROM (SELECT max(rate) AS m FROM rd GROUP BY block_id))", "r0 AS MATERIALIZED (SELECT 0e0 AS low, max(dist / greatest(rate, 1)) + 1e0 AS high FROM rd)"]
    for k in range(rounds):
        parts.append(f"g{k} AS MATERIALIZED (SELECT low + (high - low) * i / 16 AS t FROM r{k}, range(1, 17) a(i))")
        parts.append(f"s{k} AS MATERIALIZED (SELECT g{k}.t, coalesce(sum(b.rate), 0) AS rate FROM g{k} LEFT JOIN {best('t').format(f'g{k}')} c ON c.t = g{k}.t GROUP BY g{k}.t)")
        parts.append(f"f{k} AS MATERIALIZED (SELECT coalesce(min(t) FILTER (WHERE rate <= budget), (SELECT high FROM r{k})) AS fit FROM s{k}, bud)")
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT greatest(low, coalesce((SELECT max(t) FROM s{k} WHERE t < fit), low)) AS low, fit AS high FROM r{k}, f{k})")
    return "WITH " + ", ".join(parts) + f" SELECT round(t, 6) + 0.0 AS \"lambda\", CAST(sum(b.rate) AS BIGINT) AS rate, CAST(sum(b.dist) AS BIGINT) AS dist, count(*) AS blocks FROM {best('high').format(f'r{rounds}')} GROUP BY t"


@query(_bisection_sql())
def budget_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection of the least trade-off whose bytes fit half of all blocks' bytes."""
    blocks = strips.kept(ledger.by_block(rel.rd(spark, sf_dir)))  # six searches read it
    budget = blocks.agg(F.sum(F.array_max(F.transform("points", lambda p: p["rate"])))).head()[0] // 2
    return ledger.allocate_blocks(blocks, budget)[1].withColumn("lambda", r6("lambda"))


@query("WITH l AS (SELECT user_id, ts, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) FILTER (WHERE value < before) AS falls, coalesce(max(value < before), FALSE) AS violated FROM l GROUP BY user_id")
def monotone_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    fell = F.col("value") < F.lag("value").over(w)
    e = rel.table(spark, sf_dir, "events").withColumn("fell", F.coalesce(fell, F.lit(False)))
    return e.groupBy("user_id").agg(F.count_if("fell").alias("falls"), F.bool_or("fell").alias("violated"))


@query("WITH r AS (SELECT l_orderkey AS block_id, k AS tag, l_partkey % 500 AS start, l_partkey % 500 + l_suppkey % 60 AS stop FROM lines), o AS (SELECT *, lag(stop) OVER (PARTITION BY block_id ORDER BY start, tag) AS before FROM r) SELECT block_id, tag, start, before AS previous_stop FROM o WHERE start < before")
def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_partkey") % 500
    r = rel.lines(spark, sf_dir).select(F.col("l_orderkey").alias("block_id"), F.col("k").alias("tag"), start.alias("start"), (start + F.col("l_suppkey") % 60).alias("stop"))
    o = r.withColumn("previous_stop", F.lag("stop").over(W.partitionBy("block_id").orderBy("start", "tag")))
    return o.where("start < previous_stop").select("block_id", "tag", "start", "previous_stop")


@query("SELECT p_partkey AS id, least(p_size * 400, 12704 - 4) - 46 - 88 - 750 AS budget, p_size * 400 <= 12704 AS fits, CASE WHEN p_size * 400 < 128 THEN 6 WHEN p_size * 400 < 65536 THEN 7 ELSE 8 END AS tag_bytes, round(p_size * 400 * 8 / (480.0e0 * 640), 6) + 0.0 AS bpp FROM part")
def card_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") * 400
    tag = F.when(size < 128, 6).when(size < 65536, 7).otherwise(8)
    return rel.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.least(size, F.lit(12704 - 4)) - 46 - 88 - 750).alias("budget"), (size <= 12704).alias("fits"), tag.alias("tag_bytes"), r6(g.bits_per_pixel(size, F.lit(480.0), F.lit(640))).alias("bpp"))


@query("SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k'), '0') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.absent'), '0') AS absent FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")).cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.absent"), F.lit("0")).alias("absent"))


@query("WITH o AS (SELECT id, symmetry, round(0.3e0 * symmetry + 0.3e0 * sharpness + 0.4e0 * geometry, 9) AS overall FROM assessments WHERE id % 10 <> 0) SELECT count(*) AS images, round(avg(overall), 6) + 0.0 AS mean_overall, count(*) FILTER (WHERE overall >= 0.6) AS compliant, round(100.0e0 * count(*) FILTER (WHERE overall >= 0.6) / count(*), 6) + 0.0 AS percent FROM o")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = rel.assessments(spark, sf_dir).where("id % 10 <> 0").withColumn("overall", F.round(quality.overall(F.col("symmetry"), F.col("sharpness"), F.col("geometry")), 9))
    good = F.count_if(F.col("overall") >= 0.6)
    return o.agg(F.count(F.lit(1)).alias("images"), r6(F.avg("overall")).alias("mean_overall"), good.alias("compliant"), r6(100.0 * good / F.count(F.lit(1))).alias("percent"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE agrees) AS agree, count(*) FILTER (WHERE NOT agrees) AS disagree, count(override) AS overrides, round(count(*) FILTER (WHERE agrees) / CAST(count(*) AS DOUBLE), 6) + 0.0 AS agreement FROM reviews")
def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return rel.reviews(spark, sf_dir).agg(n.alias("total"), F.count_if("agrees").alias("agree"), F.count_if(~F.col("agrees")).alias("disagree"), F.count("override").alias("overrides"), r6(F.count_if("agrees") / n).alias("agreement"))


@query("SELECT reviewer, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS place FROM reviews GROUP BY reviewer")
def reviewer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rel.reviews(spark, sf_dir).groupBy("reviewer").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.rank().over(W.orderBy(F.col("n").desc())))


@query("SELECT DISTINCT reviewer, override FROM reviews WHERE NOT agrees")
def distinct_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.reviews(spark, sf_dir).where(~F.col("agrees")).select("reviewer", "override").distinct()


@query("WITH e AS (SELECT o_orderkey AS image_id, 1 + o_custkey % 4 AS expected FROM orders), f AS (SELECT l_orderkey AS image_id, count(*) AS found FROM lineitem GROUP BY l_orderkey) SELECT e.image_id, e.expected, CAST(coalesce(f.found, 0) AS BIGINT) AS found FROM e LEFT JOIN f ON f.image_id = e.image_id WHERE coalesce(f.found, 0) <> e.expected")
def corpus_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), (1 + F.col("o_custkey") % 4).alias("expected"))
    f = rel.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.count(F.lit(1)).alias("found"))
    both = e.join(f, "image_id", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    return both.where("found <> expected")


@query("SELECT o_orderkey AS id, concat_ws(',', o_orderstatus, CASE WHEN o_orderpriority <> o_orderstatus THEN o_orderpriority END, CASE WHEN o_custkey % 2 = 0 THEN 'even' END) AS requirements FROM orders")
def requirements_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = rel.table(spark, sf_dir, "orders")
    parts = gates.requirement_union(F.array("o_orderstatus"), F.array("o_orderpriority", "o_orderstatus"), F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("even"))))
    return o.select(F.col("o_orderkey").alias("id"), F.array_join(parts, ",").alias("requirements"))


@query("SELECT image, level, CAST(rank AS INTEGER) AS rank, rose FROM (SELECT o_custkey AS image, o_orderkey AS level, row_number() OVER w AS rank, coalesce(o_totalprice > lag(o_totalprice) OVER w, FALSE) AS rose FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))")
def blur_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = rel.table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("image"), F.col("o_orderkey").alias("level"), F.row_number().over(w).alias("rank"), F.coalesce(F.col("o_totalprice") > F.lag("o_totalprice").over(w), F.lit(False)).alias("rose"))


@query("SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice, p_partkey) AS INTEGER) AS place FROM part WHERE p_size >= 10")
def lexicographic_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("p_brand").orderBy(F.col("p_size").desc(), "p_retailprice", "p_partkey")
    return rel.table(spark, sf_dir, "part").where("p_size >= 10").select("p_brand", "p_partkey", F.row_number().over(w).alias("place"))


@query("SELECT l_suppkey AS plan, CAST(sum(CASE WHEN d >= 0 THEN d ELSE 0 END) AS BIGINT) AS received, CAST(sum(CASE WHEN d < 0 THEN -d ELSE 0 END) AS BIGINT) AS given, CAST(sum(d) AS BIGINT) AS net FROM (SELECT l_suppkey, l_partkey % 101 - 50 AS d FROM lineitem) GROUP BY l_suppkey")
def change_cost_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rel.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("plan"), (F.col("l_partkey") % 101 - 50).alias("d"))
    return d.groupBy("plan").agg(F.sum(F.greatest("d", F.lit(0))).alias("received"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("given"), F.sum("d").alias("net"))


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') SELECT 'receiver only' AS side, count(*) AS n FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'donor only', count(*) FROM b WHERE k NOT IN (SELECT k FROM a)")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = rel.table(spark, sf_dir, "lineitem")
    keys = li.where(F.col("l_returnflag").isin("R", "A")).groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "A").alias("a"))
    n = keys.agg(F.count_if(F.col("r") & ~F.col("a")).alias("x"), F.count_if(F.col("a") & ~F.col("r")).alias("y"))
    return n.select(F.explode(F.array(F.struct(F.lit("receiver only").alias("side"), F.col("x").alias("n")), F.struct(F.lit("donor only").alias("side"), F.col("y").alias("n")))).alias("s")).select("s.side", "s.n")


@query("SELECT doc_id, sha256(text) AS digest, length(text) AS n, upper(source) || '/' || lang AS label FROM documents")
def checked_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rel.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n"), F.concat(F.upper("source"), F.lit("/"), "lang").alias("label"))


@query("SELECT l_orderkey AS image, CAST(round_even(l_discount * 480, 0) AS INTEGER) AS x, CAST(round_even(l_tax * 640, 0) AS INTEGER) AS y, l_linenumber AS crop FROM lineitem")
def crop_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.bround(F.col("l_discount") * 480, 0).cast("int").alias("x"), F.bround(F.col("l_tax") * 640, 0).cast("int").alias("y"), F.col("l_linenumber").alias("crop"))


_GUARDS_SQL = """WITH known AS (SELECT block_id, max(pass_no) AS last, list(pass_no) FILTER (WHERE rate % 3 > 0) AS legal, max(pass_no) FILTER (WHERE rate % 3 > 0) AS terminal FROM rd GROUP BY block_id),
c AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END AS block_id, CAST(o_custkey % 7 - 1 AS INTEGER) AS endpoint FROM orders),
t AS (SELECT c.*, terminal, CASE WHEN last IS NULL THEN 'Unknown frozen coding block' WHEN NOT (endpoint = -1 OR coalesce(list_contains(legal, endpoint), FALSE)) THEN 'Select a frozen legal native pass' WHEN endpoint > last THEN 'Native pass exceeds its frozen table' END AS error FROM c LEFT JOIN known k ON k.block_id = c.block_id)
SELECT block_id, endpoint, error FROM t WHERE error IS NOT NULL OR endpoint <> coalesce(terminal, -1)"""


@query(_GUARDS_SQL)
def change_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of blocks' last passes that can be replayed, or what is wrong with them; those that change nothing are left out."""
    points = rel.rd(spark, sf_dir)
    key = F.col("o_orderkey")
    changes = rel.table(spark, sf_dir, "orders").select(F.when(key % 11 == 0, -key).otherwise(key).alias("block_id"), (F.col("o_custkey") % 7 - 1).cast("int").alias("endpoint"))
    return ledger.checked_changes(points, points.where("rate % 3 > 0"), changes)


_EMISSION_SQL = """WITH s AS (SELECT output_id, CAST(sum(resolution + 5) AS BIGINT) AS header, CAST(sum(payload) AS BIGINT) AS body, CAST(sum(face) AS BIGINT) AS protected FROM subbands GROUP BY output_id),
e AS (SELECT o_orderkey AS output_id, coalesce(header + body, 0) AS bytes, o_orderkey % 13 = 0 OR (o_custkey % 17 = 0 AND coalesce(protected, 0) <> 1) OR 100 + coalesce(header + body, 0) > 20000 OR o_orderkey % 19 = 0 AS bad FROM orders LEFT JOIN s ON output_id = o_orderkey)
SELECT output_id, bytes, CASE WHEN bad THEN 'Final codestream emission does not satisfy its measured byte constraints.' END AS error FROM e"""


@query(_EMISSION_SQL)
def emission_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written packets against the simulation: some with a byte too many, another protected part, over the cap, or a length that is off."""
    bands = rel.subbands(spark, sf_dir)
    packets = bands.select("output_id", (F.col("resolution") + 5).alias("header"), F.col("payload").alias("body"), F.col("face").alias("protected"), F.col("shared").alias("promoted"), F.col("outside").alias("unprotected"))
    simulated = packets.groupBy("output_id").agg(F.sum(F.col("header") + F.col("body")).alias("whole"), F.sum("protected").alias("part"))
    key = F.col("o_orderkey")
    whole, part = F.coalesce("whole", F.lit(0)), F.coalesce("part", F.lit(0))
    expected = rel.table(spark, sf_dir, "orders").join(simulated, key == F.col("output_id"), "left").select(
        key.alias("output_id"), (whole + F.when(key % 13 == 0, 1).otherwise(0)).alias("packet_bytes"), F.when(F.col("o_custkey") % 17 == 0, F.lit(1)).otherwise(part).alias("protected_bytes"),
        F.lit(100).alias("head_bytes"), F.lit(20_000).alias("cap"), (100 + whole - 2 + F.when(key % 13 == 0, 1).otherwise(0) + F.when(key % 19 == 0, 3).otherwise(0)).alias("written"),
    )
    return ledger.emission_errors(packets, expected)
