"""Queries of options, parsing, enrichment and small derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portrel.functions import options, text
from portrel.plans.registry import query, r6
from portrel.sources import relations as rel


@query("""WITH o AS (SELECT event_id AS id, CAST(event_id % 131 AS DOUBLE) / 100 - 0.1e0 AS threshold, CAST(event_id % 227 AS DOUBLE) - 20 AS rotation FROM events)
SELECT id, CASE WHEN threshold < 0 OR threshold > 1 THEN 'threshold' WHEN rotation < 0 OR rotation > 180 THEN 'rotation' END AS code FROM o""")
def option_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("event_id")
    o = rel.table(spark, sf_dir, "events").select(c.alias("id"), ((c % 131) / 100 - 0.1).alias("threshold"), ((c % 227) - 20).cast("double").alias("rotation"))
    return o.select("id", options.invalid_options(F.col("threshold"), F.col("rotation"))["code"].alias("code"))


@query("""WITH p(preset, enforce, threshold) AS (VALUES ('strict', true, 0.85e0), ('lenient', false, 0.6e0), ('default', false, 0.7e0))
SELECT id, preset, geometry >= threshold OR NOT enforce AS passes, threshold FROM assessments JOIN p ON preset = CASE id % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'lenient' ELSE 'default' END""")
def option_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets as rows, joined by name; what is asked for otherwise is the default."""
    name = F.element_at(F.array(*map(F.lit, ("strict", "lenient", "default"))), (F.col("id") % 3 + 1).cast("int"))
    a = rel.assessments(spark, sf_dir).withColumn("preset", name)
    found = a.join(F.broadcast(options.presets(spark)), "preset")  # three rows
    return found.select("id", "preset", ((F.col("geometry") >= F.col("threshold")) | ~F.col("enforce")).alias("passes"), "threshold")


@query("""WITH o AS (SELECT event_id AS id, CAST(event_id % 301 AS DOUBLE) - 20 AS gradient, CAST(event_id * 37 % 70001 AS DOUBLE) AS variance, CAST(event_id % 17 AS BIGINT) - 1 AS pixels, CAST(event_id % 13 AS DOUBLE) / 10 AS fraction FROM events)
SELECT id, gradient BETWEEN 0 AND 255 AND variance BETWEEN 0 AND 65025 AND pixels > 0 AND fraction BETWEEN 0 AND 1 AS valid FROM o""")
def backdrop_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("event_id")
    o = rel.table(spark, sf_dir, "events").select(c.alias("id"), (c % 301 - 20).cast("double").alias("gradient"), (c * 37 % 70001).cast("double").alias("variance"), (c % 17 - 1).alias("pixels"), ((c % 13) / 10).alias("fraction"))
    return o.select("id", options.backdrop_valid(F.col("gradient"), F.col("variance"), F.lit(10.0), F.lit(5.0), F.col("pixels"), F.col("fraction"), F.lit(16_777_216)).alias("valid"))


@query("SELECT p_partkey AS id, list_contains(string_split(p_name, ' '), 'json') OR p_size % 5 = 0 AS structured, CASE WHEN p_size % 4 = 0 THEN 'minimum' WHEN p_size % 4 = 1 THEN 'preferred' END AS target FROM part")
def argument_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether arguments ask for structured output, and the size target that they name."""
    size = F.col("p_size")
    words = F.split("p_name", " ")
    more = F.array_compact(F.array(F.when(size % 5 == 0, F.lit("--JSON")), F.when(size % 4 == 0, F.lit("--target=Minimum")).when(size % 4 == 1, F.lit("--target=preferred")).when(size % 4 == 2, F.lit("--target=other"))))
    arguments = F.concat(F.transform(words, lambda w: F.when(w == "json", F.lit("--json")).otherwise(w)), more)
    return rel.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), options.has_flag(arguments, "--json").alias("structured"), options.named_value(arguments, "--target", ("minimum", "preferred")).alias("target"))


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract_string(props, '$.missing') AS BIGINT), 1) AS expected FROM events")
def json_parse_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON objects by name in any case, with a default."""
    e = rel.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.json_fields(F.upper("props")).alias("f"))
    return e.select("id", text.field("f", "K").cast("long").alias("k"), F.coalesce(text.field("f", "Missing").cast("long"), F.lit(1).cast("long")).alias("expected"))


@query("""SELECT s_suppkey AS id, '{"Id":' || s_suppkey || ',"Status":"' || CASE s_suppkey % 3 WHEN 0 THEN 'Accepted' WHEN 1 THEN 'ReviewRequired' ELSE 'Failed' END || '","Nation":' || s_nationkey || '}' AS body FROM supplier""")
def json_serialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON objects, enumerations by name."""
    s = rel.table(spark, sf_dir, "supplier")
    status = text.enum_name(F.col("s_suppkey") % 3, ("Accepted", "ReviewRequired", "Failed"))
    return s.select(F.col("s_suppkey").alias("id"), F.to_json(F.struct(F.col("s_suppkey").alias("Id"), status.alias("Status"), F.col("s_nationkey").alias("Nation"))).alias("body"))


@query("""WITH t AS (SELECT s_suppkey AS id, (s_suppkey % 10) / 10.0e0 AS a, (s_suppkey % 7) / 10.0e0 AS b, (s_suppkey % 4) / 10.0e0 AS c FROM supplier), v AS (SELECT id, unnest([a, b, c]) AS x FROM t)
SELECT id, array_to_string(list_transform(list_sort(list(DISTINCT x)), lambda y: printf('%.1f', y)), ';') AS levels FROM v WHERE x <= 0.8 GROUP BY id""")
def level_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from a comma-separated text, ascending, each once; what is no number, or over the most, is left out."""
    part = lambda k: F.format_string("%.1f", (F.col("s_suppkey") % k) / 10)
    s = rel.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat_ws(" , ", part(10), F.lit("x"), part(7), part(4)).alias("text"))
    levels = text.numbers(F.col("text"), 0.0, 0.8)
    return s.select("id", F.array_join(F.transform(levels, lambda v: F.format_string("%.1f", v)), ";").alias("levels"))


@query("SELECT s_suppkey AS id, regexp_full_match(lower(md5(CAST(s_suppkey AS VARCHAR)))[1:8], '[0-9a-f]{8}') AS well_formed, 8 AS length FROM supplier")
def short_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random short identifiers: eight hexadecimal digits."""
    s = rel.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), text.short_id().alias("short"))
    return s.select("id", F.col("short").rlike("^[0-9a-f]{8}$").alias("well_formed"), F.length("short").alias("length"))


@query("SELECT image_id, count(DISTINCT label) AS regions, round(avg(r) FILTER (label = 'A'), 6) + 0.0 AS a, coalesce(round(avg(r) FILTER (label = 'Z'), 6), -1) + 0.0 AS z FROM pixels GROUP BY image_id")
def region_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by region as one map for each image; a region that isn't there has a default."""
    means = rel.pixels(spark, sf_dir).groupBy("image_id", "label").agg(F.avg("r").alias("m"))
    maps = means.groupBy("image_id").agg(text.region_map("label", "m").alias("by"))
    return maps.select("image_id", F.size("by").cast("long").alias("regions"), r6(F.try_element_at("by", F.lit("A"))).alias("a"), r6(F.coalesce(F.try_element_at("by", F.lit("Z")), F.lit(-1.0))).alias("z"))


@query("SELECT user_id, event_id AS id, CAST(coalesce(date_diff('microsecond', lag(ts) OVER w, ts), 0) AS BIGINT) AS elapsed, ts > TIMESTAMP '2000-01-01' AS past FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def elapsed_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microseconds since the step before, and whether a time has passed."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = rel.table(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_id").alias("id"), text.elapsed(F.lag("ts").over(w), F.col("ts")).alias("elapsed"), (F.col("ts") > F.to_timestamp(F.lit("2000-01-01"))).alias("past"))


@query("""WITH d AS (SELECT p_partkey AS ref, p_name AS name FROM part WHERE p_partkey % 10 <> 0), u AS (SELECT l_orderkey AS component, l_partkey AS ref FROM lineitem)
SELECT component, count(*) AS n, count(d.ref) AS resolved, count(*) - count(d.ref) AS dangling FROM u LEFT JOIN d ON d.ref = u.ref GROUP BY component""")
def dependency_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of components looked up in a dictionary; those that it lacks dangle."""
    known = rel.table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("name"))
    used = rel.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("component"), F.col("l_partkey").alias("ref"))
    return text.enriched(used, known, "ref", "name").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("resolved"), F.count_if(F.col("name").isNull()).alias("dangling"))


@query("""WITH f AS (SELECT doc_id, lower(source || '_' || (doc_id % 40)) AS base FROM documents), r AS (SELECT conv_id, lower((CASE conv_id % 2 WHEN 0 THEN 'web' ELSE 'books' END) || '_' || (conv_id % 40)) AS base FROM conversations GROUP BY conv_id)
SELECT doc_id AS id, count(r.conv_id) AS results FROM f LEFT JOIN r ON r.base = f.base GROUP BY doc_id""")
def basename_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the results of the same base name, whatever the folders, extensions and case."""
    files = rel.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/in/A.b/"), F.upper("source"), F.lit("_"), F.col("doc_id") % 40, F.lit(".JPG")).alias("path"))
    name = F.when(F.col("conv_id") % 2 == 0, "web").otherwise("books")
    results = rel.table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.concat(F.lit("out/"), name, F.lit("_"), F.col("conv_id") % 40, F.lit(".json")).alias("result_path"))
    return text.matched_by_name(files, "path", results, "result_path").groupBy("id").agg(F.count("conv_id").alias("results"))


@query("SELECT image_id, i, round(CASE WHEN r + g + b > 0 THEN r / CAST(r + g + b AS DOUBLE) ELSE 0 END, 6) + 0.0 AS high_ratio, CAST(r + g + b AS BIGINT) AS total, round((r / 255e0 + g / 255e0 + b / 255e0) / 3, 6) + 0.0 AS overall FROM pixels")
def frequency_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, the share of high frequencies and the mean of three region measures."""
    from portrel.functions import geometry as g

    high, mid, low = (F.col(c) for c in "rgb")
    d = g.frequency_metrics(high, mid, low)
    return rel.pixels(spark, sf_dir).select("image_id", "i", r6(d["ratio"]).alias("high_ratio"), d["total"].alias("total"), r6((high / 255 + mid / 255 + low / 255) / 3).alias("overall"))


@query("""WITH c AS (SELECT block_id, max(pass_no) - block_id % 2 AS want FROM rd GROUP BY block_id) SELECT count(*) AS blocks, CAST(sum(coalesce(r.rate, 0)) AS BIGINT) AS bytes, CAST(sum(coalesce(r.dist, 0)) AS BIGINT) AS credit FROM c LEFT JOIN rd r ON r.block_id = c.block_id AND r.pass_no = c.want""")
def endpoint_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and credit of all blocks at their chosen passes; before the first pass both are 0."""
    from portrel.operators import ledger

    points = rel.rd(spark, sf_dir)
    chosen = points.groupBy("block_id").agg(F.max("pass_no").alias("last")).select("block_id", (F.col("last") - F.col("block_id") % 2).alias("want"))
    return ledger.endpoint_totals(points, chosen)


@query("SELECT image_id, label, round(avg((pow(r - 128, 2) + pow(g - 128, 2)) / 2 - (pow(b - 128, 2) + pow(g - 100, 2)) / 2), 4) + 0.0 AS improvement, count(*) FILTER (pow(r - 128, 2) + pow(g - 128, 2) > pow(b - 128, 2) + pow(g - 100, 2)) AS better FROM pixels GROUP BY image_id, label")
def improvement_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much a pixel's squared error fell, mean over its channels; summed up by region."""
    from portrel.operators import regions

    square = lambda c, goal: (F.col(c) - goal) * (F.col(c) - goal)
    gain = regions.improvement([square("r", 128), square("g", 128)], [square("b", 128), square("g", 100)])
    return rel.pixels(spark, sf_dir).groupBy("image_id", "label").agg((F.round(F.avg(gain), 4) + 0.0).alias("improvement"), F.count_if(gain > 0).alias("better"))


@query("SELECT id, round(CASE WHEN symmetry > 0.2e0 THEN (symmetry - geometry) / (symmetry - 0.2e0) END, 6) + 0.0 AS closure, CASE WHEN head > 0 THEN round(ipd - head, 6) + 0.0 WHEN ipd > 100 THEN 0.0 END AS delta FROM assessments")
def gap_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What part of the way to a goal was gone, and differences of ratios that may both be missing."""
    from portrel.functions import geometry as g

    known = F.when(F.col("head") > 0, F.col("head"))
    other = F.when(F.col("head") > 0, F.col("ipd"))
    return rel.assessments(spark, sf_dir).select("id", r6(g.gap_closure(F.col("symmetry"), F.col("geometry"), F.lit(0.2))).alias("closure"), r6(g.ratio_delta(other, known, F.col("ipd") > 100)).alias("delta"))


@query("SELECT id, CASE WHEN symmetry > 0 THEN round(sharpness / symmetry, 6) + 0.0 END AS ratio, geometry > 0 AND symmetry > 0 AND sharpness > symmetry AS valid FROM assessments")
def edge_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portrel.functions import geometry as g

    sigma, low, high = F.col("geometry"), F.col("symmetry"), F.col("sharpness")
    return rel.assessments(spark, sf_dir).select("id", r6(F.try_divide(high, low)).alias("ratio"), g.edge_config_valid(sigma, low, high).alias("valid"))
