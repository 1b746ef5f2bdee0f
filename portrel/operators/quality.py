"""Scores, rules and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portrel.functions import validate

RULE = "standard string, mode string, min_symmetry double, min_sharpness double, min_head double, max_head double, min_ipd double, max_ipd double"
#: Thresholds of the two capture modes.
RULES = [("PIV", "input", 0.40, 0.15, 25.0, 85.0, 60.0, 200.0), ("PIV", "output", 0.60, 0.25, 35.0, 80.0, 90.0, 120.0)]


def rules(spark: SparkSession) -> DataFrame:
    names = [field.split()[0] for field in RULE.split(", ")]
    values = ", ".join(f"('{a}', '{b}', {', '.join(f'{v}D' for v in rest)})" for a, b, *rest in RULES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules({', '.join(names)})")


def overall(symmetry: Column, sharpness: Column, geometry: Column) -> Column:
    return 0.3 * symmetry + 0.3 * sharpness + 0.4 * geometry


def gated(rows: DataFrame, rule: DataFrame, standard: str = "standard", mode: str = "mode") -> DataFrame:
    """Join each row with its rule (upper-cased standard, else PIV) and list what it fails, in order. Spark broadcasts the rules if they
    are as few as usual. Input mode only advises on symmetry and eye distance."""
    keys = rule.select(F.col("standard").alias("rule_standard"), F.col("mode").alias("rule_mode"), *[c for c in rule.columns if c not in ("standard", "mode")])
    known = rule.select(F.col("standard").alias("known_standard")).distinct()
    named = rows.join(known, F.upper(standard) == F.col("known_standard"), "left").withColumn("known_standard", F.coalesce("known_standard", F.lit("PIV")))
    r = named.join(keys, (F.col("known_standard") == F.col("rule_standard")) & (F.col(mode) == F.col("rule_mode")), "left").drop("known_standard")
    strict = F.col(mode) != "input"
    failed = validate.kept(
        F.when(strict & (F.col("symmetry") < F.col("min_symmetry")), F.lit("symmetry")),
        F.when(F.col("sharpness") < F.col("min_sharpness"), F.lit("sharpness")),
        F.when(F.col("head") < F.col("min_head"), F.lit("head_low")).when(F.col("head") > F.col("max_head"), F.lit("head_high")),
        F.when(strict & (F.col("ipd") < F.col("min_ipd")), F.lit("ipd_low")).when(strict & (F.col("ipd") > F.col("max_ipd")), F.lit("ipd_high")),
    )
    return r.withColumn("failed", failed).withColumn("compliant", F.size("failed") == 0)


def violations(rows: DataFrame) -> DataFrame:
    """One row for each score under its level: (id, metric, severity)."""
    def rule(name: str, critical: float, major: float) -> Column:
        v = F.col(name)
        return F.when(v < critical, F.struct(F.lit(name).alias("metric"), F.lit("Critical").alias("severity"))).when(v < major, F.struct(F.lit(name).alias("metric"), F.lit("Major").alias("severity")))

    listed = validate.kept(rule("symmetry", 0.3, 0.6), rule("sharpness", 0.2, 0.5), rule("geometry", 0.4, 0.7))
    return rows.select("id", F.explode(listed).alias("v")).select("id", "v.metric", "v.severity")


def first_feasible(rows: DataFrame, key: str, order: str, ok: str, reason: str) -> DataFrame:
    """(key, chosen, trace): the first candidate in order that is ok (null: none), and the reasons of those before it."""
    one = rows.groupBy(key).agg(F.min(F.when(F.col(ok), F.col(order))).alias("chosen"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(reason).alias("r")))).alias("all"))
    before = F.filter("all", lambda t: F.col("chosen").isNull() | (t["o"] < F.col("chosen")))
    return one.select(key, "chosen", F.array_join(F.transform(before, lambda t: t["r"]), "; ").alias("trace"))
