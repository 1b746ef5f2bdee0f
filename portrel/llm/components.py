"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrel.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(v, component) of all ends of ``edges(a, b)``: the component is the smallest id that is reachable.

    A large star ties each vertex's larger neighbours to its smallest one, a small star its smaller ones; repeated until
    nothing changes. Every round is two aggregations and joins on vertices; no path or component is held in one place.
    Loops and repeated edges do no harm; no edges give no rows.
    """
    spark = edges.sparkSession
    paths: list[str] = []
    now = common.stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), paths)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        old = list(paths)
        now = common.stored(small.where("a <> b").distinct(), paths)
        new_mark = _mark(now)
        common.discard(spark, old)
        paths = [p for p in paths if p not in old]
        if new_mark == mark:
            break
        mark = new_mark
    roots = now.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    return row[0], row[1]
