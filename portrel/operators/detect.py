"""Detection post-processing: prior grids, decoding, gates, non-max suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from portrel.functions import geometry as g

#: Steps of the feature maps and the box sizes on each.
LEVELS = ((8, (16, 32)), (16, (64, 128)), (32, (256, 512)))


def priors(spark: SparkSession, side: int = 640) -> DataFrame:
    """(i, cx, cy, s): normalised prior boxes in order of level, row, column and size."""
    out, before = None, 0
    for step, sizes in LEVELS:
        n = -(-side // step)
        cell = spark.range(n * n * len(sizes)).withColumn("k", F.col("id") % len(sizes)).withColumn("c", F.floor(F.col("id") / len(sizes)))
        size = F.element_at(F.array(*map(F.lit, sizes)), (F.col("k") + 1).cast("int"))
        level = cell.select((F.col("id") + before).alias("i"), ((F.col("c") % n + 0.5) * step / side).alias("cx"), ((F.floor(F.col("c") / n) + 0.5) * step / side).alias("cy"), (size / side).alias("s"))
        out = level if out is None else out.unionByName(level)
        before += n * n * len(sizes)
    return out


def decode(found: DataFrame, prior: DataFrame, side: int = 640) -> DataFrame:
    """Boxes of network outputs (i, dx, dy, dw, dh): centre plus a tenth of the prior, size by an exponential of a fifth."""
    b = found.join(prior, "i")
    b = b.withColumns({"pw": F.col("s") * F.exp(F.col("dw") * 0.2) * side, "ph": F.col("s") * F.exp(F.col("dh") * 0.2) * side})
    return b.withColumns({"px": (F.col("cx") + F.col("dx") * 0.1 * F.col("s")) * side - F.col("pw") / 2, "py": (F.col("cy") + F.col("dy") * 0.1 * F.col("s")) * side - F.col("ph") / 2})


def non_max_suppression(boxes: DataFrame, image: str = "image_id", det: str = "det_id", most: float = 0.4) -> DataFrame:
    """(image, det): the boxes that greedy suppression keeps: by falling confidence (ties in order of ``det``), each that
    overlaps no kept one by more than ``most``. A fold over each image's sorted array; detections of an image are few."""
    one = F.struct((-F.col("conf")).alias("o"), F.col(det).alias("d"), "x", "y", "w", "h")
    lists = boxes.groupBy(image).agg(F.array_sort(F.collect_list(one)).alias("b"))
    kind = lists.schema["b"].dataType.simpleString()
    keep = F.aggregate("b", F.array().cast(kind), lambda have, b: F.when(F.exists(have, lambda k: g.iou(k, b) > most), have).otherwise(F.concat(have, F.array(b))))
    return lists.select(image, F.explode(keep).alias("k")).select(image, F.col("k.d").alias(det))


def exactly_one(images: DataFrame, boxes: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, n, code): images with one detection pass; others have an error code. Images without any stay in."""
    n = boxes.groupBy(image).agg(F.count(F.lit(1)).alias("n"))
    out = images.select(image).distinct().join(n, image, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("code", F.when(F.col("n") == 0, "no_face").when(F.col("n") > 1, "multiple_faces"))


def top(boxes: DataFrame, keys: Sequence[str], k: int, *order) -> DataFrame:  # noqa: ANN002
    """The first ``k`` rows of each group."""
    turn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return boxes.withColumn("turn", turn).where(F.col("turn") <= k)
