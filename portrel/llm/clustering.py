"""Centroid clustering: Lloyd's rounds over distinct quantised vectors with multiplicities.

Identical quantised vectors are grouped first, so a vector that a third of all rows hold is one row with a weight. A round is one pass
over the distinct vectors: each task assigns its own and gives out, for each cluster, the weight and the weighted integer sum of each
component; Spark adds these up, and the centroids (``k`` times the dimensions, whatever the corpus) are divided on the driver. At
the end the assignments are joined back to the rows by the vector. Vectors that hold a thousandth of all rows or more, a thousand at
most by that, are joined by broadcast, so no key of the shuffled join is hot.

Components are floor(scale * x), held to +-2**53; sums, centroids and distances are exact at any size, distances and
inertias beyond a long are its greatest value. Vectors that are null, of another length, or hold a null or non-finite
component take no part. Rows with a null id take part, but come last as starting centroids. Repeated rows, and rows of one id, count
each. Fewer vectors than ``k`` make fewer centroids; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrel.llm import common

K, DIMS, SCALE, ROUNDS, SEED = 8, 64, 1024, 10, 3
MOST = 2.0**53
TOP = (1 << 63) - 1
#: A vector with at least this share of all rows is joined back by broadcast: at most 1,000 are.
HOT_SHARE = 1000
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def quantised(rows: DataFrame, dims: int = DIMS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as whole numbers."""
    clean = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.lit(float(scale)) * x.cast("double"))))
    return rows.where(clean).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, whole).alias("v"))


def _table(column: pa.ListArray, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest centroid (ties: the smaller one) and the squared distance, exact."""
    reach = int(np.abs(x).max(initial=0)) + max(abs(c) for row in centroids for c in row)
    if x.shape[1] * reach**2 < MOST:
        own, other = x.astype(np.float64), np.array(centroids, np.float64)
        far = ((own * own).sum(axis=1)[:, None] - 2 * (own @ other.T) + (other * other).sum(axis=1)).astype(np.int64)
    else:
        own = x.astype(object)
        far = np.stack([((own - np.array(c, object)) ** 2).sum(axis=1) for c in centroids], axis=1)
    near = far.argmin(axis=1)
    return near, far[np.arange(len(x)), near]


def weighted_sums(distinct: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Weight and component sums of each cluster that has vectors, of the distinct vectors (v, n)."""
    k, dims = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), object)  # Python's whole numbers: exact
        for batch in batches:
            if not batch.num_rows:
                continue
            x, n = _table(batch.column("v"), dims), np.asarray(batch.column("n"))
            near, _ = nearest(x, centroids)
            x = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
            small = int(np.abs(x).max()) * int(n.sum()) < MOST
            kind = np.float64 if small else object
            share = np.zeros((k, len(x)), kind)
            share[near, np.arange(len(x))] = n
            part = share @ x.astype(kind)
            sums += part.astype(np.int64).astype(object) if small else part
        cells = [(c, j, Decimal(int(sums[c, j]))) for c in range(k) if sums[c, dims] for j in range(dims + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in cells], pa.int32()), pa.array([x[1] for x in cells], pa.int32()), pa.array([x[2] for x in cells], pa.decimal128(38, 0))], ["c", "j", "s"])

    added = distinct.select("v", "n").mapInArrow(run, "c int, j int, s decimal(38,0)").groupBy("c", "j").agg(F.sum("s").alias("s"))
    rows: dict[int, list[int]] = {}
    for c, j, s in added.collect():  # k times (dims + 1)
        rows.setdefault(c, [0] * (dims + 1))[j] = int(s)
    return {c: (row[-1], row[:-1]) for c, row in rows.items()}


def assigned(distinct: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(v, n, cluster, distance) of the distinct vectors."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        near, far = nearest(_table(batch.column("v"), len(centroids[0])), centroids)
        far = np.array([min(TOP, d) for d in far], np.int64) if far.dtype == object else far
        return pa.RecordBatch.from_arrays([batch.column("v"), batch.column("n"), pa.array(near.astype(np.int32)), pa.array(far)], ["v", "n", "cluster", "distance"])

    return common.map_batches(distinct, step, "v array<long>, n long, cluster int, distance long")


def cluster(rows: DataFrame, k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """RESULT for every vector that takes part, and the final centroids.

    The first centroids are the ``k`` vectors whose sha256 of ``seed:id`` is least. Rounds end early once no centroid moves, as
    further ones would change nothing.
    """
    spark = rows.sparkSession
    common.small_batches(spark)
    kept = quantised(rows, dims, scale, key, vector)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [list(r["v"]) for r in kept.orderBy(order.asc_nulls_last(), "vec_id", "v").limit(k).collect()]
    if not centroids:
        return spark.createDataFrame([], RESULT), []
    distinct = common.stored(kept.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    for _ in range(rounds):
        found = weighted_sums(distinct, centroids)
        moved = [[s // found[c][0] for s in found[c][1]] if c in found else old for c, old in enumerate(centroids)]
        if moved == centroids:
            break
        centroids = moved

    done = common.stored(assigned(distinct, centroids))
    spread = done.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")).alias("spread"), F.sum("n").alias("n")).collect()  # k rows
    inertia = {r["cluster"]: int(r["spread"]) for r in spread}
    held = lambda x: min(TOP, x)
    about = [(c, held(inertia.get(c, 0)), held(sum(inertia.values())), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids)]
    clusters = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows

    hot = F.col("n") * HOT_SHARE >= sum(r["n"] for r in spread)
    few, rest = (done.where(x).select("v", "cluster", "distance") for x in (hot, ~hot))
    others = kept.join(F.broadcast(few.select("v")), "v", "left_anti").join(rest.hint("merge"), "v")
    joined = kept.join(F.broadcast(few), "v").unionByName(others)
    return joined.join(F.broadcast(clusters), "cluster").select(*[x.split()[0] for x in RESULT.split(", ")]), centroids
