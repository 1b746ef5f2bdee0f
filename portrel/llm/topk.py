"""Exact top-k search: scores of stated queries against all vectors, and global histograms that close in on each kth score.

Vectors are packed into blocks where they lie. Blocks of queries are sent to groups of vector blocks, and one pair of blocks is one
matrix product. The first pass counts, for each query, all its scores in equal ranges of all possible scores; a task adds up the
counts of a query block over its group, Spark adds them up over the groups. The range that holds the kth score is cut into ranges
again, and so on until no query has more than ``ENOUGH`` scores from the start of that range on, or the range is one score. The last
pass keeps the scores from there on and, of equal ones, the smallest ids.

Components are floor(256 x) and scores are their exact integer products: in double precision where no product of two norms reaches
2**53, in 64-bit integers below 2**62, in whole numbers of any size beyond; scores that no long can hold are its least or greatest
value, and components of 2**1016 or more count as the greatest double. Vectors that are null, empty, or hold a null or non-finite
component, take no part, nor do rows with a null id; only vectors of one length are compared. A query never meets rows of its own id. Equal
scores go to the smaller id, and repeated rows count each as candidates; a query id that repeats asks once, with its smallest
vector. Fewer candidates than k give all of them; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from portrel.llm import common

VECTOR_BLOCK = 1024
QUERY_BLOCK = 1024
#: Vector blocks that a task meets with a block of queries before it gives out what it counted.
GROUP = 64
RANGES = 256
#: Scores from the start of a query's range on with which it needs no narrower one.
ENOUGH = 1024
#: Vectors that wait for a full block, in bytes over all lengths.
WAITING = 32 << 20
TOP = (1 << 63) - 1


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): the integer vectors that take part."""
    clean = F.size(vector) > 0
    clean &= F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    most = F.lit(float(np.finfo(np.float64).max))
    # floor() of a double is a long in SQL; beyond 2**52 a double is whole anyway.
    whole = lambda x: F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(F.greatest(-most, F.least(most, x)))
    return rows.where(F.col(key).isNotNull() & clean).select(F.col(key).alias("id"), F.transform(vector, lambda x: whole(F.lit(256.0) * x.cast("double"))).alias("v"))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Pack (id, v) into (dims, ids, data) blocks of at most ``rows`` vectors of one length, within each task."""

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, data = (np.concatenate(x) for x in zip(*held, strict=True))
        for at in range(0, len(ids), rows):
            some = slice(at, at + rows)
            yield pa.RecordBatch.from_arrays([pa.array([data.shape[1]], pa.int32()), pa.array([ids[some].astype("<i8").tobytes()], pa.binary()), pa.array([data[some].astype("<f8").tobytes()], pa.binary())], ["dims", "ids", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten())
            begin = np.cumsum(sizes) - sizes
            ids = np.asarray(batch.column("id"))
            for dims in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dims)
                waiting.setdefault(dims, []).append((ids[own], flat[begin[own][:, None] + np.arange(dims)]))
                held += 8 * len(own) * (dims + 1)
                if sum(len(i) for i, _ in waiting[dims]) >= rows:
                    held -= sum(8 * len(i) * (dims + 1) for i, _ in waiting[dims])
                    yield from packed(waiting.pop(dims))
            if held > WAITING:
                for some in waiting.values():
                    yield from packed(some)
                waiting, held = {}, 0
        for some in waiting.values():
            yield from packed(some)

    return vectors.mapInArrow(run, "dims int, ids binary, data binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer products of all rows of two arrays of whole numbers, held to the range of a long."""
    with np.errstate(over="ignore", invalid="ignore"):
        norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
        reach = norm_a.max(initial=0.0) * norm_b.max(initial=0.0)
        if reach < 2.0**53:
            return (a @ b.T).astype(np.int64)
        fits_a, fits_b = np.abs(a) < 2.0**62, np.abs(b) < 2.0**62
        out = np.where(fits_a, a, 0).astype(np.int64) @ np.where(fits_b, b, 0).astype(np.int64).T
        rows, columns = np.nonzero(~(norm_a[:, None] * norm_b[None, :] < 2.0**62))
    whole_a, whole_b = {r: list(map(int, a[r])) for r in set(rows.tolist())}, {c: list(map(int, b[c])) for c in set(columns.tolist())}
    for r, c in zip(rows.tolist(), columns.tolist(), strict=True):
        out[r, c] = max(-TOP, min(TOP, sum(x * y for x, y in zip(whole_a[r], whole_b[c], strict=True))))
    return out


def _pairs(queries: DataFrame, vectors: DataFrame, groups: int) -> DataFrame:
    """Each block of queries with each block of vectors of its length: query blocks go to every group of vector blocks, and a task
    meets one of them with its whole group before the next."""
    left = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = vectors.select("dims", "ids", "data", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("group"))
    return left.join(right.hint("merge"), ["dims", "group"])  # never broadcast: both sides grow


def _by_query_block(pairs: DataFrame, least: int, start: Callable, meet: Callable, give: Callable, schema: str) -> DataFrame:
    """Fold the vector blocks that follow each other with one block of queries: ``start(qids)``, then ``meet(state, lows, ids,
    scores, others)`` for each, then ``give(state, qids, lows)``. Queries without a start have ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = qids = vectors = lows = None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["block"], row["group"]) != now:
                    if now is not None:
                        yield give(state, qids, lows)
                    now = (row["block"], row["group"])
                    qids = np.frombuffer(row["qids"], "<i8")
                    vectors = np.frombuffer(row["qdata"], "<f8").reshape(-1, row["dims"])
                    known = {x["query_id"]: x["low"] for x in row["lows"] or ()}
                    lows = np.array([known.get(q, least) for q in qids.tolist()], np.int64)
                    state = start(qids)
                ids = np.frombuffer(row["ids"], "<i8")
                scores = products(vectors, np.frombuffer(row["data"], "<f8").reshape(-1, row["dims"]))
                state = meet(state, lows, ids, scores, qids[:, None] != ids[None, :])
        if now is not None:
            yield give(state, qids, lows)

    return pairs.mapInArrow(run, schema)


def _narrow(pairs: DataFrame, least: int, width: int, k: int) -> DataFrame:
    """(query_id, low, upto): the start of the range that holds each query's kth score, of ranges ``width`` wide from its present
    start on, and how many scores are not below it. Scores beyond the present range count as one more range."""
    step = np.uint64(width)

    def meet(counts: np.ndarray, lows: np.ndarray, ids: np.ndarray, scores: np.ndarray, others: np.ndarray) -> np.ndarray:
        q, c = np.nonzero(others & (scores >= lows[:, None]))
        above = (scores[q, c].view(np.uint64) - lows[q].view(np.uint64)) // step
        cells = q * (RANGES + 1) + np.minimum(above, np.uint64(RANGES)).astype(np.int64)
        return counts + np.bincount(cells, minlength=len(counts))

    def give(counts: np.ndarray, qids: np.ndarray, lows: np.ndarray) -> pa.RecordBatch:
        cells = np.flatnonzero(counts)
        q, cell = np.divmod(cells, RANGES + 1)
        return pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(lows[q]), pa.array(cell), pa.array(counts[cells])], ["query_id", "base", "cell", "n"])

    counts = _by_query_block(pairs, least, lambda qids: np.zeros(len(qids) * (RANGES + 1), np.int64), meet, give, "query_id long, base long, cell long, n long")
    counts = counts.groupBy("query_id", "base", "cell").agg(F.sum("n").alias("n"))
    down = W.partitionBy("query_id").orderBy(F.col("cell").desc())
    reached = counts.withColumn("upto", F.sum("n").over(down))
    held = F.coalesce(F.max(F.when(F.col("upto") >= k, F.struct("cell", "upto"))), F.min(F.struct("cell", "upto")))
    found = reached.groupBy("query_id", "base").agg(held.alias("held"))
    low = F.col("base").cast("decimal(20,0)") + F.col("held.cell").cast("decimal(6,0)") * F.lit(Decimal(width)).cast("decimal(20,0)")  # a product may be no long
    return found.select("query_id", low.cast("long").alias("low"), F.col("held.upto").alias("upto"))


def _select(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of all scores from each query's start on; a task that has more than ``k`` gives out its best."""

    def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], ids[keep], scores[keep]

    def meet(state: tuple, lows: np.ndarray, ids: np.ndarray, scores: np.ndarray, others: np.ndarray) -> tuple:
        q, c = np.nonzero(others & (scores >= lows[:, None]))
        return best(*(np.concatenate(x) for x in zip(state, (q, ids[c], scores[q, c]), strict=True)))

    def give(state: tuple, qids: np.ndarray, lows: np.ndarray) -> pa.RecordBatch:
        q, ids, scores = state
        return pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    return _by_query_block(pairs, -TOP, lambda qids: (np.zeros(0, np.int64),) * 3, meet, give, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` highest inner products with rows of other ids."""
    spark = rows.sparkSession
    common.small_batches(spark)
    whole = quantised(rows, key, vector)
    packed = common.stored(blocks(whole, VECTOR_BLOCK))
    queries = quantised(rows.where(is_query), key, vector).groupBy("id").agg(F.min("v").alias("v"))
    spread = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = blocks(queries.repartition(spread), QUERY_BLOCK).withColumnsRenamed({"ids": "qids", "data": "qdata"})
    asked = common.stored(asked.withColumn("block", F.monotonically_increasing_id()))
    many = packed.count()
    groups = max(1, -(-many // GROUP), min(many, common.partitions(spark)))
    # No score is beyond the product of the two largest norms; one number.
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    most = whole.agg(F.max(norm)).head()[0]
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = min(TOP, int(most * most * (1 + 1e-9)) + 1) if most < 2.0**32 else TOP
    width = -(-(2 * bound + 1) // RANGES)

    members = _members(asked)
    pairs = _pairs(asked.withColumn("lows", F.lit(None).cast("array<struct<query_id: bigint, low: bigint>>")), packed, groups)
    while True:
        kth = common.stored(_narrow(pairs, -bound, width, k))
        lows = kth.join(members, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "low")).alias("lows"))  # at most QUERY_BLOCK
        pairs = _pairs(asked.join(common.stored(lows), "block"), packed, groups)
        if width == 1 or (kth.agg(F.max("upto")).head()[0] or 0) <= max(ENOUGH, k):
            break
        width = -(-width // RANGES)
    best = common.stored(_select(pairs, k))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _members(asked: DataFrame) -> DataFrame:
    """(block, query_id) of each block of queries."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(x, "<i8") for x in batch.column("qids").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("block")), [len(i) for i in ids])), pa.array(np.concatenate(ids))], ["block", "query_id"])

    return common.stored(common.map_batches(asked.select("block", "qids"), run, "block long, query_id long"))

