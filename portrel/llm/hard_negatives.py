"""Hard-negative mining by bit-sliced integer products.

Vectors are packed into blocks where they lie, each of one length and of (whole-number) labels that fall in one of ``LABEL_PARTS`` parts by hash.
Blocks of anchors meet groups of vector blocks, twice: with the blocks of their label's part for their positives (the best rows of
their label), then with all blocks for the negatives (rows of other labels whose score lies in a window below a positive's).

Where two blocks meet, components count from the least of their block, so they are sums of bit-planes. Planes are added up from the
most significant one on: after each, a pair's score lies between the sum so far plus all that the planes left can take away and plus
all that they can add. Pairs go as soon as that interval misses what is asked: for positives, as its end is below the anchor's
``positives`` best lower ends so far; for negatives, as it misses all of the anchor's windows, or is below the ``negatives`` best scores
found in each of them. While many pairs are left a plane is one matrix product, then it is summed for the pairs left only. What
stays after the last plane has exact scores. Blocks whose products are beyond 2**53 are scored by exact products instead.

Components are floor(scale * x); scores that no long can hold are its ends. Rows with a null id, label or vector, an empty vector,
or any null or non-finite component take no part. Only vectors of one length meet. An anchor never meets rows of its own id; repeated
rows count each; an anchor id that repeats asks once, with its smallest vector and label. Anchors without a positive, or positives
without a negative, give no rows; nor does an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from portrel.llm import common, topk

#: Parts of the labels by hash; blocks of vectors hold labels of one part.
LABEL_PARTS = 64
VECTOR_BLOCK = ANCHOR_BLOCK = 1024
GROUP = 64
#: Vectors with larger components are packed apart, so that a few of them don't take the planes from others.
PLAIN = 2.0**20
#: Pairs are listed one by one once no more than one of so many is left.
SPARSE = 16
WAITING = 32 << 20
LEAST, TOP = -(1 << 63), (1 << 63) - 1


def labelled(rows: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, part, v) of the rows that take part."""
    both = F.when(F.col(key).isNotNull() & label.isNotNull(), F.struct(F.col(key).cast("long").alias("id"), label.cast("long").alias("label")))
    whole = topk.quantised(rows.select(both.alias("_row"), F.col(vector).alias("_v")), "_row", "_v")
    return whole.select("id.id", "id.label", F.pmod(F.xxhash64("id.label"), F.lit(LABEL_PARTS)).cast("int").alias("part"), "v")


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Pack (id, label, part, v) into (dims, part, ids, labels, data) blocks of at most ``rows`` vectors, within each task."""

    def packed(part: int, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, labels, data = (np.concatenate(x) for x in zip(*held, strict=True))
        for at in range(0, len(ids), rows):
            some = slice(at, at + rows)
            raw = [pa.array([x[some].astype(t).tobytes()], pa.binary()) for x, t in ((ids, "<i8"), (labels, "<i8"), (data, "<f8"))]
            yield pa.RecordBatch.from_arrays([pa.array([data.shape[1]], pa.int32()), pa.array([part], pa.int32()), *raw], ["dims", "part", "ids", "labels", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int, bool], list[tuple[np.ndarray, ...]]] = {}
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(np.asarray(batch.column("v").offsets))
            flat = np.asarray(batch.column("v").flatten())
            begin = np.cumsum(sizes) - sizes
            ids, labels, part = (np.asarray(batch.column(c)) for c in ("id", "label", "part"))
            wide = np.maximum.reduceat(np.abs(flat), begin) > PLAIN
            kind = np.stack([sizes, part, wide], axis=1)
            for dims, own_part, is_wide in np.unique(kind, axis=0).tolist():
                own = np.flatnonzero((sizes == dims) & (part == own_part) & (wide == bool(is_wide)))
                key = (dims, own_part, bool(is_wide))
                waiting.setdefault(key, []).append((ids[own], labels[own], flat[begin[own][:, None] + np.arange(dims)]))
                held += 8 * len(own) * (dims + 2)
                if sum(len(x[0]) for x in waiting[key]) >= rows:
                    held -= sum(8 * len(x[0]) * (dims + 2) for x in waiting[key])
                    yield from packed(own_part, waiting.pop(key))
            if held > WAITING:
                for (_, own_part, _), some in waiting.items():
                    yield from packed(own_part, some)
                waiting, held = {}, 0
        for (_, own_part, _), some in waiting.items():
            yield from packed(own_part, some)

    return vectors.mapInArrow(run, "dims int, part int, ids binary, labels binary, data binary")


def sliced(q: np.ndarray, x: np.ndarray, alive: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, best: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of the pairs in ``alive`` whose score lies in [floor, ceiling] of its row of q; with ``best``, pairs
    that can't be among a row's so many best may be left out. Planes are processed most significant first."""
    base = x.min(axis=0)
    with np.errstate(over="ignore"):
        above = x - base
    take, give = np.minimum(q, 0).sum(axis=1), np.maximum(q, 0).sum(axis=1)  # what a plane can take away or add at most
    bits = int(above.max()).bit_length() if above.max() < 2.0**52 else 64
    if not (give - take).max(initial=0.0) * (2.0**bits + np.abs(base).max()) < 2.0**53:
        score = topk.products(q, x)
        a, c = np.nonzero(alive & (score >= floor[:, None]) & (score <= ceiling[:, None]))
        return a, c, score[a, c]
    above = above.astype(np.int64)  # past 2**52 only where q is zero
    score = np.repeat((q @ base)[:, None], len(x), axis=1)
    floor, ceiling = floor.astype(np.float64), ceiling.astype(np.float64)
    pairs = None
    for j in reversed(range(bits)):
        plane, rest = (above >> j & 1).astype(np.float64), float((1 << j) - 1)
        if pairs is None:
            score += q @ plane.T * float(1 << j)
            low = score + rest * take[:, None]
            if best and len(x) > best:
                sure = np.partition(np.where(alive, low, -np.inf), len(x) - best, axis=1)[:, len(x) - best]
                floor = np.maximum(floor, sure)
            alive &= (low <= ceiling[:, None]) & (score + rest * give[:, None] >= floor[:, None])
            if SPARSE * np.count_nonzero(alive) <= alive.size:
                pairs = np.nonzero(alive)
                listed = score[pairs]
        else:
            a, c = pairs
            for at in range(0, len(a), 1 << 16):  # bounds the memory of the rows gathered
                some = slice(at, at + (1 << 16))
                listed[some] += np.einsum("ij,ij->i", q[a[some]], plane[c[some]]) * float(1 << j)
            stay = (listed + rest * give[a] >= floor[a]) & (listed + rest * take[a] <= ceiling[a])
            pairs, listed = (a[stay], c[stay]), listed[stay]
    if pairs is None:  # also where all vectors are equal: there is no plane then
        alive &= (score >= floor[:, None]) & (score <= ceiling[:, None])
        pairs = np.nonzero(alive)
        listed = score[pairs]
    return *pairs, listed.astype(np.int64)


def _best(slot: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each slot the k highest scores, ties to smaller ids; slots ascend."""
    order = np.lexsort((ids, -scores, slot))
    slot, ids, scores = slot[order], ids[order], scores[order]
    keep = np.arange(len(slot)) - np.searchsorted(slot, slot) < k
    return slot[keep], ids[keep], scores[keep]


def _kth(slot: np.ndarray, scores: np.ndarray, slots: int, k: int) -> np.ndarray:
    """The kth best score of each slot in what ``_best`` gave, or the least long."""
    out = np.full(slots, LEAST, np.int64)
    at = np.arange(len(slot)) - np.searchsorted(slot, slot) == k - 1
    out[slot[at]] = scores[at]
    return out


def _fold(pairs: DataFrame, start: Callable, meet: Callable, give: Callable, schema: str) -> DataFrame:
    """Fold the vector blocks that follow each other with one block of anchors: a merge join's left rows come with all they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, anchors = None, None, ()
        for batch in batches:
            for row in batch.to_pylist():
                if (row["block"], row["group"]) != now:
                    if now is not None:
                        yield give(state, anchors)
                    now = (row["block"], row["group"])
                    anchors = np.frombuffer(row["aids"], "<i8"), np.frombuffer(row["alabels"], "<i8"), np.frombuffer(row["adata"], "<f8").reshape(-1, row["dims"])
                    state = start(anchors, row)
                others = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["data"], "<f8").reshape(-1, row["dims"])
                state = meet(state, anchors, others)
        if now is not None:
            yield give(state, anchors)

    return pairs.mapInArrow(run, schema)


def positives_of(pairs: DataFrame, k: int) -> DataFrame:
    """(anchor_id, place, positive_id, positive_score): each anchor's k best rows of its label and another id."""

    def start(anchors: tuple, row: dict) -> tuple:
        return (np.zeros(0, np.int64),) * 3

    def meet(state: tuple, anchors: tuple, others: tuple) -> tuple:
        (aids, alabels, q), (ids, labels, x) = anchors, others
        floor = _kth(state[0], state[2], len(aids), k)
        alive = (alabels[:, None] == labels[None, :]) & (aids[:, None] != ids[None, :])
        a, c, score = sliced(q, x, alive, floor, np.full(len(aids), TOP), k)
        return _best(*(np.concatenate(y) for y in zip(state, (a, ids[c], score), strict=True)), k)

    def give(state: tuple, anchors: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(anchors[0][state[0]]), pa.array(state[1]), pa.array(state[2])], ["anchor_id", "positive_id", "positive_score"])

    found = _fold(pairs, start, meet, give, "anchor_id long, positive_id long, positive_score long")
    order = W.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def negatives_of(pairs: DataFrame, k: int, positives: int, low: int, high: int) -> DataFrame:
    """(anchor_id, place, positive_id, positive_score, rank, negative_id, negative_score) of blocks whose rows hold their anchors' ``wanted`` positives."""

    def start(anchors: tuple, row: dict) -> tuple:
        """Windows of each anchor's positives, and the slots' best negatives so far; a slot is an anchor and the place of a positive."""
        at = {a: i for i, a in enumerate(anchors[0].tolist())}
        least, most, ids, scores = (np.full((len(at), positives), v, np.int64) for v in (TOP, LEAST, 0, 0))
        for x in row["wanted"]:
            cell = at[x["anchor_id"]], x["place"] - 1
            ids[cell], scores[cell] = x["positive_id"], x["positive_score"]
            least[cell], most[cell] = -(-low * x["positive_score"] // 100), high * x["positive_score"] // 100
        empty = least > most
        least[empty], most[empty] = TOP, LEAST
        return least, most, ids, scores, (np.zeros(0, np.int64),) * 3

    def meet(state: tuple, anchors: tuple, others: tuple) -> tuple:
        (aids, alabels, q), (ids, labels, x), (least, most, pids, pscores, have) = anchors, others, state
        least_now = np.maximum(least, _kth(have[0], have[2], least.size, k).reshape(least.shape))
        alive = (alabels[:, None] != labels[None, :]) & (aids[:, None] != ids[None, :])
        a, c, score = sliced(q, x, alive, least_now.min(axis=1), most.max(axis=1))
        row, place = np.nonzero((score[:, None] >= least_now[a]) & (score[:, None] <= most[a]))
        new = a[row] * positives + place, ids[c[row]], score[row]
        return least, most, pids, pscores, _best(*(np.concatenate(y) for y in zip(have, new, strict=True)), k)

    def give(state: tuple, anchors: tuple) -> pa.RecordBatch:
        _, _, pids, pscores, (slot, ids, scores) = state
        columns = [anchors[0][slot // positives], slot % positives + 1, pids.ravel()[slot], pscores.ravel()[slot], ids, scores]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    found = _fold(pairs, start, meet, give, "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = W.partitionBy("anchor_id", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its ``positives`` best rows
    of its label, the ``negatives`` best rows of other labels with ``low`` to ``high`` percent of the positive's score."""
    spark = rows.sparkSession
    common.small_batches(spark)
    packed = common.stored(blocks(labelled(rows, key, vector, label), VECTOR_BLOCK))
    once = labelled(rows.where(is_anchor), key, vector, label).groupBy("id").agg(F.min(F.struct("v", "label", "part")).alias("_")).select("id", "_.*")
    spread = max(1, -(-once.count() // ANCHOR_BLOCK))
    asked = blocks(once.repartition(spread), ANCHOR_BLOCK).withColumnsRenamed({"ids": "aids", "labels": "alabels", "data": "adata"})
    asked = common.stored(asked.withColumn("block", F.monotonically_increasing_id()))
    many = packed.count()
    groups = max(1, -(-many // GROUP), min(many, common.partitions(spark)))
    dealt = packed.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    # Both sides grow with the corpus, so they are merged and never broadcast.
    everywhere = lambda left: left.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    own = everywhere(asked).join(dealt.hint("merge"), ["dims", "part", "group"])
    found = common.stored(positives_of(own, positives))

    members = common.stored(_members(asked))
    wanted = found.join(members, "anchor_id").groupBy("block").agg(F.collect_list(F.struct("anchor_id", "place", "positive_id", "positive_score")).alias("wanted"))  # at most ANCHOR_BLOCK times positives
    met = everywhere(asked.drop("part").join(common.stored(wanted), "block")).join(dealt.drop("part").hint("merge"), ["dims", "group"])
    return negatives_of(met, negatives, positives, low, high).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _members(asked: DataFrame) -> DataFrame:
    """(block, anchor_id) of each block of anchors."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(x, "<i8") for x in batch.column("aids").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("block")), [len(i) for i in ids])), pa.array(np.concatenate(ids))], ["block", "anchor_id"])

    return common.map_batches(asked.select("block", "aids"), run, "block long, anchor_id long")
