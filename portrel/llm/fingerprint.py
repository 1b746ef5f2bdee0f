"""Document fingerprints by a homomorphic multiset hash.

A document is the multiset of its paragraphs (lines; an empty text has none). Each paragraph is hashed to a wide vector and
the fingerprint is their sum, lane by lane, modulo a power of two: ``EQUAL_LANES`` lanes modulo 2**64, the
512 bits of a cryptographic digest of the whole paragraph, and ``LIKE_LANES`` lanes modulo 2**32 that add up +1 or -1 for each of the paragraph's runs of ``RUN`` words.
So the order of paragraphs doesn't matter, and paragraphs are put into a stored fingerprint or taken out of it (``inserted``,
``deleted``) by adding or subtracting their vectors, without the document's text.
The first lanes decide equality; the inner product of the others estimates how much two documents share.

Nulls are empty texts. Of repeated rows each has its result. Rows with a null ``doc_id`` are the lowest ones. An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrel.llm import common

EQUAL_LANES = 8
LIKE_LANES = 256
RUN = 3

def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of each text's fingerprint: (rows, EQUAL_LANES) uint64 and (rows, LIKE_LANES) int32."""
    data, offsets = common.text_bytes(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    breaks = np.flatnonzero(data == 10)
    row_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    full = np.flatnonzero(size > 0)
    starts = np.sort(np.concatenate([offsets[:-1][full], breaks + 1]))
    rows = np.sort(np.concatenate([full, row_of_break]))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    same = np.zeros(len(starts), dtype=bool)
    same[:-1] = rows[1:] == rows[:-1]
    ends[~same] = offsets[1:][rows[~same]]
    equal = np.zeros((n, EQUAL_LANES), dtype=np.uint64)
    if len(starts):
        whole = data.tobytes()
        digests = b"".join(hashlib.blake2b(whole[a:b], digest_size=8 * EQUAL_LANES).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
        wide = np.frombuffer(digests, "<u8").reshape(-1, EQUAL_LANES)
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        equal[rows[first]] = np.add.reduceat(wide, first, axis=0)
    like = np.zeros((n, LIKE_LANES), dtype=np.int32)
    begin, end, _ = common.word_spans(data, offsets)
    if len(begin):
        # The paragraph of each word, and runs of words that stay in it; a shorter paragraph is one run.
        home = np.searchsorted(starts, begin, side="right") - 1
        count = np.bincount(home, minlength=len(starts))
        left = (np.cumsum(count)[home] - np.arange(len(home)))  # words from this one to the paragraph's end
        is_run = (left >= RUN) | ((count[home] < RUN) & (left == count[home]))
        at = np.flatnonzero(is_run)
        words = common.word_hashes(data, begin, end)
        h = words[at].copy()
        for k in range(1, RUN):
            more = left[at] > k
            nxt = np.minimum(at + k, len(words) - 1)
            h = common.mix(h * np.uint64(3) + np.where(more, words[nxt], np.uint64(k)))
        lane = (h >> np.uint64(40)).astype(np.int64) % LIKE_LANES
        sign = np.where(h & np.uint64(1), 1.0, -1.0)
        where = rows[home[at]] * LIKE_LANES + lane
        like = np.bincount(where, weights=sign, minlength=n * LIKE_LANES).astype(np.int64).astype(np.int32).reshape(n, LIKE_LANES)
    return equal, like


def hexes(equal: np.ndarray, like: np.ndarray) -> list[str]:
    return [a.tobytes().hex() + b.tobytes().hex() for a, b in zip(equal.astype("<u8"), like.astype("<i4"), strict=True)]


def lanes(fingerprints: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The two parts behind the strings of ``hexes`` (null: those of an empty text)."""
    raw = b"".join(bytes.fromhex(f) if f else bytes(8 * EQUAL_LANES + 4 * LIKE_LANES) for f in fingerprints)
    table = np.frombuffer(raw, np.uint8).reshape(len(fingerprints), 8 * EQUAL_LANES + 4 * LIKE_LANES)
    return np.ascontiguousarray(table[:, : 8 * EQUAL_LANES]).view("<u8"), np.ascontiguousarray(table[:, 8 * EQUAL_LANES :]).view("<i4")


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each row of two lots of fingerprints: 1 for equal ones, else the shared part of the larger document."""
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    most = np.maximum((x * x).sum(axis=1), (y * y).sum(axis=1))
    near = np.clip((x * y).sum(axis=1) / np.maximum(most, 1.0), 0.0, 1.0)
    return np.where((a[0] == b[0]).all(axis=1), 1.0, near)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds each text's fingerprint as a hex string."""
    common.small_batches(docs.sparkSession)
    kept = docs.drop(name)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(hexes(*vectors(batch.column(text))), pa.string())], [*batch.schema.names, name])

    return common.map_batches(kept, step, f"{ddl}, `{name}` string")


def inserted(rows: DataFrame, paragraphs: str, fingerprint: str = "fingerprint") -> DataFrame:
    """``rows`` with the column ``fingerprint`` brought up to date for paragraphs (column ``paragraphs``, one on each line; null or
    empty: none) that were put into the documents, wherever."""
    return _changed(rows, paragraphs, fingerprint, 1)


def deleted(rows: DataFrame, paragraphs: str, fingerprint: str = "fingerprint") -> DataFrame:
    """The same for paragraphs that were taken out."""
    return _changed(rows, paragraphs, fingerprint, -1)


def _changed(rows: DataFrame, paragraphs: str, fingerprint: str, sign: int) -> DataFrame:
    common.small_batches(rows.sparkSession)
    names = rows.columns

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            now = [have + own if sign > 0 else have - own for have, own in zip(lanes(batch.column(fingerprint).to_pylist()), vectors(batch.column(paragraphs)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(hexes(*now), pa.string()) if c == fingerprint else batch.column(c) for c in names], names)

    return common.map_batches(rows, step, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields))


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edits(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likeness of its own to that one and the next document's.

    The edited text has the last half of the code points replaced by the first as many of the next document, in descending
    order of ``doc_id``; after the last document comes the first.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select("doc_id", "text")
    cuts = common.bucket_bounds(docs, "doc_id", 4 * common.partitions(spark))
    dealt = common.with_bucket(docs, "doc_id", cuts)
    # One row for each bucket, whose number is a parameter: the last document of each goes to the next bucket as well.
    order = F.struct(F.col("doc_id"), F.xxhash64("text").alias("hash"))
    last = sorted((r["bucket"], r["m"]["doc_id"], r["m"]["hash"]) for r in dealt.groupBy("bucket").agg(F.max(order).alias("m")).collect())
    following = [(b, doc, h, last[(i + 1) % len(last)][0]) for i, (b, doc, h) in enumerate(last)]
    ends = F.broadcast(spark.createDataFrame(following, "bucket int, last_id long, last_hash long, following int"))
    is_last = F.col("doc_id").eqNullSafe(F.col("last_id")) & (F.xxhash64("text") == F.col("last_hash"))
    places = F.when(is_last, F.array(F.struct("bucket", F.lit(False).alias("lent")), F.struct(F.col("following").alias("bucket"), F.lit(True).alias("lent")))).otherwise(F.array(F.struct("bucket", F.lit(False).alias("lent"))))
    lent = dealt.join(ends, "bucket").select("doc_id", "text", F.explode(places).alias("at")).select("at.bucket", "at.lent", "doc_id", "text")
    lent = lent.repartition(common.partitions(spark), "bucket").sortWithinPartitions("bucket", F.col("lent").desc(), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, before = "", None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own = vectors(pa.array(texts, pa.large_string()))
            edited = []
            for t in texts:
                half = len(t) // 2
                edited.append(t[: len(t) - half] + text[:half])
                text = t
            if before is None:
                before = (np.zeros((1, EQUAL_LANES), np.uint64), np.zeros((1, LIKE_LANES), np.int32))
            nxt = tuple(np.concatenate([b, o[:-1]]) for b, o in zip(before, own, strict=True))
            before = tuple(o[-1:].copy() for o in own)
            changed = vectors(pa.array(edited, pa.large_string()))
            columns = [
                batch.column("doc_id"),
                pa.array(list(map(len, texts)), pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                pa.array(hexes(*own), pa.string()),
                pa.array(hexes(*changed), pa.string()),
                pa.array(likeness(own, changed), pa.float64()),
                pa.array(likeness(own, nxt), pa.float64()),
            ]
            out = pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield out.filter(pa.array([not x for x in batch.column("lent").to_pylist()]))

    return lent.mapInArrow(run, EDITED)
