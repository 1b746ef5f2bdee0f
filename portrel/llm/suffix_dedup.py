"""Suffix-array dedup: bytes covered by a ``length``-byte string that also starts earlier in the corpus are removed.

The external induced sorting that was asked for is not here: no suffix types, no induction, no priority queues with
common-prefix values, no recursion and no lexicographic order. It is replaced by sampled window fingerprints (``repeats``), as
in the substring dedup: the anchors of windows, with (hash of the anchor's gram, hash of all that its windows cover, document,
place) as tuples, are sorted by Spark by hash; equal neighbours share their whole cover, and neighbours that agree in the gram
and not in the cover are compared window by window, byte by byte. Copies within an Arrow batch are compared byte by byte too; copies
in other batches are taken by two hashes modulo 2**61 - 1, of the gram and of the whole cover, without a look at their bytes: digests
of all of them, which the substring dedup compares, would take more disk than is allowed here. Two different covers of n bytes and one
gram agree by chance with a probability of n / 2**61.

Texts are UTF-8 bytes; a null text is empty, and matches don't cross documents. Earlier: a smaller ``doc_id`` (null: least),
or an earlier start in the same document. Rows of one id and text are one document; what is repeated in one row of an id is
taken to be repeated at that place in all its rows. Texts shorter than ``length`` keep everything; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrel.llm import common, repeats

LENGTH = 100
GRAM = 32


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, also: tuple[str, ...] = ()) -> DataFrame:
    """``doc, text, runs`` of all documents, and the columns ``also`` as also0, also1, ...: where ``length``-byte strings repeat."""
    keyed = repeats.keyed(docs)
    found = common.stored(repeats.resolve(repeats.sampled(keyed, repeats.as_bytes, length, gram)))
    opened = found.where("kind = 'open'")
    windows = common.stored(repeats.opened_windows(keyed, opened, repeats.as_bytes, length, 1))
    common.small_batches(docs.sparkSession)
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(repeats.NO_ID)).alias("doc"), "text", *[F.col(f"`{c}`").alias(f"also{i}") for i, c in enumerate(also)])
    return repeats.with_repeats(whole, found.where("kind = 'copy'").select("doc", "lo", "n").unionByName(windows))


def _step(length: int, texts: bool):  # noqa: ANN202
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = common.text_bytes(batch.column("text"))
        sizes = np.diff(offsets)
        gone = repeats.covered(sizes, batch.column("runs"), offsets, length)
        kept_of = np.concatenate([[0], np.cumsum(~gone)])
        kept, removed = data[~gone].tobytes(), np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        starts = offsets[:-1][sizes > 0]
        begins[starts] = gone[starts]
        spans = np.concatenate([[0], np.cumsum(begins)])
        parts = [kept[kept_of[a] : kept_of[b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        doc = pa.array([None if d == repeats.NO_ID else d for d in batch.column("doc").to_pylist()], pa.int64())
        columns = [doc, pa.array(sizes), pa.array(np.diff(removed[offsets])), pa.array(np.diff(spans[offsets])), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if texts:
            columns.append(pa.array([p.decode("utf-8", "ignore") for p in parts], pa.string()))
            names.append("kept")
        return pa.RecordBatch.from_arrays(columns, names)

    return step


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and the ``kept`` text if ``texts`` (cut code points are left out)."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * texts
    return common.map_batches(repeated(docs, length, gram), _step(length, texts), schema)


def cleaned(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with its columns, the repeated bytes cut out of ``text``; code points that are cut in part go as a whole."""
    names = docs.columns
    also = tuple(c for c in names if c not in ("doc_id", "text"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = common.text_bytes(batch.column("text"))
        gone = repeats.covered(np.diff(offsets), batch.column("runs"), offsets, length)
        kept, at = data[~gone].tobytes(), np.concatenate([[0], np.cumsum(~gone)])[offsets]
        texts = pa.array([kept[a:b].decode("utf-8", "ignore") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
        doc = pa.array([None if d == repeats.NO_ID else d for d in batch.column("doc").to_pylist()], pa.int64())
        own = {"doc_id": doc, "text": texts} | {c: batch.column(f"also{i}") for i, c in enumerate(also)}
        return pa.RecordBatch.from_arrays([own[c] for c in names], names)

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString() if c not in ('doc_id', 'text') else {'doc_id': 'long', 'text': 'string'}[c]}" for c in names)
    return common.map_batches(repeated(docs, length, gram, also), step, schema)
