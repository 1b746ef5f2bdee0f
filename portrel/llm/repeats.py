"""Repeated windows: which runs of ``length`` tokens of one document also start earlier in the corpus.

Shared by the substring and the suffix-array dedup. A token is a byte or a word; positions are token numbers.

* Sampled suffixes: of each window of ``length`` tokens the ``gram`` tokens with the least hash are its anchor. Equal windows
  have equal anchors at equal places, so an anchor stands for all windows that it rules: consecutive ones, a *unit*.
* A unit is a tuple (gram hash, hash of all tokens that its windows cover, document, first window, windows). Tuples are
  sorted externally by Spark, and each reducer walks its sorted tuples once: units with the same cover repeat as a whole,
  and all but the first are removed. Firsts of different covers under one gram may still share some windows; only these
  are opened, and their windows compared one by one.
* Hashes are polynomial, modulo the prime 2**61 - 1; covers and windows are told apart by the gram's hash and their own. Copies
  found within an Arrow batch are compared byte by byte, and opened windows token by token; ``verified`` compares the other copies by
  cryptographic digests of all their bytes. Words are told apart in windows by 64-bit hashes, which differ for words of one length up to 8 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrel.llm import common

UNIT = "gram long, cover long, doc long, lo long, n int, copy boolean"
FOUND = "kind string, gram long, cover long, doc long, lo long, n int, fdoc long, flo long"
NO_ID = -(1 << 63)
#: Windows that are sampled at a time: bounds a task's memory whatever the texts' lengths. A unit cut here is two units.
CHUNK = 1 << 18
#: Grams with more different covers than this are compared by a shuffle of single windows instead of in one task.
HOT_COVERS = 20_000


class Tokens:
    """A batch of documents as tokens: values for hashing, the n + 1 offsets of the documents, and the tokens' bytes: those of
    tokens [a, b) are raw[at[a]:at[b]]."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, raw: np.ndarray, at: np.ndarray):
        self.values, self.offsets, self.raw, self.at = values, offsets, raw, at


def as_bytes(texts: pa.Array) -> Tokens:
    data, offsets = common.text_bytes(texts)
    return Tokens(data, offsets, data, np.arange(len(data) + 1))


def as_words(texts: pa.Array) -> Tokens:
    data, offsets = common.text_bytes(texts)
    begin, end, first = common.word_spans(data, offsets)
    size = end - begin + 1  # each word with one space after it
    raw = np.concatenate([data, np.full(1, 32, np.uint8)])[segments_of(begin, size)]
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    raw[at[1:] - 1] = 32
    return Tokens(common.word_hashes(data, begin, end), first, raw, at)


def run_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` tokens from each position on."""
    start = np.arange(max(len(sums) - size, 0))
    return common.slice_hash(sums, start, start + size)


def least_in_window(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys, by doubling."""
    have = 1
    while have * 2 <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :]) if width > have else keys


def units(tokens: Tokens, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram hash, cover hash, document index, first window, windows) of each unit; positions count in the whole batch."""
    parts = [_units(tokens, at, min(at + CHUNK, len(tokens.values)), length, gram) for at in range(0, max(1, len(tokens.values)), CHUNK)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _units(tokens: Tokens, at: int, stop: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the windows that start in [at, stop)."""
    offsets = np.clip(tokens.offsets, at, min(stop + length - 1, len(tokens.values))) - at
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    if not windows.sum():
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    sums = common.prefix_sums(tokens.values[at : at + offsets[-1]])
    grams = run_hashes(sums, gram)
    low = np.uint64(0xFFFFFFFF)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchors = (least_in_window(keys, length - gram + 1) & low).astype(np.int64)
    start = np.repeat(offsets[:-1], windows) + common.segments(windows)
    own = anchors[start]
    row = np.repeat(np.arange(len(windows)), windows)
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])]))
    count = np.diff(np.concatenate([first, [len(own)]]))
    lo, anchor = start[first], own[first]
    cover = common.slice_hash(sums, lo, lo + count - 1 + length)
    cover = common.mix(cover + (anchor - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return grams[anchor], cover, row[first], lo + at, count


def sampled(docs: DataFrame, tokens: Callable[[pa.Array], Tokens], length: int, gram: int) -> DataFrame:
    """UNIT rows of all documents. Units of one Arrow batch that are equal, byte by byte, go on as copies, under scattered keys, so
    that a text with many copies doesn't fill one reducer."""
    common.small_batches(docs.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = tokens(batch.column("text"))
        grams, cover, row, lo, count = units(own, length, gram)
        doc = np.asarray(batch.column("doc"))[row]
        lo = lo - own.offsets[row]
        order = np.lexsort((lo, doc, cover, grams))
        grams, cover, doc, lo, count = (x[order] for x in (grams, cover, doc, lo, count))
        copy = np.zeros(len(grams), dtype=bool)
        copy[1:] = (grams[1:] == grams[:-1]) & (cover[1:] == cover[:-1])
        lead = np.maximum.accumulate(np.where(copy, 0, np.arange(len(copy))))
        copy &= (doc != doc[lead]) | (lo != lo[lead])  # a repeated row is no earlier document
        begin, hit = own.offsets[row[order]] + lo, np.flatnonzero(copy)
        ends = begin + count - 1 + length
        first, size = own.at[begin], own.at[ends] - own.at[begin]
        copy[hit[size[hit] != size[lead[hit]]]] = False
        hit = np.flatnonzero(copy)
        for some in np.array_split(hit, max(1, int(size[hit].sum()) // (8 * CHUNK))):
            differ = own.raw[segments_of(first[some], size[some])] != own.raw[segments_of(first[lead[some]], size[some])]
            copy[some[np.unique(np.repeat(np.arange(len(some)), size[some])[differ])]] = False
        grams = np.where(copy, common.mix(cover + lo.astype(np.uint64) + doc.astype(np.uint64) * common.MULT), grams)
        return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(cover.view(np.int64)), pa.array(doc), pa.array(lo), pa.array(count.astype(np.int32)), pa.array(copy)], ["gram", "cover", "doc", "lo", "n", "copy"])

    return common.map_batches(docs, step, UNIT)


def segments_of(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of runs that begin there and are so long, one run after the other."""
    return np.repeat(begin, size) + common.segments(size)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, text): ids as long, a null id below all others."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")


def resolve(rows: DataFrame, with_firsts: bool = False) -> DataFrame:
    """Walk the tuples in the order of (gram, cover, document, place) and tell what they are.

    ``copy``: the unit's windows all start earlier as well, at (fdoc, flo); that is null where it was found within an Arrow batch, by
    comparing all tokens. ``open``: the first of its cover, under a gram that has other covers too. ``first``: any first
    of its cover, only if ``with_firsts``. Each task reads its sorted tuples as a stream and keeps one row between batches.
    """
    spark = rows.sparkSession
    common.small_batches(spark)
    names = ["gram", "cover", "doc", "lo", "n", "copy"]
    rows = rows.select(*names).repartition(common.partitions(spark), "gram").sortWithinPartitions("gram", "cover", "doc", "lo")

    def out(kind: str, held: dict[str, np.ndarray], pick: np.ndarray, first: np.ndarray | None = None) -> pa.RecordBatch:
        columns = [pa.array([kind] * int(pick.sum()), pa.string()), *(pa.array(held[c][pick]) for c in ("gram", "cover", "doc", "lo", "n"))]
        own = held["copy"][pick] if first is not None else np.ones(int(pick.sum()), bool)
        columns += [pa.array(held[c][first[pick] if first is not None else pick], mask=own) for c in ("doc", "lo")]
        return pa.RecordBatch.from_arrays(columns, ["kind", "gram", "cover", "doc", "lo", "n", "fdoc", "flo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: dict[str, np.ndarray] | None = None  # the last first of a cover so far; ``shown``: already given out as open
        shown = False
        for batch in batches:
            if not batch.num_rows:
                continue
            now = {c: np.asarray(batch.column(c)) if c != "copy" else batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            had = lead is not None
            if had:
                now = {c: np.concatenate([lead[c], now[c]]) for c in names}
            copied = now["copy"]
            same_gram, same_cover = np.zeros(len(copied), bool), np.zeros(len(copied), bool)
            same_gram[1:] = now["gram"][1:] == now["gram"][:-1]
            same_cover[1:] = same_gram[1:] & (now["cover"][1:] == now["cover"][:-1])
            at = np.maximum.accumulate(np.where(same_cover, 0, np.arange(len(copied))))
            repeat = same_cover & ((now["doc"] != now["doc"][at]) | (now["lo"] != now["lo"][at]))
            fresh = np.zeros(len(copied), bool)
            fresh[had:] = True
            yield out("copy", now, fresh & (repeat | copied), at)
            first = ~same_cover & ~copied
            other_before = first & same_gram
            # The first cover of a gram is open once a second one comes.
            firsts = np.flatnonzero(first)
            opened = other_before.copy()
            if len(firsts) > 1:
                follows = other_before[firsts[1:]] & (now["gram"][firsts[1:]] == now["gram"][firsts[:-1]])
                opened[firsts[:-1]] |= follows
            give = opened.copy()
            if had:
                give[0] &= not shown
            yield out("open", now, give)
            if with_firsts:
                yield out("first", now, fresh & first)
            if len(firsts):
                last = firsts[-1]
                shown = bool(opened[last]) or (had and last == 0 and shown)
                lead = {c: now[c][last : last + 1] for c in names}

    return rows.mapInArrow(run, FOUND)


def contents(docs: DataFrame, opened: DataFrame, spans: DataFrame | None, tokens: Callable[[pa.Array], Tokens], length: int) -> DataFrame:
    """(whole, gram, doc, lo, n, content) from one pass over the documents: all tokens of each of the ``opened(gram, doc, lo, n)`` units
    (whole), and a cryptographic digest of all tokens of each of the ``spans(doc, lo, n)``."""
    common.small_batches(docs.sparkSession)
    asked = opened.select(F.lit(True).alias("whole"), "gram", "doc", "lo", "n")
    if spans is not None:
        asked = asked.unionByName(spans.select(F.lit(False).alias("whole"), F.lit(0).cast("long").alias("gram"), "doc", "lo", "n").distinct())
    wanted = asked.groupBy("doc").agg(F.collect_list(F.struct("whole", "gram", "lo", "n")).alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = tokens(batch.column("text"))
            lists = batch.column("units")
            many = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            whole = flat.field(0).to_numpy(zero_copy_only=False)
            gram, lo, n = (np.asarray(flat.field(i)) for i in (1, 2, 3))
            row = np.repeat(np.arange(len(many)), many)
            begin = own.offsets[row] + lo
            size = n.astype(np.int64) - 1 + length
            doc = np.asarray(batch.column("doc"))[row]
            for some in np.array_split(np.arange(len(row)), max(1, int(size.sum()) // (4 * CHUNK))):
                parts = [
                    own.values[a : a + k].tobytes() if w else hashlib.blake2b(own.raw[own.at[a] : own.at[a + k]].tobytes(), digest_size=16).digest()
                    for a, k, w in zip(begin[some].tolist(), size[some].tolist(), whole[some].tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(whole[some]), pa.array(gram[some]), pa.array(doc[some]), pa.array(lo[some]), pa.array(n[some]), pa.array(parts, pa.binary())], ["whole", "gram", "doc", "lo", "n", "content"])

    return docs.join(wanted, "doc").mapInArrow(run, "whole boolean, gram long, doc long, lo long, n int, content binary")


def verified(copies: DataFrame, held: DataFrame) -> DataFrame:
    """(doc, lo, n) of the copies(doc, lo, n, fdoc, flo) whose tokens are those at (fdoc, flo), by the digests of ``contents``."""
    digests = held.where("not whole").select("doc", "lo", "n", "content").distinct()
    own = copies.where("fdoc is not null").join(digests, ["doc", "lo", "n"])
    first = digests.select(F.col("doc").alias("fdoc"), F.col("lo").alias("flo"), "n", F.col("content").alias("first"))
    same = own.join(first, ["fdoc", "flo", "n"]).where(F.col("content") == F.col("first"))
    return same.select("doc", "lo", "n").unionByName(copies.where("fdoc is null").select("doc", "lo", "n"))


def opened_windows(docs: DataFrame, opened: DataFrame, tokens: Callable[[pa.Array], Tokens], length: int, wide: int) -> DataFrame:
    """(doc, lo, n): windows of the ``opened`` units that start earlier too, compared one by one. ``wide``: bytes of a token."""
    return windows_of(contents(docs, opened, None, tokens, length), opened, length, wide)


def windows_of(held: DataFrame, opened: DataFrame, length: int, wide: int) -> DataFrame:
    """The same from the ``contents`` of the opened units."""
    units_of = held.where("whole").select("gram", "doc", "lo", "content")
    hot = opened.groupBy("gram").count().where(F.col("count") > HOT_COVERS).select("gram")
    if not hot.limit(1).count():
        return _compared(units_of, length, wide)
    units_of = common.stored(units_of)
    return _compared(units_of.join(hot, "gram", "left_anti"), length, wide).unionByName(_compared_by_shuffle(units_of.join(hot, "gram", "left_semi"), length, wide))


def _window_hashes(batch: pa.RecordBatch, length: int, wide: int) -> tuple[np.ndarray, ...]:
    """(hash, row of the batch, offset in the unit) of each window of the batch's units, then their tokens' values and where each window starts."""
    column = batch.column("content")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    values = data.view(np.uint64) if wide == 8 else data
    ends = (ends - ends[0]) // wide
    sizes = np.diff(ends) - length + 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    offset = common.segments(sizes)
    start = ends[:-1][row] + offset
    return common.slice_hash(common.prefix_sums(values), start, start + length), row, offset, values, start


def _compared(units_of: DataFrame, length: int, wide: int) -> DataFrame:
    """Units of one gram meet in one task, in order; a window that a gram already had is repeated."""
    spark = units_of.sparkSession
    dealt = units_of.repartition(common.partitions(spark), "gram").sortWithinPartitions("gram", "doc", "lo")

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, row, offset, values, start = _window_hashes(batch, length, wide)
        gram, doc, lo = (np.asarray(batch.column(c)) for c in ("gram", "doc", "lo"))
        keys = common.mix(hashes ^ gram.view(np.uint64)[row])
        order = np.argsort(keys, kind="stable")
        again = np.zeros(len(order), bool)
        sorted_keys = keys[order]
        same = sorted_keys[1:] == sorted_keys[:-1]
        lead = np.maximum.accumulate(np.where(np.concatenate([[False], same]), 0, np.arange(len(order))))
        first = order[lead]
        place = lo[row] + offset
        again[order] = (doc[row[order]] != doc[row[first]]) | (place[order] != place[first])
        hit = np.flatnonzero(again[order])  # equal hashes are not enough
        for k in range(length):
            again[order[hit[values[start[order[hit]] + k] != values[start[first[hit]] + k]]]] = False
        return _runs(again, row, doc, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            gram = np.asarray(batch.column("gram"))
            cut = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on in the next batch
            if cut == 0 and len(held) > 1 and held[-2].column("gram")[-1].as_py() == gram[-1]:
                continue
            whole = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]).combine_chunks()
            for part in whole.to_batches():
                yield judge(part)
            held = [batch.slice(cut)]
        if held:
            for part in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield judge(part)

    return dealt.mapInArrow(run, "doc long, lo long, n int")


def _runs(again: np.ndarray, row: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Consecutive repeated windows of a unit as one (doc, lo, n)."""
    hit = np.flatnonzero(again)
    if len(hit):
        first = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (row[hit][1:] != row[hit][:-1])]))
        n = np.diff(np.concatenate([first, [len(hit)]]))
        hit = hit[first]
    else:
        n = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(doc[row[hit]]), pa.array(place[hit]), pa.array(n.astype(np.int32))], ["doc", "lo", "n"])


def _compared_by_shuffle(units_of: DataFrame, length: int, wide: int) -> DataFrame:
    """The same for grams with very many covers: a row for each window, and the first of each by aggregation."""

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, row, offset, _, _ = _window_hashes(batch, length, wide)
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column("gram"))[row]), pa.array(hashes.view(np.int64)), pa.array(np.asarray(batch.column("doc"))[row]), pa.array(np.asarray(batch.column("lo"))[row] + offset)], ["gram", "hash", "doc", "lo"])

    windows = common.stored(common.map_batches(units_of, spread, "gram long, hash long, doc long, lo long"))
    first = windows.groupBy("gram", "hash").agg(F.min(F.struct("doc", "lo")).alias("first"))
    later = windows.join(first, ["gram", "hash"]).where(F.struct("doc", "lo") != F.col("first"))
    return later.select("doc", "lo", F.lit(1).alias("n"))


def with_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs(doc, text)`` with the array ``runs`` of their repeated windows (null: none)."""
    return docs.join(found.groupBy("doc").agg(F.collect_list(F.struct("lo", "n")).alias("runs")), "doc", "left")


def covered(sizes: np.ndarray, lists: pa.Array, offsets: np.ndarray, length: int) -> np.ndarray:
    """For each token of a batch whether a repeated window covers it."""
    many = np.where(np.asarray(lists.is_null()), 0, np.diff(np.asarray(lists.offsets)))
    flat = lists.flatten()
    edge = np.zeros(int(sizes.sum()) + 1, dtype=np.int32)
    if len(flat):
        row = np.repeat(np.arange(len(many)), many)
        begin = offsets[row] + np.asarray(flat.field(0))
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + np.asarray(flat.field(1)) - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0
