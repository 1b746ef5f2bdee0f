"""N-gram Jaccard join: links of documents whose sets of word shingles are alike, and the components they make.

A set is a document's distinct ``SHINGLE``-word shingles (with fewer words, the whole sequence as one). Sets link when
100 |x & y| >= 75 |x | y|. The join is exact; what it skips is proven to add nothing to the components:

* Equal sets are one vertex, the smallest id of them.
* Highly similar sets are found in *zones* (equal least hashes, confirmed by a sketch). In a zone each set is compared with
  a few leaders, then with the sets that link with most of them; from a leader's answer follow its relatives', so only sets
  outside of the zone's main component are compared with the rest. Zones only save work; no link depends on them.
* Any other link shares, at the front of both sets in one global order, ``shared(n)`` shingles. These front shingles are
  index lists, sorted by set size; for each set the part of a list that is too small for it is skipped by position (the first
  fitting one is found by bisection), and lists within one zone as a whole. Frequent shingles come last in the order, so long lists are rare. Where sets meet in one, they carry
  the parities of their shingles' counts by hash; as many as differ is a lower bound of the sets' difference, and pairs
  whose bound is too large to link aren't candidates.

Null and empty texts have the empty set, which links with nothing. Vertices are pairs of id and text: rows of one id, or of none, and
different texts are different vertices, and share a component only if their sets are linked. A component is named by the least id of
its rows, and by null if none has one. An empty table gives no rows; extra columns are ignored.

``join`` gives components only. ``all_links`` gives every link, of classes of equal sets, without zones or any other short cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from portrel.llm import common, repeats
from portrel.llm.components import components

SHINGLE = 5
PERCENT = 75
BINS, BANDS = 64, 16
LEADERS = 8
#: Equal cells of two sketches, of BINS, for which sets are tied to one zone.
ALIKE = 20
#: A zone of more sets is met as a whole by the lists: a set is a candidate for the zone, not for each of its members.
LARGE_ZONE = 8
#: Sets and shingles of one compared block; members of one group and task before it is split.
BLOCK, BLOCK_SHINGLES, GROUP = 2048, 1 << 20, 2_000
#: At most so many shingles that many leads share are compared by one matrix product, the others by index lists.
DENSE = 4096
#: Shingles that come to the front of more sets than this go last in the order, at any corpus size; the most frequent ones, at most so many, are told apart.
FREQUENT, FREQUENT_MOST = 32, 1 << 20
#: Rounds of counting; shingles that come to a front later still stay uncounted, their sets carry parities.
ROUNDS = 2
#: Ids that several rows share, and their texts, are broadcast up to so many.
SHARED_IDS = 100_000
#: Bits of a set's parities, by which sets that meet at frequent or uncounted shingles are told apart.
PARITIES = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ascending, and the n + 1 offsets of the texts."""
    data, offsets = common.text_bytes(texts)
    begin, end, first = common.word_spans(data, offsets)
    words = common.word_hashes(_LOWER[data], begin, end)
    many = np.diff(first)
    count = np.where(many > 0, np.maximum(many - size + 1, 1), 0)
    row = np.repeat(np.arange(len(many)), count)
    start = first[:-1][row] + common.segments(count)
    hashes = common.slice_hash(common.prefix_sums(words), start, start + np.minimum(many[row], size))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[fresh], hashes[fresh]
    return hashes, np.searchsorted(row, np.arange(len(many) + 1))


def _rows(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """(doc, n, h1, h2, bands, sketch): size of each document's set, two digests of it, hashes of groups of least shingles, and
    a byte of each least shingle."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, offsets = sets(batch.column("text"), size)
        row = _rows(offsets)
        rows = len(offsets) - 1
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(hashes ^ np.uint64(seed)))]) for seed in (1, 2)]
        digests = [s[offsets[1:]] - s[offsets[:-1]] for s in sums]
        bins = row * BINS + (hashes & np.uint64(BINS - 1)).astype(np.int64)
        cells, at = np.unique(bins, return_index=True)
        least = np.zeros(rows * BINS, np.uint64)
        least[cells] = hashes[at] | np.uint64(1)
        sketch = (common.mix(least) & np.uint64(255)).astype(np.uint8)
        cells_of = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((np.arange(rows + 1) * BINS).astype(np.int32)), pa.py_buffer(sketch)])
        least = least.reshape(rows, BANDS, -1)
        full = (least > 0).any(axis=2)
        band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (rows, BANDS)).copy()
        for i in range(least.shape[2]):
            band = common.mix(band + least[:, :, i])
        many = full.sum(axis=1)
        flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(band[full].view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(np.diff(offsets)), *(pa.array(d.view(np.int64)) for d in digests), flat, cells_of], ["doc", "n", "h1", "h2", "bands", "sketch"])

    return common.map_batches(docs, step, "doc long, n long, h1 long, h2 long, bands array<long>, sketch binary")


def shared(n: np.ndarray) -> np.ndarray:
    """Front shingles that a set of ``n`` asks of a partner; a pair asks for the smaller number of its two sets."""
    return np.clip(n // 8, 1, 8)


def _front(hashes: np.ndarray, offsets: np.ndarray, percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each shingle whether it is among its set's front ones in the order (frequent, hash), and whether it is frequent."""
    often = np.zeros(len(hashes), bool)
    if len(frequent) and len(hashes):
        often = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
    n = np.diff(offsets)
    row = _rows(offsets)
    seen = np.concatenate([[0], np.cumsum(often)])
    earlier = seen[:-1] - seen[offsets[:-1]][row]  # frequent shingles before this one
    rare = n - np.diff(seen[offsets])
    turn = np.where(often, rare[row] + earlier, np.arange(len(hashes)) - offsets[:-1][row] - earlier)
    return turn < np.minimum(n, n + (-percent * n // 100) + shared(n))[row], often


def frequent_shingles(texts: DataFrame, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles at the front of more than FREQUENT sets, ascending, and those known when fronts were counted last. As frequent ones
    go last, others come to the front, which are counted in the next round, each shingle of a set once at most."""
    found = before = np.zeros(0, np.uint64)
    for turn in range(ROUNDS):
        if len(found) >= FREQUENT_MOST:
            break
        counts = _newcomers(texts, size, percent, found, before if turn else None).groupBy("token").count().where(F.col("count") > FREQUENT)
        most = counts.orderBy(F.col("count").desc(), "token").limit(FREQUENT_MOST - len(found)).select("token").toArrow()
        common.release(texts.sparkSession)
        before, found = found, np.sort(np.concatenate([found, most.column("token").to_numpy().view(np.uint64)]))
        if not most.num_rows:
            break
    return found, before


def _newcomers(texts: DataFrame, size: int, percent: int, frequent: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """(token): front shingles of each set that aren't frequent, without those that were at its front by ``before``."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, offsets = sets(batch.column("text"), size)
        pick, often = _front(hashes, offsets, percent, frequent)
        pick &= ~often
        if before is not None:
            pick &= ~_front(hashes, offsets, percent, before)[0]
        return pa.RecordBatch.from_arrays([pa.array(hashes[pick].view(np.int64))], ["token"])

    return common.map_batches(texts, step, "token long")


def fronts(texts: DataFrame, size: int, percent: int, frequent: np.ndarray, counted: np.ndarray) -> DataFrame:
    """(token, v, n, zone, large, bits) of the front shingles of each set in the order (frequent, hash); bits: the set's parities,
    empty unless the shingle is frequent or wasn't at the front as fronts were counted, with the frequent ones ``counted``."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, offsets = sets(batch.column("text"), size)
        n = np.diff(offsets)
        row = _rows(offsets)
        pick, often = _front(hashes, offsets, percent, frequent)
        often |= ~_front(hashes, offsets, percent, counted)[0]
        where, marked = row[pick], often[pick]
        asked, of = np.unique(where[marked], return_inverse=True)
        bits = parities(hashes, offsets, asked)[of]
        ends = np.concatenate([[0], np.cumsum(marked * (PARITIES // 8))]).astype(np.int32)
        carried = pa.Array.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(ends), pa.py_buffer(bits)])
        return pa.RecordBatch.from_arrays([pa.array(hashes[pick].view(np.int64)), pa.array(np.asarray(batch.column("v"))[where]), pa.array(n[where].astype(np.int32)), pa.array(np.asarray(batch.column("zone"))[where]), pa.array(batch.column("large").to_numpy(zero_copy_only=False)[where]), carried], ["token", "v", "n", "zone", "large", "bits"])

    return common.map_batches(texts, step, "token long, v long, n int, zone long, large boolean, bits binary")


def parities(hashes: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """PARITIES bits for each set of ``which``: whether a bit's share of the set's shingles is odd. Sets differ in at least as
    many shingles as their parities differ in bits."""
    out = np.zeros((len(which), PARITIES // 8), np.uint8)
    for i, at in enumerate(which):
        own = (common.mix(hashes[offsets[at] : offsets[at + 1]]) & np.uint64(PARITIES - 1)).astype(np.int64)
        out[i] = np.packbits(np.bincount(own, minlength=PARITIES) & 1)
    return out


def candidates(posted: DataFrame, percent: int) -> DataFrame:
    """(a, b, whole) of different zones that share enough front shingles: a set ``a`` with a set ``b``, or if ``whole`` with any set
    of the large zone ``b``. Each task walks its lists in order, sorted by set size."""
    spark = posted.sparkSession
    common.small_batches(spark)
    dealt = posted.repartition(common.partitions(spark), "token").sortWithinPartitions("token", "n", "v")

    def counted(a: np.ndarray, b: np.ndarray, need: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
        if len(a):
            order = np.lexsort((need, b, a))
            a, b, need = a[order], b[order], need[order]
            fresh = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            times = np.diff(np.concatenate([fresh, [len(a)]]))
            yield pa.RecordBatch.from_arrays([pa.array(a[fresh]), pa.array(b[fresh]), pa.array(np.full(len(fresh), whole)), pa.array(need[fresh].astype(np.int32)), pa.array(times)], ["a", "b", "whole", "need", "times"])

    def may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, bits: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether the parities of sets x and y leave it open that they link: |x ^ y| is at most (|x| + |y|) (100 - percent) / (100 + percent)."""
        open_ = np.ones(len(x), bool)
        told = np.flatnonzero((row[x] >= 0) & (row[y] >= 0))
        for part in np.array_split(told, len(told) // (1 << 17) + 1):
            differ = np.bitwise_count(bits[row[x[part]]] ^ bits[row[y[part]]]).sum(axis=1, dtype=np.int64)
            open_[part] = differ * (100 + percent) <= (n[x[part]].astype(np.int64) + n[y[part]]) * (100 - percent)
        return open_

    def pairs_of(v: np.ndarray, n: np.ndarray, zone: np.ndarray, bits: np.ndarray, row: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of lists at [begin, begin + size), sorted by size: each set with those before it from the first that is large enough on, of
        other zones and alike by their parities (rows of ``bits``; -1: none)."""
        member = np.repeat(begin, size) + common.segments(size)
        # Lists follow each other and are sorted by size, so list and size together ascend.
        part = np.repeat(np.arange(len(begin), dtype=np.int64) << 32, size)
        own = n[member].astype(np.int64)
        place = np.arange(len(member))
        back = place - np.searchsorted(part + own, part - (-percent * own // 100))
        at = 0
        while at < len(member):  # about a million pairs at a time
            stop = at + max(1, int(np.searchsorted(np.cumsum(back[at:]), 1 << 20, side="right")))
            later = np.repeat(place[at:stop], back[at:stop])
            later, earlier = member[later], member[later - 1 - common.segments(back[at:stop])]
            ok = zone[later] != zone[earlier]
            later, earlier = later[ok], earlier[ok]
            ok = may_link(later, earlier, n, bits, row)
            a, b = v[later[ok]], v[earlier[ok]]
            need = shared(np.minimum(n[later[ok]], n[earlier[ok]]))
            yield from counted(np.minimum(a, b), np.maximum(a, b), need, False)
            at = stop

    def zones_of(v: np.ndarray, n: np.ndarray, zone: np.ndarray, large: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Each set of these lists with the other large zones that have a set of fitting size in the list. Of two large zones
        the sets of the one with the greater id ask."""
        number = np.repeat(np.arange(len(begin)), size)
        member = np.repeat(begin, size) + common.segments(size)
        big = member[large[member]]
        order = np.lexsort((zone[big], number[large[member]]))
        big, of = big[order], number[large[member]][order]
        first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (zone[big][1:] != zone[big][:-1])])) if len(big) else np.zeros(0, np.int64)
        if not len(first):
            return
        least, most = np.minimum.reduceat(n[big], first).astype(np.int64), np.maximum.reduceat(n[big], first).astype(np.int64)
        whose, kind = of[first], zone[big][first]
        low = np.searchsorted(whose, number)
        many = np.searchsorted(whose, number, side="right") - low
        at = 0
        while at < len(member):
            stop = at + max(1, int(np.searchsorted(np.cumsum(many[at:]), 1 << 20, side="right")))
            x = np.repeat(member[at:stop], many[at:stop])
            z = np.repeat(low[at:stop], many[at:stop]) + common.segments(many[at:stop])
            own = n[x].astype(np.int64)
            ok = (zone[x] != kind[z]) & (~large[x] | (zone[x] > kind[z])) & (100 * most[z] >= percent * own) & (100 * own >= percent * least[z])
            yield from counted(v[x[ok]], kind[z[ok]], shared(-(-percent * own[ok] // 100)), True)
            at = stop

    def lists(table: pa.Table) -> Iterator[pa.RecordBatch]:
        token, v, n, zone, large = (table.column(c).to_numpy() for c in ("token", "v", "n", "zone", "large"))
        carried = table.column("bits").combine_chunks()
        ends = np.frombuffer(carried.buffers()[1], np.int32)[carried.offset : carried.offset + len(carried) + 1] // (PARITIES // 8)
        bits = np.frombuffer(carried.buffers()[2], np.uint64, ends[-1] * (PARITIES // 64)).reshape(-1, PARITIES // 64) if ends[-1] else np.zeros((0, PARITIES // 64), np.uint64)
        row = np.where(np.diff(ends) > 0, ends[:-1], -1)
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.concatenate([begin, [len(token)]]))
        mixed = (np.minimum.reduceat(zone, begin) != np.maximum.reduceat(zone, begin)) if len(begin) else np.zeros(0, bool)
        if mixed.any():
            yield from zones_of(v, n, zone, large, begin[mixed], size[mixed])
            inside = np.repeat(mixed, size) & ~large  # the rest of these lists, without the large zones' sets
            v, n, zone, token, row = v[inside], n[inside], zone[inside], token[inside], row[inside]
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([begin, [len(token)]]))
            yield from pairs_of(v, n, zone, bits, row, begin, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 400_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            token = table.column("token").to_numpy()
            cut = int(np.searchsorted(token, token[-1]))
            if cut:
                yield from lists(table.slice(0, cut))
            held, rows = table.slice(cut).combine_chunks().to_batches(), 0
        if held:
            yield from lists(pa.Table.from_batches(held).combine_chunks())

    seen = dealt.mapInArrow(run, "a long, b long, whole boolean, need int, times long")
    enough = seen.groupBy("a", "b", "whole").agg(F.sum("times").alias("times"), F.min("need").alias("need")).where(F.col("times") >= F.col("need"))
    return enough.select("a", "b", "whole")


def with_sets(texts: DataFrame, size: int) -> DataFrame:
    """(v, tokens): the sets as sorted hashes in bytes."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, offsets = sets(batch.column("text"), size)
        binary = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(hashes)])
        return pa.RecordBatch.from_arrays([batch.column("v"), binary], ["v", "tokens"])

    return common.map_batches(texts, step, "v long, tokens binary")


def links(grouped: DataFrame, percent: int) -> DataFrame:
    """(a, b): in each ``part`` of ``grouped(part, lead, v, tokens)``, the members that link with one of its leads.

    A part's leads come first and are held; its members pass by in batches and are compared with all leads at once: shingles
    that many leads share as a product of two presence matrices, the rest by index lists, which are short then.
    """
    spark = grouped.sparkSession
    common.small_batches(spark)
    dealt = grouped.repartition(common.partitions(spark), "part").sortWithinPartitions("part", F.col("lead").desc(), "v")

    def indexed(lead_v: np.ndarray, lead_n: np.ndarray, flat: np.ndarray) -> tuple:
        whose = np.repeat(np.arange(len(lead_v)), lead_n)
        order = np.argsort(flat, kind="stable")
        flat, whose = flat[order], whose[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([first, [len(flat)]]))
        often = np.flatnonzero(times >= max(4, len(lead_v) // 32))
        if len(often) > DENSE:
            often = np.sort(often[np.argpartition(-times[often], DENSE)[:DENSE]])
        dense = np.zeros(len(times), bool)
        dense[often] = True
        in_dense = np.repeat(dense, times)
        shared_ones = flat[first][dense]
        table = np.zeros((len(lead_v), len(shared_ones)), np.float32)
        table[whose[in_dense], np.repeat(np.arange(len(shared_ones)), times[dense])] = 1
        return lead_v, lead_n, shared_ones, table, flat[~in_dense], whose[~in_dense]

    def compare(leads: tuple, v: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        lead_v, lead_n, shared_ones, table, index, whose = leads
        row = np.repeat(np.arange(len(v)), sizes)
        both = np.zeros((len(v), len(lead_v)))
        if len(shared_ones):
            at = np.minimum(np.searchsorted(shared_ones, tokens), len(shared_ones) - 1)
            hit = shared_ones[at] == tokens
            mine = np.zeros((len(v), len(shared_ones)), np.float32)
            mine[row[hit], at[hit]] = 1
            both += mine @ table.T
            row, tokens = row[~hit], tokens[~hit]
        low = np.searchsorted(index, tokens)
        many = np.searchsorted(index, tokens, side="right") - low
        found = np.repeat(low, many) + common.segments(many)
        both += np.bincount(np.repeat(row, many) * len(lead_v) + whose[found], minlength=both.size).reshape(both.shape)
        linked = 100 * both >= percent * (sizes[:, None] + lead_n[None, :] - both)
        r, c = np.nonzero(linked & (v[:, None] != lead_v[None, :]))
        return pa.RecordBatch.from_arrays([pa.array(lead_v[c]), pa.array(v[r])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, leads = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, lead = np.asarray(batch.column("part")), batch.column("lead").to_numpy(zero_copy_only=False)
            column, v = batch.column("tokens"), np.asarray(batch.column("v"))
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 8
            whole = np.frombuffer(column.buffers()[2], np.uint64) if column.buffers()[2] else np.zeros(0, np.uint64)
            cuts = np.flatnonzero(np.concatenate([[True], (parts[1:] != parts[:-1]) | (lead[1:] != lead[:-1]), [True]]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if parts[a] != part:
                    part, held, leads = parts[a], [], None
                own, sizes = whole[ends[a] : ends[b]], np.diff(ends[a : b + 1])
                if lead[a]:
                    held.append((v[a:b].copy(), sizes, own.copy()))
                    continue
                if leads is None and held:
                    leads = indexed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                if leads is not None:
                    yield compare(leads, v[a:b], own, sizes)

    return dealt.mapInArrow(run, "a long, b long")


def _salted(members: DataFrame, group: str) -> DataFrame:
    """Split the members of each group into parts of about GROUP sets: adds ``salt``."""
    many = members.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("salts"))
    return members.join(many, group).withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts"))).drop("salts")


def _groups(leads: DataFrame, members: DataFrame, known: DataFrame, group: str) -> DataFrame:
    """Rows for ``links``: each part gets its leads' and its members' sets from ``known(v, tokens)``."""
    salted = _salted(members, group)
    parts = salted.select(group, "salt").distinct()
    part = F.xxhash64(group, "salt").alias("part")
    left = leads.join(parts, group).select(part, F.lit(True).alias("lead"), "v")
    right = salted.select(part, F.lit(False).alias("lead"), "v")
    return left.unionByName(right).join(known, "v").select("part", "lead", "v", "tokens")


def zones(profile: DataFrame) -> DataFrame:
    """(v, zone): sets that are tied by equal bands and like sketches, directly or by others."""
    banded = common.stored(profile.select(F.col("doc").alias("v"), F.explode("bands").alias("band")))
    first = banded.groupBy("band").agg(F.min("v").alias("first"), F.count(F.lit(1)).alias("many")).where(F.col("many") > 1)
    tied = banded.join(first, "band").where(F.col("first") != F.col("v")).select(F.col("first").alias("a"), F.col("v").alias("b")).distinct()
    sketches = profile.select("doc", "sketch")
    both = tied.join(sketches.withColumnsRenamed({"doc": "a", "sketch": "left"}), "a").join(sketches.withColumnsRenamed({"doc": "b", "sketch": "right"}), "b")

    def alike(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("left", "right"))
        return batch.select(["a", "b"]).filter(pa.array((left == right).sum(axis=1) >= ALIKE))

    return components(common.map_batches(both, alike, "a long, b long")).select("v", F.col("component").alias("zone"))


def zone_links(placed: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Enough links within zones to know their components: by leaders, then by what is outside each main component."""
    by_leaders = common.stored(links(_groups(_leaders(placed, F.lit(0)), placed, known, "zone"), percent))
    large = placed.groupBy("zone").count().where(F.col("count") > LEADERS).select("zone")
    crowd = common.stored(placed.join(large, "zone").select("v", "zone"))
    times = by_leaders.groupBy(F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("times"))
    central = _leaders(crowd.join(times, "v"), -F.col("times"))
    found = by_leaders.unionByName(common.stored(links(_groups(central, crowd, known, "zone"), percent)))

    labelled = common.stored(crowd.join(components(found), "v", "left").select("v", "zone", F.coalesce("component", "v").alias("label")))
    main = labelled.groupBy("zone", "label").count().groupBy("zone").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rest = labelled.join(main, "zone").where(F.col("label") != F.col("main")).select("v", "zone")
    return found.unionByName(against_zones(rest, labelled.select("v", "zone"), known, percent))


def against_zones(asking: DataFrame, placed: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links of sets ``asking(v, zone)`` with all sets of the zone they ask, in blocks of asking sets."""
    sized = asking.join(known.select("v", (F.length("tokens") / 8).alias("n")), "v")
    blocks = sized.groupBy("zone").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    blocked = sized.join(blocks, "zone").withColumn("block", F.pmod(F.xxhash64("v", F.lit(7)), F.col("blocks")))
    blocked = common.stored(blocked.select("v", F.xxhash64("zone", "block").alias("group"), "zone"))
    asked = placed.join(blocked.select("zone", "group").distinct(), "zone").select("v", "group")
    return links(_groups(blocked.select("v", "group"), asked, known, "group"), percent)


def _leaders(placed: DataFrame, before: Column) -> DataFrame:
    """LEADERS sets of each zone, least by ``before`` and hash; they are ranked within random parts first, so that no task
    ranks a whole zone."""
    order = (before, F.xxhash64("v", F.lit(3)), F.col("v"))
    part = placed.withColumn("slice", F.pmod(F.xxhash64("v", F.lit(5)), F.lit(64)))
    part = part.withColumn("turn", F.row_number().over(W.partitionBy("zone", "slice").orderBy(*order))).where(F.col("turn") <= LEADERS)
    return part.withColumn("turn", F.row_number().over(W.partitionBy("zone").orderBy(*order))).where(F.col("turn") <= LEADERS).select("v", "zone")


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs(doc_id, text)``."""
    rows, shared_ids = numbered(docs.select("doc_id", "text"))
    parts = _components(rows.select(F.col("_v").alias("doc"), "text"), size, percent)
    if shared_ids is None:
        own = lambda c: F.when(F.col(c) != repeats.NO_ID, F.col(c))
        return parts.select(own("doc").alias("doc_id"), F.col("n").alias("n_shingles"), own("component").alias("component_id"))
    id_of = shared_ids.select(F.col("_v").alias("doc"), F.col("doc_id").alias("own"), F.lit(True).alias("shared"))
    known = parts.join(id_of, "doc", "left").select("doc", "n", "component", F.when(F.col("shared"), F.col("own")).otherwise(F.col("doc")).alias("doc_id"))
    known = common.stored(known)
    least = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return known.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs``, with all its columns, of each component: one of the least id (nulls last); of equal ids and texts any."""
    rows, shared_ids = numbered(docs)
    parts = common.stored(_components(rows.select(F.col("_v").alias("doc"), "text"), size, percent))
    if shared_ids is None:
        return rows.join(parts.where("doc = component").select(F.col("doc").alias("_v")), "_v", "left_semi").drop("_v")
    id_of = shared_ids.select(F.col("_v").alias("doc"), F.col("doc_id").alias("own"), F.lit(True).alias("shared"))
    known = parts.select("doc", "component").join(id_of, "doc", "left").withColumn("id", F.when(F.col("shared"), F.col("own")).otherwise(F.col("doc")))
    first = common.stored(known.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc")).alias("first")).select(F.col("first.doc").alias("_v")))
    kept = rows.join(first, "_v", "left_semi")
    again = shared_ids.where("many > 1").select("_v")
    once = kept.join(again, "_v", "left_semi").dropDuplicates(["_v"])
    return kept.join(again, "_v", "left_anti").unionByName(once).drop("_v")


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with the vertex ``_v`` of each row, and (_v, doc_id, many) of the vertices whose id several rows share.

    A row's id is its vertex where no other row has it (a single null: the least long). Of shared ids each different text, by a
    cryptographic digest, gets a number that is no row's id.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(repeats.NO_ID))
    keyed = docs.withColumn("_v", doc)
    several = keyed.groupBy("_v").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("_v")
    several = common.stored(several)
    some = several.count()
    if not some:
        return keyed, None
    small = several if some > SHARED_IDS else F.broadcast(several)
    digest = F.sha2(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")), 256)
    told = keyed.join(small, "_v", "left_semi").withColumn("_digest", digest)
    ends = keyed.where(F.col("_v") != repeats.NO_ID).agg(F.min("_v"), F.max("_v")).head()
    low, high = (0, 0) if ends[0] is None else ends
    texts = told.groupBy("_v", "_digest").agg(F.count(F.lit(1)).alias("many")).withColumn("_number", F.monotonically_increasing_id())
    room = (1 << 63) - 1 - high > low + (1 << 63)  # numbers go where there is more room: after all ids, or before them
    number = F.lit(high) + 1 + F.col("_number") if room else F.lit(low) - 1 - F.col("_number")
    names = common.stored(texts.select("_v", "_digest", "many", number.alias("_new")))
    pairs = names.select("_v", "_digest", "_new")
    own = told.join(F.broadcast(pairs) if names.count() <= SHARED_IDS else pairs, ["_v", "_digest"]).drop("_v", "_digest").withColumnRenamed("_new", "_v")
    rows = keyed.join(small, "_v", "left_anti").unionByName(own)
    return rows, names.select(F.col("_new").alias("_v"), F.when(F.col("_v") != repeats.NO_ID, F.col("_v")).alias("doc_id"), "many")


def _components(keyed: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc, n, component) of each row of ``keyed(doc, text)``; rows of one ``doc`` have one text."""
    spark = keyed.sparkSession
    common.small_batches(spark)
    done: list[str] = []  # steps that nothing reads once the links are known
    profile = common.stored(profiles(keyed, size), done)
    same = profile.where(F.col("n") > 0).groupBy("n", "h1", "h2").agg(F.min("doc").alias("first"))
    classes = common.stored(profile.select("doc", "n", "h1", "h2").join(same, ["n", "h1", "h2"], "left").select("doc", "n", F.coalesce("first", "doc").alias("v")))
    vertices = classes.where((F.col("n") > 0) & (F.col("doc") == F.col("v"))).select("v").distinct()
    placed = common.stored(zones(profile.where(F.col("n") > 0).join(vertices.withColumnRenamed("v", "doc"), "doc", "left_semi")))
    many = placed.groupBy("zone").agg((F.count(F.lit(1)) > LARGE_ZONE).alias("large"))
    zoned = F.col("zone").isNotNull()
    where = vertices.join(placed.join(many, "zone"), "v", "left").select("v", F.coalesce("zone", "v").alias("zone"), zoned.alias("zoned"), F.coalesce("large", F.lit(False)).alias("large"))
    common.small_batches(spark)
    # Both tables grow with the corpus: they are merged at every size, never broadcast.
    texts = common.stored(keyed.withColumnRenamed("doc", "v").join(where.hint("merge"), "v"), done)
    near = common.stored(with_sets(texts.where("zoned"), size), done)
    within = common.stored(zone_links(placed, near, percent))

    common.small_batches(spark)
    frequent, counted = frequent_shingles(texts, size, percent)
    pairs = common.stored(candidates(fronts(texts, size, percent, frequent, counted), percent))
    single, whole = pairs.where("not whole"), pairs.where("whole")
    ends = single.select(F.explode(F.array("a", "b")).alias("v")).unionByName(whole.select(F.col("a").alias("v"))).distinct()
    common.small_batches(spark)
    asked = common.stored(with_sets(texts.join(ends.hint("merge"), "v", "left_semi"), size), done)
    grouped = _groups(single.select(F.col("a").alias("v"), "a").distinct(), single.select(F.col("b").alias("v"), "a"), asked, "a")
    across = common.stored(links(grouped, percent))
    both = near.unionByName(asked.join(placed.select("v"), "v", "left_anti"))
    with_zones = common.stored(against_zones(whole.select(F.col("a").alias("v"), F.col("b").alias("zone")), placed, both, percent))
    common.discard(spark, done)

    parts = components(within.unionByName(across).unionByName(with_zones))
    return classes.join(parts, "v", "left").select("doc", "n", F.coalesce("component", "v").alias("component"))


def all_links(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links of ``docs(doc_id, text)``: members(doc_id, n_shingles, set_id, n_links, component_id) and pairs(a, b).

    ``set_id`` names a class of equal sets, whatever the rows' ids; each pair of linked classes comes once, as a < b. All sets of
    two linked classes, and all within a class, are linked: ``n_links`` is the number of other rows that a row links with.
    Components come from the pairs and have the least id of their rows that isn't null. An empty set is a class of its own.
    """
    spark = docs.sparkSession
    done: list[str] = []
    # Numbered once and written: rows with one id, or none, and different texts are different vertices.
    rows = common.stored(repeats.keyed(docs).withColumn("row", F.monotonically_increasing_id()), done)
    common.small_batches(spark)
    profile = common.stored(profiles(rows.select(F.col("row").alias("doc"), "text"), size).select(F.col("doc").alias("row"), "n", "h1", "h2"), done)
    same = profile.where(F.col("n") > 0).groupBy("n", "h1", "h2").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("equal"))
    placed = profile.join(same, ["n", "h1", "h2"], "left").select("row", "n", F.coalesce("first", "row").alias("v"), F.coalesce("equal", F.lit(1)).alias("equal"))
    members = common.stored(placed.join(rows.select("row", "doc").hint("merge"), "row"))

    vertices = members.where((F.col("n") > 0) & (F.col("row") == F.col("v"))).select("v")
    texts = common.stored(rows.select(F.col("row").alias("v"), "text").join(vertices.hint("merge"), "v").withColumns({"zone": F.col("v"), "large": F.lit(False)}), done)
    common.small_batches(spark)
    frequent, counted = frequent_shingles(texts, size, percent)
    met = common.stored(candidates(fronts(texts, size, percent, frequent, counted), percent).select("a", "b"), done)
    common.small_batches(spark)
    ends = met.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    known = common.stored(with_sets(texts.join(ends.hint("merge"), "v", "left_semi"), size), done)
    grouped = _groups(met.select(F.col("a").alias("v"), "a").distinct(), met.select(F.col("b").alias("v"), "a"), known, "a")
    found = links(grouped, percent)
    pairs = common.stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    common.discard(spark, done)

    many = members.select("v", "equal").distinct()
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ways.join(many.withColumnsRenamed({"v": "b"}), "b").groupBy(F.col("a").alias("v")).agg(F.sum("equal").alias("others"))
    joined = members.join(linked, "v", "left").join(components(pairs), "v", "left").withColumn("root", F.coalesce("component", "v"))
    doc = F.when(F.col("doc") != repeats.NO_ID, F.col("doc"))
    least = joined.groupBy("root").agg(F.min(doc).alias("component_id"))
    links_of = F.col("equal") - 1 + F.coalesce("others", F.lit(0))
    return joined.join(least, "root").select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), F.col("v").alias("set_id"), links_of.alias("n_links"), "component_id"), pairs
