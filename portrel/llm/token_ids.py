"""Token ids as files: whole texts encoded by a word-end BPE, stored in patched frame-of-reference blocks, read back.

A file is a Parquet part whose rows are chunks. A chunk holds the ids of whole documents in ascending ``doc_id`` order
(about ``CHUNK_IDS`` ids, more only where one document is longer) and lists those documents and their id counts. Its
payload is cut into blocks of ``BLOCK`` ids. A block keeps its minimum; the differences from it are packed at the width that
holds the ``PERCENTILE`` of them; what is wider goes to the chunk's exception list. Block starts are indexed, so a block
can be read alone.

Texts are encoded as the tokenizers library does it with the vocabulary file as it is, so a special token that a text spells out
is that token. Nulls and empty texts are documents of one id, the end id. Rows with a null ``doc_id`` come first. Repeated rows are
kept, each a document of its own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrel.llm import common

BLOCK = 1024
LANES = 32
PERCENTILE = 90
CHUNK_IDS = 1 << 17
END_ID = 1
#: Characters and ids that a worker remembers of pieces, in two generations; results don't depend on it.
MEMO_BYTES = 160 << 20

#: White space besides ASCII's.
_SPACES = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: A run of Latin-1 letters, then nothing or an ASCII character that is no letter: neither composition nor the
#: tokenizer's own split joins the two parts.
_CUT = r"(?s)^(?P<run>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<rest>[\x21-\x40\x5b-\x60\x7b-\x7e].*)?\z"


class Words:
    """From texts to their ids as bytes: Arrow cuts texts into words, different words are cut into pieces, and only pieces that
    are new go to the tokenizer; white space never joins words' ids."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.held = 0
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        # A special token may take in white space beside it, so a text that spells one isn't cut into words.
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special, self.folded = [t.content for t in added], [t.content for t in added if t.normalized]
        self.fold = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        latin = "".join(map(chr, range(256)))
        if self.fold(latin) != self.fold(latin.lower()):
            raise ValueError("the tokenizer doesn't lower-case; texts can't be folded")

    def learn_runs(self, runs: list[str]) -> None:
        """Ids of letter runs, many in one call; a run is one word to the tokenizer, and only its last id closes a word."""
        for at in range(0, len(runs), 2000):
            some = runs[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * np.flatnonzero(self.closes[ids]) + 4).tolist()
            if len(ends) != len(some):
                raise ValueError("the tokenizer has no word ends; letter runs can't be told apart")
            raw = ids.tobytes()
            self.known.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def spells(self, text: str) -> bool:
        """Whether the tokenizer may find a special token in a text; some are looked for after normalisation."""
        return any(t in text for t in self.special) or bool(self.folded) and any(t in self.fold(text) for t in self.folded)

    def ids(self, column: pa.Array, runs: bool) -> pa.Array:
        """The ids of each piece of a column, as bytes; each different piece is looked up once."""
        coded = column.dictionary_encode()
        # One string for all pieces, as none holds a line end: much faster than a scalar for each.
        distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), "\n")[0].as_py().split("\n")
        new = [p for p in distinct if p not in self.known]
        self.held += sum(map(len, new)) * 12 + 200 * len(new)
        again = [p for p in new if p in self.older]
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        new = [p for p in new if p not in self.older]
        if runs:
            self.learn_runs(new)
        else:
            self.known.update((p, self.whole(p)) for p in new)
        return pa.array(list(map(self.known.__getitem__, distinct)), pa.large_binary()).take(coded.indices)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        if not texts:
            return []
        if self.held > MEMO_BYTES // 2:
            self.known, self.older, self.held = {"": b""}, self.known, 0
        folded = [lowered(t) if t else "" for t in texts]
        # Lower-casing may spell a special token where there is none, so such a text isn't cut either.
        apart = {i: self.whole(t) for i, (t, low) in enumerate(zip(texts, folded, strict=True)) if t and (self.spells(t) or self.spells(low))}
        split = pc.ascii_split_whitespace(pa.array(["" if i in apart else low for i, low in enumerate(folded)], pa.string()))
        words = split.flatten().dictionary_encode()
        cut = pc.extract_regex(words.dictionary, _CUT)
        run, rest = pc.struct_field(cut, "run"), pc.struct_field(cut, "rest")
        rest = pc.if_else(pc.is_valid(run), rest.fill_null(""), words.dictionary)
        own = pc.binary_join_element_wise(self.ids(run.fill_null(""), True), self.ids(rest, False), pa.scalar(b"", pa.large_binary()))
        ids = own.take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[np.cumsum(split.value_lengths().to_numpy())].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [apart[i] if i in apart else bytes(raw[begin:end]) for i, (begin, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True))]


def lowered(text: str) -> str:
    """A text of Latin-1 in lower case, others as they are; white space as ASCII's. To the tokenizer this is the same text."""
    if not text.isascii():
        text = _SPACES.sub(" ", text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


@lru_cache(maxsize=2)
def words(file: str) -> Words:
    return Words(file)


def pack(ids: np.ndarray) -> bytes:
    """Patched frame-of-reference bytes of ``ids``.

    Layout, little-endian: counts of ids, blocks and exceptions; per block minimum, width, start word of its packed bits;
    exception positions and whole differences; then the packed words. Inside a block, ids are 32 rows of 32 lanes, and a
    lane's bits follow each other in its own words.
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return struct.pack("<QII", 0, 0, 0)
    full = np.empty(blocks * BLOCK, dtype=np.uint32)
    full[:n] = ids
    full[n:] = ids[-1]
    rows = full.reshape(blocks, BLOCK)
    least = rows.min(axis=1)
    over = rows - least[:, None]
    at = BLOCK * PERCENTILE // 100
    limit = np.partition(over, at, axis=1)[:, at]
    width = np.zeros(blocks, dtype=np.uint8)
    for bit in range(32):
        width[limit >> np.uint32(bit) > 0] = bit + 1
    start = np.zeros(blocks + 1, dtype=np.uint32)
    np.cumsum(width.astype(np.uint32) * LANES, out=start[1:])
    packed = np.zeros(int(start[-1]), dtype=np.uint32)
    where, what = [], []
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        part = over[own]
        wide = part >= (np.uint64(1) << np.uint64(w))
        if wide.any():
            r, c = np.nonzero(wide)
            where.append(own[r].astype(np.uint32) * np.uint32(BLOCK) + c.astype(np.uint32))
            what.append(part[r, c])
            part[wide] = 0
        if w:
            lanes = part.reshape(len(own), LANES, LANES)
            out = np.zeros((len(own), int(w), LANES), dtype=np.uint32)
            for i in range(LANES):
                word, shift = divmod(i * int(w), 32)
                out[:, word] |= lanes[:, i] << np.uint32(shift)
                if shift + w > 32:
                    out[:, word + 1] |= lanes[:, i] >> np.uint32(32 - shift)
            packed[(start[own][:, None] + np.arange(int(w) * LANES, dtype=np.uint32))] = out.reshape(len(own), -1)
    where = np.concatenate(where) if where else np.zeros(0, np.uint32)
    what = np.concatenate(what) if what else np.zeros(0, np.uint32)
    head = struct.pack("<QII", n, blocks, len(where))
    return b"".join([head, least.tobytes(), width.tobytes(), start[:-1].tobytes(), where.tobytes(), what.tobytes(), packed.tobytes()])


def unpack(data: bytes) -> np.ndarray:
    """The ids behind the bytes of ``pack``."""
    n, blocks, patches = struct.unpack_from("<QII", data)
    at = 16

    def take(kind: type, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, dtype=kind, count=count, offset=at)
        at += found.nbytes
        return found

    if not n:
        return np.zeros(0, np.uint32)
    least, width, start = take(np.uint32, blocks), take(np.uint8, blocks), take(np.uint32, blocks)
    where, what = take(np.uint32, patches), take(np.uint32, patches)
    packed = take(np.uint32, (len(data) - at) // 4)
    over = np.zeros((blocks, BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        own = np.flatnonzero(width == w)
        bits = packed[start[own][:, None] + np.arange(int(w) * LANES, dtype=np.uint32)].reshape(len(own), int(w), LANES)
        keep = np.uint32((1 << int(w)) - 1)
        lanes = np.empty((len(own), LANES, LANES), dtype=np.uint32)
        for i in range(LANES):
            word, shift = divmod(i * int(w), 32)
            value = bits[:, word] >> np.uint32(shift)
            if shift + w > 32:
                value = value | bits[:, word + 1] << np.uint32(32 - shift)
            lanes[:, i] = value & keep
        over[own] = lanes.reshape(len(own), BLOCK)
    flat = over.reshape(-1)
    flat[where] = what
    return (over + least[:, None]).reshape(-1)[:n]


def unpack_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block behind the bytes of ``pack``: only its index entry, its packed words and the exceptions are read."""
    n, blocks, patches = struct.unpack_from("<QII", data)
    if not 0 <= block < blocks:
        raise IndexError(f"no block {block} of {blocks}")
    at_width, at_start = 16 + 4 * blocks, 16 + 5 * blocks
    at_where = at_start + 4 * blocks
    at_packed = at_where + 8 * patches
    least, start = struct.unpack_from("<I", data, 16 + 4 * block)[0], struct.unpack_from("<I", data, at_start + 4 * block)[0]
    width = data[at_width + block]
    bits = np.frombuffer(data, np.uint32, width * LANES, at_packed + 4 * start).reshape(width, LANES)
    over = np.zeros((LANES, LANES), np.uint32)
    for i in range(LANES if width else 0):
        word, shift = divmod(i * width, 32)
        value = bits[word] >> np.uint32(shift)
        if shift + width > 32:
            value = value | bits[word + 1] << np.uint32(32 - shift)
        over[i] = value & np.uint32((1 << width) - 1)
    over = over.reshape(BLOCK)
    where = np.frombuffer(data, np.uint32, patches, at_where)
    own = np.flatnonzero(where // np.uint32(BLOCK) == block)
    over[where[own] % np.uint32(BLOCK)] = np.frombuffer(data, np.uint32, patches, at_where + 4 * patches)[own]
    return (over + np.uint32(least))[: min(BLOCK, n - block * BLOCK)]


def ids_of(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents ``doc_ids(doc_id)``: of their chunks only the blocks are unpacked that they lie in."""
    common.small_batches(chunks.sparkSession)
    wanted = doc_ids.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    places = chunks.select("bucket", "before", F.posexplode("doc_ids").alias("place", "doc_id"))
    asked = places.join(wanted, "doc_id", "left_semi").groupBy("bucket", "before").agg(F.collect_list("place").alias("asked"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, found = [], []
        for ids, counts, asked, payload in zip(batch.column("doc_ids"), batch.column("counts"), *(batch.column(c).to_pylist() for c in ("asked", "payload")), strict=True):
            ends = np.cumsum(np.asarray(counts.values))
            for k in asked:
                n, at = counts[k].as_py(), int(ends[k]) - counts[k].as_py()
                first = at // BLOCK
                blocks = [unpack_block(payload, b) for b in range(first, (at + n - 1) // BLOCK + 1)]
                docs.append(ids[k].as_py())
                found.append(np.concatenate(blocks)[at - first * BLOCK :][:n].astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return common.map_batches(chunks.join(asked, ["bucket", "before"]).select("doc_ids", "counts", "asked", "payload"), step, "doc_id long, ids array<long>")


CHUNKS = "bucket int, before long, doc_ids array<long>, counts array<long>, payload binary"


def write_ids(docs: DataFrame, path: str, file: str, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write the chunk files to ``path``; returns the files read as a table."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select("doc_id", "text")
    cuts = common.bucket_bounds(docs, "doc_id", 4 * common.partitions(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = words(file)
        end = struct.pack("<I", end_id)
        bucket, before, ids, counts, parts, held = None, 0, [], [], [], 0

        def chunk() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(parts), dtype="<u4"))
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([before], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([payload], pa.binary())], ["bucket", "before", "doc_ids", "counts", "payload"])

        for batch in batches:
            encoded = encoder.encode_all(batch.column("text").to_pylist())
            for b, doc, own in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), encoded, strict=True):
                if ids and (b != bucket or held >= CHUNK_IDS):
                    yield chunk()
                    before = before + held if b == bucket else 0
                    ids, counts, parts, held = [], [], [], 0
                bucket = b
                own += end
                ids.append(doc)
                counts.append(len(own) // 4)
                parts.append(own)
                held += len(own) // 4
        if ids:
            yield chunk()

    ordered = common.in_order(common.with_bucket(docs, "doc_id", cuts), "doc_id")
    ordered.mapInArrow(run, CHUNKS).write.parquet(path)
    return spark.read.schema(CHUNKS).parquet(path)


def read_ids(chunks: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = chunks.sparkSession
    # One row for each bucket, whose number is a parameter (four for each shuffle partition).
    totals = sorted((r[0], r[1]) for r in chunks.groupBy("bucket").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).collect())
    begins, total = [], 0
    for bucket, n in totals:
        begins.append((bucket, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(begins or [(0, 0)], "bucket int, begin long"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for begin, before, ids, counts, payload in zip(*(batch.column(c).to_pylist() for c in ("begin", "before", "doc_ids", "counts", "payload")), strict=True):
            tokens = unpack(payload).astype("<u4").tobytes()
            at = 0
            for doc, n in zip(ids, counts, strict=True):
                out[0].append(doc)
                out[1].append(begin + before + at)
                out[2].append(n)
                out[3].append(zlib.crc32(tokens[4 * at : 4 * (at + n)]))
                at += n
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return common.map_batches(chunks.join(offsets, "bucket"), step, "doc_id long, start long, n_tokens long, ids_crc32 long")
