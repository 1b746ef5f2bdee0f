"""Byte-level BPE by longest matches and backtracking, without applying merges one by one.

An Aho-Corasick automaton over the vocabulary (bytes mapped to the Latin-1 characters of the same number) finds, at each
position of a piece, its longest token. The encoder takes the longest token, falls back to the token's longest proper
prefix in the vocabulary, or gives up the token before it, until each two neighbours are *compatible*: merging them from
their bytes would leave both as they are. Compatibility is decided from the two tokens' last merges and is remembered.
A position that was given up is never tried again, so the work is linear in the piece.

Texts are cut into pieces by the regex package. Its Unicode tables are of another version than tiktoken's: characters whose classes
differ are looked up in tiktoken's own tables once in each worker, and stand-ins of the right classes are put in for the cutting.

Nulls and empty texts have no ids and decode to nothing. Repeated rows each have their result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from portrel.llm import common

#: Bytes of texts and ids that a worker remembers of words and of pieces, and remembered neighbours; beyond it a memory starts
#: anew, results don't change.
MEMO_BYTES, MEMO = 64 << 20, 400_000

# Unicode's White_Space characters, as a regular expression class.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with the space that may be its own, or white space. The pre-tokenizer's pieces never cross these cuts.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


class Vocabulary:
    """A rank file's tokens with, for each, the two tokens of its last merge and its longest proper prefix."""

    def __init__(self, file: str):
        import ahocorasick

        with open(file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.find = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.find.add_word(token.decode("latin-1"), rank)
        self.find.make_automaton()
        self.shorter: dict[int, int | None] = {}
        for token, rank in ranks.items():
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), None)
        self.last_merge: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.last_merge[rank] = self._last_merge(token) if len(token) > 1 else None
        self.fits.clear()

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The one cut of ``token`` into two earlier tokens that leaves both whole until the end; None if there is none."""
        rank = self.ranks[token]
        for n in range(len(token) - 1, 0, -1):
            a, b = self.ranks.get(token[:n]), self.ranks.get(token[n:])
            if a is not None and b is not None and self._reachable(a, rank) and self._reachable(b, rank) and self._compatible(a, b, rank):
                return a, b
        return None

    def _reachable(self, part: int, rank: int) -> bool:
        return part < rank and (len(self.bytes[part]) == 1 or self.last_merge.get(part) is not None)

    def _compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether ``left`` and ``right``, side by side, both come out of the merges; only merges under ``below`` count.

        Walks down the two tokens' last merges from the latest: at each point the two parts that touch the border stand
        side by side from the merge that made the later one up to the next one, and mustn't merge in that time.
        """
        ranks, whole = self.ranks, self.bytes
        until = below if below is not None else 1 << 62
        a, b = left, right
        while True:
            joined = ranks.get(whole[a] + whole[b])
            if joined is not None and joined < until:
                return False
            split_a, split_b = self.last_merge.get(a), self.last_merge.get(b)
            if split_a is None and split_b is None:
                return True
            # The part that was made last is opened. Of equals, the left one was merged first.
            if split_b is None or split_a is not None and a > b:
                until, a = a, split_a[1]
            else:
                until, b = b + 1, split_b[0]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            found = self.fits[key] = self._compatible(left, right)
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        if rank is not None and (len(piece) == 1 or self.last_merge[rank] is not None):
            return [rank]
        longest: list[int | None] = [None] * len(piece)
        sizes = self.bytes
        for end, token in self.find.iter(piece.decode("latin-1")):
            longest[end - len(sizes[token]) + 1] = token  # of one start, later ends are longer
        open_at = bytearray(b"\x01") * (len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            last = out[-1] if out else None
            while token is not None:
                end = at + len(sizes[token])
                if open_at[end] and (last is None or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < len(piece) else None
                    break
                token = self.shorter[token]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of this text")
                open_at[at] = 0
                out.pop()
                at -= len(sizes[last])
                token = self.shorter[last]
        return out


@lru_cache(maxsize=2)
def stand_ins(pattern: str) -> dict[int, int]:
    """For each code point that is in other classes of ``pattern`` to tiktoken than to the regex package, one beyond ASCII that is
    in the wanted classes to both."""
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    wanted, other = [0] * 0x110000, [0] * 0x110000
    for bit, kind in enumerate(sorted(set(re.findall(r"\\p\{\w+\}", pattern)))):
        found = bytes(tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        for lists, chars in ((wanted, found), (other, "".join(regex.findall(kind, every)))):
            for c in map(ord, chars):
                lists[c] |= 1 << bit
    agreed: dict[int, int] = {}
    for c in range(0xA1, 0x110000):
        if wanted[c] == other[c] and not 0xD800 <= c < 0xE000:
            agreed.setdefault(wanted[c], c)
    return {c: agreed[w] for c, (w, o) in enumerate(zip(wanted, other, strict=True)) if w != o}


class Encoder(dict):
    """From a chunk of text to its ids as bytes; remembers chunks and pieces."""

    def __init__(self, file: str, pattern: str):
        import regex

        self.vocabulary = Vocabulary(file)
        self.cut = regex.compile(pattern).findall
        self.other = stand_ins(pattern)
        self.pieces: dict[str, bytes] = {}
        self.held = self.held_pieces = 0
        ranks = self.vocabulary.bytes
        self.sizes = np.zeros(max(ranks) + 1, dtype=np.int64)
        for rank, token in ranks.items():
            self.sizes[rank] = len(token)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.text = np.frombuffer(b"".join(ranks.get(i, b"") for i in range(len(self.sizes))), dtype=np.uint8)

    def split(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return self.cut(chunk)
        known = chunk.translate(self.other)
        pieces = self.cut(known)
        if known == chunk:
            return pieces
        ends = np.cumsum([len(p) for p in pieces]).tolist()
        return [chunk[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def __missing__(self, chunk: str) -> bytes:
        parts = []
        for piece in self.split(chunk):
            found = self.pieces.get(piece)
            if found is None:
                if self.held_pieces > MEMO_BYTES:
                    self.pieces.clear()
                    self.held_pieces = 0
                ids = self.vocabulary.encode_piece(piece.encode("utf-8", "surrogatepass"))
                found = self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
                self.held_pieces += len(piece) + len(found) + 150
            parts.append(found)
        out = b"".join(parts)
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = 0
        self.held += len(chunk) + len(out) + 150
        self[chunk] = out
        return out

    def encode(self, text: str | None) -> bytes:
        return b"".join([self[c] for c in _CHUNK.findall(text)]) if text else b""

    def decode(self, ids: bytes) -> bytes:
        tokens = np.frombuffer(ids, dtype="<u4")
        if not len(tokens):
            return b""
        sizes = self.sizes[tokens]
        where = np.repeat(self.starts[tokens], sizes) + common.segments(sizes)
        return self.text[where].tobytes()


@lru_cache(maxsize=2)
def encoder(file: str, pattern: str) -> Encoder:
    return Encoder(file, pattern)


def encode(docs: DataFrame, file: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids``, the little-endian unsigned 32-bit ids of each text as binary."""
    common.small_batches(docs.sparkSession)
    schema = docs.drop("ids").schema

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(file, pattern)
        ids = pa.array([coder.encode(t) for t in batch.column(text).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

    return common.map_batches(docs.drop("ids"), step, f"{_ddl(schema)}, ids binary")


def digests(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """Per document: n_tokens, SHA-256 of the ids, SHA-256 of the bytes that the ids decode to."""
    common.small_batches(docs.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(file, pattern)
        sizes, of_ids, of_text = [], [], []
        for text in batch.column("text").to_pylist():
            ids = coder.encode(text)
            sizes.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_text.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.map_batches(docs.select("doc_id", "text"), step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """``docs`` without the text, with n_tokens, ids and whether the ids decode to the text's bytes (null: none)."""
    common.small_batches(docs.sparkSession)
    kept = docs.drop("text", "n_tokens", "ids", "decodes")
    names = kept.columns

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(file, pattern)
        texts = batch.column("text").to_pylist()
        ids = [coder.encode(t) for t in texts]
        same = [coder.decode(i) == (t or "").encode("utf-8", "surrogatepass") for i, t in zip(ids, texts, strict=True)]
        own = [batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*own, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(same)], [*names, "n_tokens", "ids", "decodes"])

    return common.map_batches(docs, step, f"{_ddl(kept.schema)}, n_tokens long, ids binary, decodes boolean")


def _ddl(schema) -> str:  # noqa: ANN001
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
