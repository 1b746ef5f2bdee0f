"""Text hashing, and what must not be joined: colliding strings, and rows that share an id or have none."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from portrel.llm import common, fingerprint, jaccard, repeats, substring_dedup
from tests.llm import brute

DOCS = "doc_id long, text string"


def thue_morse(n, a="a", b="b"):
    """Two strings of 2**n letters that every polynomial hash modulo a power of two takes for one, from n = 10 on."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


def test_arithmetic():
    rng = np.random.default_rng(3)
    prime = int(common.PRIME)
    a, b = (np.concatenate([np.array(x, np.uint64), rng.integers(0, prime, 40_000, dtype=np.uint64)]) for x in ([prime - 1, prime - 1, 0], [prime - 1, 1, 7]))
    assert all(int(x) == int(y) * int(z) % prime for x, y, z in zip(common.times(a, b), a, b, strict=True))
    for values in (rng.integers(0, 256, 3000).astype(np.uint8), rng.integers(0, 2**64, 3000, dtype=np.uint64)):
        want = 0
        for i, x in enumerate(common.prefix_sums(values)[:-1].tolist()):
            assert x == want % prime
            want += int(values[i]) * pow(common.BASE, i, prime)


def test_equal_slices_have_equal_hashes_and_others_not():
    data = np.random.default_rng(1).integers(0, 3, 5000).astype(np.uint8)
    sums = common.prefix_sums(np.concatenate([data, data]))
    at = np.arange(4900)
    one, two = (common.slice_hash(sums, at + k, at + k + 90) for k in (0, 5000))
    assert (one == two).all()
    whole = data.tobytes()
    assert len(set(one.tolist())) == len({whole[i : i + 90] for i in at.tolist()})


def test_word_hashes():
    words = [w.encode() for w in ("a", "b", "ab", "ba", "a\0", "\0a", "12345678", "123456789", "x" * 63, "x" * 64, "x" * 65, "x" * 64 + "y", "y" + "x" * 64, *thue_morse(4), *thue_morse(11))]
    data = np.frombuffer(b" ".join(words * 2), np.uint8)
    size = np.array([len(w) for w in words * 2])
    begin = np.cumsum(size + 1) - size - 1
    got = common.word_hashes(data, begin, begin + size).tolist()
    assert got[: len(words)] == got[len(words) :] and len(set(got)) == len(set(words))


def test_colliding_words(spark):
    s, t = thue_morse(12)
    texts = {1: " ".join([s, t] * 10), 2: " ".join([t, s] * 10), 3: " ".join([s] * 25), 4: " ".join([t] * 25), 5: s, 6: t}
    rows = spark.createDataFrame(list(texts.items()), DOCS).repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(rows).collect()}
    assert got == brute.substring_dedup(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(rows).collect()}
    assert got == brute.components(texts)
    prints = [r["fingerprint"] for r in fingerprint.fingerprints(rows).orderBy("doc_id").collect()]
    assert len(set(prints)) == 6
    equal, _ = fingerprint.lanes(prints)
    assert all(len(set(equal[:, lane].tolist())) == 6 for lane in range(fingerprint.EQUAL_LANES))


def test_lanes_are_independent(spark):
    """Of 400 paragraphs' lanes none follows from another by what it is xored or added with."""
    rows = spark.createDataFrame([(i, f"line {i}") for i in range(400)], DOCS)
    equal, _ = fingerprint.lanes([r["fingerprint"] for r in fingerprint.fingerprints(rows).collect()])
    for k in range(1, fingerprint.EQUAL_LANES):
        assert len(set((equal[:, 0] ^ equal[:, k]).tolist())) == 400 and len(set((equal[:, 0] - equal[:, k]).tolist())) == 400


def test_copies_are_verified_by_their_bytes(spark, monkeypatch):
    """With a word hash that takes any two words for one, no window is a copy by its digest."""
    texts = {1: " ".join(f"w{i}" for i in range(40)), 2: " ".join(f"v{i}" for i in range(40)), 3: " ".join(f"w{i}" for i in range(40))}
    own = repeats.as_words(spark.createDataFrame([(texts[1],), (texts[2],)], "text string").toArrow().column("text").combine_chunks())
    assert bytes(own.raw[own.at[0] : own.at[3]]) == b"w0 w1 w2 " and bytes(own.raw[own.at[40] : own.at[42]]) == b"v0 v1 "
    copies = spark.createDataFrame([(2, 0, 5, 1, 0), (3, 0, 5, 1, 0)], "doc long, lo long, n int, fdoc long, flo long")
    docs = spark.createDataFrame(list(texts.items()), "doc long, text string")
    spans = copies.select("doc", "lo", "n").unionByName(copies.select(F.col("fdoc").alias("doc"), F.col("flo").alias("lo"), "n"))
    none = spark.createDataFrame([], "gram long, doc long, lo long, n int")
    held = repeats.contents(docs, none, spans, repeats.as_words, 20)
    assert [tuple(r) for r in repeats.verified(copies, held).collect()] == [(3, 0, 5)]


def _families():
    words = [f"word{i}" for i in range(400)]
    text = lambda i: " ".join(words[(i * 37 + k * (i + 3)) % 400] for k in range(60))
    return text


def _union(rows):
    """Component of each row, over all pairs of rows: the set of rows' places."""
    sets = [brute.shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):  # noqa: ANN001, ANN202
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]) or rows[i] == rows[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("extra", [0, (1 << 63) - 40])
def test_rows_that_share_an_id(spark, extra):
    text = _families()
    rows = [(5, text(0)), (5, text(1)), (3, text(0) + " more"), (8, text(1) + " more"), (None, text(2)), (None, text(3)), (None, text(3) + " x"), (9, text(2)), (9, ""), (9, None), (9, text(4)), (9, text(4)), (7, text(5)), (6, text(5)), (7, text(5) + " y")]
    rows = [(None if i is None else i + extra, t) for i, t in rows]
    parts = _union(rows)
    least = {p: min((i for (i, _), q in zip(rows, parts, strict=True) if q == p and i is not None), default=None) for p in parts}
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component string, n int").repartition(4)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()), key=str)
    assert got == sorted(((i, len(brute.shingles(t)), least[p]) for (i, t), p in zip(rows, parts, strict=True)), key=str)
    kept = [(r["doc_id"], r["text"]) for r in jaccard.representatives(df).collect()]
    of = {r: p for r, p in zip(rows, parts, strict=True)}
    assert sorted(of[k] for k in kept) == sorted(set(parts))  # one row of each component
    assert all(k[0] == least[of[k]] for k in kept)
    if extra:
        return
    members, _ = jaccard.all_links(df)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in members.collect() if r["n_shingles"]), key=str) == [x for x in got if x[1]]
