"""The operators on documents against plain versions, on a small table of awkward rows."""

from __future__ import annotations

import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from portrel.llm import byte_bpe, common, fingerprint, jaccard, mixing, quality, repeats, substring_dedup, suffix_dedup, token_ids
from tests.llm import brute

#: Names that the operators use for columns of their own.
EXTRA = ("doc", "n", "v", "zone", "size", "key", "bucket", "ids", "gram", "cover", "lo", "copy", "runs", "token", "label", "quality", "word")


def _texts() -> dict:
    random.seed(11)
    vocabulary = [f"{a}{b}" for a in ("Ab", "cé", "x", "Zo", "日本") for b in ("lo", "na,", "ta", ".", "$$$", "'s")]
    sentence = lambda n: " ".join(random.choices(vocabulary, k=n))
    texts = {}
    passage, line = sentence(70), sentence(9)
    for i in range(40):
        texts[i] = "\n".join([sentence(random.randint(1, 60)), *([passage] if i % 5 == 0 else []), *([line] * (i % 3)), sentence(random.randint(1, 60))])
    words = texts[7].split()
    for i in range(40, 52):  # near copies of one document
        own = list(words)
        for _ in range(i - 40):
            own[random.randrange(len(own))] = "edited"
        texts[i] = " ".join(own)
    texts |= {52: None, 53: "", 54: " \n\t ", 55: "one", 56: "ONE", 57: "a b c", 58: texts[3], 59: texts[3], 60: "ab " * 3000, 61: sentence(4000), 62: "\x1f\x1c x\x85y z"}
    texts[63] = texts[61][:9000]
    return texts


TEXTS = _texts()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "s1", "s2", "é"][i % 4] if i % 3 else "s1", len(t or ""), *["?"] * len(EXTRA)) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_suffix_dedup(docs, empty):
    assert _by_id(suffix_dedup.dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix_dedup(TEXTS)
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_dedup_other_lengths_and_chunks(docs, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_COVERS", 3)  # many grams take the way by shuffle
    got = _by_id(suffix_dedup.dedup(docs, length=40, gram=11), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix_dedup(TEXTS, 40)


def test_units_do_not_depend_on_chunks(monkeypatch):
    import pyarrow as pa

    tokens = repeats.as_bytes(pa.array(list(TEXTS.values()), pa.large_string()))
    whole = sum(repeats.units(tokens, 100, 32)[4])
    monkeypatch.setattr(repeats, "CHUNK", 500)
    assert sum(repeats.units(tokens, 100, 32)[4]) == whole


def test_suffix_dedup_cleaned(docs):
    cleaned = _by_id(suffix_dedup.cleaned(docs), "text", "lang")
    plain = brute.suffix_dedup(TEXTS)
    assert set(cleaned) == set(TEXTS)
    assert all(lang == "en" for _, lang in cleaned.values())
    assert all(len(cleaned[i][0].encode()) <= plain[i][0] - plain[i][1] for i in TEXTS)
    assert cleaned[59][0] == ""


@pytest.mark.parametrize("batches", [1, 4])
def test_substring_dedup(docs, empty, batches):
    got = _by_id(substring_dedup.dedup(docs, batches=batches), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring_dedup(TEXTS)
    assert substring_dedup.dedup(empty, batches=batches).count() == 0


def test_substring_index_over_sessions(spark, docs, tmp_path):
    """Batches that are taken in by sessions of their own find what one pass over all documents finds; old runs aren't shuffled."""
    path = f"file://{tmp_path}/index"
    want = brute.substring_dedup(TEXTS)
    gone: dict = {}
    for begin, end in ((0, 20), (20, 45), (45, 60), (60, 99)):
        own = spark.newSession()
        own.conf.set("spark.sql.shuffle.partitions", "5" if begin else "8")
        index = substring_dedup.FingerprintIndex(own, path)
        assert (index.length, index.gram, index.buckets) == (20, 6, 8)
        rows = own.createDataFrame([(i, t) for i, t in TEXTS.items() if i < end], "doc long, text string")
        for r in index.add(rows.where(F.col("doc") >= begin), rows).collect():
            gone.setdefault(r["doc"], set()).update(range(r["lo"], r["lo"] + r["n"] + 19))
        index.close()
    assert {i: len(g) for i, g in gone.items()} == {i: w[1] for i, w in want.items() if w[1]}
    index = substring_dedup.FingerprintIndex(spark, path)
    runs = index.runs()
    assert [r.split("-")[1] for r in runs] == ["2"]  # two compactions of two runs, and one of the results
    with common.settings(spark, **substring_dedup._BY_BUCKETS):
        for side in index.matches(runs[0], runs[0]):
            plan = side._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan
            assert "Exchange" not in plan
    index.close()


def test_copies_are_verified(spark):
    """What only shares hashes is no copy."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b x d e f")], "doc long, text string")
    copies = spark.createDataFrame([(2, 0, 2, 1, 0), (3, 0, 2, 1, 0), (3, 3, 1, 1, 3), (9, 0, 1, None, None)], "doc long, lo long, n int, fdoc long, flo long")
    spans = copies.where("fdoc is not null").select("doc", "lo", "n").unionByName(copies.where("fdoc is not null").select(F.col("fdoc").alias("doc"), F.col("flo").alias("lo"), "n"))
    held = repeats.contents(docs, spark.createDataFrame([], "gram long, doc long, lo long, n int"), spans, repeats.as_words, 3)
    assert sorted(map(tuple, repeats.verified(copies, held).collect())) == [(2, 0, 2), (3, 3, 1), (9, 0, 1)]


def test_repeated_rows_are_one_document(spark, docs):
    one = docs.where("doc_id in (3, 5, 61)")
    twice = one.unionByName(one)
    alone = {i: TEXTS[i] for i in (3, 5, 61)}
    got = suffix_dedup.dedup(twice)
    assert got.count() == 6
    assert _by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix_dedup(alone)


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, TEXTS[3]), (4, TEXTS[3])], "doc_id long, text string")
    got = _by_id(suffix_dedup.dedup(rows), "n_removed")
    assert got[None] == (0,)
    assert got[4][0] == len(TEXTS[3].encode())


@pytest.mark.parametrize("small", [False, True])
def test_jaccard(docs, empty, small, monkeypatch):
    if small:  # leaders, blocks and parts of a few sets, so that each way is taken
        monkeypatch.setattr(jaccard, "LEADERS", 1)
        monkeypatch.setattr(jaccard, "BLOCK", 2)
        monkeypatch.setattr(jaccard, "GROUP", 3)
        monkeypatch.setattr(jaccard, "FREQUENT", 2)
        monkeypatch.setattr(jaccard, "LARGE_ZONE", 2)
        monkeypatch.setattr(jaccard, "ALIKE", 50)
    assert _by_id(jaccard.join(docs), "n_shingles", "component_id") == brute.components(TEXTS)
    assert jaccard.join(empty).count() == 0


def test_jaccard_without_zones(docs, monkeypatch):
    """The front lists alone find all links."""
    monkeypatch.setattr(jaccard, "zones", lambda profile: profile.select(F.col("doc").alias("v"), F.col("doc").alias("zone")).where("false"))
    assert _by_id(jaccard.join(docs), "n_shingles", "component_id") == brute.components(TEXTS)


def test_jaccard_all_links(spark, empty):
    """Every pair of different sets that links, and how many other rows each row links with, also for repeated and missing ids."""
    words = TEXTS[61].split()[:400]
    texts = TEXTS | {300 + i: " ".join("edited" if k % 97 == 7 * i and i else f"{w}{i}" if k == 20 * i else w for k, w in enumerate(words)) for i in range(14)}
    rows = [(i, t) for i, t in texts.items()] + [(7, TEXTS[7]), (7, TEXTS[5]), (None, TEXTS[41]), (None, TEXTS[9]), (None, None)]
    members, pairs = jaccard.all_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    sets = [brute.shingles(t) for _, t in rows]
    like = lambda x, y: bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)
    want = sorted((i is None, i or 0, len(x), sum(k != m and like(x, y) for m, y in enumerate(sets))) for k, ((i, _), x) in enumerate(zip(rows, sets, strict=True)))
    got = members.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["n_links"]) for r in got) == want
    different = list(set(sets))
    linked = sum(like(x, y) for k, x in enumerate(different) for y in different[:k])
    assert linked > 20
    assert len({tuple(r) for r in pairs.collect()}) == pairs.count() == linked
    assert {r["set_id"] for r in got if r["n_shingles"]} >= {x for r in pairs.collect() for x in r}
    once, _ = jaccard.all_links(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert _by_id(once, "n_shingles", "component_id") == brute.components(texts)
    assert jaccard.all_links(empty)[0].count() == 0


def test_mixing(spark, docs, empty):
    rows = docs.where("doc_id < 60")
    got = mixing.mix(rows).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(rows.repartition(3)).collect()}
    sources = dict(_by_id(rows, "source"))
    size = {i: len(brute.WORD.findall(TEXTS[i] or "")) for i in sources}
    assert {r["doc_id"]: r["size"] for r in got} == size
    assert {r["doc_id"]: r["taken"] for r in got} == again
    per = {}
    for i, (s,) in sources.items():
        per[s] = per.get(s, 0) + size[i]
    names = sorted((s for s in per if s is not None)) + [None] * (None in per)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(per.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * per[s]}
        target |= {s: 3.0 * per[s] if s in over else level * weight[s] for s in (over or free)}
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    for r in got:
        s = sources[r["doc_id"]][0]
        assert (r["source_size"], r["target"]) == (per[s], pytest.approx(target[s]))
        assert r["taken"] <= 3 * r["size"]
    for s in names:
        assert abs(sum(r["taken"] for r in got if sources[r["doc_id"]][0] == s) - target[s]) <= 0.51
    assert mixing.mix(empty).count() == 0


def test_mixing_order_and_cut(spark, docs):
    """Against a plain sort of each source by its keys: whole epochs, then documents in order until the words run out."""
    rows = docs.where("doc_id < 60").unionByName(docs.where("doc_id = 7")).unionByName(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    got = mixing.mix(rows, also=["n_chars"])
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(mixing.SEED)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    keyed = rows.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), (-F.log(u) / mixing.plain_share(F.col("text"))).alias("key")).collect()
    targets = {r["source"]: r for r in mixing.targets(rows.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("source_size"))).collect()}
    want = []
    for source in {r["source"] for r in keyed}:
        own = sorted((r for r in keyed if r["source"] == source), key=lambda r: (r["key"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"]))
        whole = targets[source]["source_size"]
        epochs = int(targets[source]["target"] // whole) if whole else 0
        left = round(targets[source]["target"] - epochs * whole)
        for r in own:
            part = min(r["size"], left)
            left -= part
            want.append((r["doc_id"], r["size"], epochs * r["size"] + part))
    order = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    assert sorted(((r["doc_id"], r["size"], r["taken"]) for r in got.collect()), key=order) == sorted(want, key=order)
    assert {r["doc_id"]: r["n_chars"] for r in got.collect() if r["doc_id"]} == {i: len(TEXTS[i] or "") for i in range(1, 60)}


def test_mixing_targets_stop_at_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert (got["a"], got["c"], got[None]) == (30.0, 3.0, 15.0)
    assert sum(got.values()) == pytest.approx(1016)


def test_token_ids(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    special = {200: "a <|endoftext|> b", 201: "<|startoftext|>", 202: "x<|endoftext|>\n <|startoftext|>É <|ENDOFTEXT|>", 203: "<|endoftext", 204: "İstanbul ǅ e\u0301 <|endoftext|>"}
    more = spark.createDataFrame([(i, t) for i, t in special.items()] + [(None, "none"), (7, TEXTS[7])], "doc_id long, text string")
    chunks = token_ids.write_ids(docs.select("doc_id", "text").unionByName(more), f"file://{tmp_path}/ids", file)
    texts = sorted([*TEXTS.items(), *special.items(), (7, TEXTS[7]), (-1, "none")])
    want, at = [], 0
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [320, 49407, 321] == tokenizer.encode(special[200], add_special_tokens=False).ids
    got = token_ids.read_ids(chunks).select(F.coalesce("doc_id", F.lit(-1)), "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
    some = {i: TEXTS[i] for i in (0, 7, 52, 61)} | {202: special[202]}
    read = token_ids.ids_of(chunks, spark.createDataFrame([(i,) for i in [*some, 999]], "doc_id long")).collect()
    assert len(read) == 6
    for r in read:
        assert r["ids"] == [*tokenizer.encode(some[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
    assert token_ids.read_ids(token_ids.write_ids(empty, f"file://{tmp_path}/none", file)).count() == 0


def test_token_ids_of_odd_texts():
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(file), token_ids.Words(file)
    spaces = "\x09\x0a\x0b\x0c\x0d \x85\xa0\u1680\u2000\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    others = "\x00\x1b\x1c\x1d\x1e\x1f\x7f\xad\u180e\u200b\u2060\ufeff"
    marks = ["", "'s", "'S", "...", "!?x", "_Y", "\u0301", "\u0301,", "\u00aa", "\u00ba", "\u00b5", "\u00d7", "12", "\u2019t", "\u4f60\u597d", "\ufb01", "\u212b", "\u0130", "\u03a3 ", "\u1100\u1161", *spaces, *others]
    texts = [None, "", " ", "\n\n", *(f"{a}{m}{b}" for a in ("", " ", "Été", "DON", "straße-") for m in marks for b in ("", "Go.", "\u00c9A,", " É\u0301 \u4f60 Ab"))]
    texts += ["a <|EndOfText|> b", "<|STARTOFTEXT|>", "x<|endoftext|> \n", "Ａ <|ENDOFTEXT|>", "".join(map(chr, range(1, 0x250))), " ".join(map(chr, range(1, 0x250)))]
    for some in (texts, texts[::-1], [None], [""], []):
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(some)] == want


def test_token_ids_look_up_each_piece_once(monkeypatch):
    from tokenizers import Tokenizer

    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

        def __iter__(self):
            raise AssertionError("all of the memory is read")

        keys = items = values = __iter__

    file = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(file), token_ids.Words(file)
    encoder.known = Counted({"": b""})
    texts = ["Some words, SOME Words. words! " * 200, "more words\n" * 300]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    # Runs some, words, more; rests comma, stop, exclamation mark; the empty piece twice. Once in each of two calls.
    assert 0 < Counted.asked <= 2 * 8
    # A memory of one generation forgets what isn't used, and gives the same.
    monkeypatch.setattr(token_ids, "MEMO_BYTES", 1000)
    small = token_ids.Words(file)
    for n in range(6):
        some = [f"word{chr(97 + n)} Words, again", "other w" + "x" * n]
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode_all(some)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    assert len(small.known) < 12


def test_token_ids_of_few_words_with_a_large_memory():
    encoder, times = token_ids.Words(public_tokenizers.path("word_bpe_49k.json")), []
    letters = "abcdefghij"
    for texts in ([" ".join("".join(letters[int(d)] for d in str(n)) for n in range(100_000, 200_000))], []):
        spent = []
        for n in range(41):
            begin = time.process_time_ns()
            encoder.encode_all([f"few words {n % 2}"])
            spent.append(time.process_time_ns() - begin)
        times.append(sorted(spent)[20])
        encoder.encode_all(texts)
    assert times[1] < 8 * times[0]


def test_blocks_round_trip():
    random.seed(5)
    for n in (0, 1, 31, 1023, 1024, 1025, 5000):
        for top in (1, 2, 300, 49_000, 2**32 - 1):
            ids = np.array([random.randrange(top) for _ in range(n)], dtype=np.uint32)
            packed = token_ids.pack(ids)
            assert (token_ids.unpack(packed) == ids).all()
            for block in range(-(-n // 1024)):
                assert (token_ids.unpack_block(packed, block) == ids[block * 1024 :][:1024]).all()
    skewed = np.full(4096, 7, dtype=np.uint32)
    skewed[::50] = 2**31
    assert len(token_ids.pack(skewed)) < 1200
    assert (token_ids.unpack_block(token_ids.pack(skewed), 2) == skewed[2048:3072]).all()
    assert (token_ids.unpack(token_ids.pack(skewed)) == skewed).all()


def test_byte_bpe(spark, docs, empty):
    import tiktoken

    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = _by_id(byte_bpe.digests(docs, file, public_tokenizers.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t in TEXTS.items():
        ids = own.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    coder = byte_bpe.encoder(file, public_tokenizers.PATTERN)
    random.seed(9)
    alphabet = "aábc  \n\t'stre1９!$€日本語́ \x1c\x85"
    for _ in range(3000):
        t = "".join(random.choices(alphabet, k=random.randint(0, 30)))
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == own.encode_ordinary(t), repr(t)
    # Every code point of the planes with letters, beside letters, digits and contractions.
    for at in [*range(0, 0x33000, 64), *range(0xE0000, 0xE0200, 64), *range(0x33000, 0x110000, 4096)]:
        t = "".join(f"{chr(c)}'d a{chr(c)}1{chr(c)} " for c in range(at, at + 64) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == own.encode_ordinary(t), hex(at)
        coder.clear(), coder.pieces.clear()
    random.seed(10)
    for _ in range(5000):
        t = "".join(random.choice((chr(random.randrange(0x20, 0xD800)), chr(random.randrange(0xE000, 0x32000)), "'", "d", " ", "7")) for _ in range(random.randint(1, 12)))
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == own.encode_ordinary(t), repr(t)
    assert byte_bpe.round_trip(docs.select("doc_id", "source", "text"), file, public_tokenizers.PATTERN).where("not decodes").count() == 0
    assert byte_bpe.digests(empty, file, public_tokenizers.PATTERN).count() == 0
    again = byte_bpe.digests(docs.select("doc_id", "text").where("doc_id in (7, 53)").unionByName(spark.createDataFrame([(None, TEXTS[7]), (7, TEXTS[7])], "doc_id long, text string")), file, public_tokenizers.PATTERN)
    rows = again.collect()
    assert len(rows) == 4
    assert len({r["ids_sha256"] for r in rows if r["doc_id"] != 53}) == 1


def test_fingerprints(spark, docs, empty):
    got = {r["doc_id"]: r for r in fingerprint.edits(docs).collect()}
    ids = sorted(TEXTS)
    for k, i in enumerate(ids):
        own, nxt = TEXTS[i] or "", TEXTS[ids[k - 1]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1
        assert 0 <= r["near_next"] <= 1
    assert got[3]["fingerprint"] == got[58]["fingerprint"] == got[59]["fingerprint"]
    assert got[59]["near_next"] == 1.0
    assert got[52]["fingerprint"] == got[53]["fingerprint"]
    assert len({got[i]["fingerprint"] for i in ids}) == len({t or "" for t in TEXTS.values()})
    assert fingerprint.edits(empty).count() == 0
    one = fingerprint.edits(docs.where("doc_id = 61")).head()
    assert one["near_next"] == 1.0


def test_fingerprints_add_up():
    import pyarrow as pa

    parts = ["first line here", "second line of words", "third"]
    whole = fingerprint.vectors(pa.array(["\n".join(parts), "\n".join(reversed(parts)), *parts]))
    for lanes in whole:
        assert (lanes[0] == lanes[1]).all()
        assert (lanes[0] == lanes[2] + lanes[3] + lanes[4]).all()


def test_fingerprints_are_updated(spark):
    """Paragraphs put in and taken out of stored fingerprints, as if the changed texts had been read."""
    rows = [(1, "one\ntwo words", "new line\n\nmore", "one\nnew line\n\nmore\ntwo words"), (2, "", "first", "first"), (3, None, None, ""), (4, "a b c\n" * 40_000 + "end", "a b c", "a b c\n" * 40_001 + "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string, whole string")
    now = fingerprint.fingerprints(fingerprint.fingerprints(df), "whole", "wanted")
    more = fingerprint.inserted(now, "extra")
    assert more.where("fingerprint = wanted").count() == 4
    back = fingerprint.fingerprints(fingerprint.deleted(more, "extra"), "text", "before")
    assert back.where("fingerprint = before").count() == 4


def test_fingerprint_likeness_follows_what_is_shared():
    """Against the exact share of common three-word runs, and not wrapped by very many repeats of one."""
    import pyarrow as pa

    random.seed(3)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(random.choices(words, k=12)) for _ in range(60)]
    for keep in (0, 15, 30, 45, 60):
        other = base[:keep] + [" ".join(random.choices(words, k=12)) for _ in range(60 - keep)]
        a, b = (fingerprint.vectors(pa.array(["\n".join(x)])) for x in (base, other))
        assert abs(fingerprint.likeness(a, b)[0] - keep / 60) < 0.15
    long = ["x y z\n" * 70_000 + t for t in ("head", "tail")]
    a, b = (fingerprint.vectors(pa.array([t])) for t in long)
    assert fingerprint.likeness(a, b)[0] > 0.99


def test_quality_features_and_missing_class(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1) for i in TEXTS], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(TEXTS)
    assert {r["score"] for r in got} == {0.5}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert quality.classify(empty, labels).count() == 0


def test_quality_as_registered(spark):
    """The registered query on provided tables, with columns of clashing names, repeated rows and labels, and a missing id."""
    sf = "/root/testdata/sf0.01"
    table = common.table(spark, sf, "documents").withColumns({"x": F.lit("?"), "score": F.lit("?"), "predicted": F.lit("?")})
    labels = common.table(spark, sf, "labels")
    more = table.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))
    got = quality.classify(table.unionByName(table.where("doc_id = 5")).unionByName(more), labels.unionByName(labels.where("doc_id < 100")))
    rows = got.collect()
    assert len(rows) == table.count() + 4
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 80
    assert sum(p == q for p, q in held) > 0.93 * len(held)


def test_quality_held_out():
    """On the provided tables: nearly all held-out labels come out right."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.1"
    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    rows = docs.merge(pq.read_table(f"{sf}/labels.parquet").to_pandas(), on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id])
    x, y = quality.statistics(pa.array(rows.text, pa.large_string())), rows.quality.to_numpy()
    learn = ~held
    parts = [x[learn & (y == k)] for k in (0, 1)]
    model = quality.Discriminant([len(p) for p in parts], [p.sum(axis=0) for p in parts], [p.T @ p for p in parts])
    gap = model.difference(x[held])
    right = (gap >= 0) == (y[held] == 1)
    assert right[y[held] == 1].mean() > 0.97
    assert right[y[held] == 0].mean() > 0.97
    assert np.isfinite(model.difference(quality.statistics(pa.array(["", None, " "], pa.large_string())))).all()


def test_components(spark):
    from portrel.llm.components import components

    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in {x for e in edges if e[0] != e[1] for x in e}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ordered_buckets(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    cuts = common.bucket_bounds(df, "doc_id", 16)
    numbers = {r["bucket"]: (r["lo"], r["hi"]) for r in common.with_bucket(df, "doc_id", cuts).groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()}
    ordered = [numbers[b] for b in sorted(numbers)]
    assert all(a[1] < b[0] for a, b in zip(ordered, ordered[1:], strict=False))
