"""Top-k search, HTML extraction and the pipeline."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from portrel.llm import html_text, topk

VECTORS = {i: [math.sin(i * k + k) for k in range(1, 9)] for i in range(300)}
VECTORS |= {i: VECTORS[7] for i in range(300, 340)}  # ties
VECTORS |= {340: None, 341: [], 342: [1.0, None] * 4, 343: [float("nan")] * 8, 344: [float("inf")] * 8, 345: [1.0] * 5, 350: [0.5] * 5}


def _brute(vectors, k):
    q = {i: [math.floor(256 * x) for x in v] for i, v in vectors.items() if v and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for a in q:
        if a % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), b) for b in q if b != a and len(q[b]) == len(q[a]))[:k]
            out |= {(a, r): (b, -s) for r, (s, b) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("k", [1, 5, 400])
def test_top_k(spark, k, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "RANGES", 16)
    monkeypatch.setattr(topk, "GROUP", 2)
    monkeypatch.setattr(topk, "ENOUGH", 7)
    rows = spark.createDataFrame([(i, v, "x", 1) for i, v in VECTORS.items()] + [(None, [1.0] * 8, "x", 1)], "vec_id long, embedding array<double>, ids string, score int").repartition(4)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(rows, F.col("vec_id") % 50 == 0, k).collect()}
    assert got == _brute(VECTORS, k)


@pytest.mark.parametrize("size", [1e7, 3e9, 1e300])
def test_top_k_of_large_components(spark, size):
    """Exact beyond 2**53 and 2**63; scores that no long can hold are its ends."""
    top = 2**63 - 1
    vectors = {i: [(i % 7 - 3) * size + i * 1.001, float(i % 3), 0.3 - i] for i in range(1, 120)} | {200: [1.0, 2.0, 3.0], 250: [0.0, 1.7e308, 0.0], 251: [0.0, 1.0, 5.5]}
    q = {i: [math.floor(x) * 256 if abs(x) > 1e18 else math.floor(256 * x) for x in v] for i, v in vectors.items()}
    want = {}
    for a in (50, 100, 200, 250):
        scored = sorted((-max(-top, min(top, sum(x * y for x, y in zip(q[a], q[b], strict=True)))), b) for b in q if b != a)[:5]
        want |= {(a, r): (b, -s) for r, (s, b) in enumerate(scored, 1)}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(rows, F.col("vec_id") % 50 == 0, 5).collect()}
    assert got == want


def test_top_k_of_nothing(spark):
    rows = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(rows, F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(alone, F.col("vec_id") % 50 == 0).count() == 0


def _page(i: int, body: str) -> tuple:
    return (i, f"https://www.site.example/{i}", f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>")


def test_html_rules(spark):
    pages = [
        _page(1, '<nav><ul><li>menu</ul></nav><header>top</header><article><h1>A &amp; B</h1><p>One<br>two  three<p>four <b>bo</b>ld<script>var t="</p>";</script><div class="comments"><p>first!</p></div></article><aside>x</aside><footer>f</footer>'),
        _page(2, '<div id="cookie-notice">ok?</div><div><p>no article <span class="ad">buy</span>here&nbsp;&lt;</p><form><p>name</p></form></div><!-- <p>gone</p> -->'),
        _page(3, "<p>open <i>never closed<p>next"),
        _page(4, "<main><div>a<div>b</div>c</div></main><p>outside</p>"),
        (5, None, "<p>no url</p>"), (6, "http://[bad", ""), (7, "https://www.site.example/7", None), (8, "https://www.site.example/8", "a < b & c <p title='x>y'>d"),
    ]
    df = spark.createDataFrame([(*p, "z", 1) for p in pages], "page_id long, url string, html string, host string, text int")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got == {1: "A & B\nOne two three\nfour bold", 2: "no article here <", 3: "open never closed\nnext", 4: "a\nb\nc", 5: "no url", 6: "", 7: "", 8: "a < b & c\nd"}
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_template_is_learned(spark):
    """A line that stands on all pages of a host goes though nothing marks it; on another host it stays."""
    pages = [_page(i, f"<div>Daily Example</div><div><p>Story {i} begins.</p><p>Then part {i * 7}.</p></div><div>All rights.</div>") for i in range(12)]
    pages += [(100 + i, f"https://other{i}.example/", pages[0][2]) for i in range(12)]
    copies = [(200 + i, "https://copies.example/", pages[0][2]) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages + copies, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} begins.\nThen part {i * 7}." for i in range(12))
    whole = "Daily Example\nStory 0 begins.\nThen part 0.\nAll rights."
    assert all(got[100 + i] == whole for i in range(12))
    assert all(got[200 + i] == whole for i in range(30))


def test_tree_matching():
    def tree(*kids):
        root = html_text.Node("div", False, False)
        root.kids = [k if isinstance(k, html_text.Node) else html_text.Node(k, False, False) for k in kids]
        return root

    def best(a, b):
        if a.tag != b.tag:
            return 0
        m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids, 1):
            for j, y in enumerate(b.kids, 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + best(x, y))
        return 1 + m[-1][-1]

    import random

    random.seed(4)
    for _ in range(300):
        make = lambda depth: tree(*[make(depth - 1) if depth and random.random() < 0.3 else random.choice("pqr") for _ in range(random.randint(0, 5))])
        a, b = make(2), make(2)
        html_text.number(a), html_text.number(b)
        pairs: list = []
        assert html_text.match(a, b, pairs) == best(a, b)
        assert len({p for p, _ in pairs}) == len({q for _, q in pairs}) == len(pairs)


def test_tree_matching_of_long_lists_and_deep_trees():
    """The largest match at any size: more than 142 children a side, or nested deeper than Python recurses."""
    import random

    def tree(*kids):
        root = html_text.Node("div", False, False)
        root.kids = list(kids)
        return root

    def kid(kind):
        node = html_text.Node(kind[0], False, False)
        node.kids = [html_text.Node("#", False, False) for _ in kind[1:]]
        return node

    random.seed(6)
    for n, m in ((160, 170), (30, 900), (3, 2)):
        kinds = [[random.choice(("p#", "p##", "h#", "ul")) for _ in range(k)] for k in (n, m)]
        a, b = (tree(*map(kid, k)) for k in kinds)
        html_text.number(a), html_text.number(b)
        best = [0] * (m + 1)
        for x in kinds[0]:
            row = [0]
            for j, y in enumerate(kinds[1]):
                row.append(max(best[j + 1], row[j], best[j] + (min(len(x), len(y)) if x[0] == y[0] else 0)))
            best = row
        pairs: list = []
        assert html_text.match(a, b, pairs) == len(pairs) == 1 + best[-1]
        assert sorted(pairs) == sorted(pairs, key=lambda p: p[1])
    deep = [tree(), tree(kid("p#"))]
    for _ in range(5000):
        deep = [tree(d) for d in deep]
    html_text.number(deep[0]), html_text.number(deep[1])
    assert html_text.match(*deep, []) == 5001


def test_html_template_of_long_pages(spark):
    """An unmarked block after a varying number of many paragraphs is template as on short pages."""
    pages = [_page(i, "".join(f"<p>Story {i}, part {k}.</p>" for k in range(150 + 7 * i)) + "<div>All rights</div>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "\n".join(f"Story {i}, part {k}." for k in range(150 + 7 * i)) for i in range(12))


def test_html_template_of_small_hosts(spark):
    """From two different pages on; edited copies of one page are no evidence, nor is a page alone."""
    lead, tail = "<div>Daily Example</div>", "<div>All rights.</div>"
    page = lambda i, host, body: (i, f"https://{host}.example/{i}", f"<html><body>{lead}<div>{body}</div>{tail}</body></html>")
    story = lambda i: f"<p>Story {i} begins on day {i}.</p><p>Then comes part {i * 7} of it.</p>"
    rows, want = [], {}
    for n in (2, 3, 7):
        for k in range(n):
            i = 10 * n + k
            rows.append(page(i, f"small{n}", story(i)))
            want[i] = f"Story {i} begins on day {i}.\nThen comes part {i * 7} of it."
    rows.append(page(100, "alone", story(100)))
    want[100] = "Daily Example\nStory 100 begins on day 100.\nThen comes part 700 of it.\nAll rights."
    parts = [f"Paragraph {k} of the one story there is." for k in range(9)]
    for i, own in enumerate((parts, [parts[0], "Put in later.", *parts[1:]], parts[:4]), 200):
        rows.append(page(i, "edited", "".join(f"<p>{x}</p>" for x in own)))
        want[i] = "\n".join(["Daily Example", *own, "All rights."])
    rows += [(300 + k, f"https://most.example/{k}", f"<html><body>{lead if k else '<div>Special</div>'}<div>{story(k)}</div></body></html>") for k in range(4)]
    want |= {300 + k: f"Story {k} begins on day {k}.\nThen comes part {k * 7} of it." for k in range(4)}  # not on all pages, but outside of the region
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def _induced(rows: list[tuple], marks: bool) -> dict:
    """The rules of the module over all pages at once, in plain Python; every host has one kind of page."""
    hosts: dict = {}
    for row in rows:
        hosts.setdefault(row[1].split("/")[2], []).append(row)
    out = {}
    for own in hosts.values():
        reference = html_text.Reference(min((i, p) for i, _, p in own if p)[1])
        found = {i: reference.leaves(p, marks) for i, _, p in own}
        pages = {tuple(x[0] for x in leaves if x[0]): (leaves, apart) for leaves, apart in found.values()}
        fixed, slots = set(), {}
        low, high = 0, len(reference.nodes)
        if len(pages) > 1 and any(apart for _, apart in pages.values()):
            where: dict = {}
            for leaves, apart in pages.values():
                for key in {(x[1], x[0]) for x in leaves if x[0]}:
                    those = [x for x in leaves if (x[1], x[0]) == key]
                    where.setdefault(key, []).append((apart and any(x[4] for x in those), any(x[2] for x in those)))
            for (node, text), those in where.items():
                n = len(those)
                if n > 1 and n >= min(8, len(pages)) and n >= 0.6 * len(pages) and any(shown for shown, _ in those):
                    fixed.add((node, text))
                elif not any(marked for _, marked in those):
                    chars, many = slots.get(node, (0, 0))
                    slots[node] = chars + n * len(text), many + n

            def inside(n):
                numbers, stack = set(), [n]
                while stack:
                    numbers.add(stack[-1].number)
                    stack.extend(stack.pop().kids)
                return numbers, [sum(slots.get(m, (0, 0))[i] for m in numbers) for i in (0, 1)]

            now, total = reference.nodes[0], sum(c for c, _ in slots.values())
            while True:
                if any(k.tag in ("#", "p", "h1", "h2", "h3", "h4", "h5", "h6") and inside(k)[1][0] for k in now.kids):
                    break
                fitting = [k for k in now.kids if inside(k)[1][0] >= 0.75 * total and inside(k)[1][1] >= 1.5 * len(pages)]
                if not fitting:
                    break
                now = fitting[0]
            low, high = min(inside(now)[0]), max(inside(now)[0]) + 1
        for i, (leaves, _) in found.items():
            placed = [x for x in leaves if low <= x[1] < high] or leaves
            main = any(x[3] for x in placed)
            out[i] = "\n".join(x[0] for x in placed if x[0] and not x[2] and (x[3] or not main) and (x[1], x[0]) not in fixed)
    return out


@pytest.mark.parametrize("marks", [True, False])
def test_html_induction_against_a_plain_version(spark, marks, monkeypatch):
    """On made pages and on a provided table, also where references are joined by shuffle and hosts are dealt over tasks."""
    import random

    import pyarrow.parquet as pq

    random.seed(8)
    word = lambda: random.choice("ab cde fghi jk lmnop qrs tuv wxyz".split())
    text = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for host in range(6):
        notice, rubric = text(12), text(2)
        for k in range(random.choice((1, 2, 5, 12, 30))):
            prose = "".join(f"<{t}>{text(random.randint(1, 30))}</{t}>" for t in random.choices(("p", "div", "blockquote"), k=random.randint(0, 6)))
            menu = "<ul>" + "".join(f"<li>{word()}</li>" for _ in range(5)) + "</ul>"
            extra = random.choice(("", f"<p>{notice}</p>", '<div class="ad">buy</div>', f"<section>{text(9)}</section>"))
            rows.append((100 * host + k, f"https://h{host}.example/{k}", f"<html><body>{menu}<div>{rubric}</div><div>{extra}<h2>{text(3)}</h2>{prose}</div><footer>{text(4)}</footer></body></html>"))
    rows += [(1000 + i, u, p) for i, u, p in rows[:9]]
    monkeypatch.setattr(html_text, "KIND_LEAST", 1 << 40)
    monkeypatch.setattr(html_text, "_CONTAINER", "(never)")
    monkeypatch.setattr(html_text, "_CLASS", "(never)")
    given = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["page_id", "url", "html"]).to_pylist()]
    for pages in (rows, given):
        df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
        want = _induced(pages, marks)
        assert {r["page_id"]: r["text"] for r in html_text.extract(df, marks).collect()} == want
        if pages is given:
            continue
        with monkeypatch.context() as m:
            m.setattr(html_text, "BROADCAST_CHARS", -1)
            m.setattr(html_text, "HOT_PAGES", 4)
            assert {r["page_id"]: r["text"] for r in html_text.extract(df, marks).collect()} == want


def test_html_induction_decides_without_marks(spark):
    """The article elements and the marked adverts of the provided pages are found without looking at either."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id < 500")
    with_marks, without = ({r["page_id"]: r["text"] for r in html_text.extract(pages, marks).collect()} for marks in (True, False))
    assert sum(with_marks[i] == without[i] for i in with_marks) > 0.95 * len(with_marks)


def test_html_kinds_of_one_host(spark):
    """Two kinds of pages, each with menus at other places, learn from references of their own."""
    story = lambda i: f"<p>Story {i} begins on day {i}.</p><p>Then comes part {i * 7} of it.</p>"
    news = [(i, f"https://two.example/{i}", f'<body><div class="x">Daily</div><div class="y">{story(i)}</div></body>') for i in range(20)]
    shop = [(100 + i, f"https://two.example/{i}", f"<body><table><tr><td>Basket</td></tr></table><section><h2>Thing {i}</h2><div>Costs {i * 3}.</div></section><table><tr><td>Pay</td></tr></table></body>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(news + shop, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} begins on day {i}.\nThen comes part {i * 7} of it." for i in range(20))
    assert all(got[100 + i] == f"Thing {i}\nCosts {i * 3}." for i in range(12))


def test_html_of_awkward_pages(spark):
    """Unclosed tags and quotes, deep and long pages are read in linear time; copies of rows each have their text."""
    import time

    began = time.perf_counter()
    rows = [(1, "https://x.example/1", "<a " * 350_000), (2, "https://x.example/2", "<p>t</p>" + "<div \"'" * 100_000 + ">"), (3, "https://x.example/3", "<div>" * 10_000 + "deep"), (4, "https://x.example/4", "<div>" * 9_000 + "deeper"), (5, "https://x.example/5", "<p>word</p>" * 20_000), (5, "https://x.example/5", "<p>word</p>" * 20_000)]
    for _, _, page in rows:
        html_text.parse(page)
    assert time.perf_counter() - began < 2
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 6
    assert (texts[3], texts[4]) == ("deep", "deeper")
    assert texts[5] == "\n".join(["word"] * 20_000)
    assert texts[1].startswith("<a <a")


def test_pipeline_keeps_rows_without_id(spark):
    """Rows without an id come through all stages that don't reject them; of repeated rows one passes the near-duplicate stage."""
    import corpus_pipeline

    words = [f"word{i}" for i in range(400)]
    text = lambda i: " ".join(words[(i * 37 + k * (i + 3)) % 400] for k in range(60))
    rows = [(i, text(i), "en", "s", 0) for i in range(8)] + [(3, text(3), "en", "s", 0), (None, text(20), "en", "z", 0), (None, text(21), "en", None, 0), (9, text(2) + " more", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    near = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in near.collect()) == [(False, i) for i in range(8)] + [(True, 0)] * 2
    families = [(5, text(30), "en", "s", 0), (5, text(31), "en", "s", 0), (3, text(30) + " more", "en", "s", 0), (8, text(31) + " more", "en", "s", 0)]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(families, docs.schema), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == sorted([(3, text(30) + " more"), (5, text(31))])
    mixed = corpus_pipeline.mix_sources(spark, near, "")
    assert {r["text"] for r in mixed.where("doc_id is null").collect()} == {text(20), text(21)}
    assert mixed.columns == docs.columns


def test_pipeline(spark):
    """On the smallest tables: each stage keeps the columns, and what it decides can be seen in its result."""
    import corpus_pipeline
    from portrel.llm import common
    from tests.llm import brute

    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    kept = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf))
        kept.append(docs.toPandas())
    start, quality, near, cut, mixed, encoded = kept
    assert all(list(k.columns) == list(start.columns) for k in (quality, near, cut, mixed))
    labels = common.table(spark, sf, "labels").toPandas().set_index("doc_id").quality
    judged = start[start.doc_id.isin(labels.index)]
    good = judged[judged.doc_id.map(labels) == 1]
    assert good.doc_id.isin(quality.doc_id).mean() > 0.95
    assert len(quality) < len(start)
    parts = brute.components(dict(zip(quality.doc_id, quality.text, strict=True)))
    assert set(near.doc_id) == {c for _, c in parts.values()}
    plain = brute.suffix_dedup(dict(zip(near.doc_id, near.text, strict=True)))
    whole = {i for i, p in plain.items() if not p[1]}
    texts = dict(zip(near.doc_id, near.text, strict=True))
    assert {i: t for i, t in zip(cut.doc_id, cut.text, strict=True) if i in whole} == {i: texts[i] for i in whole}
    assert set(mixed.doc_id) <= set(cut.doc_id)
    assert mixed.groupby("doc_id").size().max() <= 3
    assert len(encoded) == len(mixed)
    assert encoded.decodes.all()
    assert (encoded.n_tokens * 4 == encoded.ids.map(len)).all()
