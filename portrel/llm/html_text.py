"""HTML extraction by wrapper induction.

A page is parsed to a tree of its block elements; inline elements only add text. Pages of one host are aligned with a reference
page of it by simple tree matching: the largest order-keeping match of equal-labelled nodes, parents with parents. Pages whose
containers have the same names and classes are of one *kind*; a kind with ``KIND_LEAST`` pages has a reference of its own, the
others of a host have that of its most frequent kind. What is counted over all pages of a reference, as Spark aggregations and
pages with equal content once, is its *wrapper*:

* A node of the reference whose text is the same on most pages is constant: template, whatever it is marked as. One of the pages
  that share the text must have less than half of its text in common with the reference page, so that copies of one article and
  edited copies of it aren't template.
* The other nodes are varying slots. The *region* is the innermost node that holds ``REGION_PART`` of all text in such slots and
  that has, on average, more than one of them; a node with prose of its own (headings, paragraphs, bare text) isn't left for one of
  its parts. Slots outside of the region go.

Marks only help where that leaves a choice: in the region, elements go that are marked as menus, headers, footers, sidebars,
notices, adverts, forms or reader comments, and where a page has an ``article`` or ``main`` element in it, what is outside of
these. A page without a match for the region, or of a host with one page or with edited copies alone, is judged by marks.

Text: character references decoded, white space inside a block turned into one space, blocks joined by a line feed in page
order. Null and empty pages have empty texts; pages without a usable url are of one host, "". Repeated rows each have their
result; a page without blocks gives an empty text; an empty table gives no rows; extra columns are ignored. Parsing is linear: a
"<" that no ">" follows is text, and once a quote is left open, quotes no longer hide a ">".
"""

from __future__ import annotations

import hashlib
import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portrel.llm import common

#: A text is constant at a node if it is there on so many pages of different content, and on such a part of the wrapper's; of fewer
#: pages (two at least) it must be on all.
TEMPLATE_LEAST, TEMPLATE_PART = 8, 0.6
#: Pages of one kind on a host from which on it has its own reference.
KIND_LEAST = 8
#: The part of all varying text that the region holds, and how many varying slots it has for each page on average.
REGION_PART, REGION_SLOTS = 0.75, 1.5
#: Tables with a row for each reference are broadcast up to so many characters in all; beyond it they are joined by shuffle, and
#: rows of hosts with so many pages are dealt over SALTS tasks.
BROADCAST_CHARS = 32 << 20
HOT_PAGES, SALTS = 10_000, 64
#: Characters of the reference pages that a worker remembers as trees; beyond it the memory starts anew.
REMEMBERED = 16 << 20

# Elements of HTML.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math".split())
_DROP = frozenset("head nav footer aside form button select dialog menu object canvas audio video".split())
_PROSE = frozenset("# p h1 h2 h3 h4 h5 h6".split())
_CLOSED_BY_BLOCK = frozenset(["p"])
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BARRIERS = ("article", "main", "body")
# Words in class, id and role that mark what is no article text.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer header masthead cookie cookies consent notice notices alert newsletter subscribe signup login popup modal overlay paywall "
    "comment comments reply replies disqus related recommended share sharing social widget toolbar pagination pager skip search contentinfo complementary".split()
)

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: The rest of a tag, up to the first ">" outside of quotes; nothing is tried twice.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_MARKED = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_WORDS = re.compile(r"[a-zA-Z]+")
_RAW_END = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in _RAW}

# As regular expressions of Spark: a url's host, and a page's containers and their classes.
_HOST = r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\[\]\s]+)"
_CONTAINER = r"(?i)<(article|aside|div|dl|footer|form|header|main|nav|ol|section|table|ul)[\s>]"
_CLASS = r"(?i)<(?:article|aside|div|dl|footer|form|header|main|nav|ol|section|table|ul)\s[^<>]*?\bclass\s*=\s*[\"']?([^\"'<>]*)"


class Node:
    __slots__ = ("tag", "kids", "text", "drop", "main", "number")

    def __init__(self, tag: str, drop: bool, main: bool):
        self.tag, self.drop, self.main = tag, drop, main
        self.kids: list[Node] = []
        self.text = ""
        self.number = -1


def _marks(attributes: str) -> bool:
    if not attributes:
        return False
    if "hidden" in attributes or "none" in attributes or "aria" in attributes:
        bare = re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)
        if re.search(r"\bhidden\b", bare) or _HIDDEN.search(attributes) and ("none" in attributes or "aria-hidden" in attributes):
            return True
    if "class" not in attributes and "id" not in attributes and "role" not in attributes:
        return False
    return any(w.lower() in _MARKS for m in _MARKED.finditer(attributes) for w in _WORDS.findall(m[1] or m[2] or m[3] or ""))


class _Tags:
    """The tags of a page in order, each found in one pass."""

    def __init__(self, page: str):
        self.page = page
        self.quotes = True
        self.last = page.rfind(">")

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" or "", name, attributes) of the first tag from ``at`` on; comments and declarations have no name."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), "", "", ""
            if at > self.last:
                return None
            name = _NAME.match(page, at)
            if name:
                end = _REST.match(page, name.end()).end() if self.quotes else page.find(">", name.end())
                if end == len(page) or page[end] != ">":
                    self.quotes = False
                    end = page.find(">", name.end())
                return at, end + 1, name[1], name[2].lower(), page[name.end() : end]
            if page.startswith(("<!", "<?"), at):
                return at, page.find(">", at) + 1, "", "", ""
            at += 1
        return None


class _Open:
    """The open elements, and where each name is open."""

    def __init__(self, root: Node):
        self.stack, self.where = [root], {}

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def pop(self) -> None:
        self.where[self.stack.pop().tag].pop()

    def close(self, name: str) -> None:
        """Close the innermost element of a name; paragraphs and list items not beyond the article they are in."""
        at = self.where.get(name)
        if not at or name in ("p", "li") and any(self.where.get(b) and self.where[b][-1] > at[-1] for b in _BARRIERS):
            return
        depth = at[-1]
        while len(self.stack) > depth:
            self.pop()


def parse(page: str | None) -> Node:
    """The tree of block elements. Runs of text become childless nodes named "#"."""
    root = Node("", False, False)
    if not page:
        return root
    tags, opened, run, at = _Tags(page), _Open(root), [], 0
    size = len(page)

    def flush() -> None:
        if run:
            text = "".join(run)
            run.clear()
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                top = opened.top
                leaf = Node("#", top.drop, top.main)
                leaf.text = text
                top.kids.append(leaf)

    skip = None  # an inline element that is marked as none of the article, and how deep it is nested
    depth = 0
    while at < size:
        tag = tags.next(at)
        if tag is None:
            if skip is None:
                run.append(page[at:])
            break
        start, end, closing, name, attributes = tag
        if start > at and skip is None:
            run.append(page[at:start])
        at = end
        if not name:
            continue
        if not closing and name in _RAW:
            over = _RAW_END[name].search(page, at)
            at = over.end() if over else size
            if name not in _INLINE:
                flush()
            continue
        if name in _INLINE:
            if skip is not None:
                if name == skip:
                    depth += -1 if closing else 1
                    if depth == 0:
                        skip = None
            elif name == "br":
                run.append(" ")
            elif not closing and name not in _VOID and _marks(attributes):
                skip, depth = name, 1
            continue
        skip = None
        flush()
        if closing:
            opened.close(name)
            continue
        if name in _VOID:
            continue
        if opened.top.tag in _CLOSED_BY_BLOCK:
            opened.pop()
        ends = _SIBLINGS.get(name)
        if ends and opened.top.tag in ends:
            opened.pop()
        top = opened.top
        is_main = name in ("article", "main")
        drop = top.drop or name in _DROP or (name == "header" and not top.main) or (not is_main and name not in ("html", "body") and _marks(attributes))
        node = Node(name, drop, top.main or is_main)
        top.kids.append(node)
        opened.push(node)
    flush()
    return root


def number(root: Node) -> list[Node]:
    """All nodes in page order, numbered."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.number = len(out)
        out.append(node)
        stack.extend(reversed(node.kids))
    return out


class _Shapes:
    """Subtrees told apart by their labels alone, and how many nodes of two of them match at most."""

    def __init__(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.tags: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}

    def of(self, root: Node) -> dict[int, int]:
        """The shape of each node of a numbered tree, by its number."""
        order, stack, out = [], [root], {}
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.kids)
        for node in reversed(order):
            kids = tuple([out[k.number] for k in node.kids])
            shape = self.ids.setdefault((node.tag, kids), len(self.tags))
            if shape == len(self.tags):
                self.tags.append(node.tag)
                self.kids.append(kids)
                self.sizes.append(1 + sum(self.sizes[k] for k in kids))
            out[node.number] = shape
        return out

    def known(self, s: int, t: int) -> int | None:
        if self.tags[s] != self.tags[t]:
            return 0
        if s == t:
            return self.sizes[s]
        return self.scores.get((s, t)) if self.kids[s] and self.kids[t] else 1

    def score(self, s: int, t: int) -> int:
        """How many nodes match; an explicit stack, so that trees may be of any depth."""
        stack = [(s, t)]
        while stack:
            pair = stack[-1]
            if self.known(*pair) is None:
                x, y = self.kids[pair[0]], self.kids[pair[1]]
                low, high_x, high_y = _ends(x, y)
                us, vs = set(x[low:high_x]), set(y[low:high_y])
                open_ = [(u, v) for u in us for v in vs if self.known(u, v) is None]
                if open_:
                    stack.extend(open_)
                    continue
                same = sum(self.sizes[k] for k in (*x[:low], *x[high_x:]))
                self.scores[pair] = 1 + same + _Lists(self, x[low:high_x], y[low:high_y]).most()
            stack.pop()
        return self.known(s, t)


def _ends(x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, int, int]:
    """Where two lists of shapes begin and end to differ. Equal shapes at either end match each other in some largest match."""
    low, high_x, high_y = 0, len(x), len(y)
    while low < high_x and low < high_y and x[low] == y[low]:
        low += 1
    while high_x > low and high_y > low and x[high_x - 1] == y[high_y - 1]:
        high_x -= 1
        high_y -= 1
    return low, high_x, high_y


class _Lists:
    """Order-keeping matches of two lists of shapes whose scores are known, a row of the table at a time."""

    def __init__(self, shapes: _Shapes, x: tuple[int, ...], y: tuple[int, ...]):
        us, vs = sorted(set(x)), sorted(set(y))
        at_u, at_v = {u: i for i, u in enumerate(us)}, {v: i for i, v in enumerate(vs)}
        self.worth = np.array([[shapes.known(u, v) for v in vs] for u in us], np.int64).reshape(len(us), len(vs))
        self.x, self.y = [at_u[u] for u in x], np.array([at_v[v] for v in y], np.int64)

    def _next(self, above: np.ndarray, i: int) -> np.ndarray:
        row = np.zeros_like(above)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + self.worth[self.x[i]][self.y]), out=row[1:])
        return row

    def most(self) -> int:
        row = np.zeros(len(self.y) + 1, np.int64)
        if len(self.y):
            for i in range(len(self.x)):
                row = self._next(row, i)
        return int(row[-1])

    def pairs(self) -> list[tuple[int, int]]:
        """The places that match in one largest match, last ones first. Of n rows about the root of n are kept, the others made again."""
        out: list[tuple[int, int]] = []
        if not len(self.x) or not len(self.y):
            return out
        step = math.isqrt(len(self.x)) + 1
        kept, row = [], np.zeros(len(self.y) + 1, np.int64)
        for i in range(len(self.x)):
            if i % step == 0:
                kept.append(row)
            row = self._next(row, i)
        j = len(self.y)
        for begin in range((len(kept) - 1) * step, -1, -step):
            rows = [kept.pop()]
            for i in range(begin, min(begin + step, len(self.x))):
                rows.append(self._next(rows[-1], i))
            for k in range(len(rows) - 1, 0, -1):
                if rows[k][j] != rows[k - 1][j]:
                    j = int(np.searchsorted(rows[k], rows[k][j])) - 1
                    out.append((begin + k - 1, j))
        return out


def match(a: Node, b: Node, out: list[tuple[int, int]], shapes: _Shapes | None = None) -> int:
    """Simple tree matching of two equal-labelled numbered trees: how many nodes match at most; the pairs of numbers of one such
    match go to ``out``. What is matched depends on no limit of size or depth. ``shapes`` may be kept for further trees."""
    shapes = shapes or _Shapes()
    of_a, of_b = shapes.of(a), shapes.of(b)
    before, stack = len(out), [(a, b)]
    while stack:
        p, q = stack.pop()
        out.append((p.number, q.number))
        if not p.kids or not q.kids:
            continue
        x, y = shapes.kids[of_a[p.number]], shapes.kids[of_b[q.number]]
        low, high_x, high_y = _ends(x, y)
        stack.extend(zip(p.kids[:low], q.kids[:low], strict=True))
        stack.extend(zip(p.kids[high_x:], q.kids[high_y:], strict=True))
        x, y = x[low:high_x], y[low:high_y]
        if x and y:
            for u in set(x):
                for v in set(y):
                    shapes.score(u, v)
            stack.extend((p.kids[low + i], q.kids[low + j]) for i, j in _Lists(shapes, x, y).pairs())
    return len(out) - before


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Reference:
    """A reference page as a numbered tree, with what matching learned of its shape."""

    def __init__(self, page: str | None):
        self.nodes = number(parse(page))
        self.shapes = _Shapes()

    def leaves(self, page: str | None, marks: bool = True) -> tuple[list[tuple[str, int, bool, bool, bool]], bool]:
        """(text, node, marked, main, whether the reference has the same text there) of each leaf of a page in its order,
        where node is the reference's that the leaf, or its closest element with a match, matches; and whether the page has less
        than half of the shorter one's text in common with the reference, wherever it stands. Elements without text are leaves too."""
        if len(self.shapes.scores) + len(self.shapes.tags) > 50_000:
            self.shapes = _Shapes()
        root = parse(page)
        own = number(root)
        pairs: list[tuple[int, int]] = []
        match(self.nodes[0], root, pairs, self.shapes)
        at = [-1] * len(own)
        for p, q in pairs:
            at[q] = p
        out = []
        for n in own:
            for k in n.kids:
                if at[k.number] < 0:
                    at[k.number] = ~at[n.number] if at[n.number] >= 0 else at[n.number]
            if not n.kids:
                place = at[n.number]
                out.append((n.text, place if place >= 0 else ~place, marks and n.drop, marks and n.main, place >= 0 and bool(n.text) and self.nodes[place].text == n.text))
        mine = [(x[0], x[2]) for x in out if x[0]]
        said = {n.text for n in self.nodes if n.text and not (marks and n.drop)}
        both = [sum(len(t) for t, gone in mine if not gone), sum(len(n.text) for n in self.nodes if n.text and not (marks and n.drop))]
        return out, 2 * sum(len(t) for t, gone in mine if not gone and t in said) < min(both)


def region(nodes: list[Node], slots: dict[int, tuple[int, int]], pages: int) -> tuple[int, int]:
    """First and next-to-last number of the region's nodes, from (characters, leaves) of varying text at each node."""
    ends = [n.number + 1 for n in nodes]
    for n in reversed(nodes):
        if n.kids:
            ends[n.number] = ends[n.kids[-1].number]
    sums = np.zeros((len(nodes) + 1, 2), np.int64)
    for node, found in slots.items():
        sums[node + 1] = found
    sums = np.cumsum(sums, axis=0)
    inside = lambda n: sums[ends[n.number]] - sums[n.number]
    now = nodes[0]
    while now.kids:
        chars = [int(inside(k)[0]) for k in now.kids]
        if any(k.tag in _PROSE and c for k, c in zip(now.kids, chars, strict=True)):
            break
        best = now.kids[int(np.argmax(chars))]
        if max(chars) < REGION_PART * sums[-1][0] or inside(best)[1] < REGION_SLOTS * pages:
            break
        now = best
    return now.number, ends[now.number]


def _hosted(pages: DataFrame) -> DataFrame:
    """(host, kind, page_id, url, html)."""
    host = F.coalesce(F.regexp_extract(F.lower("url"), _HOST, 1), F.lit(""))
    names = [F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(x), F.lit(1)))) for x in (_CONTAINER, _CLASS)]
    return pages.select(host.alias("host"), F.xxhash64(*names).alias("kind"), "page_id", "url", "html")


def _beside(rows: DataFrame, few: DataFrame, on: list[str], chars: Column, how: str = "left") -> DataFrame:
    """Join of rows with a table that has one row for each reference, ``chars`` characters long, by host and what else."""
    if (few.agg(F.sum(chars)).head()[0] or 0) <= BROADCAST_CHARS:
        return rows.join(F.broadcast(few), on, how)
    hot = common.stored(rows.groupBy("host").count().where(F.col("count") >= HOT_PAGES).select("host", F.lit(SALTS).alias("salts")))
    salts = F.coalesce("salts", F.lit(1))  # at most one hot host for HOT_PAGES rows; merged, should even these be many
    dealt = rows.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64(*[c for c in ("page_id", "said") if c in rows.columns]), salts).cast("int")).drop("salts")
    spread = few.join(hot, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(spread.hint("merge"), [*on, "salt"], how).drop("salt")


def _references(hosted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference pages (host, kind, reference): of kinds with many pages, and of each host's most frequent kind."""
    who = F.min(F.struct("page_id", F.xxhash64("html").alias("hash"))).alias("who")
    kinds = common.stored(hosted.where(F.length("html") > 0).groupBy("host", "kind").agg(F.count(F.lit(1)).alias("n"), who))
    main = kinds.groupBy("host").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind")).withColumn("is_main", F.lit(True))
    wanted = kinds.join(main, ["host", "kind"], "left").where(F.col("is_main") | (F.col("n") >= KIND_LEAST))
    wanted = common.stored(wanted.select("host", "kind", "who", F.coalesce("is_main", F.lit(False)).alias("is_main")))
    found = _beside(hosted.where(F.length("html") > 0), wanted, ["host", "kind"], F.length("host") + 40)
    found = found.where(F.struct("page_id", F.xxhash64("html").alias("hash")).eqNullSafe(F.col("who")))
    references = common.stored(found.groupBy("host", "kind", "is_main").agg(F.min("html").alias("reference")))
    return references.drop("is_main"), references.where("is_main").select("host", F.col("kind").alias("main_kind"), F.col("reference").alias("main_reference"))


LEAF = "struct<text string, node int, marked boolean, main boolean, same boolean>"
LEAVES = f"page_id long, url string, host string, wrapper long, content long, apart boolean, leaves array<{LEAF}>"


def _leaves(hosted: DataFrame, marks: bool) -> tuple[DataFrame, DataFrame]:
    """The aligned leaves of each page, and the references (host, wrapper, reference)."""
    own, main = _references(hosted)
    # The shorter way first: a page's own kind, then its host's main one.
    both = _beside(_beside(hosted, own, ["host", "kind"], F.length("reference")), main, ["host"], F.length("main_reference"))
    wrapper = F.when(F.col("reference").isNotNull(), F.col("kind")).otherwise(F.col("main_kind"))
    aligned = both.select("page_id", "url", "html", "host", wrapper.alias("wrapper"), F.coalesce("reference", "main_reference").alias("reference"))
    kind = pa.struct([("text", pa.string()), ("node", pa.int32()), ("marked", pa.bool_()), ("main", pa.bool_()), ("same", pa.bool_())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache: dict[tuple, Reference] = {}
        held = 0
        content, others, ends, flat = [], [], [0], []
        for host, wrapper, reference, page in zip(*(batch.column(c).to_pylist() for c in ("host", "wrapper", "reference", "html")), strict=True):
            key = (host, wrapper)
            if key not in cache:
                held += len(reference or "")
                if held > REMEMBERED:
                    cache.clear()
                    held = len(reference or "")
                cache[key] = Reference(reference)
            leaves, apart = cache[key].leaves(page, marks)
            content.append(digest("\n".join(x[0] for x in leaves if x[0])))
            others.append(apart)
            flat.extend(leaves)
            ends.append(len(flat))
        columns = zip(*flat, strict=True) if flat else [()] * 5
        fields = pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host", "wrapper")), pa.array(content, pa.int64()), pa.array(others, pa.bool_()), lists], ["page_id", "url", "host", "wrapper", "content", "apart", "leaves"])

    return common.stored(common.map_batches(aligned, step, LEAVES), dense=True), own.withColumnRenamed("kind", "wrapper")


def wrappers(leaves: DataFrame, references: DataFrame) -> DataFrame:
    """(host, wrapper, low, high, fixed): the region's nodes and the constant texts (node, said) of each reference that has any."""
    key = ["host", "wrapper"]
    seen = leaves.select(*key, "content", "apart", F.explode("leaves").alias("leaf")).where(F.length("leaf.text") > 0)
    leaf = [F.col("leaf.node").alias("node"), F.xxhash64("leaf.text").alias("said")]
    told = [F.max("apart").alias("apart"), F.max(F.col("apart") & F.col("leaf.same")).alias("shown"), F.max("leaf.marked").alias("marked"), F.first(F.length("leaf.text")).alias("chars")]
    different = seen.groupBy(*key, *leaf, "content").agg(*told)
    said = different.groupBy(*key, "node", "said").agg(F.count(F.lit(1)).alias("n"), F.max("shown").alias("shown"), F.max("marked").alias("marked"), F.first("chars").alias("chars"))
    sizes = leaves.groupBy(*key, "content").agg(F.max("apart").alias("apart")).groupBy(*key).agg(F.count(F.lit(1)).alias("pages"), F.max("apart").alias("apart"))
    sizes = common.stored(sizes.where((F.col("pages") > 1) & F.col("apart")))
    judged = _beside(said, sizes, key, F.length("host") + 24, "inner")
    enough = (F.col("n") >= F.least(F.lit(TEMPLATE_LEAST), "pages")) & (F.col("n") >= TEMPLATE_PART * F.col("pages")) & (F.col("n") > 1)
    judged = common.stored(judged.withColumn("constant", enough & F.col("shown")))
    fixed = judged.where("constant").groupBy(*key).agg(F.collect_list(F.struct("node", "said")).alias("fixed"))
    slots = judged.where("not constant and not marked").groupBy(*key, "node", "pages").agg(F.sum(F.col("n") * F.col("chars")).alias("chars"), F.sum("n").alias("n"))
    slots = slots.groupBy(*key, "pages").agg(F.collect_list(F.struct("node", "chars", "n")).alias("slots"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for page, pages, slots in zip(*(batch.column(c).to_pylist() for c in ("reference", "pages", "slots")), strict=True):
            found.append(region(number(parse(page)), {s["node"]: (s["chars"], s["n"]) for s in slots}, pages))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), *(pa.array(list(x), pa.int32()) for x in zip(*found, strict=True))], [*key, "low", "high"])

    regions = common.map_batches(references.join(slots, key), step, "host string, wrapper long, low int, high int")
    return common.stored(regions.join(fixed, key, "full"))


def extract(pages: DataFrame, marks: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages(page_id, url, html)``; ``marks``: whether marks help."""
    spark = pages.sparkSession
    common.small_batches(spark)
    leaves, references = _leaves(_hosted(pages), marks)
    learned = wrappers(leaves, references)
    rows = _beside(leaves, learned, ["host", "wrapper"], F.length("host") + 32 + 24 * F.coalesce(F.size("fixed"), F.lit(0)))
    here = F.filter("leaves", lambda x: (x["node"] >= F.col("low")) & (x["node"] < F.col("high")))
    rows = rows.withColumn("placed", F.when(F.col("low").isNotNull() & (F.size(here) > 0), here).otherwise(F.col("leaves")))
    template = lambda x: F.coalesce(F.array_contains("fixed", F.struct(x["node"].alias("node"), F.xxhash64(x["text"]).alias("said"))), F.lit(False))
    some_main = F.exists("placed", lambda x: x["main"])
    kept = F.filter("placed", lambda x: ~x["marked"] & (F.length(x["text"]) > 0) & (x["main"] | ~some_main) & ~template(x))
    text = F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("text")
    return rows.select("page_id", "url", text).withColumn("n_chars", F.length("text").cast("long"))
