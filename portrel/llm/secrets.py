"""Secret scans by multipart credential linking, in DataFrame operations only.

*Base* spans stand alone: assignments to a name like ``password``, access identifiers (``AKIA...``) and long hexadecimal runs.
*Weak* candidates say little alone: a login name, an address of a service, a mixed string as a signing key has. A credential has parts
that complete each other, so a weak candidate is reported only where the parts it needs co-occur in its *scope*, a run of lines
without an empty one:

* ``identifier`` (a login, user, account, client or key id that is assigned) needs a secret,
* ``secret`` (a run of ``SECRET_LENGTH`` or more letters, digits and ``+/_-`` with capitals, small letters and digits) needs an identifier,
* ``endpoint`` (``scheme://...``, or a host that is assigned) needs an identifier and a secret.

Access identifiers are identifiers, assignments and hexadecimal runs are secrets, weak parts are what they are called; candidates that
overlap a base span are left to it.

Positions are code points. They are found without a Python worker: what a pattern matches and what lies between its matches
come from two built-in functions, and running sums of their lengths are the places. Spans are joined with the scopes that hold
them as intervals: scopes are listed under each ``BIN`` code points that they touch, spans under the one where they start, so a
long document is dealt out by its bins. What a scope holds is aggregated (kinds, never pairs of spans) before weak spans
meet it, so a scope with many spans costs as much as it has.

Null and empty texts have no spans. Every row is a document of its own, whatever its id; extra columns are ignored, an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from portrel.llm import common

#: Fixed patterns of the base spans, whole matches; group 2 of an assignment is its value.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: ``AKIA[A-Z0-9]+`` and ``[0-9a-f]+`` of at least these lengths, and a value's least length.
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
#: Weak candidates.
SECRET_LENGTH = 32
IDENTIFIER = r"""((?:[uU][sS][eE][rR]|[lL][oO][gG][iI][nN]|[aA][cC][cC][oO][uU][nN][tT]|[cC][lL][iI][eE][nN][tT]|[aA][cC][cC][eE][sS][sS][_-]?[kK][eE][yY])(?:[_-]?(?:[iI][dD]|[nN][aA][mM][eE]))?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+_.-]{3,})"""
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,19}://[^\x20\x09-\x0D"'<>]+|([hH][oO][sS][tT]|[eE][nN][dD][pP][oO][iI][nN][tT])(?:[nN][aA][mM][eE])?["']?\x20*[:=]\x20*["']?([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"""
MIXED = rf"[A-Za-z0-9+/_-]{{{SECRET_LENGTH},}}"
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE = KINDS[:3]
BIN = 4096
#: Line ends, the empty lines between scopes.
EMPTY_LINES = r"\n[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*"

SCOPE = len(KINDS)


def _items(text: Column, pattern: str, fits: Column) -> Column:
    """For each match the code points between the match before and it, its own, and whether it ``fits``; null without a match."""
    matches = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), fits, lambda m, ok: F.struct(F.length(m).alias("len"), ok.alias("fits")))
    gaps = F.split(text, pattern, -1)  # one more than the matches: the last zips with none
    both = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), m["len"].cast("long").alias("len"), m["fits"].alias("fits")))
    return F.when(text.rlike(pattern), both)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _found(docs: DataFrame) -> DataFrame:
    """(row, doc_id, lists) with the items of each kind that a text has, and of its scopes if it has weak candidates."""
    text = F.coalesce("text", F.lit(""))
    no_test = lambda p: F.transform(_all(text, p), lambda _: F.lit(True))
    mixed = lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    # An identifier's or a hexadecimal match that is too short leaves nothing behind that could match, so their lengths are in the pattern.
    access, hexadecimal = f"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}", f"[0-9a-f]{{{HEX_LENGTH},}}"
    items = [
        _items(text, ASSIGN, F.transform(_all(text, ASSIGN, 2), lambda v: F.length(v) >= ASSIGN_VALUE)), _items(text, access, no_test(access)), _items(text, hexadecimal, no_test(hexadecimal)),
        _items(text, IDENTIFIER, no_test(IDENTIFIER)), _items(text, MIXED, F.transform(_all(text, MIXED), mixed)), _items(text, ENDPOINT, no_test(ENDPOINT)),
    ]
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("items")) for k, x in enumerate(items)])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text")).withColumn("lists", F.filter(lists, lambda x: x["items"].isNotNull()).alias("lists"))
    lines = F.zip_with(F.split("text", EMPTY_LINES, -1), _all(F.col("text"), EMPTY_LINES), lambda p, e: F.struct(F.length(p).cast("long").alias("gap"), F.coalesce(F.length(e), F.lit(0)).cast("long").alias("len"), F.lit(True).alias("fits")))
    scopes = F.when(F.exists("lists", lambda x: x["kind"] >= len(BASE)), lines)
    return common.stored(rows.select("row", "doc_id", "lists", scopes.alias("scopes")))


def _placed(found: DataFrame, what: Column) -> DataFrame:
    """(row, kind, start, end, fits, gap) of the items in lists of ``what``: running sums within each text and kind."""
    listed = found.select("row", F.explode(what).alias("x")).select("row", "x.kind", F.posexplode("x.items").alias("place", "item")).select("row", "kind", "place", "item.*")
    listed = listed.where(F.col("len").isNotNull()).repartition(common.partitions(found.sparkSession), "row")
    upto = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("row", "kind").orderBy("place"))
    return listed.withColumn("end", upto).withColumn("start", F.col("end") - F.col("len"))


def _spans(found: DataFrame) -> DataFrame:
    """(row, kind, start, end) of base spans and of the candidates that overlap none."""
    fit = _placed(found, F.col("lists")).where("fits").select("row", "kind", "start", "end")
    base = F.col("kind") < len(BASE)
    before, behind = W.partitionBy("row").orderBy("start", "kind"), W.partitionBy("row").orderBy(F.col("start").desc(), F.col("kind").desc())
    reach, following = F.max(F.when(base, F.col("end"))).over(before), F.min(F.when(base, F.col("start"))).over(behind)
    free = (F.coalesce(F.col("reach"), F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("following"), F.col("end")) >= F.col("end"))
    return fit.withColumn("reach", reach).withColumn("following", following).where(base | free).drop("reach", "following")


def _linked(spans: DataFrame, scopes: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the candidates whose scope holds what completes them."""
    number = lambda x: F.floor(F.col(x) / BIN)
    held = scopes.select("row", F.col("start").alias("scope"), F.col("end").alias("upto"), F.explode(F.sequence(number("start"), number("end"))).alias("bin"))
    inside = (F.col("scope") <= F.col("start")) & (F.col("start") < F.col("upto"))
    joined = spans.withColumn("bin", number("start")).join(held, ["row", "bin"]).where(inside).select("row", "scope", "kind", "start", "end")
    kind = lambda *names: F.max(F.col("kind").isin(*[KINDS.index(n) for n in names]))
    has = joined.groupBy("row", "scope").agg(kind("access", "identifier").alias("identifier"), kind("assign", "hex", "secret").alias("secret"))
    needs = F.when(F.col("kind") == KINDS.index("identifier"), F.col("secret")).when(F.col("kind") == KINDS.index("secret"), F.col("identifier")).otherwise(F.col("identifier") & F.col("secret"))
    return joined.where(F.col("kind") >= len(BASE)).join(has, ["row", "scope"]).where(needs).select("row", "kind", "start", "end")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs(doc_id, text)``: spans(start, kind, end) in order, kinds as numbers in ``KINDS``."""
    found = _found(docs)
    spans = common.stored(_spans(found))
    lines = F.when(F.col("scopes").isNotNull(), F.array(F.struct(F.lit(SCOPE).alias("kind"), F.col("scopes").alias("items"))))
    weak = spans.where(F.col("kind") >= len(BASE)).select("row").distinct()
    scopes = _placed(found.join(weak, "row", "left_semi"), lines).select("row", (F.col("start") - F.col("gap")).alias("start"), F.col("start").alias("end"))
    every = spans.where(F.col("kind") < len(BASE)).unionByName(_linked(spans, scopes))
    listed = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))  # of one text
    return found.select("row", "doc_id").join(listed, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")).alias("spans"))


def named(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): what ``scan`` found, counted and spelled out."""
    rows = scan(docs)
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
