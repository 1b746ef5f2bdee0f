"""Mixing sources to target weights, in DataFrame operations only.

Targets: every source has a weight; together the sources get ``total`` words, shared by weight, but none more than
``cap`` times its own size; what is above goes to the others by weight until none is above. That is one level L with
target = min(cap * size, L * weight), found from running sums over the sources in the order of cap * size / weight.

Taking: a source's target is whole epochs of the source, then a fraction of one. Within the fraction, documents come in the
order of Efraimidis-Spirakis keys, -ln(u) / quality weight with u from a hash of the id, ascending, until the words run
out; the last document gives only the words still missing. Sorting a whole source in one task is not needed: running sums
over ranges of keys find the range in which the words run out, then a finer range in it, and only that range's documents
are sorted.

Null texts have size 0 and are never taken; null sources are one source, the last. Repeated rows are documents of their
own. An empty table gives no rows. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from portrel.llm import common

WORD = r"[^\x20\x09-\x0D]+"
SHARES = (5.0, 2.0, 1.0)
CAP = 3.0
RANGES = 1024
#: Sources are broadcast up to so many rows; beyond it they are joined by shuffle.
BROADCAST_ROWS = 100_000
SEED = 20

#: Fixed characters that lower a document's weight by their share of its text.
_SYMBOLS = "!\"#$%&()*+/0123456789:;<=>?@[\\]^_`{|}~"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plain_share(text: Column) -> Column:
    """Quality weight, 0.05 to 1: the share of characters that are neither digits nor symbols, squared."""
    share = F.length(F.translate(text, _SYMBOLS, "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.coalesce(share * share, F.lit(0.0)), F.lit(0.05))


def beside(rows: DataFrame, few: DataFrame, on: Column) -> DataFrame:
    """Left join with a table whose size is checked: broadcast while it has at most BROADCAST_ROWS rows."""
    small = few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(few) if small else few, on, "left")


def targets(sizes: DataFrame, shares: Sequence[float] = SHARES, cap: float = CAP) -> DataFrame:
    """From (source, source_size) to (source, source_size, weight, target). One row for each source; sorted in one task."""
    everything, by_ratio = W.partitionBy(), W.orderBy("ratio", "place")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, shares)), ((F.col("place") - 1) % len(shares) + 1).cast("int"))
    rows = sizes.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight)
    rows = rows.withColumn("ceiling", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("ceiling") / F.col("weight"))
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("turn", F.row_number().over(by_ratio))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("turn", "level"))).over(everything)
    rows = rows.withColumn("found", F.coalesce(first["level"], F.lit(0.0)))
    return rows.select("source", "source_size", "weight", F.least("ceiling", F.col("found") * F.col("weight")).alias("target"))


def _cut(ranges: DataFrame, number: str) -> DataFrame:
    """From (sid, number, words, need) the range in which ``need`` words are reached, and the words before it."""
    order = W.partitionBy("sid").orderBy(number)
    summed = ranges.withColumn("upto", F.sum("words").over(order)).withColumn("before", F.col("upto") - F.col("words"))
    hit = summed.where((F.col("before") < F.col("need")) & (F.col("need") <= F.col("upto")))
    return hit.select("sid", F.col(number).alias(f"{number}_cut"), (F.col("need") - F.col("before")).alias(f"{number}_left"))


def mix(docs: DataFrame, shares: Sequence[float] = SHARES, cap: float = CAP, weight: Column | None = None, seed: int = SEED, also: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, and the columns ``also``) for every row of ``docs(doc_id, source, text)``."""
    quality = plain_share(F.col("text")) if weight is None else weight
    sized = common.stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), quality.cast("double").alias("quality"), *[F.col(c).alias(f"also{i}") for i, c in enumerate(also)]))
    few = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), shares, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    few = few.withColumn("epochs", epochs).withColumn("need", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    few = common.stored(few.withColumn("sid", F.xxhash64("source", F.lit(1))).withColumnRenamed("source", "of"))

    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11)
    u = (hashed.cast("double") + 0.5) / F.lit(float(1 << 53))
    rows = beside(sized, few, F.col("source").eqNullSafe(F.col("of"))).drop("of", "source").withColumn("key", -F.log(u) / F.col("quality"))
    place = 1.0 - F.exp(-F.col("key"))
    rows = rows.withColumn("coarse", F.least(F.floor(place * RANGES), F.lit(RANGES - 1)).cast("int"))
    rows = rows.withColumn("fine", F.pmod(F.least(F.floor(place * RANGES * RANGES), F.lit(RANGES * RANGES - 1)), F.lit(RANGES)).cast("int"))

    words = F.sum("size").alias("words")
    coarse = common.stored(_cut(rows.groupBy("sid", "coarse", "need").agg(words), "coarse"))
    rows = beside(rows, coarse.withColumnRenamed("sid", "sid1"), F.col("sid") == F.col("sid1")).drop("sid1")
    inside = rows.where(F.col("coarse") == F.col("coarse_cut"))
    fine = common.stored(_cut(inside.groupBy("sid", "fine", F.col("coarse_left").alias("need")).agg(words), "fine"))
    rows = beside(rows, fine.withColumnRenamed("sid", "sid2"), F.col("sid") == F.col("sid2")).drop("sid2")

    at_cut = F.coalesce((F.col("coarse") == F.col("coarse_cut")) & (F.col("fine") == F.col("fine_cut")), F.lit(False))
    in_front = (F.col("coarse") < F.col("coarse_cut")) | ((F.col("coarse") == F.col("coarse_cut")) & (F.col("fine") < F.col("fine_cut")))
    clear = rows.where(~at_cut).withColumn("part", F.when(in_front, F.col("size")).otherwise(F.lit(0)))
    order = W.partitionBy("sid").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    sorted_ones = rows.where(at_cut).withColumn("left", F.col("fine_left") - F.coalesce(F.sum("size").over(order), F.lit(0)))
    sorted_ones = sorted_ones.withColumn("part", F.least(F.greatest(F.col("left"), F.lit(0)), F.col("size"))).drop("left")
    both = clear.unionByName(sorted_ones)
    return both.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), *[F.col(f"also{i}").alias(c) for i, c in enumerate(also)])
