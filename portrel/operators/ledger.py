"""Byte ledgers, truncation points and their selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from portrel.operators import strips

KEY = ("tile", "component", "resolution", "subband")


def closure(rows: DataFrame, by: Sequence[str], whole: str, parts: Sequence[str]) -> DataFrame:
    """Sums by group and whether the parts close to the whole."""
    s = rows.groupBy(*by).agg(F.sum(whole).alias(whole), *[F.sum(p).alias(p) for p in parts])
    return s.withColumn("closes", F.col(whole) == sum((F.col(p) for p in parts[1:]), F.col(parts[0])))


def mismatches(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Both-sided comparison by key: rows that only one side has, or whose values differ."""
    both = a.withColumnRenamed(value, "left_value").join(b.withColumnRenamed(value, "right_value"), list(keys), "full")
    kind = F.when(F.col("right_value").isNull(), "left only").when(F.col("left_value").isNull(), "right only").when(F.col("left_value") != F.col("right_value"), "differs")
    return both.withColumn("kind", kind).where(F.col("kind").isNotNull())


def regional_ratio(totals: DataFrame, area: str, face: str, least: int = 24) -> DataFrame:
    """Raw bytes of an area (3 a pixel), the bytes that a ``least``:1 compression allows, and the status."""
    raw = 3 * F.col(area)
    allowed = F.ceil(raw / least).cast("long")
    status = F.when(F.col(face) <= 0, "unavailable").when(F.col(face) >= allowed, "satisfied").otherwise("over compressed")
    return totals.withColumns({"raw": raw, "allowed": allowed, "status": status})


def prefix_intervals(points: DataFrame, block: str = "block_id", order: str = "pass_no") -> DataFrame:
    """From the last truncation point back, those with strictly fewer bytes than all after; their steps in bytes and gain."""
    after = W.partitionBy(block).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, -1)
    kept = points.withColumn("least", F.min("rate").over(after)).where(F.col("least").isNull() | (F.col("rate") < F.col("least"))).drop("least")
    w = W.partitionBy(block).orderBy(order)
    return kept.withColumns({"bytes": F.col("rate") - F.coalesce(F.lag("rate").over(w), F.lit(0)), "gain": F.col("dist") - F.coalesce(F.lag("dist").over(w), F.lit(0))})


def hull(points: DataFrame, block: str = "block_id") -> DataFrame:
    """Truncation points on the upper convex hull of gain over bytes, from (0, 0): a fold with a stack in each block's array."""
    one = F.struct("rate", "dist", "pass_no")
    lists = points.groupBy(block).agg(F.array_sort(F.collect_list(one)).alias("p"))
    kind = lists.schema["p"].dataType.simpleString()

    def slope_falls(s, p):  # noqa: ANN001, ANN202
        n = F.size(s)
        a, b = F.get(s, n - 2), F.get(s, n - 1)
        ra, da = F.coalesce(a["rate"], F.lit(0)), F.coalesce(a["dist"], F.lit(0))
        return (b["dist"] - da) * (p["rate"] - b["rate"]) > (p["dist"] - b["dist"]) * (b["rate"] - ra)

    def push(stack, p):  # noqa: ANN001, ANN202
        popped = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(stack), F.lit(1))), stack, lambda s, _: F.when((F.size(s) > 0) & ~slope_falls(s, p), F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s))
        return F.concat(popped, F.array(p))

    folded = F.aggregate("p", F.array().cast(kind), push)
    return lists.select(block, F.explode(folded).alias("h")).select(block, "h.pass_no", "h.rate", "h.dist")


def by_block(points: DataFrame, block: str = "block_id") -> DataFrame:
    """(block, points): a row for each block with its truncation points, in their order; the points are sorted once, whatever is asked of them."""
    w = W.partitionBy(block).orderBy("pass_no")
    held = F.collect_list(F.struct("rate", "dist")).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))  # a block's passes
    return points.select(block, held.alias("points"), F.row_number().over(w).alias("_n")).where("_n = 1").drop("_n")


def best_of(blocks: DataFrame, lambdas: Sequence[float]) -> DataFrame:
    """``best_at`` of ``by_block``'s rows: each trade-off's choice is made in the block's row, and only sums leave a task."""

    kinds = ["bigint" if isinstance(f.dataType, IntegralType) else "double" for f in blocks.schema["points"].dataType.elementType]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rates, dists, counts = ([0] * len(lambdas) for _ in range(3))
        for batch in batches:
            held = batch.column("points")
            sizes = np.diff(np.asarray(held.offsets))
            values = [held.flatten().field(k) for k in (0, 1)]
            known = np.asarray(values[0].is_valid()) & np.asarray(values[1].is_valid())  # a point that lacks one is worth nothing
            rate, dist = (np.where(known, np.asarray(v.fill_null(0), np.int64 if kind == "bigint" else np.float64), 0) for v, kind in zip(values, kinds, strict=True))
            starts = np.cumsum(sizes) - sizes
            for i, t in enumerate(lambdas if len(batch) else ()):
                worth = dist - float(t) * rate
                most = np.maximum.reduceat(worth, starts)
                top = np.flatnonzero((worth == np.repeat(most, sizes)) & (worth > 0))
                block = np.searchsorted(starts, top, "right")
                order = np.lexsort((rate[top], block)) if (block[1:] == block[:-1]).any() else slice(None)
                top, block = top[order], block[order]
                chosen = top[np.append(True, block[1:] != block[:-1])[: len(top)]]
                rates[i] += rate[chosen].sum().item()
                dists[i] += dist[chosen].sum().item()
                counts[i] += len(chosen)
        yield pa.RecordBatch.from_arrays([pa.array(list(map(float, lambdas))), *(pa.array(v, pa.int64() if k == "bigint" else pa.float64()) for v, k in zip((rates, dists), kinds, strict=True)), pa.array(counts, pa.int64())], ["lambda", "rate", "dist", "blocks"])

    sums = blocks.select("points").mapInArrow(run, f"lambda double, rate {kinds[0]}, dist {kinds[1]}, blocks long").where("blocks > 0")
    return sums.groupBy("lambda").agg(*[F.sum(c).alias(c) for c in ("rate", "dist", "blocks")])


def best_at(points: DataFrame, lambdas: Sequence[float], block: str = "block_id") -> DataFrame:
    """(lambda, rate, dist, blocks): for each trade-off the sums of each block's point with the most dist - lambda * rate; no point
    (0, 0) is a choice as well; of equals the fewer bytes."""
    return best_of(by_block(points, block), lambdas)


def allocate(points: DataFrame, budget: int, steps: int = 24, block: str = "block_id") -> tuple[float, DataFrame]:
    """Bisection of the trade-off: the least lambda whose selection fits ``budget`` bytes, and that selection's totals."""
    return allocate_blocks(strips.kept(by_block(points, block)), budget, steps)


def allocate_blocks(blocks: DataFrame, budget: int, steps: int = 24) -> tuple[float, DataFrame]:
    """``allocate`` of ``by_block``'s rows, a checkpoint, as every round reads them.

    All steps' trade-offs of one round are tried in one job (16 at a time), so ``steps`` bits take a quarter of the jobs.
    """
    steepest = F.array_max(F.transform("points", lambda p: p["dist"] / F.greatest(p["rate"], F.lit(1))))
    low, high = 0.0, float(blocks.agg(F.max(steepest)).head()[0] or 0) + 1.0
    for _ in range(-(-steps // 4)):
        tried = [low + (high - low) * i / 16 for i in range(1, 17)]
        rates = {r["lambda"]: r["rate"] for r in best_of(blocks, tried).collect()}  # sixteen rows at most
        fit = next((t for t in tried if rates.get(t, 0) <= budget), high)
        low, high = max([low, *(t for t in tried if t < fit)]), fit
    return high, best_of(blocks, [high])


def endpoint_totals(points: DataFrame, chosen: DataFrame, block: str = "block_id") -> DataFrame:
    """(blocks, bytes, credit) over all blocks at the passes that ``chosen(block, want)`` names; before the first pass both are 0."""
    at = chosen.join(points, (chosen[block] == points[block]) & (chosen["want"] == points["pass_no"]), "left")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long")
    return at.agg(F.count(F.lit(1)).alias("blocks"), total("rate").alias("bytes"), total("dist").alias("credit"))


def checked_changes(points: DataFrame, legal: DataFrame, changes: DataFrame, block: str = "block_id") -> DataFrame:
    """(block, endpoint, error) of ``changes`` (block, endpoint) of blocks' last passes, -1 for none at all: those that change nothing are left out,
    and a change of an unknown block, to a pass that isn't ``legal`` (block, pass_no) or isn't among the block's ``points`` has an error."""
    known = points.groupBy(block).agg(F.max("pass_no").alias("last"))
    allowed = legal.groupBy(block).agg(F.collect_set("pass_no").alias("legal"), F.max("pass_no").alias("terminal"))
    told = changes.join(known, block, "left").join(allowed, block, "left")
    inside = (F.col("endpoint") == -1) | F.coalesce(F.array_contains("legal", F.col("endpoint")), F.lit(False))
    error = F.when(F.col("last").isNull(), "Unknown frozen coding block").when(~F.coalesce(inside, F.lit(False)), "Select a frozen legal native pass").when(F.col("endpoint") > F.col("last"), "Native pass exceeds its frozen table")
    told = told.withColumn("error", error)
    return told.where(F.col("error").isNotNull() | (F.col("endpoint") != F.coalesce("terminal", F.lit(-1)))).select(block, "endpoint", "error")


def emission_errors(packets: DataFrame, expected: DataFrame, output: str = "output_id") -> DataFrame:
    """(output, bytes, error): what outputs' written ``packets`` (output, header, body, protected, promoted, unprotected) say against
    ``expected`` (output, packet_bytes, protected_bytes, head_bytes, cap, written): the simulated bytes, closure, the cap and the length with its two end bytes."""
    total = lambda c: F.sum(c).cast("long").alias(c)
    sums = packets.groupBy(output).agg(*map(total, ("header", "body", "protected", "promoted", "unprotected")))
    both = expected.join(sums, output, "left").na.fill(0, ["header", "body", "protected", "promoted", "unprotected"])
    emitted = F.col("header") + F.col("body")
    bad = (emitted != F.col("packet_bytes")) | (F.col("protected") != F.col("protected_bytes")) | (F.col("body") != F.col("protected") + F.col("promoted") + F.col("unprotected"))
    bad |= (F.col("head_bytes") + F.col("packet_bytes") > F.col("cap")) | (F.col("written") + 2 != F.col("head_bytes") + F.col("packet_bytes"))
    return both.select(output, emitted.alias("bytes"), F.when(F.coalesce(bad, F.lit(True)), "Final codestream emission does not satisfy its measured byte constraints.").alias("error"))
