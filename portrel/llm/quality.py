"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has its mean and its covariance, shrunk towards the pooled one and then towards a diagonal. A document's score
grows with the difference of the two classes' log densities, from Mahalanobis distances by Cholesky factors that are
computed once. Only statistics of the text go in.

Learning sums moments over all labelled rows as one Spark aggregation. Labels other than 0 and 1 are left out. Where a
class has no row, all scores are 0.5. Nulls are empty texts, and empty texts have a score like any other. Repeated rows
each have their result; repeated labels count each time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portrel.llm import common

FEATURES = ("words", "word_length", "length_spread", "upper", "digits", "symbols", "symbol_ends", "lone_symbols", "line_words", "distinct", "doubled", "beyond_ascii", "bangs")
SHRINK_TO_POOLED = 0.2
SHRINK_TO_DIAGONAL = 0.1
#: Half of the log density difference at which a score is 0.75.
SOFTNESS = 10.0

_UPPER, _LOWER, _DIGIT, _SYMBOL = (np.zeros(256, dtype=bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SYMBOL[33:127] = ~(_UPPER | _LOWER | _DIGIT)[33:127]
_ODD = _SYMBOL.copy()
_ODD[[ord("."), ord(","), ord("'"), ord("-")]] = False


def statistics(texts: pa.Array) -> np.ndarray:
    """(rows, features) transformed statistics of the texts."""
    data, offsets = common.text_bytes(texts)
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets]).astype(float)
    begin, end, first = common.word_spans(data, offsets)
    words = np.diff(first).astype(float)
    row = np.repeat(np.arange(n), np.diff(first))
    length = (end - begin).astype(float)
    sum1, sum2 = np.bincount(row, length, n), np.bincount(row, length * length, n)
    mean = sum1 / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(sum2 / np.maximum(words, 1) - mean * mean, 0))
    upper = total(_UPPER[data])
    letters = np.maximum(upper + total(_LOWER[data]), 1)
    doubled = np.zeros(len(data), dtype=bool)
    doubled[1:] = (data[1:] == data[:-1]) & _SYMBOL[data[1:]]
    share = lambda part, of: np.sqrt(part / np.maximum(of, 1))
    odd_end, lone = np.zeros(n), np.zeros(n)
    distinct = np.ones(n)
    if len(begin):
        odd_end = np.bincount(row, _ODD[data[end - 1]], n)
        lone = np.bincount(row, (end - begin == 1) & _ODD[data[begin]], n)
        hashes = common.word_hashes(data, begin, end) >> np.uint64(24)
        tagged = np.sort((row.astype(np.uint64) << np.uint64(40)) | hashes)
        fresh = np.concatenate([[True], tagged[1:] != tagged[:-1]])
        distinct = np.bincount((tagged[fresh] >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(words, 1)
    columns = (np.log1p(words), np.log1p(mean), np.log1p(spread), share(upper, letters), share(total(_DIGIT[data]), size), share(total(_ODD[data]), size), share(odd_end, words), share(lone, words), np.log1p(words / (1 + total(data == 10))), distinct, share(total(doubled), size), share(total(data >= 128), size), share(total(data == 33), size))
    return np.stack(columns, axis=1)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the array of statistics."""
    common.small_batches(docs.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(batch.column("text"))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], ["doc_id", "x"])

    return common.map_batches(docs.select("doc_id", "text"), step, "doc_id long, x array<double>")


class Discriminant:
    """The fitted classes: means, inverse Cholesky factors, log determinants and priors."""

    def __init__(self, counts: list[float], sums: list[np.ndarray], squares: list[np.ndarray]):
        d = len(FEATURES)
        means = [s / n for s, n in zip(sums, counts, strict=True)]
        covers = [q / n - np.outer(m, m) for q, n, m in zip(squares, counts, means, strict=True)]
        pooled = sum(n * c for n, c in zip(counts, covers, strict=True)) / sum(counts)
        centre = sum(sums) / sum(counts)
        whole = sum(squares) / sum(counts) - np.outer(centre, centre)
        scale = np.sqrt(np.maximum(np.diag(whole), 1e-8))
        self.centre, self.scale = centre, scale
        unit = np.outer(scale, scale)
        self.classes = []
        for n, m, c in zip(counts, means, covers, strict=True):
            c = ((1 - SHRINK_TO_POOLED) * c + SHRINK_TO_POOLED * pooled) / unit
            c = (1 - SHRINK_TO_DIAGONAL) * c + SHRINK_TO_DIAGONAL * np.diag(np.diag(c)) + 1e-3 * np.eye(d)
            low = np.linalg.cholesky(c)
            self.classes.append(((m - centre) / scale, np.linalg.inv(low), 2 * np.log(np.diag(low)).sum(), math.log(n / sum(counts))))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        logs = []
        for mean, inverse, log_det, log_prior in self.classes:
            away = (z - mean) @ inverse.T
            logs.append(log_prior - 0.5 * (log_det + (away * away).sum(axis=1)))
        return logs[1] - logs[0]


def fit(measured: DataFrame, labels: DataFrame) -> Discriminant | None:
    """From ``measured(doc_id, x)`` and ``labels(doc_id, quality)``; None if a class has no row."""
    d = len(FEATURES)
    known = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1))
    rows = measured.join(known, "doc_id").select("quality", *[F.col("x")[i].alias(f"x{i}") for i in range(d)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(d)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in pairs]
    found = {r["quality"]: r for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}  # two rows
    if set(found) != {0, 1}:
        return None
    squares = []
    for k in (0, 1):
        q = np.zeros((d, d))
        for i, j in pairs:
            q[i, j] = q[j, i] = found[k][f"q{i}_{j}"]
        squares.append(q)
    return Discriminant([float(found[k]["n"]) for k in (0, 1)], [np.array([found[k][f"s{i}"] for i in range(d)]) for k in (0, 1)], squares)


def scores(measured: DataFrame, model: Discriminant | None) -> DataFrame:
    """doc_id, score (0 to 1), predicted."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column("x").flatten()).reshape(batch.num_rows, -1)
        gap = model.difference(x) if model else np.zeros(len(x))
        score = 0.5 + 0.5 * gap / (SOFTNESS + np.abs(gap))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return common.map_batches(measured, step, "doc_id long, score double, predicted int")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all ``docs`` by a model of the labelled documents that are not held out."""
    measured = common.stored(with_statistics(docs))
    model = fit(measured, labels.where(~held_out()))
    return scores(measured, model).withColumn("held_out", F.coalesce(held_out(), F.lit(False))).select("doc_id", "held_out", "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is at least 0.5."""
    measured = common.stored(with_statistics(docs))
    model = fit(measured, labels.where(~held_out()))
    common.small_batches(docs.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if model is None:
            return batch
        return batch.filter(pa.array(model.difference(statistics(batch.column("text"))) >= 0))

    return docs.mapInArrow(lambda batches: (step(b) for b in batches if b.num_rows), docs.schema)
