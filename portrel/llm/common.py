"""Helpers that the operators share: table access, durable intermediate tables, ordered buckets, text hashing."""

from __future__ import annotations

import gc
import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of an Arrow batch, whichever is met first: they bound what a Python task holds, for long texts and short rows.
BATCH_ROWS, BATCH_BYTES = 10_000, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to BATCH_ROWS and BATCH_BYTES, where they are higher. A lazy result is computed
    with what the session says then, so the lower limits stay; they change no result."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if not now or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; unset, one under the warehouse, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.steps"
    return base.rstrip("/")


def step_path(spark: SparkSession, name: str = "step") -> str:
    """A new path in the shared folder. What is there when the application ends is removed then; lazy results may read it till then."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, keep: list[str] | None = None, dense: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors.

    ``keep`` collects the path so that ``discard`` can remove it once nothing reads it any more; ``dense`` packs texts closer.
    """
    spark = df.sparkSession
    path = step_path(spark)
    (df.write.option("compression", "zstd") if dense else df.write).parquet(path)
    if keep is not None:
        keep.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    release(spark)
    return back


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps now instead of at the driver's next full collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove written steps through the file system that holds them."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the shared file system, in order; none if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as two underscores) around actions; they are put back afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``step`` to each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def bucket_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """At most ``buckets - 1`` ascending cut points that split ``df`` by ``key`` into ranges of like row counts."""
    if buckets < 2:
        return []
    cuts = df.select(F.col(key).cast("double").alias(key)).approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.2 / buckets)
    return sorted({int(x) for x in cuts})


def with_bucket(df: DataFrame, key: str, cuts: list[int], name: str = "bucket") -> DataFrame:
    """Add the number of the range that ``key`` is in: as many as there are cut points at or below it (null keys: 0)."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    from pyspark.ml.feature import Bucketizer

    ends = [float("-inf"), *map(float, cuts), float("inf")]
    number = Bucketizer(splits=ends, inputCol="_key", outputCol="_bucket").transform(df.withColumn("_key", F.coalesce(F.col(key).cast("double"), F.lit(float("-inf")))))
    return number.withColumn(name, F.col("_bucket").cast("int")).drop("_key", "_bucket")


def in_order(df: DataFrame, key: str) -> DataFrame:
    """Deal ``df`` out by ``bucket`` and sort each task's rows by bucket and ``key``; equal keys in the order of their texts' hashes.

    Each bucket is whole in one task. There are four buckets for each partition, so that hashing spreads them evenly.
    """
    return df.repartition(partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket", F.col(key).asc_nulls_first(), F.xxhash64("text"))


def tokenizer_dir() -> str:
    """Folder of the public vocabulary files; PORTREL_TOKENIZERS overrides it."""
    found = os.environ.get("PORTREL_TOKENIZERS")
    if found:
        return found
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("README.md"))


# Text hashing with numpy: polynomial prefix sums modulo the prime 2**61 - 1 give the hash of any slice in constant time. Two different
# slices of n values agree for at most n of the 2**61 bases, whatever their structure; modulo a power of two that isn't so.

PRIME = np.uint64((1 << 61) - 1)
BASE = 0x12D5_93C1_7A6E_4B0F % ((1 << 61) - 1)
MULT = np.uint64(0x9E3779B97F4A7C15)
_LOW_31, _LOW_30, _LOW_29 = (np.uint64((1 << n) - 1) for n in (31, 30, 29))
_POWERS: list[np.ndarray] = []


def _reduced(x: np.ndarray) -> np.ndarray:
    """Modulo PRIME, of any 64-bit values."""
    out = x >> np.uint64(61)
    out += x & PRIME
    out -= (out >= PRIME) * PRIME
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of values below it, from halves of 31 and 30 bits; in blocks that fit the processor's cache."""
    out = np.empty(len(a), np.uint64)
    for at in range(0, len(a), 1 << 14):
        some = slice(at, at + (1 << 14))
        a1, a0 = a[some] >> np.uint64(31), a[some] & _LOW_31
        if b.dtype == np.uint8:
            small = b[some].astype(np.uint64)
            a1 *= small
            a0 *= small
            middle, product = a1, a0
        else:
            b1, b0 = b[some] >> np.uint64(31), b[some] & _LOW_31
            middle = a1 * b0
            a1 *= b1
            a1 <<= np.uint64(1)
            b1 *= a0
            middle += b1
            a0 *= b0
            a0 += a1
            product = a0
        product += middle >> np.uint64(30)
        middle &= _LOW_30
        middle <<= np.uint64(31)
        product += middle
        out[some] = _reduced(product)
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, at least n + 1 of each."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        _POWERS.clear()
        for base in (BASE, pow(BASE, -1, int(PRIME))):
            have = np.array([1], np.uint64)
            while len(have) < size:  # doubling
                have = np.concatenate([have, times(have, np.full(len(have), pow(base, len(have), int(PRIME)), np.uint64))])
            _POWERS.append(have)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits; no two values become one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of value times power up to each position (one longer than ``values``), modulo PRIME."""
    terms = times(_powers(len(values))[0][: len(values)], values if values.dtype == np.uint8 else _reduced(values.astype(np.uint64)))
    high, low = np.cumsum(terms >> np.uint64(32)), np.cumsum(terms & np.uint64(0xFFFFFFFF))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    out[1:] = _reduced(_reduced(low) + (high >> np.uint64(29)) + ((high & _LOW_29) << np.uint64(32)))
    return out


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the slices [start, end) of the values behind ``sums``; the length is part of the hash."""
    raw = times(_reduced(sums[end] + (PRIME - sums[start])), _powers(len(sums))[1][start])
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


#: Words of more bytes than this are hashed by a cryptographic digest.
LONG_WORD = 64


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [begin, end) of ``data``: different for different words of one length up to 8 bytes; up to
    LONG_WORD bytes chained in steps of 8, longer ones by a digest."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded.data, strides=(1,))  # the 8 bytes from each position on
    size = end - begin
    out = size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    short = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(short):
        left = size[short] - at
        chunk = eights[begin[short] + at]
        cut = (np.maximum(8 - left, 0) * 8).astype(np.uint64)
        chunk = np.where(left >= 8, chunk, (chunk << cut) >> cut)
        out[short] = mix((out[short] ^ chunk) + MULT)
        at += 8
        short = short[left > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: empty) as one array, and the n + 1 offsets of its rows."""
    array = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    array = array.fill_null("")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+`` and, per row, the index of its first word (n + 1 of them)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~_SPACE[data]
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = ink[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = ink[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def segments(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(begin, counts)
