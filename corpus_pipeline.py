"""The corpus pipeline: quality, near duplicates, repeated substrings, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
Nulls and empty tables: as in each operator. Near duplicates are told by rows, not by ids: of rows that share an id, or have none, one
goes only if a row with a like text stays. No stage can be stated in SQL as a whole (a learned model,
hashed sampling keys, a tokenizer), so ``ORACLE_SQL`` is None and the stages are tested against plain versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portrel.llm import byte_bpe, common, jaccard, mixing, quality, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs.select(*COLUMNS), common.table(spark, sf_dir, "labels"))


def _row_key() -> Column:
    """128 bits for a row's id, source and text: equal for repeated rows only, and never null."""
    parts = ["doc_id", "source", "text", F.isnull("source"), F.isnull("text")]  # a hash passes over nulls
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second"), *reversed(parts)).alias("b"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join one document with the least id stays."""
    return jaccard.representatives(docs.select(*COLUMNS))


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that start earlier too are cut out; documents with no word left go."""
    cut = suffix_dedup.cleaned(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))
    return cut.where(F.col("text").rlike(mixing.WORD))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes once for each whole epoch, and once more if the mix takes at least
    half of it in the last, fractional one; documents that aren't taken go."""
    keyed = docs.select(*COLUMNS, _row_key().alias("_key"))
    taken = mixing.mix(keyed, also=["_key"]).where(F.col("size") > 0)
    copies = taken.select("_key", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("copies")).where(F.col("copies") > 0)
    copies = common.stored(copies.groupBy("_key").agg(F.max("copies").alias("copies")))
    both = keyed.join(copies, "_key")
    return both.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document, with whether they decode to its text."""
    import public_tokenizers

    return byte_bpe.round_trip(docs.select("doc_id", "source", "text"), f"{common.tokenizer_dir()}/byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_substrings),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
