"""Substring dedup by a log-structured fingerprint index.

The index is a folder of immutable runs. A run holds window fingerprints (``repeats`` tuples) in buckets of their gram's hash,
sorted, written once. A new batch of documents makes its tuples, which are sorted and walked once for what repeats within the batch;
the first of each cover are written as a run of their own. It is then merge-joined with each older run, bucket by bucket: neither
is shuffled or sorted again. Matches are verified: copies by digests of all their words, others window by window. Once a
level has ``MOST_RUNS`` runs they are compacted into one of the next level, where superseded tuples (copies of an earlier one) are
dropped. An index can be opened again, in another session, to take in further batches.

A window is ``length`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one document. Words covered by a window that also starts
earlier (smaller ``doc_id``, null least, or earlier in the document) are removed. Null texts have no words. Rows of one id
and text are one document; what is repeated in one row of an id is taken to be repeated at that place in all its rows.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portrel.llm import common, repeats

LENGTH = 20
GRAM = 6
BATCHES = 3
MOST_RUNS = 2


RUN = "gram long, cover long, doc long, lo long, n int"
SETTINGS = "length int, gram int, buckets int"

#: Reads of runs keep their buckets and order, and joins on (gram, cover) are content with buckets of grams.
_BY_BUCKETS = {
    "spark__sql__sources__bucketing__autoBucketedScan__enabled": "false", "spark__sql__legacy__bucketedTableScan__outputOrdering": "true",
    "spark__sql__requireAllClusterKeysForCoPartition": "false",
}


class FingerprintIndex:
    """Runs of fingerprints in the folder ``path``: one that is there is opened with its own settings, else it is begun."""

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, gram: int = GRAM, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        if "settings" not in common.listed(spark, self.path):
            begun = [(length, gram, buckets or common.partitions(spark))]
            spark.createDataFrame(begun, SETTINGS).coalesce(1).write.parquet(f"{self.path}/settings")
        self.length, self.gram, self.buckets = spark.read.schema(SETTINGS).parquet(f"{self.path}/settings").head()
        self.tables: dict[str, str] = {}

    def runs(self) -> list[str]:
        """Names of the finished runs, run-<level>-<number>, oldest first."""
        names = [n for n in common.listed(self.spark, self.path) if n.startswith("run-") and "_SUCCESS" in common.listed(self.spark, f"{self.path}/{n}")]
        return sorted(names, key=lambda n: int(n.split("-")[2]))

    def table(self, run: str) -> DataFrame:
        """(gram, cover, doc, lo, n) of a run, one for each cover, known to Spark as a table of sorted buckets."""
        if run not in self.tables:
            name = self.tables[run] = f"fingerprints_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (gram) SORTED BY (gram, cover) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")
        return self.spark.table(self.tables[run])

    def write(self, tuples: DataFrame, level: int) -> str:
        numbers = [int(n.split("-")[2]) for n in common.listed(self.spark, self.path) if n.startswith("run-")]
        run = f"run-{level}-{max(numbers, default=0) + 1}"
        name = self.tables[run] = f"fingerprints_{uuid.uuid4().hex}"
        dealt = tuples.select("gram", "cover", "doc", "lo", "n").repartition(self.buckets, "gram")
        dealt.write.bucketBy(self.buckets, "gram").sortBy("gram", "cover").format("parquet").option("path", f"{self.path}/{run}").saveAsTable(name)
        common.release(self.spark)
        return run

    def matches(self, new: str, old: str) -> tuple[DataFrame, DataFrame]:
        """Merge-join of a batch's run with an older one: copies (doc, lo, n, fdoc, flo), and the units (gram, doc, lo, n) of both that
        share a gram and not a cover."""
        mine, theirs = self.table(new), self.table(old)
        first = theirs.select("gram", "cover", F.col("doc").alias("fdoc"), F.col("lo").alias("flo"))
        copies = mine.join(first.hint("merge"), ["gram", "cover"])
        grams = theirs.select("gram").distinct()
        other = mine.join(theirs.select("gram", "cover").hint("merge"), ["gram", "cover"], "left_anti").join(grams.hint("merge"), "gram", "left_semi")
        asked = theirs.join(other.select("gram").distinct().hint("merge"), "gram", "left_semi")
        unit = ["gram", "doc", "lo", "n"]
        return copies.select("doc", "lo", "n", "fdoc", "flo"), other.select(*unit).unionByName(asked.select(*unit))

    def add(self, batch: DataFrame, known: DataFrame) -> DataFrame:
        """Take in ``batch(doc, text)``, whose ids are above all before; returns its repeated windows (doc, lo, n).

        ``known(doc, text)`` are all documents so far, this batch among them; only those with matches are read into tasks.
        """
        before = self.runs()
        paths: list[str] = []
        within = common.stored(repeats.resolve(repeats.sampled(batch, repeats.as_words, self.length, self.gram), with_firsts=True), paths)
        new = self.write(within.where("kind = 'first'"), 0)
        with common.settings(self.spark, **_BY_BUCKETS):
            copies, opened = within.where("kind = 'copy'").select("doc", "lo", "n", "fdoc", "flo"), within.where("kind = 'open'").select("gram", "doc", "lo", "n")
            for old in before:
                more, others = (common.stored(x, paths) for x in self.matches(new, old))
                copies, opened = copies.unionByName(more), opened.unionByName(others)
        opened = opened.distinct()
        spans = copies.where("fdoc is not null").select("doc", "lo", "n").unionByName(copies.where("fdoc is not null").select(F.col("fdoc").alias("doc"), F.col("flo").alias("lo"), "n"))
        held = common.stored(repeats.contents(known, opened, spans, repeats.as_words, self.length), paths, dense=True)
        both = repeats.verified(copies, held).unionByName(repeats.windows_of(held, opened, self.length, 8))
        least = batch.agg(F.min("doc")).head()[0]  # windows of earlier documents were told before
        out = common.stored(both.where(F.lit(False) if least is None else F.col("doc") >= least))
        common.discard(self.spark, paths)
        self.compact()
        return out

    def compact(self) -> None:
        """Merge the runs of a level into one of the next once there are MOST_RUNS; of each cover the first unit stays."""
        level = 0
        while runs := [r for r in self.runs() if r.split("-")[1] == str(level)]:
            if len(runs) >= MOST_RUNS:
                rows = reduce(DataFrame.unionByName, [self.table(r) for r in runs]).groupBy("gram", "cover").agg(F.min(F.struct("doc", "lo", "n")).alias("u"))
                self.write(rows.select("gram", "cover", "u.doc", "u.lo", "u.n"), level + 1)
                for r in runs:
                    self.forget(r)
                    common.discard(self.spark, [f"{self.path}/{r}"])
            level += 1

    def forget(self, run: str) -> None:
        """Take a run's table out of the session; its files stay."""
        if run in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(run)}")

    def close(self) -> None:
        for run in list(self.tables):
            self.forget(run)


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """``doc, text, runs`` of all documents, taken in as ``batches`` batches of ascending ids."""
    spark = docs.sparkSession
    keyed = repeats.keyed(docs)
    cuts = [repeats.NO_ID, *common.bucket_bounds(keyed, "doc", batches)]
    path = common.step_path(spark, "fingerprints")
    index = FingerprintIndex(spark, path, length, gram)
    found = []
    for begin, end in zip(cuts, [*cuts[1:], None], strict=True):
        known = keyed if end is None else keyed.where(F.col("doc") < end)
        found.append(index.add(known.where(F.col("doc") >= begin), known))
    index.close()
    common.discard(spark, [path])
    common.small_batches(spark)
    return repeats.with_repeats(keyed, reduce(DataFrame.unionByName, found))


def _step(length: int, texts: bool):  # noqa: ANN202
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = common.text_bytes(batch.column("text"))
        begin, end, first = common.word_spans(data, offsets)
        sizes = np.diff(first)
        gone = repeats.covered(sizes, batch.column("runs"), first, length)
        removed = np.concatenate([[0], np.cumsum(gone)])
        # Kept words with one space before each; a document's first space is left out.
        begin, end = begin[~gone], end[~gone]
        long = end - begin + 1
        where = np.repeat(begin - 1, long) + common.segments(long)
        heads = np.cumsum(long) - long
        chars = data[np.maximum(where, 0)] if len(where) else np.zeros(0, np.uint8)
        chars[heads] = 32
        kept_words = np.concatenate([[0], np.cumsum(~gone)])[first]
        at = np.concatenate([heads, [len(chars)]])[kept_words]
        whole = chars.tobytes()
        parts = [whole[a + 1 : b] for a, b in zip(at[:-1], at[1:], strict=True)]
        doc = pa.array([None if d == repeats.NO_ID else d for d in batch.column("doc").to_pylist()], pa.int64())
        columns = [doc, pa.array(sizes), pa.array(np.diff(removed[first])), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if texts:
            columns.append(pa.array([p.decode("utf-8", "ignore") for p in parts], pa.string()))
            names.append("kept")
        return pa.RecordBatch.from_arrays(columns, names)

    return step


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), and the ``kept`` words as text if ``texts``."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return common.map_batches(repeated(docs, length, gram, batches), _step(length, texts), schema)
