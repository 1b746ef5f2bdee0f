"""Python data sources for what Spark has no reader or writer for: entries of archives, growing files of JSON lines, files of a container format.

Paths are of a file system that the driver and all executors have mounted at the same place.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

ENTRIES = "package string, place long, name string, size long, stored long, method int, package_bytes long"
#: Entries of an archive's directory that a partition reads.
ENTRIES_OF_PARTITION = 65_536
# The records of an archive's end and directory.
_END, _END64, _LOCATOR64, _ENTRY = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2"


def directory(path: str) -> tuple[int, int]:
    """(offset, entries) of an archive's central directory, by the record at its end; archives of more than 4 GB or 65,535 entries too."""
    size = os.path.getsize(path)
    with open(path, "rb") as file:
        tail_at = max(0, size - 22 - 65_535)
        file.seek(tail_at)
        tail = file.read()
        at = tail.rfind(_END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(_END, 0, at)
        if at < 0:
            raise ValueError(f"{path}: no end of an archive's directory")
        many, length, offset = struct.unpack_from("<HII", tail, at + 10)
        end_at = tail_at + at
        if many == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            file.seek(max(0, end_at - 20))
            locator = file.read(20)
            if locator[:4] != _LOCATOR64:
                raise ValueError(f"{path}: no 64-bit end of an archive's directory")
            file.seek(struct.unpack_from("<Q", locator, 8)[0])
            record = file.read(56)
            if record[:4] != _END64:
                raise ValueError(f"{path}: no 64-bit end of an archive's directory")
            many, length, offset = struct.unpack_from("<QQQ", record, 32)
        if offset + length > end_at:
            raise ValueError(f"{path}: the archive's directory doesn't fit")
        return offset, many


def entries(path: str, first: int, last: int) -> Iterator[tuple]:
    """(place, name, size, stored, method) of the entries [first, last): the headers before them are only passed by."""
    at, many = directory(path)
    with open(path, "rb", buffering=1 << 20) as file:
        file.seek(at)
        for place in range(min(last, many)):
            head = file.read(46)
            if len(head) < 46 or head[:4] != _ENTRY:
                raise ValueError(f"{path}: entry {place} of the directory is cut off")
            flags, method = struct.unpack_from("<HH", head, 8)
            stored, size, name_size, extra_size, note_size = struct.unpack_from("<IIHHH", head, 20)
            if place < first:
                file.seek(name_size + extra_size + note_size, os.SEEK_CUR)
                continue
            name, extra = file.read(name_size), file.read(extra_size)
            file.seek(note_size, os.SEEK_CUR)
            k = 0
            while k + 4 <= len(extra):
                kind, long = struct.unpack_from("<HH", extra, k)
                if kind == 1:
                    values = iter(struct.unpack_from(f"<{long // 8}Q", extra, k + 4))
                    size = next(values) if size == 0xFFFFFFFF else size
                    stored = next(values) if stored == 0xFFFFFFFF else stored
                k += 4 + long
            yield place, name.decode("utf-8" if flags & 0x800 else "cp437"), size, stored, method


@dataclass
class Part(InputPartition):
    path: str
    first: int
    last: int


class ArchiveSource(DataSource):
    """``archive``: (package, place, name, size, stored, method, package_bytes) of the entries of an archive, or of all files of a folder that
    end with the option ``suffix`` (.zip). Nothing is unpacked; each partition reads a range of a central directory."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema: object) -> DataSourceReader:
        return ArchiveReader(self.options["path"], self.options.get("suffix", ".zip"), int(self.options.get("entries", ENTRIES_OF_PARTITION)))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, size: int):
        self.path, self.suffix, self.size = path.removeprefix("file:"), suffix, size

    def partitions(self) -> list[Part]:
        files = [self.path] if not os.path.isdir(self.path) else sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if n.endswith(self.suffix))
        parts = [Part(f, at, at + self.size) for f in files for at in range(0, max(1, directory(f)[1]), self.size)]
        return parts or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.path:
            package, whole = os.path.basename(part.path), os.path.getsize(part.path)
            for place, name, size, stored, method in entries(part.path, part.first, part.last):
                yield package, place, name, size, stored, method, whole


def inventory(rows: DataFrame, required: Sequence[str], group: str, allowed: Sequence[str], most_bytes: int) -> DataFrame:
    """(package, error, subject): the first fault of each package of ``rows`` (package, name, package_bytes), in the order of the checks, or nulls.

    Too large; a name twice; not one ``.nuspec``; a ``required`` name missing; a name under ``lib/`` outside of ``group``; a ``.dll`` that isn't ``allowed``.
    """
    packages = rows.groupBy("package").agg(F.max("package_bytes").alias("bytes"), F.count_if(F.endswith("name", F.lit(".nuspec"))).alias("specs"))
    fault = lambda order, message, subject: F.struct(F.lit(order).alias("order"), subject.alias("subject"), F.lit(message).alias("error"))
    whole = packages.select("package", F.when(F.col("bytes") >= most_bytes, fault(0, "Package exceeds the release size allowance.", F.lit(None).cast("string"))).when(F.col("specs") != 1, fault(2, "Package must contain one nuspec.", F.lit(None).cast("string"))).alias("f"))
    twice = rows.groupBy("package", "name").count().where("count > 1").select("package", fault(1, "Package contains duplicate archive entries.", F.col("name")).alias("f"))
    wanted = packages.select("package", F.explode(F.array(*map(F.lit, required)).cast("array<string>")).alias("name"))
    missing = wanted.join(rows, ["package", "name"], "left_anti").select("package", fault(3, "Missing bundled file.", F.col("name")).alias("f"))
    outside = F.startswith("name", F.lit("lib/")) & ~F.startswith("name", F.lit(group))
    odd = F.endswith("name", F.lit(".dll")) & ~F.coalesce(F.array_contains(F.array(*map(F.lit, allowed)).cast("array<string>"), F.col("name")), F.lit(False))
    named = rows.select("package", F.when(outside, fault(4, "Ship one complete compatible framework group.", F.col("name"))).when(odd, fault(5, "Unexpected implementation or development assembly in package.", F.col("name"))).alias("f"))
    first = whole.unionByName(twice).unionByName(missing).unionByName(named).groupBy("package").agg(F.min("f").alias("f"))  # a null is no fault
    return first.select("package", F.col("f.error").alias("error"), F.col("f.subject").alias("subject"))


class LineStream(DataSource):
    """``json_lines``: (file, start, line) of the lines of all files of a folder, as a stream. Files may grow at their end and new ones
    may come; a line counts once its line end is there. An offset is how far each file is read, so a batch can be read again."""

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def schema(self) -> str:
        return "file string, start long, line string"

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return LineReader(self.options["path"].removeprefix("file:"))


def whole_lines(path: str, begin: int) -> int:
    """Where the last line that is whole ends, at ``begin`` or behind it."""
    at = os.path.getsize(path)
    with open(path, "rb") as file:
        while at > begin:
            low = max(begin, at - 65_536)
            file.seek(low)
            found = file.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return begin


class LineReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path, self.known = path, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        names = sorted(n for n in os.listdir(self.path) if n.endswith(".jsonl"))
        self.known |= {n: whole_lines(os.path.join(self.path, n), self.known.get(n, 0)) for n in names}
        return {n: self.known[n] for n in names if self.known[n]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(n, start.get(n, 0), e) for n, e in sorted(end.items()) if e > start.get(n, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        with open(os.path.join(self.path, part.path), "rb") as file:
            file.seek(part.first)
            at = part.first
            while at < part.last:
                line = file.readline()
                yield part.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stream (file, start, and the fields of ``schema``); a line that is no such object has null fields."""
    spark.dataSource.register(LineStream)
    return spark.readStream.format("json_lines").load(path).select("file", "start", F.from_json("line", schema).alias("_")).select("file", "start", "_.*")


def _bytes(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def _box(kind: str, *content: Column) -> Column:
    whole = F.concat(*content)
    return F.concat(_bytes(F.length(whole) + 8, 4), F.lit(kind.encode()), whole)


def container(codestream: Column, height: Column, width: Column, bits: Column) -> Column:
    """A JPEG 2000 file around a codestream, as bytes; ``bits`` are those of each component. Null if the codestream is, or there are no
    components, or the file would be 4 GB or larger."""
    lit = lambda h: F.lit(bytes.fromhex(h))
    varied = F.array_size(F.array_distinct(bits)) > 1
    depth = F.when(varied, 255).otherwise(F.get(bits, F.lit(0)) - 1)
    header = _box("ihdr", _bytes(height, 4), _bytes(width, 4), _bytes(F.size(bits), 2), _bytes(depth, 1), lit("070000"))
    colour = _box("colr", lit("010000"), _bytes(F.when(F.size(bits) > 1, 16).otherwise(17), 4))
    each = F.unhex(F.array_join(F.transform(bits, lambda b: F.lpad(F.hex((b - 1).cast("long")), 2, "0")), ""))
    both = F.concat(header, colour, F.when(varied, _box("bpcc", each)).otherwise(F.lit(b"")))
    whole = F.concat(lit("0000000c6a5020200d0a870a"), _box("ftyp", F.lit(b"jp2 "), _bytes(F.lit(0), 4), F.lit(b"jp2 ")), _box("jp2h", both), _box("jp2c", codestream))
    return F.when((F.size(bits) > 0) & (F.length(codestream) < (1 << 32) - 8), whole)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class FileSink(DataSource):
    """``files``: writes rows (name, content) as files of a folder. A task writes its files under other names, and gives all of them
    theirs at its end, or removes them; a job that fails removes what its tasks had finished."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"].removeprefix("file:"))


class FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        staged: dict[str, str] = {}
        done: list[str] = []
        try:
            for row in rows:
                name, content = row["name"], row["content"]
                if name is None or content is None or os.path.basename(name) != name or name in ("", ".", ".."):
                    raise ValueError(f"no file can be written for the name {name!r}")
                own = os.path.join(self.path, name)
                if own in staged or os.path.exists(own):
                    raise ValueError(f"{own} is there already")
                staged[own] = os.path.join(self.path, f".{uuid.uuid4().hex}.part")
                with open(staged[own], "wb") as file:
                    file.write(content)
                    file.flush()
                    os.fsync(file.fileno())
            for own, part in staged.items():
                os.link(part, own)  # fails if another task has made that file meanwhile
                done.append(own)
        except BaseException:
            for path in done:
                os.remove(path)
            raise
        finally:
            for part in staged.values():
                if os.path.exists(part):
                    os.remove(part)
        return Written(done)

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        for message in messages:
            for path in message.paths if message else ():
                if os.path.exists(path):
                    os.remove(path)


def write_files(rows: DataFrame, path: str) -> None:
    """Write ``rows`` (name, content) as files of the folder ``path``."""
    rows.sparkSession.dataSource.register(FileSink)
    rows.select("name", "content").write.format("files").mode("append").save(path)


def archive_entries(spark: SparkSession, path: str, suffix: str = ".zip", size: int = ENTRIES_OF_PARTITION) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("suffix", suffix).option("entries", size).load(path)
