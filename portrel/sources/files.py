"""File sources and sinks of image corpora, through Spark's readers and writers only."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from portrel.functions import validate

# Extensions that count as images.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "jp2")

CORPUS = "id string, subjects array<struct<id: string, source: string, expectedFaceCount: int, expectLandmarks: boolean>>"
RULES = "name string, minSymmetry double, minSharpness double, minHeadSize double, maxHeadSize double, minIpd double, maxIpd double"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def images(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """(path, content, length) of a folder's image files, in no order: contents aren't sent through a sort."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(folder).select("path", "content", "length")
    return found.where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS))


def ordered_paths(found: DataFrame) -> DataFrame:
    """(path, length) of images in case-insensitive order of their paths; only these are sorted, contents aren't read."""
    return found.select("path", "length").orderBy(F.upper("path"), "path")


def corpus(spark: SparkSession, file: str) -> DataFrame:
    """One row for each subject of a corpus manifest; a missing expectation is one face with landmarks."""
    c = spark.read.schema(CORPUS).option("multiLine", True).json(file)
    s = c.select(F.col("id").alias("corpus"), F.posexplode("subjects").alias("ordinal", "s"))
    return s.select("corpus", "ordinal", "s.id", "s.source", F.coalesce("s.expectedFaceCount", F.lit(1)).alias("expected_faces"), F.coalesce("s.expectLandmarks", F.lit(True)).alias("expect_landmarks"))


def custom_rules(spark: SparkSession, file: str) -> DataFrame:
    return spark.read.schema(RULES).option("multiLine", True).json(file)


def verified(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """Pinned sources (id, path, sha256) joined with files (path, content) by file name; ``error`` where one is missing or its
    hash differs. The files are hashed where they are read; only hashes are shuffled."""
    name = lambda c: F.regexp_extract(c, r"([^/\\]*)$", 1)
    hashed = files.select(name(F.col("path")).alias("name"), F.sha2("content", 256).alias("found"), F.length("content").alias("length"))
    both = pinned.withColumn("name", name(F.col("path"))).join(hashed, "name", "left")
    error = validate.first_error((F.col("found").isNull(), validate.error("missing", "no such file")), (F.col("found") != F.lower("sha256"), validate.error("hash", "the content differs")))
    return both.select("id", "path", "found", "length", error.alias("error"))


def write_manifest(rows: DataFrame, folder: str) -> None:
    """JSON lines; written as a whole or not at all, and never over an earlier one."""
    rows.write.mode("errorifexists").json(folder)


def write_report(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(folder)


def append_review(reviews: DataFrame, folder: str) -> None:
    reviews.withColumn("timestamp", F.current_timestamp()).write.mode("append").json(folder)


# Headers of image files, by expressions over their first bytes.
# Signatures and where the sizes lie.
MOST_PIXELS = 64_000_000
_PNG, _JP2, _BMP = "89504E470D0A1A0A", "0000000C6A5020200D0A870A", "424D"


def _number(content: Column, at: int, size: int, little: bool = False) -> Column:
    """An unsigned number of ``size`` bytes from byte ``at`` on."""
    places = range(at + size - 1, at - 1, -1) if little else range(at, at + size)
    digits = F.concat(*[F.hex(F.substring(content, p + 1, 1)) for p in places])
    return F.conv(digits, 16, 10).cast("long")


#: JPEG markers that begin a frame, and those without a length.
_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_BARE = frozenset({0x01, *range(0xD0, 0xD8)})


def chained_size(data: bytes | None) -> tuple[str, int, int] | None:
    """(format, width, height) of a JPEG file by its frame header, behind the segments before it, or of a TIFF file by its first
    directory (BigTIFF too); None for others and where the chain breaks off. Pixel data isn't touched."""
    data = data or b""
    try:
        if data[:2] == b"\xff\xd8":
            at = 2
            while data[at] == 0xFF:
                while data[at] == 0xFF:
                    at += 1
                marker = data[at]
                at += 1
                if marker in _FRAMES:
                    height, width = struct.unpack_from(">HH", data, at + 3)
                    return "jpeg", width, height
                if marker in (0xD9, 0xDA):
                    return None
                if marker not in _BARE:
                    size = struct.unpack_from(">H", data, at)[0]
                    if size < 2:
                        return None
                    at += size
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order and struct.unpack_from(order + "H", data, 2)[0] in (42, 43):
            big = struct.unpack_from(order + "H", data, 2)[0] == 43
            at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
            many = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
            found: dict[int, int] = {}
            for k in range(min(many, 65_535)):
                entry = at + (8 + 20 * k if big else 2 + 12 * k)
                tag, kind = struct.unpack_from(order + "HH", data, entry)
                if tag in (256, 257) and kind in (3, 4, 16):
                    found[tag] = struct.unpack_from(order + {3: "H", 4: "I", 16: "Q"}[kind], data, entry + (12 if big else 8))[0]
                if len(found) == 2:
                    return "tiff", found[256], found[257]
    except (struct.error, IndexError):
        pass
    return None


@F.pandas_udf(StructType([StructField("format", StringType()), StructField("width", LongType()), StructField("height", LongType())]))
def _chained(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([chained_size(c) or (None, None, None) for c in contents], columns=["format", "width", "height"]).astype({"width": "Int64", "height": "Int64"})


def header(content: Column) -> Column:
    """struct(format, width, height) from the head of a PNG, BMP, JPEG 2000 or binary PNM file; null for others."""
    head = F.hex(F.substring(content, 1, 64))
    ascii_head = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    clean = F.regexp_replace(ascii_head, r"#[^\n]*\n", "")
    pnm = lambda i: F.regexp_extract(clean, r"^P[56]\s+(\d{1,9})\s+(\d{1,9})\s", i)
    box = F.instr(head, F.lit("69686472"))  # the box "ihdr"; its payload starts four bytes on, two digits to a byte
    ihdr = lambda skip: F.conv(F.substring(head, box + 8 + skip, F.lit(8)), 16, 10).cast("long")
    of = lambda name, w, h: F.struct(F.lit(name).alias("format"), w.alias("width"), h.alias("height"))
    return (
        F.when(F.startswith(head, F.lit(_PNG)), of("png", _number(content, 16, 4), _number(content, 20, 4)))
        .when(F.startswith(head, F.lit(_JP2)) & (box > 0), of("jp2", ihdr(8), ihdr(0)))
        .when(F.startswith(head, F.lit(_BMP)), of("bmp", _number(content, 18, 4, True), _number(content, 22, 4, True)))
        .when(pnm(1) != "", of("pnm", pnm(1).cast("long"), pnm(2).cast("long")))
    )


def probed(files: DataFrame, most: int = MOST_PIXELS) -> DataFrame:
    """Files (path, content) with their ``header`` and an ``error`` where it can't be read, is empty or says more than ``most``
    pixels: to be filtered before anything is decoded. Only JPEG and TIFF files, whose sizes are behind chains of segments, go to Python."""
    start = F.hex(F.substring("content", 1, 4))
    chain = _chained(F.when(F.startswith(start, F.lit("FFD8")) | start.isin("49492A00", "4D4D002A", "49492B00", "4D4D002B"), F.col("content")))
    h = files.withColumn("_chain", chain).withColumn("header", F.coalesce(header(F.col("content")), F.when(F.col("_chain.format").isNotNull(), F.col("_chain")))).drop("_chain")
    pixels = F.col("header.width").cast("decimal(20,0)") * F.col("header.height").cast("decimal(20,0)")
    error = validate.first_error((F.col("header").isNull(), validate.error("header", "not a known image header")), (pixels <= 0, validate.error("size", "an empty image")), (pixels > most, validate.error("pixels", "too many pixels")))
    return h.withColumn("error", error)


def decoded(spark: SparkSession, folder: str, most: int = MOST_PIXELS) -> DataFrame:
    """(path, height, width, channels, data) of the files of ``decoded_or_error`` that have no error."""
    return decoded_or_error(spark, folder, most).where("error is null").drop("error")


def decoded_or_error(spark: SparkSession, folder: str, most: int = MOST_PIXELS) -> DataFrame:
    """(path, height, width, channels, data, error) of a folder's files, JPEG, PNG, BMP and GIF by Spark's image source.

    Headers are probed first: files with more than ``most`` pixels, or without a known header, come out with an error and are never
    decoded, and so do those that the image source can't decode. A GIF has no header here and is decoded as it is. The
    driver holds the paths of the files to be decoded, as Spark's own listing of a folder does.
    """
    files = probed(spark.read.format("binaryFile").load(folder), most)
    gif = F.hex(F.substring("content", 1, 4)) == "47494638"
    told = files.select("path", F.when(~gif, F.col("error.message")).alias("error"))
    good = [r["path"] for r in told.where("error is null").select("path").collect()]
    refused = told.where("error is not null").select("path", *[F.lit(None).cast(t).alias(n) for n, t in (("height", "int"), ("width", "int"), ("channels", "int"), ("data", "binary"))], "error")
    if not good:
        return refused
    image = spark.read.format("image").option("dropInvalid", False).load(good).select("image.*")
    broken = F.col("height") < 0
    fields = [F.when(~broken, F.col(c)).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))]
    large = F.col("height").cast("long") * F.col("width") > most
    return image.select(F.col("origin").alias("path"), *fields, F.when(broken, "the file can't be decoded").when(large, "too many pixels").alias("error")).unionByName(refused)


def raster_rows(rasters: DataFrame) -> DataFrame:
    """(path, y, x, r, g, b) of decoded images; the image source keeps channels in the order blue, green, red, and one for grey."""
    size = F.col("height") * F.col("width")
    byte = lambda at: F.conv(F.hex(F.substring(F.col("data"), at + 1, F.lit(1))), 16, 10).cast("int")
    cell = rasters.where(size > 0).select("path", "width", "channels", "data", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    channel = lambda k: byte((F.col("i") * F.col("channels") + F.when(F.col("channels") >= 3, F.lit(k)).otherwise(0)).cast("int"))
    return cell.select("path", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))


def mask_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Masks (name, y, x) saved as Parquet rows, and what follows from them: ``hair`` is the head without the face, ``outside`` all
    pixels of the name ``image`` that aren't on the face."""
    rows = spark.read.schema("name string, y int, x int").parquet(folder)
    of = lambda name: rows.where(F.col("name") == name).select("y", "x").distinct()
    derived = lambda name, a: of(a).join(of("face"), ["y", "x"], "left_anti").select(F.lit(name).alias("name"), "y", "x")
    return rows.distinct().unionByName(derived("hair", "head")).unionByName(derived("outside", "image"))


def as_json(rows: DataFrame) -> DataFrame:
    """(value): each row as a JSON object; a row with an ``error`` gives an object of the error alone."""
    fields = [c for c in rows.columns if c != "error"]
    body = F.to_json(F.struct(*fields))
    if "error" in rows.columns:
        body = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(body)
    return rows.select(body.alias("value"))


def _escaped(c: Column) -> Column:
    out = c
    for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(mark))
    return out


def write_html_report(rows: DataFrame, folder: str, title: str) -> None:
    """A table as the text of a HTML page: one line for each row, written by one task; for reports, whose rows are few."""
    cell = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    line = lambda tag, cs: F.concat(F.lit("<tr>"), *[cell(tag, c) for c in cs], F.lit("</tr>"))
    body = rows.select(F.lit(1).alias("part"), line("td", [F.coalesce(_escaped(F.col(c).cast("string")), F.lit("")) for c in rows.columns]).alias("value"))
    spark = rows.sparkSession
    head = spark.range(1).select(F.lit(0).alias("part"), F.concat(F.lit("<html><head><title>"), _escaped(F.lit(title)), F.lit("</title></head><body><table>"), line("th", [_escaped(F.lit(c)) for c in rows.columns])).alias("value"))
    foot = spark.range(1).select(F.lit(2).alias("part"), F.lit("</table></body></html>").alias("value"))
    head.unionByName(body).unionByName(foot).coalesce(1).sortWithinPartitions("part").select("value").write.mode("overwrite").text(folder)


def write_markdown_report(rows: DataFrame, folder: str, title: str) -> None:
    """The same as a Markdown table."""
    line = lambda cs: F.concat(F.lit("| "), F.array_join(F.array(*cs), " | "), F.lit(" |"))
    safe = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    body = rows.select(F.lit(1).alias("part"), line([safe(c) for c in rows.columns]).alias("value"))
    names = [F.lit(c) for c in rows.columns]
    head = rows.sparkSession.range(1).select(F.lit(0).alias("part"), F.concat_ws("\n", F.lit(f"# {title}\n"), line(names), F.lit("|" + " --- |" * len(names))).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("part").select("value").write.mode("overwrite").text(folder)


def write_pair(image: DataFrame, record: DataFrame, folder: str) -> None:
    """Two tables that belong together, under ``folder``/image and ``folder``/record: both or neither. They are staged beside it and
    renamed in turn, under a lock that one writer holds; if the second can't be moved, the first one is taken back."""
    spark = image.sparkSession
    jvm = spark.sparkContext._jvm
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    fs = path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    lock, stage, names = path("_LOCK"), f"_stage-{uuid.uuid4().hex}", ("image", "record")
    if not fs.createNewFile(lock):
        raise FileExistsError(f"another writer holds {folder}")
    moved: list[str] = []
    try:
        if any(fs.exists(path(n)) for n in names):
            raise FileExistsError(f"{folder} has a pair already")
        for name, rows in zip(names, (image, record), strict=True):
            rows.write.parquet(path(f"{stage}/{name}").toString())
        for name in names:
            if not fs.rename(path(f"{stage}/{name}"), path(name)):
                raise OSError(f"{name} can't be moved into {folder}")
            moved.append(name)
    except Exception:
        for name in moved:
            fs.delete(path(name), True)
        raise
    finally:
        fs.delete(path(stage), True)
        fs.delete(lock, False)
