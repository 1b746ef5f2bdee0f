"""Sources and sinks on files made here."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from portrel.sources import containers, files


def _box(kind: bytes, payload: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(payload), kind) + payload


def _stream() -> bytes:
    siz = struct.pack(">HH", 0xFF51, 10) + b"\0" * 8
    body = b"\x01" * 20
    sot = struct.pack(">HHHIBB", 0xFF90, 10, 0, 12 + 2 + len(body), 0, 1)
    return b"\xff\x4f" + siz + sot + b"\xff\x93" + body + b"\xff\xd9"


@pytest.fixture
def folder(tmp_path):
    jp2 = _box(b"jP  ", b"\r\n\x87\n") + _box(b"jp2h", _box(b"ihdr", b"\0" * 14)) + _box(b"jp2c", _stream())
    for name, content in {"b_blur_0.3.JPG": b"b", "A.png": b"a", "notes.txt": b"n", "c.jp2": jp2, "broken.jp2": jp2[:-3]}.items():
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_images_in_order(spark, folder):
    names = [r[0].rsplit("/", 1)[1] for r in files.ordered_paths(files.images(spark, str(folder))).select("path").collect()]
    assert names == ["A.png", "broken.jp2", "b_blur_0.3.JPG", "c.jp2"]  # "_" is after capital letters
    assert files.images(spark, str(folder), "*_blur_*").count() == 1
    row = spark.range(1).select(files.extension(F.lit("x/Y.z/photo.JPeG")).alias("e"), files.stem(F.lit("x/Y.z/photo.JPeG")).alias("s")).head()
    assert (row["e"], row["s"]) == ("jpeg", "photo")


def test_boxes_and_markers(spark, folder):
    rows = containers.box_table(files.images(spark, str(folder), "*.jp2")).orderBy("path", "offset").collect()
    good = [(r["type"], r["depth"], r["payload"]) for r in rows if r["path"].endswith("/c.jp2")]
    assert good == [("jP  ", 0, 4), ("jp2h", 0, 22), ("ihdr", 1, 14), ("jp2c", 0, len(_stream()))]
    broken = [r for r in rows if r["path"].endswith("/broken.jp2")]
    assert any(r["error"] for r in broken)
    found = containers.markers(_stream())
    assert [m for _, m, _ in found] == [0xFF4F, 0xFF51, 0xFF90, 0xFF93, 0xFFD9]
    assert found[-1][0] == len(_stream()) - 2


def test_corpus_and_verification(spark, folder, tmp_path):
    (tmp_path / "corpus.json").write_text(json.dumps({"id": "people", "subjects": [{"id": "a", "source": "A.png"}, {"id": "z", "source": "z.png", "expectedFaceCount": 0, "expectLandmarks": False}]}, indent=1))
    got = [tuple(r) for r in files.corpus(spark, str(tmp_path / "corpus.json")).orderBy("ordinal").collect()]
    assert got == [("people", 0, "a", "A.png", 1, True), ("people", 1, "z", "z.png", 0, False)]
    pinned = spark.createDataFrame([("a", "A.png", hashlib.sha256(b"a").hexdigest().upper()), ("b", "b_blur_0.3.JPG", "00"), ("z", "z.png", "00")], "id string, path string, sha256 string")
    codes = {r["id"]: r["code"] for r in files.verified(files.images(spark, str(folder)), pinned).select("id", "error.code").collect()}
    assert codes == {"a": None, "b": "hash", "z": "missing"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é")], "id long, note string")
    files.write_manifest(rows, str(tmp_path / "m"))
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_manifest(rows, str(tmp_path / "m"))
    files.write_report(rows, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).head()["note"] == "é"
    for _ in range(2):
        files.append_review(rows, str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v")).count() == 2


def _png(width: int, height: int, pixels: bytes) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + pixels[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_headers_are_probed_before_decoding(spark):
    jp2 = bytes.fromhex("0000000C6A5020200D0A870A") + _box(b"ftyp", b"jp2 \0\0\0\0jp2 ") + _box(b"jp2h", _box(b"ihdr", struct.pack(">IIHBBBB", 640, 480, 3, 7, 7, 0, 0)))
    rows = [
        ("a", _png(3, 2, bytes(18))), ("b", jp2), ("c", b"BM" + bytes(16) + struct.pack("<ii", 30, 20)), ("d", b"P6\n# made\n12 7\n255\n" + bytes(252)), ("e", b"GIF"), ("f", b""), ("g", None),
        ("h", _png(1, 1, bytes(3))[:16] + struct.pack(">II", 100_000, 100_000)), ("i", _png(1, 1, bytes(3))[:16] + struct.pack(">II", 0, 5)),
    ]
    got = {r["path"]: (r["header"] and tuple(r["header"]), r["error"] and r["error"]["code"]) for r in files.probed(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a"] == (("png", 3, 2), None)
    assert got["b"] == (("jp2", 480, 640), None)
    assert got["c"] == (("bmp", 30, 20), None)
    assert got["d"] == (("pnm", 12, 7), None)
    assert {got[k][1] for k in "efg"} == {"header"}
    assert got["h"][1] == "pixels"
    assert got["i"][1] == "size"


def test_decoded_pixels(spark, tmp_path):
    pixels = bytes(range(0, 180, 10))
    (tmp_path / "x.png").write_bytes(_png(3, 2, pixels))
    (tmp_path / "bad.png").write_bytes(b"no image")
    found = files.raster_rows(files.decoded(spark, str(tmp_path))).orderBy("y", "x").collect()
    assert [(r["y"], r["x"], r["r"], r["g"], r["b"]) for r in found] == [(i // 3, i % 3, *pixels[3 * i : 3 * i + 3]) for i in range(6)]
    assert files.decoded(spark, str(tmp_path), most=5).count() == 0


def test_reports_and_masks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b", None), (2, "<&>", "code")], "id int, note string, error string")
    files.write_html_report(rows, str(tmp_path / "html"), "T & t")
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "html")).collect())
    assert text.startswith("<html><head><title>T &amp; t</title>")
    assert "<tr><td>2</td><td>&lt;&amp;&gt;</td><td>code</td></tr>" in text
    assert text.endswith("</table></body></html>")
    files.write_markdown_report(rows, str(tmp_path / "md"), "T")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert lines[:1] == ["# T"]
    assert "| 1 | a\\|b |  |" in lines
    assert [r[0] for r in files.as_json(rows).collect()] == ['{"id":1,"note":"a|b"}', '{"error":"code"}']
    cells = [(n, y, 0) for n, ys in {"image": range(6), "head": range(1, 5), "face": range(2, 4)}.items() for y in ys]
    spark.createDataFrame(cells, "name string, y int, x int").write.parquet(str(tmp_path / "masks"))
    masks = files.mask_bundle(spark, str(tmp_path / "masks"))
    got = {n: sorted(r["y"] for r in masks.where(F.col("name") == n).collect()) for n in ("hair", "outside")}
    assert got == {"hair": [1, 4], "outside": [0, 1, 4, 5]}


def test_pairs_are_written_whole(spark, tmp_path):
    good, bad = spark.range(3), spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))
    files.write_pair(good, good, str(tmp_path / "a"))
    assert [spark.read.parquet(str(tmp_path / "a" / n)).count() for n in ("image", "record")] == [3, 3]
    with pytest.raises(FileExistsError):
        files.write_pair(good, good, str(tmp_path / "a"))
    with pytest.raises(Exception, match="broken"):
        files.write_pair(good, bad, str(tmp_path / "b"))
    assert [p.name for p in (tmp_path / "b").iterdir() if not p.name.startswith(".")] == []
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "_LOCK").write_text("")
    with pytest.raises(FileExistsError):
        files.write_pair(good, good, str(tmp_path / "c"))
