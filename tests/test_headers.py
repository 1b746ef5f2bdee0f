"""Image headers behind chains of segments, and files that can't or mustn't be decoded."""

from __future__ import annotations

import struct

import pytest

from portrel.sources import files
from tests.test_sources import _png


def _jpeg(width, height, frame=0xC0, before=b"", fill=b""):
    segment = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(9)) + before + segment(0xDB, bytes(65)) + fill + segment(0xC4, bytes(20)) + segment(frame, struct.pack(">BHHB", 8, height, width, 3) + bytes(9)) + b"\xff\xda"


def _tiff(width, height, order="<", kind=4, big=False):
    mark = {"<": b"II", ">": b"MM"}[order]
    if big:
        head = mark + struct.pack(order + "HHHQ", 43, 8, 0, 24) + bytes(8)
        body = struct.pack(order + "Q", 2) + b"".join(struct.pack(order + "HHQQ", t, 16, 1, v) for t, v in ((256, width), (257, height)))
        return head + body
    value = lambda v: struct.pack(order + "HH", v, 0) if kind == 3 else struct.pack(order + "I", v)
    entries = [(254, struct.pack(order + "I", 0)), (256, value(width)), (257, value(height))]
    return mark + struct.pack(order + "HI", 42, 10) + b"xx" + struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, kind, 1) + v for t, v in entries)


def test_chained_sizes():
    thumbnail = b"\xff\xe1" + struct.pack(">H", 2 + 40) + b"Exif\0\0" + _jpeg(7, 7)[:34]
    for frame in (0xC0, 0xC1, 0xC2, 0xCF):
        assert files.chained_size(_jpeg(640, 480, frame, thumbnail, b"\xff\xff")) == ("jpeg", 640, 480)
    for order, kind, big in (("<", 4, False), (">", 3, False), (">", 4, False), ("<", 16, True), (">", 16, True)):
        assert files.chained_size(_tiff(640, 480, order, kind, big)) == ("tiff", 640, 480)
    whole = _jpeg(640, 480)
    at = whole.index(b"\xff\xc0")
    assert [files.chained_size(whole[:n]) for n in range(at + 8)] == [None] * (at + 8)
    assert all(files.chained_size(_tiff(640, 480)[:n]) is None for n in range(46))
    assert files.chained_size(None) is None and files.chained_size(b"\xff\xd8\xff\xe0\0\1") is None and files.chained_size(b"\xff\xd8\xff\xd9") is None


def test_probe_of_chains(spark):
    rows = [("a", _jpeg(30, 20)), ("b", _tiff(60_000, 60_000, ">")), ("c", _jpeg(0, 5)), ("d", _jpeg(3, 3)[:40]), ("e", None), ("f", _png(3, 2, bytes(18)))]
    found = files.probed(spark.createDataFrame([(*r, 1) for r in rows], "path string, content binary, width int"))
    got = {r["path"]: (r["header"] and tuple(r["header"]), r["error"] and r["error"]["code"]) for r in found.collect()}
    assert got == {"a": (("jpeg", 30, 20), None), "b": (("tiff", 60_000, 60_000), "pixels"), "c": (("jpeg", 0, 5), "size"), "d": (None, "header"), "e": (None, "header"), "f": (("png", 3, 2), None)}


def test_errors_of_decoding(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(_png(3, 2, bytes(18)))
    (tmp_path / "cut.png").write_bytes(_png(3, 2, bytes(18))[:40])
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "large.png").write_bytes(_png(1, 1, bytes(3))[:16] + struct.pack(">II", 90_000, 90_000))
    got = {r["path"].rsplit("/", 1)[1]: (r["height"], r["width"], r["error"]) for r in files.decoded_or_error(spark, str(tmp_path)).collect()}
    assert got == {"x.png": (2, 3, None), "cut.png": (None, None, "the file can't be decoded"), "bad.png": (None, None, "not a known image header"), "large.png": (None, None, "too many pixels")}


@pytest.mark.parametrize("most", [5])
def test_nothing_to_decode(spark, tmp_path, most):
    (tmp_path / "x.png").write_bytes(_png(3, 2, bytes(18)))
    assert [r["error"] for r in files.decoded_or_error(spark, str(tmp_path), most).collect()] == ["too many pixels"]
