"""Archives, streams of JSON lines and container files, on files made here."""

from __future__ import annotations

import json
import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from portrel.sources import containers, exchange


def _archive(path, names, note=b""):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as file:
        for n in names:
            file.writestr(n, n * 3)
        file.comment = note
    return path


def _end_64(path):
    """The same archive with a 64-bit end of its directory, and 64-bit sizes in its first entry."""
    data = path.read_bytes()
    at = data.rfind(b"PK\5\6")
    many, length, offset = struct.unpack_from("<HII", data, at + 10)
    directory = data[offset : offset + length]
    stored, size, name_size, extra_size = struct.unpack_from("<IIHH", directory, 20)
    extra = struct.pack("<HHQQ", 1, 16, size, stored)
    first = directory[:20] + struct.pack("<IIHH", 0xFFFFFFFF, 0xFFFFFFFF, name_size, extra_size + 20) + directory[32 : 46 + name_size] + extra + directory[46 + name_size :]
    record = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, many, many, len(first), offset)
    locator = b"PK\6\7" + struct.pack("<IQI", 0, offset + len(first), 1)
    path.write_bytes(data[:offset] + first + record + locator + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


def test_archives(spark, tmp_path):
    names = [f"lib/{i}/é{i}.txt" for i in range(50)]
    _archive(tmp_path / "a.zip", names, b"a note with PK\5\6 in it")
    _archive(tmp_path / "b.zip", names)
    _end_64(tmp_path / "b.zip")
    _archive(tmp_path / "c.zip", [])
    (tmp_path / "other.txt").write_text("x")
    rows = exchange.archive_entries(spark, str(tmp_path), size=7)
    assert rows.rdd.getNumPartitions() == 8 + 8 + 1
    got = sorted((r["package"], r["place"], r["name"], r["size"]) for r in rows.collect())
    assert got == [(p, i, n, 3 * len(n.encode())) for p in ("a.zip", "b.zip") for i, n in enumerate(names)]
    (tmp_path / "d.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="no end of an archive's directory"):
        exchange.archive_entries(spark, str(tmp_path / "d.zip")).collect()
    assert exchange.archive_entries(spark, str(tmp_path), ".none").count() == 0


def test_inventory(spark, tmp_path):
    good = ["x.nuspec", "README.md", "lib/n8/A.dll", "lib/n8/A.xml"]
    made = {
        "good": good, "twice": [*good, "README.md"], "specs": [*good, "y.nuspec"], "none": good[1:], "missing": good[:3], "group": [*good, "lib/n6/A.xml"], "odd": [*good, "tools/B.dll"],
        "both": [*good[:3], "tools/B.dll", "lib/n6/q"],
    }
    with pytest.warns(UserWarning, match="Duplicate name"):
        for name, files in made.items():
            _archive(tmp_path / f"{name}.zip", files)
    rows = exchange.archive_entries(spark, str(tmp_path))
    check = lambda most: {r["package"][:-4]: (r["error"], r["subject"]) for r in exchange.inventory(rows, good[1:], "lib/n8/", ["lib/n8/A.dll"], most).collect()}
    assert check(10**9) == {
        "good": (None, None), "twice": ("Package contains duplicate archive entries.", "README.md"), "specs": ("Package must contain one nuspec.", None), "none": ("Package must contain one nuspec.", None),
        "missing": ("Missing bundled file.", "lib/n8/A.xml"), "group": ("Ship one complete compatible framework group.", "lib/n6/A.xml"), "odd": ("Unexpected implementation or development assembly in package.", "tools/B.dll"), "both": ("Missing bundled file.", "lib/n8/A.xml"),
    }
    assert set(check(1).values()) == {("Package exceeds the release size allowance.", None)}


def test_json_lines_once_over_restarts(spark, tmp_path):
    """A stream that is stopped and begun again from its checkpoint gives each whole line once; a line without its end waits."""
    folder, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")
    folder.mkdir()

    def run():
        lines = exchange.json_lines(spark, str(folder), "id long, event string")
        lines.writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r["file"], r["start"], r["id"], r["event"]) for r in spark.read.parquet(out).collect())

    line = lambda i: json.dumps({"id": i, "event": "é" * i}) + "\n"
    (folder / "a.jsonl").write_text(line(1) + line(2) + '{"id": 3, "ev')
    (folder / "skip.txt").write_text(line(9))
    first = run()
    assert [r[2:] for r in first] == [(1, "é"), (2, "éé")]
    assert run() == first
    with open(folder / "a.jsonl", "a") as file:
        file.write('ent": "x"}\n')
    (folder / "b.jsonl").write_text("no json\n" + line(4) * 3)
    again = run()
    assert [r[2:] for r in again] == [(1, "é"), (2, "éé"), (3, "x"), (None, None), (4, "éééé"), (4, "éééé"), (4, "éééé")]
    assert run() == again


def test_containers(spark, tmp_path):
    rows = [("a.jp2", b"\xff\x4f\xff\xd9", 640, 480, [8, 8, 8]), ("b.jp2", b"", 1, 1, [8]), ("c.jp2", b"xyz", 2, 70_000, [8, 12])]
    df = spark.createDataFrame(rows, "name string, code binary, h int, w int, bits array<int>").select("name", exchange.container(F.col("code"), F.col("h"), F.col("w"), F.col("bits")).alias("content"))
    exchange.write_files(df.repartition(3), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["a.jp2", "b.jp2", "c.jp2"]
    for name, code, h, w, bits in rows:
        data = (tmp_path / "out" / name).read_bytes()
        found = containers.boxes(data)
        inner = ["ihdr", "colr"] + ["bpcc"] * (len(set(bits)) > 1)
        assert [b[2] for b in found] == ["jP  ", "ftyp", "jp2h", *inner, "jp2c"]
        assert data.endswith(code) and len(data) == 85 + len(code) + (8 + len(bits) if len(inner) > 2 else 0)
        at = found[3][0] + 8
        assert struct.unpack_from(">IIHB", data, at) == (h, w, len(bits), 255 if len(inner) > 2 else bits[0] - 1)
    none = spark.createDataFrame([(None, [8]), (b"x", []), (b"x", None)], "code binary, bits array<int>").select(exchange.container(F.col("code"), F.lit(1), F.lit(1), F.col("bits")).alias("c")).collect()
    assert [r["c"] for r in none] == [None] * 3


def test_failed_writes_leave_no_file(spark, tmp_path):
    """A task that fails, or another one of its job, leaves neither files nor parts of any; files that are there stay as they are."""
    out = tmp_path / "out"
    good = [(f"f{i}", b"x" * i) for i in range(20)]
    for bad in ((None, b"x"), ("../up", b"x"), ("f3", b"y"), ("g", None)):
        df = spark.createDataFrame([*good, bad], "name string, content binary").coalesce(1)
        with pytest.raises(Exception, match="can be written|there already"):
            exchange.write_files(df, str(out))
        assert os.listdir(out) == []
    exchange.write_files(spark.createDataFrame(good, "name string, content binary").repartition(4), str(out))
    with pytest.raises(Exception, match="there already"):
        exchange.write_files(spark.createDataFrame([("f5", b"other"), ("new", b"z")], "name string, content binary").repartition(2), str(out))
    assert sorted(os.listdir(out)) == sorted(n for n, _ in good) and (out / "f5").read_bytes() == b"x" * 5
