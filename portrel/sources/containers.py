"""Box and marker tables of JPEG 2000 files, as table functions: one row for each box or marker segment."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Boxes that hold boxes, and markers without a length.
_NESTED = (b"jp2h",)
_BARE = (0xFF4F, 0xFF93, 0xFFD9)


def boxes(data: bytes) -> list[tuple[int, int, str, int, int]]:
    """(offset, depth, type, header bytes, payload bytes) of each box; raises where a box doesn't fit."""
    out = []

    def walk(at: int, end: int, depth: int) -> None:
        while at < end:
            if at + 8 > end:
                raise ValueError(f"a box header at {at} is cut off")
            size, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1:
                if at + 16 > end:
                    raise ValueError(f"a box header at {at} is cut off")
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            elif size == 0:
                size = end - at
            if size < head or at + size > end:
                raise ValueError(f"the box at {at} doesn't fit")
            out.append((at, depth, kind.decode("latin-1"), head, size - head))
            if kind in _NESTED:
                walk(at + head, at + size, depth + 1)
            at += size

    walk(0, len(data), 0)
    return out


def markers(codestream: bytes) -> list[tuple[int, int, int]]:
    """(offset, marker, segment bytes) up to the end; tile data is skipped by each tile part's length."""
    out, at, part_end = [], 0, None
    while at + 2 <= len(codestream):
        marker = struct.unpack_from(">H", codestream, at)[0]
        if marker in _BARE:
            out.append((at, marker, 2))
            at = part_end if marker == 0xFF93 and part_end else at + 2
            continue
        if at + 4 > len(codestream):
            raise ValueError(f"the marker at {at} is cut off")
        size = struct.unpack_from(">H", codestream, at + 2)[0] + 2
        if at + size > len(codestream):
            raise ValueError(f"the marker at {at} doesn't fit")
        if marker == 0xFF90:
            length = struct.unpack_from(">I", codestream, at + 6)[0]
            part_end = at + length if length else len(codestream) - 2
        out.append((at, marker, size))
        at += size
    return out


def register(spark: SparkSession) -> None:
    """Register the table function ``jp2_boxes(content)``; a broken file gives one row with an error."""

    @F.udtf(returnType="offset long, depth int, type string, header int, payload long, error string")
    class Boxes:
        def eval(self, content: bytes) -> Iterator[tuple]:
            try:
                for offset, depth, kind, head, payload in boxes(bytes(content)):
                    yield offset, depth, kind, head, payload, None
            except ValueError as broken:
                yield None, None, None, None, None, str(broken)

    spark.udtf.register("jp2_boxes", Boxes)


def box_table(files: DataFrame) -> DataFrame:
    """(path, offset, depth, type, header, payload, error) of ``files(path, content)``."""
    spark = files.sparkSession
    register(spark)
    return spark.sql("SELECT f.path, b.* FROM {files} f, LATERAL jp2_boxes(f.content) b", files=files)
