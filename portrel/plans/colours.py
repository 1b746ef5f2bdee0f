"""Queries of colour profiles: made profiles, most with one fault each, and the colours that the good ones give."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portrel.plans.registry import query
from portrel.sources import exchange, profiles
from portrel.sources import relations as rel

#: Colorants by rows: those of sRGB, and those of a wider space.
WIDE = (0.60974, 0.20528, 0.14919, 0.31111, 0.62567, 0.06322, 0.01947, 0.06087, 0.74457)
#: The place in a made profile where a gamma's two bytes go, from the table.
_SLOT = bytes.fromhex("0f0f")


def _s15(*values: float) -> bytes:
    return b"".join(struct.pack(">i", round(v * 65536)) for v in values)


def gamma_curve() -> bytes:
    return b"curv" + bytes(4) + struct.pack(">I", 1) + _SLOT


def table_curve(*samples: int) -> bytes:
    return b"curv" + bytes(4) + struct.pack(">I", len(samples)) + struct.pack(f">{len(samples)}H", *samples)


def parametric_curve(function: int, *values: float) -> bytes:
    return b"para" + bytes(4) + struct.pack(">HH", function, 0) + _s15(*values)


#: Parameters of the sRGB curve.
_SRGB_CURVE = (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)


def made(matrix: tuple[float, ...] = profiles.SRGB, curve: bytes | None = None, header: dict[int, bytes] | None = None, tags: list[tuple[str, bytes]] | None = None, entries: dict[int, bytes] | None = None, cut: int = 0) -> bytes:
    """A profile's bytes; ``header`` and ``entries`` overwrite bytes of the header and of the tag table, ``tags`` replace or add to the usual ones."""
    xyz = lambda v: b"XYZ " + bytes(4) + _s15(*v)
    shape = curve or gamma_curve()
    own = {c: xyz(matrix[i::3]) for i, c in enumerate(profiles.COLORANTS)} | {"wtpt": xyz(profiles.D50)} | dict.fromkeys(profiles.CURVES, shape)
    for name, content in tags or []:
        own.pop(name, None)
        if content:
            own[name] = content
    table, store, places = b"", b"", {}
    begin = 132 + 12 * len(own)
    for name, content in own.items():
        if content not in places:
            store += bytes(-len(store) % 4)
            places[content] = begin + len(store)
            store += content
        table += name.encode() + struct.pack(">II", places[content], len(content))
    for at, value in (entries or {}).items():
        table = table[:at] + value + table[at + len(value) :]
    head = bytearray(128)
    size = begin + len(store)
    fields = {0: struct.pack(">I", size), 8: b"\x04", 12: b"mntrRGB XYZ ", 36: b"acsp", 68: _s15(*profiles.D50)} | (header or {})
    for at, value in fields.items():
        head[at : at + len(value)] = value
    whole = bytes(head) + struct.pack(">I", len(own)) + table + store
    return whole[: len(whole) - cut]


def cases() -> list[tuple[bytes, str | None]]:
    """Profiles and their errors; the first five are good: gammas over two spaces, sRGB's own curve, samples, and a straight line."""
    bent = lambda f, *v: made(curve=parametric_curve(f, *v))
    white = lambda v: b"XYZ " + bytes(4) + _s15(*v)
    return [
        (made(), None), (made(WIDE), None), (bent(3, *_SRGB_CURVE), None), (made(WIDE, table_curve(0, 9000, 32000, 65535)), None), (made(curve=table_curve()), None),
        (made(cut=4), profiles.SIZE), (made(header={0: b"\0\0\0\1"}), profiles.SIZE), (made(header={36: b"acsq"}), profiles.HEADER), (made(header={8: b"\x05"}), profiles.HEADER), (made(header={12: b"prtr"}), profiles.KIND), (made(header={16: b"CMYK"}), profiles.KIND),
        (made(header={64: b"\0\0\0\4"}), profiles.FIELDS), (made(header={127: b"\1"}), profiles.FIELDS), (made(header={68: _s15(0.9505)}), profiles.WHITE), (made(entries={}, header={}, tags=[(n, b"") for n in (*profiles.COLORANTS, "wtpt", *profiles.CURVES)]), profiles.COUNT),
        (made(entries={4: struct.pack(">I", 218)}), profiles.STORAGE), (made(entries={4: struct.pack(">I", 8)}), profiles.STORAGE), (made(entries={8: struct.pack(">I", 99999)}), profiles.STORAGE), (made(entries={12: b"rXYZ"}), profiles.UNIQUE), (made(entries={16: struct.pack(">I", 220)}), profiles.OVERLAP),
        (made(tags=[("A2B0", bytes(12))]), profiles.TABLES), (made(tags=[("cicp", bytes(12))]), profiles.TABLES), (made(tags=[("gXYZ", b"")]), profiles.REQUIRED.format("gXYZ")), (made(tags=[("wtpt", b"")]), profiles.REQUIRED.format("wtpt")), (made(tags=[("gTRC", b"")]), profiles.REQUIRED.format("gTRC")),
        (made(tags=[("wtpt", white(profiles.D50) + bytes(4))]), profiles.SINGLE), (made(tags=[("wtpt", white((9.0, 1.0, 1.0)))]), profiles.BOUNDS), (made(tuple(v * 0.98 for v in profiles.SRGB)), profiles.NORMAL), (made((0.3214,) * 3 + (1 / 3,) * 3 + (0.27497,) * 3), profiles.SINGULAR),
        (made(curve=b"curv\0\0\0\1" + bytes(4)), profiles.CURVE_HEADER), (made(curve=table_curve(1, 2, 3)[:-2]), profiles.SAMPLES), (made(curve=table_curve(0)), profiles.GAMMA), (made(curve=table_curve(0, 9, 8, 65535)), profiles.RISING), (bent(5, 1.0), profiles.STORED), (bent(1, 1.0), profiles.STORED),
        (bent(0, 17.0), profiles.DEFINED), (bent(1, 2.0, -1.0, 0.5), profiles.DEFINED), (bent(3, 2.0, 1.0, -0.9, 0.5, 0.5), profiles.DEFINED), (made(curve=b"mluc" + bytes(12)), profiles.CURVE_TYPE), (made(curve=table_curve(7, 7, 7)), profiles.CURVE_VALUES), (bent(4, 1.0, 1.0, 0.0, 1.0, 0.5, -0.4, 0.0), profiles.CURVE_VALUES),
    ]


def made_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, case, data): a profile for each part, with a gamma from its size where the case has one."""
    listed = [(i, data.hex().upper()) for i, (data, _) in enumerate(cases())]
    some = F.broadcast(spark.createDataFrame(listed, "case long, hex string"))
    parts = rel.dealt(rel.table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % len(listed)).alias("case"), F.lpad(F.hex(128 + F.col("p_size").cast("long") * 12), 4, "0").alias("gamma"))
    return parts.join(some, "case").select("id", "case", F.unhex(F.replace("hex", F.lit(_SLOT.hex().upper()), F.col("gamma"))).alias("data"))


_CASES = len(cases())
_ERRORS = ", ".join(f"({i}, " + ("NULL" if e is None else "'" + e.replace("'", "''") + "'") + ")" for i, (_, e) in enumerate(cases()))


@query(f"SELECT p_partkey AS id, error, CASE WHEN error IS NULL THEN p_partkey % {_CASES} = 2 END AS describes_srgb FROM part JOIN (VALUES {_ERRORS}) c(k, error) ON k = p_partkey % {_CASES}")
def profile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each profile, in the order of its format, and whether a good one describes sRGB."""
    return profiles.parsed(made_profiles(spark, sf_dir), "id").select("id", "error", "describes_srgb")


_fixed = lambda m: [round(v * 65536) / 65536 for v in m]


def _matrix_sql(m: tuple[float, ...]) -> list[float]:
    import numpy as np

    return (np.linalg.inv(np.array(profiles.SRGB).reshape(3, 3)) @ np.array(_fixed(m)).reshape(3, 3)).ravel().tolist()


def _colour_sql() -> str:
    g, a, b, c, d = _fixed(_SRGB_CURVE)
    curve = f"""CASE WHEN k IN (0, 1) THEN pow(x, (128 + p_size * 12) / 256e0) WHEN k = 2 THEN CASE WHEN x >= {d!r}e0 THEN pow(greatest(0, {a!r}e0 * x + {b!r}e0), {g!r}e0) ELSE {c!r}e0 * x END
        WHEN k = 3 THEN ((1 - (x * 3 - floor(x * 3))) * [0, 9000, 32000, 65535][CAST(floor(x * 3) AS INTEGER) + 1] + (x * 3 - floor(x * 3)) * [0, 9000, 32000, 65535][least(CAST(floor(x * 3) AS INTEGER) + 2, 4)]) / 65535e0 ELSE x END"""
    rows = ", ".join(f"({k}, {_matrix_sql(WIDE if k in (1, 3) else profiles.SRGB)})" for k in range(5))
    channel = lambda i: f"CAST(round(255 * CASE WHEN l{i} <= 0.0031308 THEN 12.92e0 * l{i} ELSE 1.055e0 * pow(l{i}, 1 / 2.4e0) - 0.055e0 END) AS INTEGER)"
    return f"""WITH px AS (SELECT p_partkey AS id, p_size, p_partkey % {_CASES} AS k, [p_partkey * 37 % 256, p_partkey * 101 % 256, (p_partkey * 59 + 13) % 256] AS v FROM part WHERE p_partkey % {_CASES} < 5),
m(k, m) AS (VALUES {rows}), c AS (SELECT id, k, i, {curve} AS y FROM (SELECT id, p_size, k, i, v[i] / 255e0 AS x FROM px, range(1, 4) t(i))), li AS (SELECT id, k, list(y ORDER BY i) AS y FROM c GROUP BY id, k),
o AS (SELECT id, {", ".join(f"least(1e0, greatest(0e0, m[{3 * i + 1}] * y[1] + m[{3 * i + 2}] * y[2] + m[{3 * i + 3}] * y[3])) AS l{i}" for i in range(3))} FROM li JOIN m ON li.k = m.k)
SELECT p_partkey AS id, {channel(0)} AS r, {channel(1)} AS g, {channel(2)} AS b FROM part LEFT JOIN o ON id = p_partkey"""


@query(_colour_sql())
def profile_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel of each part through its profile's curves and matrix to sRGB; without a colour where the profile has a fault."""
    told = profiles.parsed(made_profiles(spark, sf_dir), "id")
    pixel = [(F.col("id") * 37) % 256, (F.col("id") * 101) % 256, (F.col("id") * 59 + 13) % 256]
    r, g, b = profiles.converted(*pixel, F.col("matrix"), F.col("curves"))
    return told.select("id", r.alias("r"), g.alias("g"), b.alias("b"))


_HEX = lambda v, n: f"lpad(hex(CAST({v} AS BIGINT)), {2 * n}, '0')"


@query(f"""WITH p AS (SELECT p_partkey AS id, hex(encode(p_name)) AS code, p_size AS h, p_size * 3 AS w, CASE p_partkey % 3 WHEN 0 THEN [8] WHEN 1 THEN [8, 8, 8] ELSE [8, 10, 12] END AS bits FROM part),
b AS (SELECT id, code, '00000016' || hex(encode('ihdr')) || {_HEX('h', 4)} || {_HEX('w', 4)} || {_HEX('len(bits)', 2)} || CASE WHEN bits[2] = 10 THEN 'FF' ELSE '07' END || '070000' || '0000000F' || hex(encode('colr')) || '010000' || CASE WHEN len(bits) > 1 THEN '00000010' ELSE '00000011' END || CASE WHEN bits[2] = 10 THEN '0000000B' || hex(encode('bpcc')) || '07090B' ELSE '' END AS head FROM p),
f AS (SELECT id, unhex('0000000C6A5020200D0A870A' || '00000014' || hex(encode('ftypjp2 ')) || '00000000' || hex(encode('jp2 ')) || {_HEX('length(head) // 2 + 8', 4)} || hex(encode('jp2h')) || head || {_HEX('length(code) // 2 + 8', 4)} || hex(encode('jp2c')) || code) AS data FROM b)
SELECT id, CAST(octet_length(data) AS INTEGER) AS n_bytes, sha256(data) AS sha256 FROM f""")
def container_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files around codestreams (stand-ins: names), of one, three and three unequal components, by their digests."""
    p, k = rel.table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    bits = F.when(k == 0, F.array(F.lit(8))).when(k == 1, F.array(*[F.lit(8)] * 3)).otherwise(F.array(F.lit(8), F.lit(10), F.lit(12)))
    data = exchange.container(F.encode("p_name", "UTF-8"), F.col("p_size"), F.col("p_size") * 3, bits)
    return p.select(F.col("p_partkey").alias("id"), data.alias("data")).select("id", F.length("data").alias("n_bytes"), F.sha2("data", 256).alias("sha256"))
