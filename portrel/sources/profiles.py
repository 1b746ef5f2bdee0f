"""Colour profiles (ICC matrix and tone-curve profiles) from bytes to rows: tags at variable offsets, what is wrong with them, and their curves.

Everything is an expression over the profile's bytes: numbers are read at offsets that other numbers give. Tags become rows, so that
their alignment, their uniqueness and overlaps of their storage are checked by windows over offsets, as an interval join of neighbours
would; the rest of a profile's values is checked on its own row. The first fault, in the order of the file format, is the ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: D50 white, the adapted colorants of sRGB by rows, bounds of the supported profiles.
D50 = (0.9642, 1.0, 0.8249)
SRGB = (0.436030342570117, 0.385101860087134, 0.143067806654203, 0.222438466210245, 0.716942745571917, 0.060618777416563, 0.013897440074263, 0.097076381494207, 0.713926257896652)
LEAST_BYTES, MOST_BYTES, MOST_TAGS, MOST_SAMPLES = 132, 4 << 20, 128, 65_536
COLORANTS, CURVES = ("rXYZ", "gXYZ", "bXYZ"), ("rTRC", "gTRC", "bTRC")
#: Numbers of parameters of the parametric curve functions.
PARAMETERS = (1, 3, 4, 5, 7)
SAME, CLOSE = 0.0001, 0.005

#: Fixed messages.
SIZE = "ICC declared size must match the bounded profile payload."
HEADER = "Supported ICC headers use the acsp signature and profile version 2 or 4."
KIND = "Supported source ICC profiles use an input, display, or color-space RGB matrix with XYZ PCS."
FIELDS = "ICC rendering-intent and reserved-header fields require valid values."
WHITE = "ICC PCS illuminant must be D50."
COUNT = "ICC tag count exceeds the validated table bounds."
STORAGE = "ICC tag storage must be aligned and contained after its tag table."
UNIQUE = "ICC tag signatures must be unique."
OVERLAP = "ICC tags may share identical storage; partial overlaps require correction."
TABLES = "ICC LUT, multi-process, or CICP profiles require an external color-managed conversion to sRGB."
REQUIRED = "ICC matrix profile requires the {} tag."
SINGLE = "ICC colorants and white point require a single XYZ value."
BOUNDS = "ICC XYZ values exceed this converter's supported bounds."
NORMAL = "ICC matrix colorants must already be normalized to the D50 PCS white."
SINGULAR = "ICC colorant matrix must be nonsingular."
CURVE_HEADER = "ICC tone curve requires a valid type header."
SAMPLES = "ICC sampled curve count must match its bounded tag payload."
GAMMA = "ICC gamma must lie in the supported range (0,16]."
RISING = "ICC sampled tone curves must be monotone increasing."
STORED = "ICC parametric curve type and parameter storage require valid values."
DEFINED = "ICC parametric curve parameters require a defined monotone function over [0,1]."
CURVE_TYPE = "Supported ICC tone curves use curveType or parametricCurveType."
CURVE_VALUES = "ICC tone curves require finite, nonconstant, monotone values."


def unsigned(data: Column, offset: Column | int, size: int = 4) -> Column:
    """The big-endian number of ``size`` bytes at an offset."""
    at = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    return F.conv(F.hex(F.substring(data, at, F.lit(size))), 16, 10).cast("long")


def fixed(data: Column, offset: Column | int) -> Column:
    """A signed number with 16 bits behind the point."""
    n = unsigned(data, offset)
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n) / 65536.0


def signature(data: Column, offset: Column | int) -> Column:
    at = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    return F.decode(F.substring(data, at, F.lit(4)), "ISO-8859-1")


def _first(*faults: tuple[Column, str]) -> Column:
    """The first message whose condition holds, or isn't known."""
    chain = F.when(F.lit(False), "")
    for bad, message in faults:
        chain = chain.when(F.coalesce(bad, F.lit(True)), message)
    return chain


def header_error(data: Column) -> Column:
    size, count = F.length(data), unsigned(data, 128)
    white = [F.abs(fixed(data, 68 + 4 * i) - F.lit(w)) > SAME for i, w in enumerate(D50)]
    return _first(
        (data.isNull() | (size < LEAST_BYTES) | (size > MOST_BYTES) | (unsigned(data, 0) != size), SIZE), ((signature(data, 36) != "acsp") | ~unsigned(data, 8, 1).isin(2, 4), HEADER),
        (~signature(data, 12).isin("mntr", "scnr", "spac") | (signature(data, 16) != "RGB ") | (signature(data, 20) != "XYZ "), KIND), ((unsigned(data, 64) > 3) | (F.hex(F.substring(data, F.lit(101), F.lit(28))) != "00" * 28), FIELDS),
        (white[0] | white[1] | white[2], WHITE), ((count == 0) | (count > MOST_TAGS) | (132 + 12 * count > size), COUNT),
    )


def tags(profiles: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(key, place, name, offset, length) of the tags of profiles whose header is fit."""
    b = F.col(data)
    good = profiles.where(header_error(b).isNull()).select(key, b.alias("_b"), F.explode(F.sequence(F.lit(0), (unsigned(b, 128) - 1).cast("int"))).alias("place"))
    at = 132 + 12 * F.col("place")
    return good.select(key, "place", signature(F.col("_b"), at).alias("name"), unsigned(F.col("_b"), at + 4).alias("offset"), unsigned(F.col("_b"), at + 8).alias("length"))


def tag_errors(profiles: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(key, error, held) of profiles whose header is fit: what is wrong with their tag table, or the tags by name."""
    sizes = profiles.select(key, F.length(data).alias("_size"), (132 + 12 * unsigned(F.col(data), 128)).alias("_table"))
    rows = tags(profiles, key, data).join(sizes, key)
    stored = (F.col("offset") < F.col("_table")) | (F.col("offset") % 4 != 0) | (F.col("length") < 8) | (F.col("offset") + F.col("length") > F.col("_size"))
    again = F.row_number().over(W.partitionBy(key, "name").orderBy("place")) > 1
    before = F.lag(F.struct("offset", "length")).over(W.partitionBy(key).orderBy("offset", "length"))
    # Tags with one and the same storage follow each other; only other neighbours can overlap.
    overlap = (before["offset"] + before["length"] > F.col("offset")) & ((before["offset"] != F.col("offset")) | (before["length"] != F.col("length")))
    marked = rows.withColumns({"fault": F.when(stored, STORAGE).when(again, UNIQUE), "overlap": F.coalesce(overlap, F.lit(False)), "table": F.col("name").rlike("^(A2B|B2A|D2B|B2D)|^cicp$")})
    one = marked.groupBy(key).agg(F.min(F.when(F.col("fault").isNotNull(), F.struct("place", "fault")))["fault"].alias("fault"), F.max("overlap").alias("overlap"), F.max("table").alias("table"), F.collect_list(F.struct("name", "offset", "length")).alias("held"))  # MOST_TAGS
    return one.select(key, F.coalesce("fault", F.when(F.col("overlap"), OVERLAP), F.when(F.col("table"), TABLES)).alias("error"), "held")


def _tag(name: str) -> Column:
    return F.get(F.filter("held", lambda t: t["name"] == name), F.lit(0))


def _xyz_faults(data: Column, name: str) -> list[tuple[Column, str]]:
    tag = F.col(f"_{name}")
    at = tag["offset"]
    large = [F.abs(fixed(data, at + 8 + 4 * i)) > 4 for i in range(3)]
    return [(tag.isNull(), REQUIRED.format(name)), ((tag["length"] != 20) | (signature(data, at) != "XYZ ") | (unsigned(data, at + 4) != 0), SINGLE), (large[0] | large[1] | large[2], BOUNDS)]


def _curve_faults(data: Column, name: str) -> list[tuple[Column, str]]:
    """Of a curve's storage and parameters; those of its values follow."""
    tag = F.col(f"_{name}")
    at, length = tag["offset"], tag["length"]
    kind, count, function = signature(data, at), unsigned(data, at + 8), unsigned(data, at + 8, 2)
    sampled, parametric = kind == "curv", kind == "para"
    falls = F.exists(F.zip_with(F.slice(F.col(f"_s{name}"), 1, F.size(f"_s{name}") - 1), F.slice(F.col(f"_s{name}"), 2, F.size(f"_s{name}")), lambda a, b: b < a), lambda x: x)
    gamma = unsigned(data, at + 12, 2) / 256.0
    many = F.get(F.array(*map(F.lit, PARAMETERS)), function.cast("int"))
    p = F.col(f"_p{name}")
    undefined = (p[0] <= 0) | (p[0] > 16) | F.exists(p, lambda v: F.abs(v) > 16) | ((function > 0) & (p[1] <= 0)) | ((function >= 3) & ((p[4] < 0) | (p[4] > 1) | (p[3] < 0) | (p[1] * p[4] + p[2] < -1e-12)))
    return [
        (tag.isNull(), REQUIRED.format(name)), ((length < 12) | (unsigned(data, at + 4) != 0), CURVE_HEADER), (sampled & ((count > MOST_SAMPLES) | (12 + 2 * count != length)), SAMPLES),
        (sampled & (count == 1) & ((gamma <= 0) | (gamma > 16)), GAMMA), (sampled & (count > 1) & falls, RISING),
        (parametric & ((function > 4) | (unsigned(data, at + 10, 2) != 0) | (length != 12 + 4 * F.coalesce(many, F.lit(0)))), STORED), (parametric & undefined, DEFINED), (~sampled & ~parametric, CURVE_TYPE),
    ]


def _with_curve(rows: DataFrame, data: Column, name: str) -> DataFrame:
    """Adds the curve's samples, its parameters (as many as 7), its error, and its values at the 256 inputs where nothing was wrong before it;
    a curve in the same storage as the one before has the same values."""
    tag = F.col(f"_{name}")
    at, length = tag["offset"], tag["length"]
    kind, count = signature(data, at), unsigned(data, at + 8)
    fits = (kind == "curv") & (count >= 1) & (count <= MOST_SAMPLES) & (12 + 2 * count == length)
    samples = F.when(fits, F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: unsigned(data, at + 12 + 2 * i, 2))).otherwise(F.array().cast("array<bigint>"))
    parameters = F.array(*[F.when(12 + 4 * (i + 1) <= length, fixed(data, at + 12 + 4 * i)).otherwise(F.lit(0.0)) for i in range(7)])
    function = unsigned(data, at + 8, 2)
    rows = rows.withColumns({f"_s{name}": samples, f"_p{name}": F.when(kind == "para", parameters).otherwise(F.array(*[F.lit(1.0)] * 7)), f"_f{name}": F.when(kind == "para", function).otherwise(F.lit(-1))})
    s, p, f = F.col(f"_s{name}"), F.col(f"_p{name}"), F.col(f"_f{name}")

    def value(i: Column) -> Column:
        x = i / F.lit(255.0)
        place = x * (F.size(s) - 1)
        low = F.floor(place).cast("int")
        high = F.least(low + 1, F.size(s) - 1)
        line = ((1 - (place - low)) * F.get(s, low) + (place - low) * F.get(s, high)) / 65535.0
        sampled = F.when(F.size(s) >= 2, line).otherwise(F.pow(x, F.when(F.size(s) == 1, F.get(s, F.lit(0)) / 256.0).otherwise(F.lit(1.0))))
        powered = F.pow(F.greatest(F.lit(0.0), p[1] * x + p[2]), p[0])
        begins = x >= F.when(p[1] != 0, -p[2] / p[1]).otherwise(F.lit(0.0))
        told = (
            F.when(f == 0, F.pow(x, p[0])).when(f == 1, F.when(begins, powered).otherwise(F.lit(0.0))).when(f == 2, F.when(begins, powered + p[3]).otherwise(p[3]))
            .when(f == 3, F.when(x >= p[4], powered).otherwise(p[3] * x)).otherwise(F.when(x >= p[4], powered + p[5]).otherwise(p[3] * x + p[6]))
        )
        return F.when(f < 0, sampled).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), told)))

    rows = rows.withColumn(f"_e{name}", F.coalesce("_fault", _first(*_curve_faults(data, name))))
    values = F.transform(F.sequence(F.lit(0), F.lit(255)), value)
    k = CURVES.index(name)
    if k:
        other = F.col(f"_{CURVES[k - 1]}")
        values = F.when((at == other["offset"]) & (length == other["length"]), F.col(f"_c{CURVES[k - 1]}")).otherwise(values)
    rows = rows.withColumn(f"_c{name}", F.when(F.col(f"_e{name}").isNull(), values))
    return rows.withColumn("_fault", F.when(F.col(f"_e{name}").isNotNull(), F.col(f"_e{name}")).otherwise(_first(_value_fault(name))))


def _value_fault(name: str) -> tuple[Column, str]:
    c = F.col(f"_c{name}")
    falls = F.exists(F.zip_with(F.slice(c, 1, 255), F.slice(c, 2, 255), lambda a, b: a > b + 1e-12), lambda x: x)
    odd = F.exists(c, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    return odd | (F.get(c, F.lit(255)) - F.get(c, F.lit(0)) < SAME) | falls, CURVE_VALUES


def _determinant(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def _inverse(m: tuple[float, ...]) -> list[list[float]]:
    import numpy as np

    return np.linalg.inv(np.array(m).reshape(3, 3)).tolist()


def parsed(profiles: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(key, error, matrix, curves, describes_srgb): one row for each of ``profiles`` (key, data), with the first fault, or else the nine
    numbers from linear source to linear sRGB, by rows, and three curves of 256 values."""
    b = F.col(data)
    checked = profiles.select(key, data, header_error(b).alias("_header")).join(tag_errors(profiles, key, data), key, "left")
    names = [*COLORANTS, "wtpt", *CURVES]
    rows = checked.withColumns({f"_{n}": _tag(n) for n in names})
    cells = [fixed(b, F.col(f"_{c}")["offset"] + 8 + 4 * i) for i in range(3) for c in COLORANTS]
    rows = rows.withColumn("_m", F.array(*cells))
    m = F.col("_m")
    off = [F.abs(m[3 * i] + m[3 * i + 1] + m[3 * i + 2] - F.lit(w)) > CLOSE for i, w in enumerate(D50)]
    xyz = [f for n in [*COLORANTS, "wtpt"] for f in _xyz_faults(b, n)]
    early = F.coalesce(F.col("_header"), F.col("error"), _first(*xyz, (off[0] | off[1] | off[2], NORMAL), (F.abs(_determinant(m)) < 0.000001, SINGULAR)))
    rows = rows.withColumn("_fault", early)
    for n in CURVES:
        rows = _with_curve(rows, b, n)
    rows = rows.withColumnRenamed("_fault", "_error")
    back = _inverse(SRGB)
    to_srgb = F.array(*[sum(F.lit(back[i][k]) * m[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)])
    x = lambda i: i / 255.0
    decode = F.array(*[F.lit(x(i) / 12.92 if x(i) <= 0.04045 else ((x(i) + 0.055) / 1.055) ** 2.4) for i in range(256)])
    near = F.forall(F.zip_with(m, F.array(*map(F.lit, SRGB)), lambda a, c: F.abs(a - c) <= 0.0002), lambda v: v)
    for n in CURVES:
        near &= F.forall(F.zip_with(f"_c{n}", decode, lambda a, c: F.abs(a - c) <= SAME), lambda v: v)
    fit = lambda c: F.when(F.col("_error").isNull(), c)
    return rows.select(key, F.col("_error").alias("error"), fit(to_srgb).alias("matrix"), fit(F.array(*[F.col(f"_c{n}") for n in CURVES])).alias("curves"), fit(near).alias("describes_srgb"))


def converted(red: Column, green: Column, blue: Column, matrix: Column, curves: Column) -> list[Column]:
    """A pixel's red, green and blue in sRGB, as bytes: through the profile's curves and matrix, halves rounded away from zero; null without a
    matrix and curves."""
    linear = [F.get(F.get(curves, F.lit(i)), c.cast("int")) for i, c in enumerate((red, green, blue))]
    out = []
    for i in range(3):
        v = sum(F.get(matrix, F.lit(3 * i + j)) * linear[j] for j in range(3))
        v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
        encoded = F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
        out.append(F.when(matrix.isNotNull() & curves.isNotNull(), F.round(255 * encoded).cast("int")))
    return out
