"""Raster operators on whole tiles: a row holds an image part as one array, rows of pixels one after the other.

What is linear in the pixels (transforms, stencils, resampling) is one matrix product for an Arrow batch of tiles; the rest are a few
array steps over the batch. Nothing is shuffled. The matrices are of one tile's size, squared: this is for small tiles such as 8x8; whole
images go by ``strips`` and ``edges``. Tiles of another size, or with nulls, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrel.operators import raster

#: Rows of an Arrow batch that are computed at a time: bounds the arrays of a task.
ROWS = 2048


def map_tiles(tiles: DataFrame, keys: Sequence[str], size: int, out: Sequence[str], step: Callable[[np.ndarray], dict[str, np.ndarray]], value: str = "v") -> DataFrame:
    """(keys, ``out``): ``step`` turns (tiles, size) numbers into an array (tiles, any) for each name of ``out``."""
    schema = tiles.select(*keys).schema
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields] + [f"`{n}` array<double>" for n in out])
    whole = (F.size(value) == size) & F.forall(value, lambda x: x.isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = step(np.asarray(part.column(value).flatten(), dtype=np.float64).reshape(-1, size))
                lists = []
                for n in out:
                    values = np.ascontiguousarray(found[n], dtype=np.float64).reshape(part.num_rows, -1)
                    ends = np.arange(part.num_rows + 1, dtype=np.int32) * values.shape[1]
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1))))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *lists], [*keys, *out])

    return tiles.where(whole).select(*keys, F.col(value).cast("array<double>").alias(value)).mapInArrow(run, ddl)


def linear(tiles: DataFrame, keys: Sequence[str], maps: dict[str, np.ndarray], value: str = "v") -> DataFrame:
    """(keys, one array for each map): products of the matrices with the tiles."""
    size = next(iter(maps.values())).shape[1]
    return map_tiles(tiles, keys, size, list(maps), lambda v: {n: v @ m.T for n, m in maps.items()}, value)


def cells(arrays: DataFrame, keys: Sequence[str], names: Sequence[str], width: int = 8) -> DataFrame:
    """(keys, y, x, names): a row for each cell of the arrays."""
    one = arrays.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("i", "c"))
    return one.select(*keys, F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).alias("x"), *[F.col(f"c.{n}").alias(n) for n in names])


def stencil(kernel: raster.Kernel, height: int = 8, width: int = 8) -> np.ndarray:
    """The matrix of a zero-padded correlation."""
    out = np.zeros((height, width, height, width))
    for dy, dx, w in kernel:
        for y in range(max(0, -dy), min(height, height - dy)):
            for x in range(max(0, -dx), min(width, width - dx)):
                out[y, x, y + dy, x + dx] += w
    return out.reshape(height * width, -1)


def cosine(size: int = 8) -> np.ndarray:
    """The matrix of the orthonormal two-dimensional cosine transform."""
    basis = np.array(raster.cosine_basis(size))
    return np.kron(basis, basis)


def lifting(size: int) -> np.ndarray:
    """The matrix of one 9/7 level along a line of even length: low band, then high band."""
    s = np.eye(size)
    mirror = lambda i: abs(i) if i < size else 2 * (size - 1) - i
    for factor, odd in ((raster.ALPHA, 1), (raster.BETA, 0), (raster.GAMMA, 1), (raster.DELTA, 0)):
        before = s.copy()
        for i in range(odd, size, 2):
            s[i] = before[i] + factor * (before[mirror(i - 1)] + before[mirror(i + 1)])
    return np.concatenate([raster.K_LOW * s[0::2], raster.K_HIGH * s[1::2]])


def lifting_levels(size: int, levels: int) -> np.ndarray:
    """Several levels, each on the low band of the one before."""
    whole = np.eye(size)
    for level in range(levels):
        n = size >> level
        step = np.eye(size)
        step[:n, :n] = lifting(n)
        whole = step @ whole
    return whole


def wavelet(size: int = 8, levels: int = 3) -> np.ndarray:
    """Two-dimensional analysis of a square tile; its inverse is the synthesis."""
    whole = np.eye(size * size)
    for level in range(levels):
        n = size >> level
        one = np.eye(size)
        one[:n, :n] = lifting(n)
        low = np.arange(size) < n
        step = np.kron(one, one)
        outside = ~np.logical_and.outer(low, low).reshape(-1)
        step[outside] = np.eye(size * size)[outside]
        whole = step @ whole
    return whole


def high_part(c: str = "c", size: int = 8, above: int = 2) -> dict[str, object]:
    """Columns high, total and ratio of an array of squared coefficients; those with i + j over ``above`` are high; flat tiles: 0."""
    power = F.transform(c, lambda v: v * v)
    total = F.aggregate(power, F.lit(0.0), lambda a, v: a + v)
    high = F.aggregate(F.filter(power, lambda _, i: F.floor(i / size) + i % size > above), F.lit(0.0), lambda a, v: a + v)
    return {"high": high, "total": total, "ratio": F.coalesce(F.try_divide(high, total), F.lit(0.0))}


def neighbour_steps(v: np.ndarray, height: int = 8, width: int = 8) -> dict[str, np.ndarray]:
    """Mean and largest absolute difference to the up to four neighbours of each pixel; a lone pixel has 0."""
    t = v.reshape(-1, height, width)
    total, most, n = np.zeros_like(t), np.zeros_like(t), np.zeros((height, width))
    for axis in (1, 2):
        d = np.abs(np.diff(t, axis=axis))
        for shift in (0, 1):
            where = [slice(None)] * 3
            where[axis] = slice(shift, t.shape[axis] - 1 + shift)
            total[tuple(where)] += d
            most[tuple(where)] = np.maximum(most[tuple(where)], d)
            n[tuple(where[1:])] += 1
    return {"mean_step": total / np.maximum(n, 1), "max_step": most}


def window_variance(v: np.ndarray, height: int = 8, width: int = 8) -> dict[str, np.ndarray]:
    """Variance over the 3x3 pixels around, clipped at the borders."""
    t = v.reshape(-1, height, width)
    sums = []
    for values in (np.ones((1, height, width)), t, t * t):
        wide = np.pad(values, ((0, 0), (1, 1), (1, 1)))
        sums.append(sum(wide[:, 1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width] for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    n, s, q = sums
    return {"variance": np.maximum(q / n - (s / n) ** 2, 0)}


def _shifted(t: np.ndarray, dy: int, dx: int, fill: float) -> np.ndarray:
    """Each cell's neighbour at (dy, dx)."""
    height, width = t.shape[1:]
    wide = np.pad(t, ((0, 0), (1, 1), (1, 1)), constant_values=fill)
    return wide[:, 1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width]


_FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))
_EIGHT = (*_FOUR, (-1, -1), (-1, 1), (1, -1), (1, 1))


def grow(open_: np.ndarray, seeds: np.ndarray, eight: bool = False) -> np.ndarray:
    """The open cells that are tied to an open seed, in tiles (n, height, width) of any size: grown until nothing changes."""
    have = open_ & seeds
    while True:
        more = have.copy()
        for dy, dx in _EIGHT if eight else _FOUR:
            more |= _shifted(have, dy, dx, False)
        more &= open_
        if (more == have).all():
            return have
        have = more


def labels(open_: np.ndarray) -> np.ndarray:
    """For each open cell the least cell number of its eight-connected component, -1 elsewhere; tiles of any size."""
    n, height, width = open_.shape
    far = height * width
    now = np.where(open_, np.arange(far).reshape(height, width), far)
    while True:
        least = now
        for dy, dx in _EIGHT:
            least = np.minimum(least, _shifted(now, dy, dx, far))
        least = np.where(open_, least, far)
        if (least == now).all():
            return np.where(open_, now, -1)
        now = least


def thin(gx: np.ndarray, gy: np.ndarray, least: float) -> np.ndarray:
    """Magnitudes that are not under either neighbour's along the gradient, in one of four directions, and at least ``least``; 0
    elsewhere and where a neighbour lies outside."""
    m = np.sqrt(gx * gx + gy * gy)
    turn = np.mod(np.degrees(np.arctan2(gy, gx)), 180.0)
    way = np.where((turn < 22.5) | (turn >= 157.5), 0, np.where(turn < 67.5, 1, np.where(turn < 112.5, 2, 3)))
    keep = m >= least
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        own = (m >= _shifted(m, dy, dx, np.inf)) & (m >= _shifted(m, -dy, -dx, np.inf))
        keep &= (way != k) | own
    return np.where(keep, m, 0.0)


def canny(v: np.ndarray, blur: np.ndarray, low: float, high: float, height: int = 8, width: int = 8) -> dict[str, np.ndarray]:
    """Edges of tiles: blur, gradients, thinning, edges tied to strong ones, components. ``edge``: the magnitude or 0; ``segment``:
    the least cell number of an edge's component, -1 for none or one of less than three pixels."""
    smooth = v @ blur.T
    gx, gy = (smooth @ stencil(k, height, width).T for k in (raster.SOBEL_X, raster.SOBEL_Y))
    m = thin(gx.reshape(-1, height, width), gy.reshape(-1, height, width), low)
    kept = grow(m >= low, m >= high, eight=True)
    found = labels(kept)
    count = np.zeros((len(v), height * width + 1), np.int64)
    np.add.at(count, (np.arange(len(v))[:, None], found.reshape(len(v), -1)), 1)
    long = np.take_along_axis(count, found.reshape(len(v), -1), axis=1).reshape(found.shape) >= 3
    return {"edge": np.where(kept, m, 0.0), "segment": np.where(kept & long, found, -1)}


def bicubic(height: int, width: int, out_height: int, out_width: int, affine: Sequence[float], a: float = -0.5) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of a bicubic resampling through an output-to-source map (row vectors), weights of the taps on the image adding up to 1,
    and which output cells lie outside of the source."""

    def weight(t: float) -> float:
        t = abs(t)
        return (a + 2) * t**3 - (a + 3) * t**2 + 1 if t <= 1 else a * (t**3 - 5 * t**2 + 8 * t - 4) if t < 2 else 0.0

    out, outside = np.zeros((out_height * out_width, height * width)), np.zeros(out_height * out_width, bool)
    for i in range(out_height * out_width):
        oy, ox = divmod(i, out_width)
        x, y = affine[0] * ox + affine[2] * oy + affine[4], affine[1] * ox + affine[3] * oy + affine[5]
        if not (0 <= x <= width - 1 and 0 <= y <= height - 1):
            outside[i] = True
            continue
        fx, fy = int(np.floor(x)), int(np.floor(y))
        taps = [(yy * width + xx, weight(x - xx) * weight(y - yy)) for yy in range(fy - 1, fy + 3) for xx in range(fx - 1, fx + 3) if 0 <= xx < width and 0 <= yy < height]
        total = sum(w for _, w in taps)
        for k, w in taps:
            out[i, k] += w / total
    return out, outside


def needed(mask: np.ndarray, levels: int = 1, size: int = 8) -> np.ndarray:
    """Coefficients of the 9/7 analysis along lines that any pixel of a region needs to be made again."""
    support = np.abs(np.linalg.inv(lifting_levels(size, levels))) > 1e-12
    return (mask.reshape(-1, size).astype(int) @ support.astype(int) > 0).reshape(len(mask), -1)
