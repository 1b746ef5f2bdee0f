"""How much of each wavelet coefficient's energy falls on a masked region: squared synthesis responses, applied to the mask.

A coefficient's response is the image that it alone makes; for the separable 9/7 wavelet that is a product of a response along
the line and one across it, and so are their squares. The mask's lines are projected on the squared responses along lines, and these
projections, in strips, on those across them: the transposed synthesis, with squared taps. No coefficient is synthesised as an image.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrel.operators import raster, strips

#: Impulses whose responses are made at a time.
IMPULSES = 256


def synthesised(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One level of synthesis along the first axis, of an even origin: the lifting steps undone in turn, ends mirrored."""
    n = len(low) + len(high)
    if n == 1:
        return low.copy()
    s = np.empty((n, *low.shape[1:]))
    s[0::2], s[1::2] = low / raster.K_LOW, high / raster.K_HIGH
    for factor, odd in ((raster.DELTA, 0), (raster.GAMMA, 1), (raster.BETA, 0), (raster.ALPHA, 1)):
        at = np.arange(odd, n, 2)
        before, behind = np.abs(at - 1), np.where(at + 1 < n, at + 1, 2 * (n - 1) - at - 1)
        s[at] -= factor * (s[before] + s[behind])
    return s


def lengths(size: int, level: int) -> list[int]:
    """Of the low bands from the image down to ``level``."""
    out = [size]
    for _ in range(level):
        out.append((out[-1] + 1) // 2)
    return out


def squared_responses(size: int, level: int, high: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each coefficient of a line's band: where its response begins, how long it is, and the squares one after the other."""
    sizes = lengths(size, level)
    many = sizes[-2] - sizes[-1] if high else sizes[-1]
    starts, ends, taps = [], [], []
    for at in range(0, many, IMPULSES):
        own = min(IMPULSES, many - at)
        signal = np.zeros((many, own))
        signal[at + np.arange(own), np.arange(own)] = 1.0
        for k in reversed(range(level)):
            other = sizes[k] - len(signal)
            first = high and k == level - 1
            signal = synthesised(np.zeros((other, own)), signal) if first else synthesised(signal, np.zeros((other, own)))
        present = signal != 0
        starts += present.argmax(axis=0).tolist()
        ends += (size - present[::-1].argmax(axis=0)).tolist()
        taps += [np.square(signal[a:b, i]) for i, (a, b) in enumerate(zip(starts[at:], ends[at:], strict=True))]
    begin = np.array(starts, np.int64)
    return begin, np.array(ends, np.int64) - begin, np.concatenate(taps) if taps else np.zeros(0)


def projected(values: np.ndarray, responses: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums of the last axis' values by each response's squares."""
    begin, size, taps = responses
    if not len(begin):
        return np.zeros((*values.shape[:-1], 0))
    edge = np.cumsum(size) - size
    place = np.repeat(begin - edge, size) + np.arange(len(taps))
    return np.add.reduceat(values[..., place] * taps, edge, axis=-1)


def influence(mask: DataFrame, keys: Sequence[str], channel: str, level: int, high_x: bool, high_y: bool, strip: int = strips.STRIP) -> DataFrame:
    """Lines (keys, y, height, total, share) of a band's coefficients: the energy of each one's response, and that on the mask's pixels.

    ``mask`` has lines of zeros and ones; ``height`` is the band's. Bands without coefficients give no lines.
    """
    keys = list(keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mask.select(*keys).schema.fields)

    def along(batches):  # noqa: ANN001, ANN202
        known: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                line = np.asarray(batch.column(channel)[i].values, np.float64)
                if len(line) not in known:
                    known.clear()
                    known[len(line)] = squared_responses(len(line), level, high_x)
                has = known[len(line)]
                if not len(has[0]):
                    continue
                edge = np.cumsum(has[1]) - has[1]
                columns = [batch.column(k).slice(i, 1) for k in keys] + [batch.column("y").slice(i, 1), batch.column("height").slice(i, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([projected(line, has).tolist()], pa.list_(pa.float64())), pa.array([np.add.reduceat(has[2], edge).tolist()], pa.list_(pa.float64()))], [*keys, "y", "height", "p", "t"])

    lines = mask.select(*keys, "y", "height", channel).mapInArrow(along, f"{schema}, y int, height int, p array<double>, t array<double>")
    # A response of this level reaches no further than so many pixels from its coefficient's place.
    step_size, far = 1 << level, 5 << level
    size = lambda h: lengths(h, level)[-2] - lengths(h, level)[-1] if high_y else lengths(h, level)[-1]
    low = F.col("height")
    for _ in range(level - 1):
        low = F.floor((low + 1) / 2)
    many = F.floor(low / 2) if high_y else F.floor((low + 1) / 2)
    parts = strips.grouped(lines, keys, ["p", "t"], F.floor((F.col("y") - far) / (step_size * strip)), F.floor((F.col("y") + far) / (step_size * strip)), F.ceil(many / strip))
    known: dict[int, tuple] = {}

    def across(row: dict, ys: np.ndarray, block: dict[str, np.ndarray]) -> tuple[int, dict[str, np.ndarray]]:
        if row["height"] not in known:
            known.clear()
            known[row["height"]] = squared_responses(row["height"], level, high_y)
        begin, length, taps = known[row["height"]]
        own = slice(row["strip"] * strip, min((row["strip"] + 1) * strip, len(begin)))
        edge = np.cumsum(length) - length
        some = taps[edge[own.start] : edge[own.stop - 1] + length[own.stop - 1]]
        share = projected(block["p"].T, (begin[own] - ys[0], length[own], some)).T
        total = np.add.reduceat(some, edge[own] - edge[own.start])[:, None] * block["t"][0][None, :]
        return own.start, {"total": total, "share": np.minimum(share, total)}

    return strips.mapped(parts, keys, ["total", "share"], across, size)
