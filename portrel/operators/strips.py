"""Whole images of any size as lines, and what needs several of them as strips of lines with halos.

An image is a relation of lines: (keys, y, height, and an array of the line's values for each channel). What a line decides alone is
an array expression. What needs lines above and below is computed in strips: each line goes to every strip that needs it (``grouped``,
one shuffle), and a task holds one strip and its halo, never an image. Strips give out lines again, so operators follow each
other. The lines of an image are as long as its first; an image without lines gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that a strip gives out.
STRIP = 32

Step = Callable[[dict, np.ndarray, dict[str, np.ndarray]], tuple[int, dict[str, np.ndarray]]]


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the cluster names in spark.checkpoint.dir: several plans read it, and lost executors don't lose it.
    Where no folder is named, in local mode only, it is one under the warehouse."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints")
    return df.checkpoint()


def matched(rows: DataFrame, others: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join of lines, or of points on them. Both sides are shuffled and sorted: Spark takes an array for a single value when it estimates a size,
    so it would send lines that it takes for small through the driver to all executors."""
    return rows.join(others.hint("merge"), list(on), how)


def told(rows: DataFrame, images: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Lines, or points on them, with what ``images`` (a row each) says of their image. Both are shuffled, and a task holds its images' rows."""
    return rows.join(images.hint("shuffle_hash"), list(keys), how)


def lines(pixels: DataFrame, keys: Sequence[str], channels: Sequence[str], height: str = "height") -> DataFrame:
    """Lines of the pixels (keys, y, x, height, channels)."""
    one = pixels.groupBy(*keys, "y", height).agg(F.sort_array(F.collect_list(F.struct("x", *channels))).alias("_line"))
    return one.select(*keys, "y", F.col(height).alias("height"), *map(_channel, channels))


def _channel(c: str) -> Column:
    return F.transform("_line", lambda p: p[c].cast("double")).alias(c)


def cells(image: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """(keys, y, x, channels): a row for each pixel."""
    one = image.select(*keys, "y", F.posexplode(F.arrays_zip(*channels)).alias("x", "_p"))
    return one.select(*keys, "y", "x", *[F.col(f"_p.{c}").alias(c) for c in channels])


def grouped(image: DataFrame, keys: Sequence[str], channels: Sequence[str], first: Column, last: Column, strips: Column) -> DataFrame:
    """(keys, strip, height, block): each line in the strips from ``first`` to ``last`` that need it, of the ``strips`` that there are."""
    own = F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(last, strips - 1).cast("int"))
    dealt = image.where((first < strips) & (last >= 0) & (strips > 0)).select(*keys, "height", "y", *channels, F.explode(own).alias("strip"))
    return dealt.groupBy(*keys, "strip").agg(F.first("height").alias("height"), F.sort_array(F.collect_list(F.struct("y", *channels))).alias("block"))


def mapped(strips: DataFrame, keys: Sequence[str], out: Sequence[str], step: Step, height: Callable[[int], int] = lambda h: h) -> DataFrame:
    """Lines (keys, y, height, out) of what ``step(row, ys, block)`` makes of each strip: its first line's number and an array (lines,
    width) for each name. ``block`` has the given lines ``ys`` of each channel, without those of a number below zero; ``row`` the keys, strip and height."""
    schema = strips.select(*keys).schema
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields] + ["y int, height int"] + [f"`{n}` array<double>" for n in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("block")
            ends = np.asarray(held.offsets)
            fields = held.type.value_type
            about = batch.select(list(dict.fromkeys([*keys, "strip", "height"]))).to_pylist()
            for i, row in enumerate(about):
                some = held.values.slice(ends[i], ends[i + 1] - ends[i])
                ys = np.asarray(some.field(0))
                if len(ys) and ys[0] < 0:  # a mark that the strip is there, without values
                    ys = ys[1:]
                block = {fields[k].name: np.asarray(some.field(k).flatten(), np.float64).reshape(len(ys), -1 if len(ys) else 0) for k in range(1, fields.num_fields)}
                begin, found = step(row, ys, block)
                many = len(found[out[0]])
                if not many:
                    continue
                columns = [pa.array([row[k]] * many, batch.column(k).type) for k in keys]
                columns += [pa.array(np.arange(begin, begin + many, dtype=np.int32)), pa.array(np.full(many, height(row["height"]), np.int32))]
                for n in out:
                    values = np.ascontiguousarray(found[n], np.float64)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) * values.shape[1]), pa.array(values.reshape(-1))))
                yield pa.RecordBatch.from_arrays(columns, [*keys, "y", "height", *out])

    return strips.mapInArrow(run, ddl)


def with_halo(image: DataFrame, keys: Sequence[str], channels: Sequence[str], out: Sequence[str], halo: int, step: Callable[[dict[str, np.ndarray], int, int], dict[str, np.ndarray]], strip: int = STRIP) -> DataFrame:
    """Lines that ``step(block, above, below)`` makes of each strip's lines with up to ``halo`` lines on both sides. It gives the
    same number of lines; ``above`` and ``below`` say how many of the halo's are there (fewer only at the image's borders)."""
    y = F.col("y")
    parts = grouped(image, keys, channels, F.floor((y - halo) / strip), F.floor((y + halo) / strip), F.ceil(F.col("height") / strip))

    def own(row: dict, ys: np.ndarray, block: dict[str, np.ndarray]) -> tuple[int, dict[str, np.ndarray]]:
        begin = row["strip"] * strip
        end = min(begin + strip, row["height"])
        above, below = begin - int(ys[0]), int(ys[-1]) + 1 - end
        found = step(block, above, below)
        return begin, {n: found[n][above : above + end - begin] for n in out}

    return mapped(parts, keys, out, own)


def _filled(values: np.ndarray, radius: int, above: int, below: int, mode: str, **how: object) -> np.ndarray:
    """The block with as many lines added at the image's borders as its halo lacks."""
    return np.pad(values, ((radius - min(above, radius), radius - min(below, radius)), (0, 0)), mode=mode, **how)


def gaussian(sigma: float) -> np.ndarray:
    """A normalised kernel that reaches three sigmas."""
    radius = int(np.ceil(3 * sigma))
    weights = np.exp(-((np.arange(-radius, radius + 1) / sigma) ** 2) / 2)
    return weights / weights.sum()


def convolved(values: np.ndarray, kernel: np.ndarray, above: int, below: int) -> np.ndarray:
    """A symmetric kernel along lines and across them; borders are reflected without repeating them."""
    radius = len(kernel) // 2
    wide = np.pad(values, ((0, 0), (radius, radius)), mode="reflect")
    along = sum(w * wide[:, k : k + values.shape[1]] for k, w in enumerate(kernel))
    tall = _filled(along, radius, above, below, "reflect")
    inner = len(values) - min(above, radius) - min(below, radius)
    out = sum(w * tall[k : k + inner] for k, w in enumerate(kernel))
    return np.concatenate([np.zeros((min(above, radius), values.shape[1])), out, np.zeros((min(below, radius), values.shape[1]))])


def blurred(image: DataFrame, keys: Sequence[str], channels: dict[str, str], sigma: float, strip: int = STRIP) -> DataFrame:
    """Lines of the blurred ``channels`` (new name: channel)."""
    kernel = gaussian(sigma)
    return with_halo(image, keys, sorted(set(channels.values())), list(channels), len(kernel) // 2, lambda b, above, below: {n: convolved(b[c], kernel, above, below) for n, c in channels.items()}, strip)


def sliding_least(values: np.ndarray, width: int, axis: int) -> np.ndarray:
    """Least of each ``width`` values that follow each other, by doubling."""
    take = lambda v, a, b: v[a : len(v) - b] if axis == 0 else v[:, a : v.shape[1] - b]
    have = 1
    while have * 2 <= width:
        values = np.minimum(take(values, 0, have), take(values, have, 0))
        have *= 2
    rest = width - have
    return np.minimum(take(values, 0, rest), take(values, rest, 0)) if rest else values


def eroded(image: DataFrame, keys: Sequence[str], channel: str, radius: int, out: str = "eroded", strip: int = STRIP) -> DataFrame:
    """Grey erosion: the least value of the square of ``radius`` around each pixel; outside the image all is zero."""
    width = 2 * radius + 1

    def step(block: dict[str, np.ndarray], above: int, below: int) -> dict[str, np.ndarray]:
        values = block[channel]
        along = sliding_least(np.pad(values, ((0, 0), (radius, radius))), width, 1)
        tall = _filled(along, radius, above, below, "constant")
        found = sliding_least(tall, width, 0)
        empty = np.zeros((1, values.shape[1]))
        return {out: np.concatenate([np.repeat(empty, min(above, radius), 0), found, np.repeat(empty, min(below, radius), 0)])}

    return with_halo(image, keys, [channel], [out], radius, step, strip)


def slopes(image: DataFrame, keys: Sequence[str], channel: str, strip: int = STRIP) -> DataFrame:
    """Lines of ``dy`` and ``dx``: half the difference of the two neighbours, at a border the whole difference to the one there is."""

    def step(block: dict[str, np.ndarray], above: int, below: int) -> dict[str, np.ndarray]:
        along = [np.gradient(block[channel], axis=a) if block[channel].shape[a] > 1 else np.zeros_like(block[channel]) for a in (0, 1)]
        return {"dy": along[0], "dx": along[1]}

    return with_halo(image, keys, [channel], ["dy", "dx"], 1, step, strip)


def sampled(image: DataFrame, points: DataFrame, keys: Sequence[str], channels: Sequence[str], also: Sequence[str]) -> DataFrame:
    """(keys, also, channels): the ``points`` (keys, also, px, py) with the values between pixels, from the four around; points outside are moved to the border.

    Points of a line are gathered and meet the two lines around them, once each; no pixel becomes a row.
    """
    about = image.where("y = 0").select(*keys, "height", F.size(channels[0]).alias("_width"))
    inside = lambda c, size: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(size) - 1.000001)
    placed = told(points, about, keys).withColumn("_x", inside("px", "_width")).withColumn("_y", inside("py", "height"))
    held = placed.groupBy(*keys, F.floor("_y").cast("int").alias("_line")).agg(F.collect_list(F.struct("_x", "_y", *also)).alias("_points"))
    low = image.select(*keys, F.col("y").alias("_line"), *[F.col(c).alias(f"_low_{c}") for c in channels])
    high = image.select(*keys, (F.col("y") - 1).alias("_line"), *[F.col(c).alias(f"_high_{c}") for c in channels])
    both = matched(matched(held, low, [*keys, "_line"]), high, [*keys, "_line"])

    def value(c: str):  # noqa: ANN202
        def at(p: Column) -> Column:
            left = F.floor(p["_x"]).cast("int")
            fx, fy = p["_x"] - left, p["_y"] - F.col("_line")
            line = lambda side: (1 - fx) * F.get(F.col(f"_{side}_{c}"), left) + fx * F.get(F.col(f"_{side}_{c}"), left + 1)
            return ((1 - fy) * line("low") + fy * line("high")).alias(c)

        return at

    made = F.transform("_points", lambda p: F.struct(*[p[a].alias(a) for a in also], *[value(c)(p) for c in channels]))
    return both.select(*keys, F.explode(made).alias("_p")).select(*keys, "_p.*")


def crossings(line: Column) -> Column:
    """Places between neighbours of an array where its values pass through zero, ascending."""
    pairs = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    told = F.transform(pairs, lambda p, i: F.when((p["a"] * p["b"] <= 0) & (F.abs(p["b"] - p["a"]) > 1e-9), i - p["a"] / (p["b"] - p["a"])))
    return F.filter(told, lambda x: x.isNotNull())
