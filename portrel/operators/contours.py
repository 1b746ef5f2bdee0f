"""Contours of garment edges in whole images, and how a candidate's differ from its source's.

A contour is a relation (keys, side, y, position): where red minus green, slightly blurred, passes through zero on each line of a
region, left (side 0) and right (side 1) of its centre column. A source's contour takes the crossing next to the centre; a
candidate's takes the one nearest to the source's, within a radius. A line without one has a null position.

The region of an image is given in columns ``first_row``, ``last_row`` and ``center`` of its lines' ``regions`` (keys, these).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from portrel.operators import strips

#: Fixed values of the measurement: blurs of the opponent channel, of colours, along a contour and of chroma; search radius; the places along a
#: normal and how many at its ends make its levels; how far overshoot counts; clothing's least contrast and border, weights of luminance.
OPPONENT, SMOOTH, ALONG, CHROMA = 0.65, 0.8, 2.0, 3.0
RADIUS = 8
REACH, PLACES, ENDS = 12.0, 97, 12
HALO_REACH = 6.0
CLOTHING, BORDER, ABOVE_REGION = 20.0, 8, 30
LUMA = (0.2126, 0.7152, 0.0722)
RGB = ("r", "g", "b")
LEAST_ROWS, LEAST_INTERIOR, LEAST_SEAMS = 13, 100, 10


def opponent(image: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines of red minus green, blurred."""
    plain = image.withColumn("o", F.zip_with("r", "g", lambda r, g: r - g))
    return strips.blurred(plain, keys, {"o": "o"}, OPPONENT)


def contours(image: DataFrame, regions: DataFrame, keys: Sequence[str], anchors: DataFrame | None = None, radius: float = RADIUS) -> DataFrame:
    """(keys, side, y, position) of each line of the regions; ``anchors`` are such contours, and each of their lines comes out."""
    found = strips.told(opponent(image, keys), regions, keys).where(F.col("y").between(F.col("first_row"), F.col("last_row")))
    found = found.select(*keys, "y", "center", strips.crossings(F.col("o")).alias("at"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.filter("at", f).alias("at")) for s, f in enumerate((lambda x: x < F.col("center"), lambda x: x > F.col("center")))])).alias("s")
    told = found.select(*keys, "y", sides).select(*keys, F.col("s.side").alias("side"), "y", F.col("s.at").alias("at"))
    if anchors is None:
        return told.select(*keys, "side", "y", F.when(F.col("side") == 0, F.array_max("at")).otherwise(F.array_min("at")).alias("position"))
    near = F.filter(F.transform("at", lambda x: F.struct(F.abs(x - F.col("anchor")).alias("far"), x.alias("x"))), lambda c: c["far"] <= radius)
    tied = strips.matched(anchors.withColumnRenamed("position", "anchor"), told, [*keys, "side", "y"], "left")
    return tied.select(*keys, "side", "y", F.array_min(near)["x"].alias("position"))


def profiles(contour: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side, y, k, px, py): ``PLACES`` points along the normal of each line's contour."""
    w = W.partitionBy(*keys, "side").orderBy("y")
    before, behind, own = F.lag("position").over(w), F.lead("position").over(w), F.col("position")
    slope = F.when(before.isNull(), behind - own).when(behind.isNull(), own - before).otherwise((behind - before) / 2)
    turned = contour.withColumn("slope", slope).withColumn("nx", 1 / F.sqrt(1 + F.col("slope") * F.col("slope"))).withColumn("ny", -F.col("slope") * F.col("nx"))
    at = turned.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
    offset = offset_of(F.col("k"))
    return at.select(*keys, "side", "y", "k", (F.col("position") + F.col("nx") * offset).alias("px"), (F.col("y") + F.col("ny") * offset).alias("py"))


def offset_of(k: Column) -> Column:
    return k * (2 * REACH / (PLACES - 1)) - REACH


def _mean(values: Column, begin: int, size: int) -> Column:
    return F.aggregate(F.slice(values, begin, size), F.lit(0.0), lambda a, x: a + x) / size


def ends_of(values: Column) -> tuple[Column, Column]:
    """Mean levels at a profile's two ends."""
    return _mean(values, 1, ENDS), _mean(values, PLACES - ENDS + 1, ENDS)


def with_width(rows: DataFrame, profile: str, out: str) -> DataFrame:
    """Adds how far the places nearest to the middle lie apart at which a profile has gone 10 and 90 percent of its way; null without
    both. The steps are columns of their own, so that no lambda computes them again for each place."""
    low, high = ends_of(F.col(profile))
    way = F.col("_high") - F.col("_low")
    steps = rows.withColumns({"_low": low, "_high": high}).withColumn("_way", F.when(F.abs(way) > 1e-9, way).otherwise(F.lit(1.0)))
    steps = steps.withColumns({f"_at{i}": _less(profile, level) for i, level in enumerate((0.1, 0.9))})
    steps = steps.withColumns({f"_hit{i}": strips.crossings(F.col(f"_at{i}")) for i in (0, 1)})
    near = [F.array_min(F.transform(f"_hit{i}", lambda p: F.struct(F.abs(offset_of(p)).alias("far"), offset_of(p).alias("o"))))["o"] for i in (0, 1)]
    return steps.withColumn(out, F.abs(near[1] - near[0])).drop("_low", "_high", "_way", "_at0", "_at1", "_hit0", "_hit1")


def _less(profile: str, level: float) -> Column:
    return F.transform(profile, lambda v: (v - F.col("_low")) / F.col("_way") - level)


def sampled_profiles(image: DataFrame, points: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """(keys, side, y, r, g, b): the colours along each profile as arrays."""
    values = strips.sampled(image, points, keys, RGB, ["side", "y", "k"])
    held = values.groupBy(*keys, "side", "y").agg(F.sort_array(F.collect_list(F.struct("k", *RGB))).alias("_p"))  # PLACES of each
    return held.select(*keys, "side", "y", *[F.transform("_p", lambda p: p[c]).alias(prefix + c) for c in RGB])


def _minus(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _luma(prefix: str = "") -> Column:
    two = F.zip_with(prefix + "r", prefix + "g", lambda r, g: LUMA[0] * r + LUMA[1] * g)
    return F.zip_with(two, prefix + "b", lambda a, b: a + LUMA[2] * b)


def _high_pass(values: Column) -> Column:
    """Values along a contour less their blurred course; the ends are reflected."""
    kernel = strips.gaussian(ALONG)
    radius, last = len(kernel) // 2, F.size(values) - 1
    weights = F.array(*map(F.lit, kernel.tolist()))

    def rest(v: Column, i: Column) -> Column:
        place = lambda j: last - F.abs(last - F.abs(j))  # noqa: E731  reflected; a contour is longer than the kernel's half
        course = F.aggregate(F.sequence(F.lit(-radius), F.lit(radius)), F.lit(0.0), lambda a, d: a + F.get(weights, d + radius) * F.get(values, place(i + d)))
        return v - course

    return F.transform(values, rest)


def clothing(source: DataFrame, regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, y, height, interior, seams, smooth gradients ``dy`` and ``dx``): lines of the garment's pixels away from its border, and of those that lie on
    a seam or fold: the steepest tenth of them."""
    smooth = strips.kept(strips.blurred(source, keys, {c: c for c in RGB}, SMOOTH))
    green = strips.told(smooth, regions, keys).withColumn("cloth", F.zip_with("r", "g", lambda r, g: F.when((g - r > CLOTHING) & (F.col("y") >= F.col("first_row") - ABOVE_REGION), 1.0).otherwise(0.0)))
    interior = strips.eroded(green, keys, "cloth", BORDER, "interior")
    steep = strips.slopes(smooth.select(*keys, "y", "height", _luma().alias("l")), keys, "l")
    both = strips.matched(steep, interior.drop("height"), [*keys, "y"])
    both = strips.kept(both.withColumn("steep", F.zip_with("dy", "dx", lambda a, b: F.sqrt(a * a + b * b))))
    inside = strips.cells(both, keys, ["steep", "interior"]).where("interior > 0")
    level = inside.groupBy(*keys).agg(F.greatest(F.lit(0.5), F.percentile("steep", F.lit(0.9))).alias("level"))
    marked = strips.told(both, level, keys, "left").withColumn("seams", F.zip_with("interior", "steep", lambda i, s: F.when((i > 0) & (s >= F.col("level")), 1.0).otherwise(0.0)))
    return marked.select(*keys, "y", "height", "interior", "seams", "dy", "dx")


def rms(c: Column) -> Column:
    """Root mean square; null as soon as one value is null."""
    return F.when(F.count(F.lit(1)) == F.count(c), F.sqrt(F.avg(c * c)))


def reference(source: DataFrame, regions: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What a source gives to measure by: (keys, error), null where it is fit, its contours, the colours along their profiles, and its
    ``clothing``; all of them are checkpoints."""
    contour = strips.kept(contours(source, regions, keys))
    points = profiles(contour, keys)
    about = source.where("y = 0").select(*keys, "height", F.size("r").alias("width"))
    fits = regions.join(about, list(keys), "left").withColumn("fits", (F.col("first_row") >= 0) & (F.col("first_row") < F.col("last_row")) & (F.col("last_row") < F.col("height")) & (F.col("center") > 0) & (F.col("center") < F.col("width")))
    missing = contour.groupBy(*keys).agg(F.max(F.col("position").isNull()).alias("missing"))
    out = strips.told(points, about, keys).groupBy(*keys).agg(F.max((F.col("px") < 0) | (F.col("px") >= F.col("width") - 1) | (F.col("py") < 0) | (F.col("py") >= F.col("height") - 1)).alias("outside"))
    told = strips.kept(sampled_profiles(source, points, keys))
    contrast = sum((ends_of(F.col(c))[1] - ends_of(F.col(c))[0]) ** 2 for c in RGB)
    edges = with_width(told.withColumn("_o", _minus("r", "g")), "_o", "wide").groupBy(*keys).agg(F.max(F.sqrt(contrast) <= 1e-9).alias("flat"), F.max(F.col("wide").isNull()).alias("open"))
    cloth = strips.kept(clothing(source, regions, keys))
    total = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda a, x: a + x)).cast("long").alias(c)
    areas = cloth.groupBy(*keys).agg(total("interior"), total("seams"))
    joined = fits
    for more in (missing, out, edges, areas):
        joined = joined.join(more, list(keys), "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(True))
    error = (
        F.when(~F.coalesce(F.col("fits"), F.lit(False)), "Neckline rows and center must fit the source.").when(F.col("last_row") - F.col("first_row") < LEAST_ROWS - 1, "Neckline measurements require at least 13 consecutive source rows.")
        .when(yes("missing"), "The source neckline needs a reviewed region or different color-boundary model.").when(yes("outside"), "Normal edge profiles require complete source-pixel support.")
        .when(yes("flat"), "Every source edge profile requires positive RGB contrast.").when(yes("open"), "The source neckline needs complete 10%-90% transition support.")
        .when(F.coalesce("interior", F.lit(0)) < LEAST_INTERIOR, "The source clothing region is too small for the color-detail measurement.").when(F.coalesce("seams", F.lit(0)) < LEAST_SEAMS, "Source clothing has insufficient measured seam/fold gradient support.")
    )
    return strips.kept(joined.select(*keys, error.alias("error"), F.col("interior").alias("interior_pixels"), F.col("seams").alias("seam_pixels"))), contour, told, cloth


def measured(source: DataFrame, candidate: DataFrame, regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row of metrics for each source: what is wrong with it (``error``), or how the candidate's edges and clothing differ from its own."""
    keys = list(keys)
    state, contour, own, cloth = reference(source, regions, keys)
    good = state.where("error is null").select(*keys)
    contour, source = strips.told(contour, good, keys), strips.told(source, good, keys)
    actual = strips.kept(contours(candidate, regions, keys, contour))
    both = strips.matched(contour, actual.withColumnRenamed("position", "now"), [*keys, "side", "y"]).withColumn("off", F.col("now") - F.col("position"))
    lost = F.count(F.lit(1)) - F.count("off")
    places = both.groupBy(*keys).agg(lost.alias("missing_rows"), F.count(F.lit(1)).alias("samples"), rms(F.col("off")).alias("position_rms"), F.when(lost == 0, F.percentile(F.abs("off"), F.lit(0.95))).alias("position_p95"))
    course = both.groupBy(*keys, "side").agg(F.sort_array(F.collect_list(F.struct("y", "off"))).alias("c"))  # a line each
    rough = course.where(~F.exists("c", lambda p: p["off"].isNull())).select(*keys, F.explode(_high_pass(F.transform("c", lambda p: p["off"]))).alias("v"))
    rough = rough.groupBy(*keys).agg(rms(F.col("v")).alias("rough"))

    points = profiles(contour, keys)
    pair = strips.matched(strips.told(own, good, keys), sampled_profiles(candidate, points, keys, "c_"), [*keys, "side", "y"])
    gap = lambda c: (ends_of(F.col(c))[1] - ends_of(F.col(c))[0])
    contrast = F.sqrt(sum((gap("c_" + c) - gap(c)) ** 2 for c in RGB)) / F.sqrt(sum(gap(c) ** 2 for c in RGB))
    squares = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    pair = with_width(with_width(pair.withColumns({"_o": _minus("r", "g"), "_c": _minus("c_r", "c_g")}), "_o", "_was"), "_c", "_is")
    wide = F.col("_is") - F.col("_was")
    over = F.transform("c_l", lambda v, k: F.when(F.abs(offset_of(k)) <= HALO_REACH, F.greatest(F.col("_least") - v, F.lit(0.0)) + F.greatest(v - F.col("_most"), F.lit(0.0))).otherwise(0.0))
    near = sum(abs(-REACH + k * 2 * REACH / (PLACES - 1)) <= HALO_REACH for k in range(PLACES))
    pair = pair.withColumns({"l": _luma(), "c_l": _luma("c_")}).withColumns({"_least": F.array_min("l"), "_most": F.array_max("l")}).select(*keys, wide.alias("wide"), contrast.alias("contrast"), sum(squares(_minus("c_" + c, c)) for c in RGB).alias("profile"), squares(over).alias("over"))
    mean_root = lambda c, n: F.sqrt(F.sum(c) / (F.count(F.lit(1)) * n))
    edges = pair.groupBy(*keys).agg(rms(F.col("wide")).alias("width_rms"), (F.count(F.lit(1)) - F.count("wide")).alias("width_missing"), rms(F.col("contrast")).alias("contrast_rms"), mean_root("profile", 3 * PLACES).alias("profile_rms"), mean_root("over", near).alias("halo_rms"))

    smooth = strips.blurred(strips.told(candidate, good, keys), keys, {c: c for c in RGB}, SMOOTH)
    steep = strips.slopes(smooth.select(*keys, "y", "height", _luma().alias("l")), keys, "l").select(*keys, "y", F.col("dy").alias("c_dy"), F.col("dx").alias("c_dx"))
    chroma = {f"{c}g": F.zip_with(_minus("c_" + c, "c_g"), _minus(c, "g"), lambda x, y: x - y) for c in ("r", "b")}
    named = candidate.select(*keys, "y", *[F.col(c).alias("c_" + c) for c in RGB])
    blotch = strips.blurred(strips.matched(source, named, [*keys, "y"]).select(*keys, "y", "height", *[v.alias(k) for k, v in chroma.items()]), keys, {"rg": "rg", "bg": "bg"}, CHROMA).drop("height")
    at = strips.matched(strips.matched(strips.told(cloth, good, keys), steep, [*keys, "y"]), blotch, [*keys, "y"])
    dots = strips.cells(at, keys, ["interior", "seams", "dy", "dx", "c_dy", "c_dx", "rg", "bg"]).where("interior > 0")
    off = (F.col("c_dy") - F.col("dy")) ** 2 + (F.col("c_dx") - F.col("dx")) ** 2
    colour = dots.groupBy(*keys).agg(F.sqrt(F.avg(F.when(F.col("seams") > 0, off))).alias("seam_rms"), F.sqrt(F.avg(F.col("rg") ** 2 + F.col("bg") ** 2) / 2).alias("blotch_rms"))

    out = state
    for more in (places, rough, edges, colour):
        out = out.join(more, keys, "left")
    names = ["missing_rows", "samples", "position_rms", "position_p95", "width_rms", "width_missing", "contrast_rms", "profile_rms", "halo_rms", "seam_rms", "blotch_rms"]
    return out.select(*keys, "error", *names, F.when(F.col("missing_rows") == 0, F.col("rough")).alias("jaggedness_rms"), *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("interior_pixels", "seam_pixels")])


def nearest_points(points: DataFrame, others: DataFrame, keys: Sequence[str], cell: float = 4.0) -> DataFrame:
    """(keys, id, far, other): for each of ``points`` (keys, id, x, y) the nearest of ``others`` of its image and how far it is; ties to
    the smaller id, null where the image has none.

    Points meet what lies in the nine cells around their own. A nearest point is proven once it isn't farther than a cell is
    wide, as all that is nearer lies in these nine; the rest go on with cells twice as wide, until the cells are wider than an image's points
    are spread. Each round is an equi-join on cells.
    """
    keys = list(keys)
    spread = points.select(*keys, "x", "y").unionByName(others.select(*keys, "x", "y")).groupBy(*keys).agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("s")).agg(F.max("s")).head()[0]
    waiting, done = points.select(*keys, "id", "x", "y"), []
    while True:
        last = spread is None or cell > spread
        number = lambda c, size=cell: F.floor(F.col(c) / size)
        around = waiting.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])))
        around = around.select(*keys, "id", "x", "y", (number("y") + F.col("_d.dy")).alias("cy"), (number("x") + F.col("_d.dx")).alias("cx"))
        placed = others.select(*keys, F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), number("y").alias("cy"), number("x").alias("cx"))
        met = strips.matched(around, placed, [*keys, "cy", "cx"], "left")
        far = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2)
        best = met.groupBy(*keys, "id", "x", "y").agg(F.min(F.when(F.col("other").isNotNull(), F.struct(far.alias("far"), "other"))).alias("best"))
        best = strips.kept(best)
        proven = F.lit(True) if last else F.coalesce(F.col("best.far") <= cell, F.lit(False))
        done.append(best.where(proven).select(*keys, "id", "best.far", "best.other"))
        waiting = best.where(~proven).select(*keys, "id", "x", "y")
        if last or not waiting.limit(1).count():
            break
        cell *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
