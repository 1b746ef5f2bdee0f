"""Portrait geometry as column functions over 68 landmarks: an array of structs (x, y) in the usual order, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portrel.functions import geometry as g

#: Which landmarks make up what.
JAW, BROWS, LEFT_EYE, RIGHT_EYE, NOSE, MOUTH = range(17), range(17, 27), range(36, 42), range(42, 48), range(27, 31), (48, 51, 54, 57)
CHIN = 8


def at(points: Column, i: int) -> Column:
    return F.get(points, F.lit(i))


def pick(points: Column, which: Sequence[int], axis: str) -> Column:
    """The coordinates of some landmarks as an array."""
    return F.array(*[at(points, i)[axis] for i in which])


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def centre(points: Column, which: Sequence[int]) -> tuple[Column, Column]:
    return mean(pick(points, which, "x")), mean(pick(points, which, "y"))


def valid(points: Column, w: Column, h: Column) -> Column:
    """68 finite points, all on the image."""
    inside = lambda p: F.coalesce((p["x"] >= 0) & (p["y"] >= 0) & (p["x"] <= w) & (p["y"] <= h) & ~F.isnan(p["x"]) & ~F.isnan(p["y"]), F.lit(False))
    return (F.size(points) == 68) & F.forall(points, inside)


def face_region(points: Column, padding: float = 0.15, forehead: float = 0.3) -> dict[str, Column]:
    """Box of the jaw, up to the forehead, padded; whole pixels, never left of or above the image."""
    x, y = pick(points, JAW, "x"), pick(points, JAW, "y")
    left, right, bottom = F.array_min(x), F.array_max(x), F.array_max(y)
    top = F.least(F.array_min(y), F.array_min(pick(points, BROWS, "y")) - (bottom - F.array_min(y)) * forehead)
    wide, high = right - left, bottom - top
    corner = lambda v: F.floor(F.greatest(v, F.lit(0.0)))
    return {"x": corner(left - wide * padding), "y": corner(top - high * padding), "w": F.ceil(wide * (1 + 2 * padding)), "h": F.ceil(high * (1 + 2 * padding))}


def lines(points: Column) -> dict[str, Column]:
    """The centre line (aa), the eye line (bb) and the width between the outermost jaw points (cc), with what they come from."""
    nose, mouth = centre(points, NOSE), centre(points, MOUTH)
    left, right = centre(points, LEFT_EYE), centre(points, RIGHT_EYE)
    x = pick(points, JAW, "x")
    return {
        "aa": (nose[0] + mouth[0]) / 2, "bb": (left[1] + right[1]) / 2, "cc": F.array_max(x) - F.array_min(x), "nose_x": nose[0], "mouth_x": mouth[0],
        "eyes": g.distance(*left, *right),
    }


def line_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(F.degrees(F.atan2(y2 - y1, x2 - x1)))


def is_horizontal(angle: Column, tolerance: float = 5.0) -> Column:
    return (angle <= tolerance) | (angle >= 180 - tolerance)


def is_vertical(angle: Column, tolerance: float = 5.0) -> Column:
    return F.abs(angle - 90) <= tolerance


#: Limits of the line and width validation.
MAX_CENTRE, MAX_ALIGNMENT, EYES_FROM_BOTTOM, MIN_WIDTH_RATIO, MIN_HEAD_WIDTH, MIN_FRAME_WIDTH = 10.0, 8.0, (0.5, 0.7), 1.75, 240.0, 420


def line_validation(ls: dict[str, Column], w: Column, h: Column) -> dict[str, Column]:
    """What is off about an image's lines: an array of codes, the three geometry flags and how severe it is. The width is estimated
    from the jaw here, so no image is fully compliant."""
    off, aligned = ls["aa"] - w / 2, F.abs(ls["nose_x"] - ls["mouth_x"]) <= MAX_ALIGNMENT
    from_bottom = (h - ls["bb"]) / h
    ratio = F.try_divide(w.cast("double"), ls["cc"])
    ratio_ok = F.coalesce(ratio >= MIN_WIDTH_RATIO - 0.001, F.lit(False))
    wide, frame = ls["cc"] >= MIN_HEAD_WIDTH, w > MIN_FRAME_WIDTH
    when = lambda c, code: F.when(c, F.lit(code))
    issues = F.array_compact(F.array(
        when(F.abs(off) > MAX_CENTRE, "centre"), when(~aligned, "alignment"), when(from_bottom < EYES_FROM_BOTTOM[0], "eyes low"), when(from_bottom > EYES_FROM_BOTTOM[1], "eyes high"),
        when(~ratio_ok, "width ratio"), when(~ratio_ok, "width over"), when(~wide, "head narrow"), when(~frame, "frame narrow"),
    ))
    screen = ratio_ok & wide & frame
    bb_ok = from_bottom.between(*EYES_FROM_BOTTOM)
    severity = F.when(F.size(issues) >= 3, "Critical").when(~screen, "High").when(~bb_ok, "Medium").otherwise("Low")
    return {"issues": issues, "aa_ok": (F.abs(off) <= MAX_CENTRE) & aligned, "bb_ok": bb_ok, "screen_ok": screen, "severity": severity}


def head_size_score(points: Column, w: Column, low: float, high: float) -> Column:
    """1 in the middle of the allowed share of the image's width, 0.8 at its ends, and in proportion beyond."""
    ratio = F.abs(at(points, 16)["x"] - at(points, 0)["x"]) / w
    inside = 1 - F.abs(ratio - (low + high) / 2) / ((high - low) / 2) * 0.2
    return g.clamp(F.when(ratio < low, ratio / low).when(ratio > high, F.try_divide(F.lit(high), ratio)).otherwise(inside), 0.0, 1.0)


def centring_score(points: Column, w: Column, h: Column) -> Column:
    """A tenth of the image's side is free; what is more costs twice as much, 0.8 at most; both axes count alike."""
    left, right = centre(points, LEFT_EYE), centre(points, RIGHT_EYE)
    cx, cy = (left[0] + right[0] + at(points, 30)["x"]) / 3, (left[1] + right[1] + at(points, CHIN)["y"]) / 3
    score = lambda off: F.when(off <= 0.1, F.lit(1.0)).otherwise(1 - F.least((off - 0.1) * 2, F.lit(0.8)))
    return g.clamp((score(F.abs(cx - w / 2) / w) + score(F.abs(cy - h / 2) / h)) / 2, 0.0, 1.0)


def eye_distance_score(eyes: Column, low: float, high: float) -> Column:
    return g.clamp(F.when(eyes < low, eyes / low).when(eyes > high, F.try_divide(F.lit(high), eyes)).otherwise(F.lit(1.0)), 0.0, 1.0)


# Affine maps of row vectors: (x, y) -> (a x + c y + tx, b x + d y + ty), as a list a, b, c, d, tx, ty.


def apply(m: Sequence[Column], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, tx, ty = m
    return a * x + c * y + tx, b * x + d * y + ty


def render_map(w: Column, h: Column, degrees: Column, canvas: tuple[Column, Column], crop: dict[str, Column], out_w: Column, out_h: Column) -> list[Column]:
    """From the source to the output: rotate about the centre onto the expanded canvas, cut out ``crop``, resize."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    kx, ky = out_w / crop["w"], out_h / crop["h"]
    tx, ty = canvas[0] / 2 - (w / 2 * c - h / 2 * s), canvas[1] / 2 - (w / 2 * s + h / 2 * c)
    return [c * kx, s * ky, -s * kx, c * ky, (tx - crop["x"]) * kx, (ty - crop["y"]) * ky]


def corners(m: Sequence[Column], w: Column | float, h: Column | float) -> Column:
    """The four corners of a w x h output, clockwise from its origin, through a map: an array of structs."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    zero, w, h = F.lit(0.0), lift(w), lift(h)
    points = [apply(m, x, y) for x, y in ((zero, zero), (w, zero), (w, h), (zero, h))]
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points])


def with_chip_map(rows: DataFrame, side: int = 112, margin: float = 0.1) -> DataFrame:
    """Adds m0..m5, the map from the source to a square chip along the mean direction of eyes and mouth, around the detected box; null
    where the axis or the box is degenerate. ``rows`` has the box x, y, w, h and the points left_eye, right_eye, nose, left_mouth
    and right_mouth, structs of x and y. Step by step, so that no expression is computed twice."""
    c = F.col
    unit = lambda x, y: [F.when(F.sqrt(x * x + y * y) > 0.0001, v / F.sqrt(x * x + y * y)) for v in (x, y)]
    way = lambda a, b: unit(c(f"{b}.x") - c(f"{a}.x"), c(f"{b}.y") - c(f"{a}.y"))
    eyes, mouth = way("left_eye", "right_eye"), way("left_mouth", "right_mouth")
    r = rows.withColumns({"_ex": eyes[0], "_ey": eyes[1], "_mx": mouth[0], "_my": mouth[1]})
    r = r.withColumns({"_sx": c("_ex") + c("_mx"), "_sy": c("_ey") + c("_my")})
    opposite = F.sqrt(c("_sx") * c("_sx") + c("_sy") * c("_sy")) <= 0.0001
    r = r.withColumns({"_sx": F.when(opposite, c("_ex")).otherwise(c("_sx")), "_sy": F.when(opposite, c("_ey")).otherwise(c("_sy"))})
    axis = unit(c("_sx"), c("_sy"))
    r = r.withColumns({"_hx": axis[0], "_hy": axis[1]})
    corners_of = [(x - c("nose.x"), y - c("nose.y")) for x in (c("x"), c("x") + c("w")) for y in (c("y"), c("y") + c("h"))]
    r = r.withColumns({"_u": F.array(*[x * c("_hx") + y * c("_hy") for x, y in corners_of]), "_v": F.array(*[y * c("_hx") - x * c("_hy") for x, y in corners_of])})
    r = r.withColumns({"_u0": F.array_min("_u"), "_u1": F.array_max("_u"), "_v0": F.array_min("_v"), "_v1": F.array_max("_v")})
    r = r.withColumns({"_size": F.greatest(c("_u1") - c("_u0"), c("_v1") - c("_v0")) * (1 + margin), "_um": (c("_u0") + c("_u1")) / 2, "_vm": (c("_v0") + c("_v1")) / 2})
    r = r.withColumns({"_k": F.when(c("_size") > 0.0001, side / c("_size")), "_cx": c("nose.x") + c("_hx") * c("_um") - c("_hy") * c("_vm"), "_cy": c("nose.y") + c("_hy") * c("_um") + c("_hx") * c("_vm")})
    k, hx, hy, cx, cy = (c(f"_{n}") for n in ("k", "hx", "hy", "cx", "cy"))
    m = [k * hx, -k * hy, k * hy, k * hx, side / 2 - k * (cx * hx + cy * hy), side / 2 - k * (cy * hx - cx * hy)]
    return r.withColumns({f"m{i}": e for i, e in enumerate(m)}).drop(*[f"_{n}" for n in ("ex", "ey", "mx", "my", "sx", "sy", "hx", "hy", "u", "v", "u0", "u1", "v0", "v1", "size", "um", "vm", "k", "cx", "cy")])


def letterbox(w: Column, h: Column, side: int = 640) -> dict[str, Column]:
    """How a w x h image is fitted into a square: scale, whole size, and the padding at its left and top."""
    scale = F.least(side / w, side / h)
    new_w, new_h = F.floor(w * scale + 1e-9), F.floor(h * scale + 1e-9)
    return {"scale": scale, "new_w": new_w, "new_h": new_h, "pad_x": F.floor((side - new_w) / 2), "pad_y": F.floor((side - new_h) / 2)}


def crown_y(points: Column) -> Column:
    """Estimated top of the head: eight tenths of the brow-to-chin height above the brows."""
    brow = F.array_min(pick(points, BROWS, "y"))
    return brow - (at(points, CHIN)["y"] - brow) * 0.8


def gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def with_candidate(rows: DataFrame, w: int, h: int, out_w: int = 480, out_h: int = 640, eye_line: float = 0.45, top: int = 20, side: int = 10, least: float = 0.4, most: float = 4 / 7) -> DataFrame:
    """Adds one portrait crop of a level face (``points``) on a w x h image for the wanted head width ``ratio``: x, y, w, h in whole units
    of the output's shape, without enlargement, clamped to the image, the head's and the eyes' places in it, and as ``reason`` the
    first rule that it breaks (null: none)."""
    c, points = F.col, F.col("points")
    unit = gcd(out_w, out_h)
    x, ls = pick(points, JAW, "x"), lines(points)
    r = rows.withColumns({"_left": F.array_min(x), "_right": F.array_max(x), "_aa": ls["aa"], "_bb": ls["bb"], "_nose": ls["nose_x"], "_mouth": ls["mouth_x"], "_crown": crown_y(points), "_chin": at(points, CHIN)["y"]})
    r = r.withColumn("_jaw", c("_right") - c("_left")).withColumn("_units", F.floor(c("_jaw") / c("ratio") / (out_w // unit)))
    r = r.withColumns({"w": c("_units") * (out_w // unit), "h": c("_units") * (out_h // unit)})
    inside = lambda v, size, whole: F.least(F.greatest(F.bround(F.least(F.greatest(v, F.lit(0.0)), F.greatest(whole - size, F.lit(0)))), F.lit(0.0)), F.greatest(whole - size, F.lit(0))).cast("long")
    r = r.withColumns({"x": inside(c("_aa") - c("w") / 2, c("w"), w), "y": inside(c("_bb") - c("h") * eye_line, c("h"), h), "_scale": F.try_divide(F.lit(float(out_w)), c("w"))})
    r = r.withColumns({"head_ratio": F.try_divide(c("_jaw"), c("w")), "eye_line": F.try_divide(c("_bb") - c("y"), c("h")), "_head": (c("_chin") - c("_crown")) * c("_scale")})
    jaw, scale, ratio, eye = c("_jaw"), c("_scale"), c("head_ratio"), c("eye_line")
    margins = (c("_left") - jaw * 0.1 - c("x")) * scale, (c("x") + c("w") - c("_right") - jaw * 0.1) * scale, (c("_crown") - c("y")) * scale
    middle = ((c("_nose") + c("_mouth")) / 2 - c("x")) * scale
    reason = (
        F.when(jaw <= 0, "no width").when((c("w") < out_w) | (c("h") < out_h), "enlargement").when((c("w") > w) | (c("h") > h), "source area")
        .when((margins[0] < side) | (margins[1] < side) | (margins[2] < top), "margins").when((ratio < least) | (ratio > most), "head ratio").when((jaw < 240) | (jaw * scale < 240) | (ratio > 4 / 7), "width evidence")
        .when((c("_head") <= 0) | (c("_head") > out_h * 0.8) | ((c("_chin") - c("y")) * out_h / c("h") > out_h - side), "head height").when((eye < 0.3) | (eye > 0.5), "eye line")
        .when((F.abs((c("_nose") - c("_mouth")) * scale) > 8) | (F.abs(middle - out_w / 2) > 10), "centre line")
    )
    return r.withColumn("reason", reason).drop(*[f"_{n}" for n in ("left", "right", "aa", "bb", "nose", "mouth", "crown", "chin", "jaw", "units", "scale", "head")])


def evidence(points: Column, crop_w: Column, out_w: int = 480) -> Column:
    """What a plan's sizes rest on: estimates from landmarks, in source and output pixels."""
    jaw, head = lines(points)["cc"], at(points, CHIN)["y"] - crown_y(points)
    scale = out_w / crop_w
    size = lambda v, how: F.struct(v.alias("source"), (v * scale).alias("output"), F.lit("Estimated").alias("status"), F.lit(how).alias("basis"))
    return F.struct(size(jaw, "jaw contour").alias("head_width"), size(head, "brow to chin, extended").alias("head_height"), scale.alias("scale"))


# Half planes (a, b, m): a x + b y <= m.


def fits(planes: Column, x: Column, y: Column) -> Column:
    return F.forall(planes, lambda p: p["a"] * x + p["b"] * y <= p["m"] + 0.0001)


def clip(polygon: Column, plane: Column) -> Column:
    """A convex polygon (array of x, y) cut by a half plane: the corners inside and where its edges cross the border, in order."""
    value = lambda p: plane["a"] * p["x"] + plane["b"] * p["y"] - plane["m"]

    def edge(now: Column, i: Column) -> Column:
        before = F.when(i == 0, F.element_at(polygon, -1)).otherwise(F.get(polygon, i - 1))
        at_now, at_before = value(now), value(before)
        part = F.try_divide(at_before, at_before - at_now)
        cross = F.struct((before["x"] + part * (now["x"] - before["x"])).alias("x"), (before["y"] + part * (now["y"] - before["y"])).alias("y"))
        return F.array_compact(F.array(F.when((at_now <= 0) != (at_before <= 0), cross), F.when(at_now <= 0, now)))

    return F.when(F.size(polygon) > 0, F.flatten(F.transform(polygon, edge))).otherwise(polygon)


def clip_all(polygon: Column, planes: Column) -> Column:
    return F.aggregate(planes, polygon, lambda shape, p: clip(shape, p))


def nearest_feasible(polygon: Column, planes: Column, px: Column, py: Column) -> Column:
    """The whole point next to a polygon's corners and edges that fits all planes and is closest to (px, py), itself if it fits;
    struct (x, y) or null. Of equally close ones the first, by proposal, row and column."""

    def edge(a: Column, i: Column) -> Column:
        b = F.get(polygon, F.pmod(i + 1, F.size(polygon)))
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        part = g.clamp(F.coalesce(F.try_divide((px - a["x"]) * dx + (py - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0)), 0.0, 1.0)
        return F.struct((a["x"] + part * dx).alias("x"), (a["y"] + part * dy).alias("y"))

    proposals = F.concat(polygon, F.transform(polygon, edge))
    span = lambda v: F.sequence(F.floor(v) - 1, F.ceil(v) + 1)
    grid = F.flatten(F.transform(proposals, lambda p: F.flatten(F.transform(span(p["y"]), lambda y: F.transform(span(p["x"]), lambda x: F.struct(x.alias("x"), y.alias("y")))))))
    numbered = F.transform(F.filter(grid, lambda p: fits(planes, p["x"], p["y"])), lambda p, i: F.struct(((p["x"] - px) * (p["x"] - px) + (p["y"] - py) * (p["y"] - py)).alias("away"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y")))
    own = F.struct(px.cast("long").alias("x"), py.cast("long").alias("y"))
    # The least is bound to a name by an array of one, or it would be looked for again for each use.
    best = F.get(F.transform(F.array(F.array_min(numbered)), lambda b: F.when(b.isNotNull(), F.struct(b["x"].alias("x"), b["y"].alias("y")))), F.lit(0))
    return F.when(fits(planes, px, py), own).otherwise(best)
