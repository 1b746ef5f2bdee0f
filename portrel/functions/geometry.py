"""Geometry and scoring as column functions. Everything computes in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, low: float | Column, high: float | Column) -> Column:
    lift = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(v, lift(low)), lift(high))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (structs of x, y, w, h) over their union; 0 if they are apart."""
    width = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    height = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    both = width * height
    return F.when((width < 0) | (height < 0), F.lit(0.0)).otherwise(both / (a["w"] * a["h"] + b["w"] * b["h"] - both))


def eye_rotation(left_x: Column, left_y: Column, right_x: Column, right_y: Column) -> Column:
    """Degrees that level the eyes."""
    return -F.degrees(F.atan2(right_y - left_y, right_x - left_x))


def normalise_angle(degrees: Column) -> Column:
    """To (-180, 180]."""
    turned = F.pmod(degrees, F.lit(360.0))
    return F.when(turned > 180, turned - 360).otherwise(turned)


def expanded_canvas(w: Column, h: Column, degrees: Column) -> tuple[Column, Column]:
    """Width and height that hold a w x h image after a rotation."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    return F.ceil(F.round(w * c + h * s, 9)).cast("long"), F.ceil(F.round(w * s + h * c, 9)).cast("long")


def affine_inverse(a: Column, b: Column, c: Column, d: Column, tx: Column, ty: Column) -> list[Column]:
    """Inverse of the row-vector map (x, y) -> (ax + cy + tx, bx + dy + ty); null where it has none."""
    det = a * d - b * c
    ok = det != 0
    over = lambda v: F.when(ok, F.try_divide(v, det))
    return [over(d), over(-b), over(-c), over(a), over(c * ty - d * tx), over(b * tx - a * ty)]


def falling_sigmoid(asymmetry: Column, middle: float = 0.2, slope: float = 8.0, cut: float = 20.0) -> Column:
    e = slope * (asymmetry - middle)
    return F.when(e > cut, F.lit(0.0)).when(e < -cut, F.lit(1.0)).otherwise(1 / (1 + F.exp(e)))


def variance_sigmoid(variance: Column, middle: float = 0.0008, slope: float = 2500.0) -> Column:
    return 1 / (1 + F.exp(-(variance - middle) * slope))


def sharpness_scale(ratio: Column, gain: float = 294.0) -> Column:
    return F.least(ratio * gain, F.lit(1.0))


def in_ellipse(x: Column, y: Column, cx: Column, cy: Column, rx: Column, ry: Column, degrees: Column) -> Column:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    u, v = (x - cx) * c + (y - cy) * s, (y - cy) * c - (x - cx) * s
    return (u * u) / (rx * rx) + (v * v) / (ry * ry) <= 1


def bits_per_pixel(size: Column, w: Column, h: Column) -> Column:
    return size * 8 / (w * h)


def deviation(v: Column, low: Column, high: Column) -> Column:
    """0 inside [low, high], else the distance relative to the bound that is missed."""
    off = F.when(v < low, (low - v) / F.greatest(F.abs(low), F.lit(0.001))).when(v > high, (v - high) / F.greatest(F.abs(high), F.lit(0.001)))
    return F.coalesce(off, F.lit(0.0))


def scaled(size: Column, scale: Column) -> Column:
    return size * scale


def inverse_scale(scale: Column) -> Column:
    return F.try_divide(F.lit(1.0), scale)


def significant_scale(scale: Column, least: float = 0.01) -> Column:
    return F.abs(scale - 1) > least


def significant_angle(degrees: Column, least: float = 0.1) -> Column:
    return F.abs(degrees) > least


def shape_consistent(ratio: Column, wanted: Column, most: float = 0.1) -> Column:
    """Whether a width to height ratio is within a part of the wanted one."""
    return F.abs(ratio / wanted - 1) <= most


def frequency_metrics(high: Column, mid: Column, low: Column) -> dict[str, Column]:
    """Total energy of three bands and the high one's share; 0 where there is none."""
    total = high + mid + low
    return {"total": total, "ratio": F.when(total > 0, high / total).otherwise(0.0)}


def gap_closure(before: Column, after: Column, goal: Column) -> Column:
    """The part of the way from ``before`` down to ``goal`` that was gone; null if there was none to go, or a value is missing."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(finite(before) & finite(after) & finite(goal) & (before > goal), F.try_divide(before - after, before - goal))


def ratio_delta(actual: Column, reference: Column, both_exact: Column) -> Column:
    """Difference of two ratios; 0 where both are missing because nothing differs, else null where one is missing."""
    return F.when(actual.isNotNull() & reference.isNotNull(), actual - reference).when(both_exact, F.lit(0.0))


def edge_config_valid(sigma: Column, low: Column, high: Column) -> Column:
    return (sigma > 0) & (low > 0) & (high > low)


def rotated(x: Column, y: Column, cx: Column, cy: Column, degrees: Column) -> tuple[Column, Column]:
    """A point turned about a centre."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return (x - cx) * c - (y - cy) * s + cx, (x - cx) * s + (y - cy) * c + cy


def cropped(v: Column, start: Column, scale: Column) -> Column:
    """A coordinate after a crop that begins at ``start`` and a scaling."""
    return (v - start) * scale


def head_oval(brow: Column, chin: Column, jaw_width: Column) -> dict[str, Column]:
    """The estimated crown, and width and height of the face's oval."""
    face, width = chin - brow, jaw_width * 0.9
    return {"crown": brow - 0.8 * face, "width": width, "height": F.greatest(0.85 * face, 1.3 * width)}


def centring_percent(x: Column, y: Column, w: Column, h: Column) -> Column:
    """100 in the middle of the image, 0 at half a diagonal from it and beyond."""
    half = F.sqrt(w * w + h * h) / 2
    return F.greatest(F.lit(0.0), 1 - distance(x, y, w / 2, h / 2) / half) * 100


def five_points(cx: Column, cy: Column, prior: Column, offsets: Sequence[tuple[Column, Column]], side: int, pad_x: Column, pad_y: Column, scale: Column) -> Column:
    """Landmarks of a detection from a network's offsets to its prior box, a tenth of the prior's size each, taken back from the padded
    square to the image: an array of structs."""
    back = lambda c, d, pad: ((c + d * 0.1 * prior) * side - pad) / scale
    return F.array(*[F.struct(back(cx, dx, pad_x).alias("x"), back(cy, dy, pad_y).alias("y")) for dx, dy in offsets])


def landmark_crop(x: Column, y: Column, w: Column, h: Column, image_w: Column, image_h: Column, padding: float = 0.1) -> dict[str, Column]:
    """A box padded by a part of its size and clipped to the image, in whole pixels, with the square that holds it: its side and how
    far the crop lies in it."""
    x0, y0 = F.greatest(F.floor(x - padding * w), F.lit(0)), F.greatest(F.floor(y - padding * h), F.lit(0))
    x1, y1 = F.least(F.ceil(x + (1 + padding) * w), image_w), F.least(F.ceil(y + (1 + padding) * h), image_h)
    side = F.greatest(x1 - x0, y1 - y0)
    return {"x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0, "side": side, "in_x": F.floor((side - (x1 - x0)) / 2), "in_y": F.floor((side - (y1 - y0)) / 2)}


def from_crop(u: Column, v: Column, crop: dict[str, Column]) -> tuple[Column, Column]:
    """A point of the unit square back to the image through a ``landmark_crop``."""
    return u * crop["side"] - crop["in_x"] + crop["x"], v * crop["side"] - crop["in_y"] + crop["y"]
