"""Gates and decisions over columns: each takes what it judges as columns, in the order in which it is judged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frontal(yaw: Column, pitch: Column, roll: Column, most: float = 15.0) -> tuple[Column, Column]:
    """Whether a pose is frontal, and the largest of its angles."""
    worst = F.greatest(F.abs(yaw), F.abs(pitch), F.abs(roll))
    return worst <= most, worst


def encoder_failure(width: Column, length: Column, cap: Column, rest: Column, least_width: float = 50) -> Column:
    """The first check that an encoded file fails: image width, empty output, more bytes than the cap, bytes that don't add up."""
    return F.when(width < least_width, "width").when(length < 1, "empty").when(length > cap, "over cap").when(rest != 0, "not closed")


def colour_basis(has_profile: Column, has_tag: Column) -> Column:
    """What an image's colours rest on: an embedded profile, else its colour-space tag, else an assumption."""
    return F.when(has_profile, "icc").when(has_tag, "exif").otherwise("assumed")


def evidence_status(measured: Column) -> Column:
    return F.when(measured, "Measured").otherwise("Estimated")


def region_label(face: Column, foreground: Column, candidate: Column) -> Column:
    """A pixel's one label; the face before the foreground before a backdrop candidate."""
    return F.when(face, "face").when(foreground, "foreground").when(candidate, "candidate").otherwise("unknown")


def requirement_union(*lists: Column) -> Column:
    """Lists one after the other, each requirement where it comes first; null lists add nothing."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def sort_key(value: Column, exact: Column, eligible: Column) -> Column:
    """What candidates are ranked by: exact ones before all, ineligible ones after all, missing values just before these."""
    low = F.lit(float("-inf"))
    return F.when(~eligible, low).when(exact, F.lit(float("inf"))).otherwise(F.coalesce(value, F.lit(-1.7976931348623157e308)))
