"""Options as columns: presets, checks and arguments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portrel.functions import validate

#: Presets of the quality assessment.
PRESETS = (("strict", True, 0.85), ("lenient", False, 0.6), ("default", False, 0.7))


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, enforce boolean, threshold double")


def invalid_options(threshold: Column, rotation: Column) -> Column:
    """The first error of a quality threshold (0 to 1) and a largest rotation (0 to 180 degrees); null if both are right."""
    return validate.first_error(
        ((threshold < 0) | (threshold > 1), validate.error("threshold", "must be between 0 and 1")), ((rotation < 0) | (rotation > 180), validate.error("rotation", "must be between 0 and 180 degrees")),
    )


def backdrop_valid(gradient: Column, variance: Column, distance: Column, edge: Column, pixels: Column, fraction: Column, most: Column) -> Column:
    """Whether the bounds of a backdrop analysis are all finite and in range."""
    finite = lambda c, low, high: F.coalesce(~F.isnan(c) & c.between(low, high), F.lit(False))
    return finite(gradient, 0, 255) & finite(variance, 0, 65_025) & finite(distance, 0, 255) & finite(edge, 0, 255) & (edge > 0) & (pixels > 0) & (pixels <= most) & finite(fraction, 0, 1) & most.between(1, 16_777_216)


def has_flag(arguments: Column, flag: str) -> Column:
    return F.exists(arguments, lambda a: F.lower(a) == flag)


def named_value(arguments: Column, name: str, allowed: Sequence[str]) -> Column:
    """The value of the first argument name=value, in lower case; null if there is none or it isn't allowed."""
    found = F.get(F.filter(arguments, lambda a: F.startswith(F.lower(a), F.lit(f"{name}="))), F.lit(0))
    value = F.lower(F.substring(found, len(name) + 2, 1 << 20))
    return F.when(value.isin(*allowed), value)
