"""Errors as data: a row carries a value or an error, and nothing raises for a single row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR = "struct<code:string,message:string>"


def error(code: str, message: str | Column) -> Column:
    return F.struct(F.lit(code).alias("code"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


def first_error(*checks: tuple[Column, Column]) -> Column:
    """The error of the first check (failed, error) that failed, in order; null if none did."""
    return F.coalesce(*[F.when(failed, e) for failed, e in checks], F.lit(None).cast(ERROR))


def kept(*optional: Column) -> Column:
    """Array of the columns that aren't null, in order."""
    return F.array_compact(F.array(*optional))
