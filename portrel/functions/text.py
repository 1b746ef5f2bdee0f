"""Parsing, naming and matching of small texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_fields(body: Column) -> Column:
    """A JSON object's fields as a map from their names in lower case; of names that only differ in case the first one counts."""
    parsed = F.from_json(body, "map<string,string>")
    entries = F.transform(F.map_entries(parsed), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda o: o["key"]), e["key"]) == i + 1)
    return F.map_from_entries(first)


def field(fields: str, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name.lower()))


def enum_name(number: Column, names: Sequence[str]) -> Column:
    """The name of a value of an enumeration from 0 on; null beyond it."""
    return F.get(F.array(*map(F.lit, names)), number.cast("int"))


def numbers(listed: Column, least: float, most: float) -> Column:
    """The numbers of a comma-separated text within bounds, ascending, each once."""
    parsed = F.transform(F.split(listed, ","), lambda t: F.trim(t).try_cast("double"))
    return F.array_sort(F.array_distinct(F.filter(parsed, lambda v: v.isNotNull() & v.between(least, most))))


def short_id() -> Column:
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8)


def region_map(name: str, value: str) -> Column:
    """An aggregate: a map from names to values, which must be few and different."""
    return F.map_from_entries(F.collect_list(F.struct(name, value)))


def elapsed(start: Column, end: Column) -> Column:
    """Microseconds between two times; 0 without a start."""
    return F.coalesce(F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp")), F.lit(0).cast("long"))


def base_name(path: Column) -> Column:
    """A path's last part without its extension, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", ""))


def matched_by_name(files: DataFrame, path: str, results: DataFrame, result_path: str) -> DataFrame:
    """Files with the results of the same base name; files without any stay."""
    keyed = results.withColumn("_base", base_name(F.col(result_path)))
    return files.withColumn("_base", base_name(F.col(path))).join(keyed, "_base", "left").drop("_base")


def enriched(rows: DataFrame, dictionary: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with the dictionary's ``name`` for their ``key``, null where it has none."""
    return rows.join(dictionary.select(key, name), key, "left")
