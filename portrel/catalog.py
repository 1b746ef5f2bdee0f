"""All registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from portrel.plans import checks, colours, details, faces, frontiers, images, more, photos, portraits, records, tiles  # noqa: F401  importing registers
from portrel.plans.registry import ORACLES, QUERIES, Plan


def queries() -> dict[str, Plan]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
