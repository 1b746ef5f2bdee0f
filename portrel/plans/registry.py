"""Names of queries, their Spark plans and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portrel.sources import relations

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Plan], Plan]:
    """Register a plan under its function's name. ``sql`` names stand-in relations, which are put in front of it."""

    def add(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if sql:
            wanted = " ".join([sql, *(text for name, text in relations.SQL.items() if re.search(rf"\b{name}\b", sql))])
            used = [text for name, text in relations.SQL.items() if re.search(rf"\b{name}\b", wanted)]
            body = sql.strip()
            head = "WITH RECURSIVE " + ", ".join(used) if used else ""
            if body.startswith("WITH RECURSIVE "):
                body = body.removeprefix("WITH RECURSIVE ")
                ORACLES[plan.__name__] = f"{head}, {body}" if head else f"WITH RECURSIVE {body}"
            elif body.startswith("WITH "):
                body = body.removeprefix("WITH ")
                ORACLES[plan.__name__] = f"{head}, {body}" if head else f"WITH {body}"
            else:
                ORACLES[plan.__name__] = f"{head} {body}".strip()
        return plan

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + 0.0
