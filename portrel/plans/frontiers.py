"""Queries of the donor frontier: options of the stand-in blocks' passes, folded per output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portrel.operators import frontier
from portrel.plans.registry import query
from portrel.sources import relations as rel

MOST_FREED, MOST_LOST = 6, 3.0


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(output_id, grp, endpoint, freed, credit_lost, face, hair) and limits: an option for each line of an order, two for odd ones."""
    q, p, s = F.floor("l_quantity").cast("long"), F.col("l_partkey"), F.col("l_suppkey")
    one = lambda e: F.struct(F.lit(e).cast("long").alias("endpoint"), (1 + (q + e) % 3).alias("freed"), (((p + 5 * e) % 7) / 4).alias("credit_lost"), ((s + 9 * e + p) % 21 - 10).cast("double").alias("face"), ((p + 4 * e) % 15 - 7).cast("double").alias("hair"))
    both = F.when(F.col("l_linenumber") % 2 == 1, F.array(one(1), one(2))).otherwise(F.array(one(1)))
    listed = rel.lines(spark, sf_dir).select(F.col("l_orderkey").alias("output_id"), F.col("k").cast("long").alias("grp"), F.explode(both).alias("o")).select("output_id", "grp", "o.*")
    return listed.withColumns({"most_freed": F.lit(MOST_FREED), "most_lost": F.lit(MOST_LOST)})


_SQL = f"""WITH RECURSIVE o AS MATERIALIZED (SELECT l_orderkey AS output_id, k AS grp, e AS endpoint, 1 + (CAST(floor(l_quantity) AS BIGINT) + e) % 3 AS freed, ((l_partkey + 5 * e) % 7) / 4e0 AS credit_lost, CAST((l_suppkey + 9 * e + l_partkey) % 21 - 10 AS DOUBLE) AS face, CAST((l_partkey + 4 * e) % 15 - 7 AS DOUBLE) AS hair
    FROM lines, range(1, 3) t(e) WHERE e = 1 OR l_linenumber % 2 = 1),
many AS (SELECT output_id, max(grp) AS n FROM o GROUP BY output_id),
s AS (SELECT output_id, 0 AS k, CAST(0 AS BIGINT) AS freed, 0e0 AS credit_lost, 0e0 AS face, 0e0 AS hair, CAST([] AS BIGINT[][]) AS changes FROM many
    UNION ALL SELECT s.output_id, s.k + 1, s.freed + c.freed, s.credit_lost + c.credit_lost, s.face + c.face, s.hair + c.hair, CASE WHEN c.endpoint = 0 THEN s.changes ELSE list_append(s.changes, [CAST(c.grp AS BIGINT), c.endpoint]) END
    FROM s JOIN (SELECT output_id, grp, endpoint, freed, credit_lost, face, hair FROM o UNION ALL SELECT DISTINCT output_id, grp, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0e0, 0e0, 0e0 FROM o) c ON c.output_id = s.output_id AND c.grp = s.k + 1
    WHERE s.freed + c.freed <= {MOST_FREED} AND s.credit_lost + c.credit_lost <= {MOST_LOST}),
whole AS MATERIALIZED (SELECT s.output_id, freed, credit_lost, face, hair, min(changes) AS changes FROM s JOIN many m ON m.output_id = s.output_id AND m.n = s.k GROUP BY ALL)
SELECT output_id, freed, credit_lost, face, hair, array_to_string(list_transform(changes, lambda c: c[1] || '=' || c[2]), ' ') AS changes FROM whole a
WHERE NOT EXISTS (SELECT 1 FROM whole b WHERE b.output_id = a.output_id AND b.freed = a.freed AND b.credit_lost <= a.credit_lost AND b.face <= a.face AND b.hair <= a.hair AND (b.credit_lost < a.credit_lost OR b.face < a.face OR b.hair < a.hair))"""


@query(_SQL)
def donor_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state of each output's frontier: exact; the SQL takes all combinations and drops what another one dominates."""
    found = frontier.donor_frontier(options(spark, sf_dir), "output_id", beam=None)
    spelled = F.array_join(F.transform("changes", lambda c: F.concat_ws("=", c["grp"].cast("string"), c["endpoint"].cast("string"))), " ")
    return found.select("output_id", "freed", "credit_lost", "face", "hair", spelled.alias("changes"))
