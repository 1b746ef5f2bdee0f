"""What only shows on larger tables, or on ones in several files: on small ones made so."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from portrel import catalog
from portrel.operators import contours, frontier, ledger, strips
from portrel.plans import colours


def test_attribution_totals_in_the_order_of_files(spark, tmp_path):
    """Outputs whose estimates add up to one side of a whole number or the other, by their order; their bands lie in six files."""
    rng = np.random.default_rng(2)
    q, p, s = rng.integers(1, 51, (60_000, 6)), rng.integers(0, 20_000, (60_000, 6)), rng.integers(0, 1000, (60_000, 6))
    credit = (q * 100 + p % 97) * (s % 11) // 20 * 0.97
    below = lambda c: np.floor(np.add.accumulate(c, axis=1)[:, -1])
    torn = np.flatnonzero(below(credit) != below(credit[:, ::-1]))
    assert len(torn) > 20
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(6):
        rows = {"l_orderkey": torn, "l_partkey": p[torn, k], "l_suppkey": s[torn, k], "l_linenumber": np.full(len(torn), k, np.int32), "l_quantity": q[torn, k].astype(float)}
        pq.write_table(pa.table(rows), tmp_path / "lineitem.parquet" / f"part-{k}.parquet")
    con = duckdb.connect()
    con.sql("SET threads = 1")  # with more, the SQL's own sums have no order
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["attribution_totals"]).fetchall()
    got = catalog.queries()["attribution_totals"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_lines_are_never_broadcast(spark):
    """Spark takes an array for one value when it estimates a size, so joins of lines and points mustn't leave it the choice."""
    image = spark.range(3).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("y"), F.lit(64).alias("height"), *[F.array_repeat(F.lit(100.0), 48).alias(c) for c in "rgb"])
    regions = spark.range(3).select(F.col("id").alias("image_id"), F.lit(12).alias("first_row"), F.lit(51).alias("last_row"), F.lit(24).alias("center"))
    contour = contours.contours(image, regions, ["image_id"])
    points = contours.profiles(contour, ["image_id"])
    for found in (contour, contours.contours(image, regions, ["image_id"], contour), contours.sampled_profiles(image, points, ["image_id"])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan


def test_outputs_folded_together_are_as_folded_alone(monkeypatch):
    """Ties, slack, limits, beams and changes of several words; as many passes as the largest frontier has states, not as there are states."""
    rng = np.random.default_rng(4)
    names = ["grp", "endpoint", "freed", "credit_lost", "face", "hair"]
    lost = np.array([0.0, 0.25, 0.5, 1.0, 1.0 - 5e-8, 1.0 + 6e-8])
    for word in (12, frontier.WORD):
        monkeypatch.setattr(frontier, "WORD", word)
        for beam in (None, 1, 2, 5):
            outs = []
            for n in rng.integers(1, 13, 40):
                columns = [rng.integers(1, 9, n), rng.integers(1, 4, n), rng.integers(1, 4, n), rng.choice(lost, n), rng.integers(-4, 5, n).astype(float), rng.integers(-3, 4, n).astype(float)]
                outs.append(sorted(zip(*(c.tolist() for c in columns), strict=True)))
            freed, credit = rng.integers(0, 13, len(outs)), rng.choice([0.0, 1.0, 3.0, 50.0], len(outs))
            columns = {n: np.array([o[i] for out in outs for o in out]) for i, n in enumerate(names)}
            own, sums, many, change = frontier.folded(np.repeat(np.arange(len(outs)), list(map(len, outs))), columns, freed, credit, beam)
            got: list[list] = [[] for _ in outs]
            for k, (i, end) in enumerate(zip(own, np.cumsum(many), strict=True)):
                told = change[end - many[k] : end]
                got[i].append((*(s[k].item() for s in sums), tuple(zip(columns["grp"][told].tolist(), columns["endpoint"][told].tolist(), strict=True))))
            assert list(map(sorted, got)) == [sorted(frontier.fold(out, int(f), float(c), beam)) for out, f, c in zip(outs, freed, credit, strict=True)]


def test_choices_are_made_in_the_rows_of_blocks(spark):
    """No trade-off multiplies points before they are sorted or shuffled, and a round of the search moves sums only; of equals the fewer bytes."""
    rng = np.random.default_rng(3)
    rows = [(b, k, int(r), int(d)) for b in range(50) for k, (r, d) in enumerate(rng.integers(0, 12, (int(rng.integers(1, 7)), 2)))]
    points = spark.createDataFrame([*rows, (99, 0, None, 5)], "block_id long, pass_no long, rate long, dist long")
    tried = [0.0, 0.5, 1.0, 2.0, 30.0]
    plan = ledger.best_at(points, tried)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortAggregate" not in plan
    want = {}
    for t in tried:
        best = [max((d - t * r, -r, d) for o, _, r, d in rows if o == b) for b in range(50)]
        best = [x for x in best if x[0] > 0]
        want[t] = (-sum(x[1] for x in best), sum(x[2] for x in best), len(best))
    assert {r[0]: tuple(r)[1:] for r in ledger.best_at(points, tried).collect()} == {t: w for t, w in want.items() if w[2]}
    blocks = strips.kept(ledger.by_block(points))
    assert blocks.count() == 51
    plan = ledger.best_of(blocks, tried)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan and "Window" not in plan


def test_costly_rows_of_a_small_file_are_dealt_out(spark):
    sf = "/root/testdata/sf0.001"
    for rows in (catalog.queries()["nearest_feasible_crop"](spark, sf), colours.made_profiles(spark, sf)):
        counts = rows.groupBy(F.spark_partition_id()).count().collect()
        assert len(counts) > 4
