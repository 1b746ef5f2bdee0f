"""The registered queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portrel.llm import byte_bpe, clustering, common, fingerprint, hard_negatives, html_text, jaccard, mixing, quality, secrets, substring_dedup, suffix_dedup, token_ids, topk


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(common.table(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.step_path(spark, "token-ids")
    return token_ids.read_ids(token_ids.write_ids(common.table(spark, sf_dir, "documents"), path, f"{common.tokenizer_dir()}/word_bpe_49k.json"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(common.table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(common.table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(common.table(spark, sf_dir, "documents"), f"{common.tokenizer_dir()}/byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(common.table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits(common.table(spark, sf_dir, "documents"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(common.table(spark, sf_dir, "embeddings"))[0]


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(common.table(spark, sf_dir, "documents"))


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


HARD_NEGATIVES_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def _clustering_sql(rounds: int = clustering.ROUNDS) -> str:
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, sha256('3:' || vec_id) AS h, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, vec_id, q) - 1 AS c, q FROM v ORDER BY h NULLS LAST, vec_id, q LIMIT 8)",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT rid, vec_id, x, c, d FROM (SELECT v.rid, v.vec_id, v.q AS x, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v CROSS JOIN c{r} c)
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, list(m ORDER BY j) AS q FROM (SELECT c, j, CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
        FROM (SELECT c, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{r}) GROUP BY c, j) GROUP BY c UNION ALL SELECT c, q FROM c{r} WHERE c NOT IN (SELECT c FROM a{r}))""")
    last = f"""SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""
    return "WITH " + ",\n".join(parts) + "\n" + last


def _secrets_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    always, mixed = "true", "regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[a-z]') AND regexp_matches(s, '[0-9]')"
    kinds = [
        (secrets.ASSIGN, f"length(regexp_extract(s, {quoted(secrets.ASSIGN)}, 2)) >= 6"), ("AKIA[A-Z0-9]+", "length(s) >= 20"), ("[0-9a-f]+", "length(s) >= 24"),
        (secrets.IDENTIFIER, always), (secrets.MIXED, mixed), (secrets.ENDPOINT, always), (secrets.EMPTY_LINES, always),
    ]
    found = " UNION ALL ".join(f"SELECT rid, {k} AS kind, regexp_extract_all(text, {quoted(p)}) AS m, regexp_split_to_array(text, {quoted(p)}) AS p FROM d" for k, (p, _) in enumerate(kinds))
    fits = " ".join(f"WHEN {k} THEN {f}" for k, (_, f) in enumerate(kinds))
    names = ", ".join(quoted(n) for n in secrets.KINDS)
    say = lambda only: f"coalesce(string_agg([{names}][kind + 1] || ':' || b || ':' || e, ',' ORDER BY b, kind, e) FILTER (WHERE {only}), '')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), f AS MATERIALIZED ({found}),
i AS (SELECT rid, kind, k, m[k] AS s, length(p[k]) AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM f)),
w AS MATERIALIZED (SELECT *, CAST(sum(gap + length(s)) OVER (PARTITION BY rid, kind ORDER BY k) AS BIGINT) AS e, e - length(s) AS b, CASE kind {fits} END AS fit FROM i),
x AS (SELECT rid, kind, b, e FROM w WHERE fit AND kind < 6), base AS (SELECT * FROM x WHERE kind < 3),
free AS (SELECT * FROM x WHERE kind >= 3 AND NOT EXISTS (SELECT 1 FROM base o WHERE o.rid = x.rid AND o.b < x.e AND x.b < o.e)),
part AS MATERIALIZED (SELECT o.*, (SELECT coalesce(max(w.e), 0) FROM w WHERE w.rid = o.rid AND w.kind = 6 AND w.e <= o.b) AS scope FROM (SELECT * FROM base UNION ALL SELECT * FROM free) o),
has AS (SELECT rid, scope, bool_or(kind IN (1, 3)) AS id, bool_or(kind IN (0, 2, 4)) AS sec FROM part GROUP BY ALL),
every AS (SELECT p.rid, p.kind, p.b, p.e FROM part p JOIN has h ON p.rid = h.rid AND p.scope = h.scope WHERE p.kind < 3 OR CASE p.kind WHEN 3 THEN sec WHEN 4 THEN id ELSE id AND sec END),
g AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2, {say("kind < 3")} AS base, {say("true")} AS spans FROM every GROUP BY rid)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.rid = g.rid"""


def queries() -> dict:
    own = (op1_top_k, op2_mixing, op3_substring_dedup, op4_token_ids, op5_jaccard_join, op6_html_text, op7_byte_bpe, op8_quality, op9_suffix_dedup, op10_fingerprints, op11_clustering, op12_hard_negatives, op13_secrets)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_top_k": TOP_K_SQL, "op11_clustering": _clustering_sql(), "op12_hard_negatives": HARD_NEGATIVES_SQL, "op13_secrets": _secrets_sql()}
