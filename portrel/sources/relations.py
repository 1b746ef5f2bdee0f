"""Stand-in relations: the row shapes of portrait analytics, derived from the provided tables.

There are no photographs in the test data, so each relation has the shape of a real one (detections, landmarks, 8x8 tiles,
pixels, byte ledgers) and values from the tables. Parity is of semantics, not of photographs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a small file that cost much each, dealt out evenly: as a few megabytes they would be one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _long(c: Column) -> Column:
    return c.cast("long")


def blocks8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, y, x, v): each 64-float vector as an 8x8 grayscale tile."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    return e.select("vec_id", "label", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.col("e").cast("double").alias("v"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, v): the same tiles, each whole in one row as an array of its rows of pixels."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, idx, x, y): 32 points from consecutive pairs, on a 480x640 canvas."""
    e = table(spark, sf_dir, "embeddings")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(k.alias("idx"), F.get("embedding", 2 * k).cast("double").alias("ex"), F.get("embedding", 2 * k + 1).cast("double").alias("ey"))))
    return e.select("vec_id", pair.alias("p")).select("vec_id", F.col("p.idx").alias("idx"), (240 + 200 * F.col("p.ex")).alias("x"), (320 + 200 * F.col("p.ey")).alias("y"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with ``k``, a number from 1 that is unique in an order (its line numbers repeat)."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, det_id, x, y, w, h, conf): detections, several to an image."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("k")
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("image_id"), n.alias("det_id"), (p % 40).cast("double").alias("x"), (s % 40).cast("double").alias("y"),
        (40 + p % 23).cast("double").alias("w"), (40 + s % 19).cast("double").alias("h"), (((7919 * p + 104729 * s + 31 * n) % 1000) / 1000).alias("conf"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, i, r, g, b, label): RGB pixels, a hundred images, labelled by region."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 100).alias("image_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i"), (_long(F.floor("l_extendedprice")) % 256).alias("r"),
        ((F.col("l_partkey") * 31 + F.col("l_suppkey")) % 256).alias("g"), (_long(F.floor(F.col("l_quantity") * 5)) % 256).alias("b"), F.col("l_returnflag").alias("label"),
    )


def subbands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(output_id, tile, component, resolution, subband, payload, face, shared, outside, file, place): a conserved byte ledger, and where
    in the table's files each row lies."""
    li = table(spark, sf_dir, "lineitem")
    payload = _long(F.floor("l_quantity")) * 100 + F.col("l_partkey") % 97
    face = F.floor(payload * (F.col("l_suppkey") % 11) / 20).cast("long")
    shared = F.floor(payload * (F.col("l_partkey") % 7) / 20).cast("long")
    return li.select(
        F.col("l_orderkey").alias("output_id"), (F.col("l_suppkey") % 2).cast("int").alias("tile"), (F.col("l_linenumber") % 3).cast("int").alias("component"), F.col("l_linenumber").cast("int").alias("resolution"),
        (F.col("l_partkey") % 4).cast("int").alias("subband"), payload.alias("payload"), face.alias("face"), shared.alias("shared"), (payload - face - shared).alias("outside"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"),
    )


def rd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block_id, pass_no, rate, dist): truncation points of a code block; running bytes and gains."""
    w = W.partitionBy("l_orderkey").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    li = lines(spark, sf_dir)
    return li.select(F.col("l_orderkey").alias("block_id"), F.col("k").alias("pass_no"), _long(F.sum(F.floor("l_quantity")).over(w)).alias("rate"), _long(F.sum(F.floor(F.col("l_extendedprice") / 100)).over(w)).alias("dist"))


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, symmetry, sharpness, geometry, head, ipd): scores between 0 and 1, a head size in percent and eyes in pixels."""
    c = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        c.alias("id"), ((c * 37) % 101 / 100).alias("symmetry"), ((c * 53 + 11) % 101 / 100).alias("sharpness"), ((c * 71 + F.col("user_id")) % 101 / 100).alias("geometry"),
        ((c * 13 + 7) % 100).cast("double").alias("head"), (40 + (c * 29) % 180).cast("double").alias("ipd"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, reviewer, agrees, override): reviewed images."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return joined.select(F.col("doc_id").alias("image"), F.col("source").alias("reviewer"), (F.col("quality") == 1).alias("agrees"), F.when(F.col("toxic") == 1, F.col("lang")).alias("override"))


#: Tiles of a made image on each side: 64 lines of 96 pixels.
TILES_HIGH, TILES_WIDE = 8, 12


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, height, v, w, u): lines of images of several tiles each; ``w`` and ``u`` are the tiles turned and halved. Rows of tiles that aren't
    full are left out, so the last image is lower."""
    e = table(spark, sf_dir, "embeddings")
    many = TILES_HIGH * TILES_WIDE
    at = F.col("vec_id") % many
    tile = F.col("embedding").cast("array<double>")
    placed = e.select(F.floor(F.col("vec_id") / many).alias("image_id"), F.floor(at / TILES_WIDE).cast("int").alias("ty"), (at % TILES_WIDE).alias("tx"), tile.alias("v"), F.reverse(tile).alias("w"), F.concat(F.slice(tile, 33, 32), F.slice(tile, 1, 32)).alias("u"))
    rows = placed.groupBy("image_id", "ty").agg(F.sort_array(F.collect_list(F.struct("tx", "v", "w", "u"))).alias("t")).where(F.size("t") == TILES_WIDE)
    rows = rows.withColumn("height", ((F.max("ty").over(W.partitionBy("image_id")) + 1) * 8).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    line = lambda c: F.flatten(F.transform("t", lambda t: F.slice(t[c], F.col("k") * 8 + 1, 8))).alias(c)
    return rows.select("image_id", (F.col("ty") * 8 + F.col("k")).alias("y"), "height", line("v"), line("w"), line("u"))


def photos(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines (image_id, y, height, r, g, b) of a garment between two edges, with noise from the tables, and of a changed version of each."""

    def edge(center: float):  # noqa: ANN202
        return lambda x: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), 6 * (F.abs(x - center) - 20 - F.col("y") / 16)))

    def shot(center: float, base: float, gain: float, red: str, green: str, blue: str, depth: float) -> DataFrame:
        o = edge(center)
        channels = [F.transform(red, lambda v, x: base + o(x) / 2 + gain * v).alias("r"), F.transform(green, lambda v, x: 110 - o(x) / 2 + gain * v).alias("g"), F.transform(blue, lambda v, x: 100 + depth * v + x % 12 * 3).alias("b")]
        return m.select("image_id", "y", "height", *channels)

    m = mosaics(spark, sf_dir)
    return shot(47.6, 110.0, 8.0, "v", "w", "u", 30.0), shot(47.9, 111.0, 10.0, "u", "v", "w", 28.0)


def necklines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, first_row, last_row, center): where each photo's edges are looked for; every fourth is too short, one in seven off the centre."""
    i = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / (TILES_HIGH * TILES_WIDE)).alias("image_id")).distinct()
    first = 12 + F.col("image_id") % 3
    return i.select("image_id", first.cast("int").alias("first_row"), F.when(F.col("image_id") % 4 == 3, first + 6).otherwise(51).cast("int").alias("last_row"), F.when(F.col("image_id") % 7 == 2, 2).otherwise(48).alias("center"))


#: The same relations for DuckDB, as common table expressions.
SQL = {
    "blocks8": "blocks8 AS (SELECT vec_id, label, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i))",
    "mosaics": "mosaics AS MATERIALIZED (SELECT image_id, CAST(ty * 8 + i // 8 AS INTEGER) AS y, CAST(tx * 8 + i % 8 AS INTEGER) AS x, CAST((max(ty) OVER (PARTITION BY image_id) + 1) * 8 AS INTEGER) AS height, CAST(e[i + 1] AS DOUBLE) AS v, CAST(e[64 - i] AS DOUBLE) AS w, CAST(e[(i + 32) % 64 + 1] AS DOUBLE) AS u FROM (SELECT vec_id // 96 AS image_id, vec_id % 96 // 12 AS ty, vec_id % 12 AS tx, embedding AS e, count(*) OVER (PARTITION BY vec_id // 12) AS n FROM embeddings) t, range(64) r(i) WHERE n = 12)",
    "photos": "photos AS MATERIALIZED (SELECT image_id, y, x, height, 110 + o / 2 + 8 * v AS r, 110 - o / 2 + 8 * w AS g, 100 + 30 * u + x % 12 * 3 AS b, 111 + p / 2 + 10 * u AS cr, 110 - p / 2 + 10 * v AS cg, 100 + 28 * w + x % 12 * 3 AS cb FROM (SELECT *, greatest(-30e0, least(30e0, 6 * (abs(x - 47.6e0) - 20 - y / 16e0))) AS o, greatest(-30e0, least(30e0, 6 * (abs(x - 47.9e0) - 20 - y / 16e0))) AS p FROM mosaics))",
    "necklines": "necklines AS (SELECT image_id, CAST(12 + image_id % 3 AS INTEGER) AS first_row, CAST(CASE WHEN image_id % 4 = 3 THEN 18 + image_id % 3 ELSE 51 END AS INTEGER) AS last_row, CASE WHEN image_id % 7 = 2 THEN 2 ELSE 48 END AS center FROM (SELECT DISTINCT vec_id // 96 AS image_id FROM embeddings))",
    "landmarks": "landmarks AS (SELECT vec_id, CAST(k AS INTEGER) AS idx, 240 + 200 * CAST(embedding[2 * k + 1] AS DOUBLE) AS x, 320 + 200 * CAST(embedding[2 * k + 2] AS DOUBLE) AS y FROM embeddings, range(32) t(k))",
    "lines": "lines AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS k FROM lineitem)",
    "boxes": "boxes AS (SELECT l_orderkey AS image_id, k AS det_id, CAST(l_partkey % 40 AS DOUBLE) AS x, CAST(l_suppkey % 40 AS DOUBLE) AS y, CAST(40 + l_partkey % 23 AS DOUBLE) AS w, CAST(40 + l_suppkey % 19 AS DOUBLE) AS h, CAST((7919 * l_partkey + 104729 * l_suppkey + 31 * k) % 1000 AS DOUBLE) / 1000 AS conf FROM lines)",
    "pixels": "pixels AS (SELECT l_orderkey % 100 AS image_id, l_orderkey * 8 + l_linenumber AS i, CAST(floor(l_extendedprice) AS BIGINT) % 256 AS r, (l_partkey * 31 + l_suppkey) % 256 AS g, CAST(floor(l_quantity * 5) AS BIGINT) % 256 AS b, l_returnflag AS label FROM lineitem)",
    "subbands": "subbands AS (SELECT output_id, tile, component, resolution, subband, payload, face, shared, payload - face - shared AS outside FROM (SELECT *, CAST(floor(payload * s / 20.0) AS BIGINT) AS face, CAST(floor(payload * p / 20.0) AS BIGINT) AS shared FROM (SELECT l_orderkey AS output_id, CAST(l_suppkey % 2 AS INTEGER) AS tile, CAST(l_linenumber % 3 AS INTEGER) AS component, CAST(l_linenumber AS INTEGER) AS resolution, CAST(l_partkey % 4 AS INTEGER) AS subband, CAST(floor(l_quantity) AS BIGINT) * 100 + l_partkey % 97 AS payload, l_suppkey % 11 AS s, l_partkey % 7 AS p FROM lineitem)))",
    "rd": "rd AS (SELECT l_orderkey AS block_id, k AS pass_no, CAST(sum(floor(l_quantity)) OVER w AS BIGINT) AS rate, CAST(sum(floor(l_extendedprice / 100)) OVER w AS BIGINT) AS dist FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    "assessments": "assessments AS (SELECT event_id AS id, CAST((event_id * 37) % 101 AS DOUBLE) / 100 AS symmetry, CAST((event_id * 53 + 11) % 101 AS DOUBLE) / 100 AS sharpness, CAST((event_id * 71 + user_id) % 101 AS DOUBLE) / 100 AS geometry, CAST((event_id * 13 + 7) % 100 AS DOUBLE) AS head, CAST(40 + (event_id * 29) % 180 AS DOUBLE) AS ipd FROM events)",
    "reviews": "reviews AS (SELECT l.doc_id AS image, d.source AS reviewer, l.quality = 1 AS agrees, CASE WHEN l.toxic = 1 THEN d.lang END AS override FROM labels l JOIN documents d ON l.doc_id = d.doc_id)",
}
