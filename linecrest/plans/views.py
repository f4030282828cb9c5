"""Deterministic views that stand for voxel data over the driver's tables, in Spark and as SQL with the same rows.

raw_voxels: lineitem rows as raw slices of a 16 x 16 x 8 grid, with off-grid and half coordinates. voxels: rounded, in
the grid, the last row of each. slices: a (group, day) of events each. logits: embeddings as scorer outputs. paths: file
names of the slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linecrest.functions import columns as C
from linecrest.operators import voxels as V
from linecrest.params import Detection, Grid

GRID = Grid(16, 16, 8)
#: Scores of the view are ten times what real ones are, and so are its thresholds.
CANDIDATES = Detection(line_weak=0.4, line_strong=0.6, pole_candidate=0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    df = df.withColumn("group_id", F.concat("l_returnflag", "l_linestatus")).withColumn("slice_seq", F.floor(F.col("l_orderkey") / 500).cast("long"))
    order = Window.partitionBy("group_id", "slice_seq").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return df.select(
        "group_id",
        "slice_seq",
        F.row_number().over(order).cast("long").alias("source_row"),
        (F.col("l_partkey") % 17 + (F.col("l_linenumber") - 4) / 8.0).cast("double").alias("x"),
        ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 17 + 0.25).cast("double").alias("y"),
        (F.col("l_quantity").cast("int") % 9 + (F.col("l_linenumber") % 3 - 1) * 0.5).cast("double").alias("z"),
        (F.col("l_discount") * 10).cast("double").alias("line_score"),
        (F.col("l_tax") * 10).cast("double").alias("pole_score"),
        (F.col("l_orderkey") % 4).cast("int").alias("label"),
        F.col("l_extendedprice").cast("double").alias("dist_center_ft"),
    )


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.keep_last(V.quantize(raw_voxels(spark, sf_dir), GRID))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, slice_seq, event_id and value (as milliseconds)."""
    df = table(spark, sf_dir, "events")
    return df.select((F.col("user_id") % 5).cast("long").alias("group_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("slice_seq"), "event_id", "event_type", F.col("value").cast("double").alias("value"), "user_id")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [(F.get("embedding", F.lit(i)).cast("double") * 4).alias(n) for i, n in enumerate(("s0", "s1", "s2", "pole_logit", "line_logit", "object_logit"))]
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).cast("int").alias("label"), *e)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = logits(spark, sf_dir)
    pole, line = C.fused_scores([F.col("s0"), F.col("s1"), F.col("s2")], F.col("pole_logit"), F.col("line_logit"), F.col("object_logit"))
    return df.select("vec_id", "label", F.round(pole, 9).alias("pole_score"), F.round(line, 9).alias("line_score"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = slices(spark, sf_dir)
    return df.select(F.concat(F.lit("Geo"), F.col("user_id") % 3, F.lit("/session"), "group_id", F.lit("_slice"), "slice_seq", F.lit("/f.csv")).alias("path")).distinct()


RAW_SQL = """raw_voxels AS (
  SELECT l_returnflag || l_linestatus AS group_id, CAST(floor(l_orderkey / 500.0) AS BIGINT) AS slice_seq,
    row_number() OVER (PARTITION BY l_returnflag || l_linestatus, CAST(floor(l_orderkey / 500.0) AS BIGINT)
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS source_row,
    CAST(l_partkey % 17 + (l_linenumber - 4) / 8.0 AS DOUBLE) AS x,
    CAST((l_suppkey * 7 + l_linenumber) % 17 + 0.25 AS DOUBLE) AS y,
    CAST(CAST(l_quantity AS INTEGER) % 9 + (l_linenumber % 3 - 1) * 0.5 AS DOUBLE) AS z,
    CAST(l_discount AS DOUBLE) * 10 AS line_score, CAST(l_tax AS DOUBLE) * 10 AS pole_score,
    CAST(l_orderkey % 4 AS INTEGER) AS label, CAST(l_extendedprice AS DOUBLE) AS dist_center_ft
  FROM lineitem
), in_grid AS (
  SELECT * EXCLUDE (x, y, z, label), CAST(round_even(x, 0) AS INTEGER) AS x, CAST(round_even(y, 0) AS INTEGER) AS y,
    CAST(round_even(z, 0) AS INTEGER) AS z, CASE WHEN label IN (0, 1, 2) THEN label ELSE -100 END AS label
  FROM raw_voxels WHERE round_even(x, 0) BETWEEN 0 AND 15 AND round_even(y, 0) BETWEEN 0 AND 15 AND round_even(z, 0) BETWEEN 0 AND 7
)"""
VOXELS_SQL = RAW_SQL + """, voxels AS (
  SELECT * FROM in_grid QUALIFY row_number() OVER (PARTITION BY group_id, slice_seq, x, y, z ORDER BY source_row DESC) = 1
)"""
SLICES_SQL = """slices AS (
  SELECT CAST(user_id % 5 AS BIGINT) AS group_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS slice_seq,
    event_id, event_type, CAST(value AS DOUBLE) AS value, user_id FROM events
)"""
SCORED_SQL = """logits AS (
  SELECT vec_id, CAST(label % 3 AS INTEGER) AS label, CAST(embedding[1] AS DOUBLE) * 4 AS s0, CAST(embedding[2] AS DOUBLE) * 4 AS s1,
    CAST(embedding[3] AS DOUBLE) * 4 AS s2, CAST(embedding[4] AS DOUBLE) * 4 AS p, CAST(embedding[5] AS DOUBLE) * 4 AS l, CAST(embedding[6] AS DOUBLE) * 4 AS o FROM embeddings
), powers AS (
  SELECT *, exp(s0 - greatest(s0, s1, s2)) AS e0, exp(s1 - greatest(s0, s1, s2)) AS e1, exp(s2 - greatest(s0, s1, s2)) AS e2 FROM logits
), scored AS (
  SELECT vec_id, label,
    round(greatest(0, least(1, 0.55::DOUBLE * (e1 / (e0 + e1 + e2)) + 0.35::DOUBLE * (1 / (1 + exp(-p))) + 0.10::DOUBLE * (1 / (1 + exp(-o))))), 9) AS pole_score,
    round(greatest(0, least(1, 0.55::DOUBLE * (e2 / (e0 + e1 + e2)) + 0.35::DOUBLE * (1 / (1 + exp(-l))) + 0.10::DOUBLE * (1 / (1 + exp(-o))))), 9) AS line_score
  FROM powers
)"""
PATHS_SQL = SLICES_SQL + """, paths AS (
  SELECT DISTINCT 'Geo' || (user_id % 3) || '/session' || group_id || '_slice' || slice_seq || '/f.csv' AS path FROM slices
)"""
LABEL_SQL = "CASE WHEN pole_score >= {p} AND (line_score < {l} OR pole_score >= line_score) THEN 1 WHEN line_score >= {l} THEN 2 ELSE 0 END"
