"""Episode and step views over the star-schema tables, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Progress is value over this constant, at most 1.
PROGRESS_SCALE = 300.0

#: The step view for DuckDB; queries go on after it.
STEPS = """
WITH steps AS (
  SELECT user_id AS episode_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step_id,
         concat('t', user_id % 3) AS task, event_type, value, least(value / 300.0, 1.0) AS p,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events)
"""

#: Points of vectors for DuckDB: 32 rows of x, y for each vector of 64.
POINTS = """
WITH pts AS (
  SELECT vec_id, label, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y
  FROM embeddings, range(32) t(i))
"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: its user is the episode, its place in time the step."""
    place = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode_key"),
        (F.row_number().over(place) - 1).cast("long").alias("step_id"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("task"),
        "event_type",
        "value",
        F.least(F.col("value") / PROGRESS_SCALE, F.lit(1.0)).alias("p"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as doubles, as polylines of points and as grids of tokens."""
    v = F.col("v")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    trace = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda i: F.struct(F.get(v, 2 * i).alias("x"), F.get(v, 2 * i + 1).alias("y")))
    return rows.withColumn("trace", trace).withColumn("tokens", F.transform(v, lambda x: F.floor((x + 1) * 32).cast("int")))

WINDOW_SQL = "WINDOW w AS (PARTITION BY episode_key ORDER BY step_id)"
