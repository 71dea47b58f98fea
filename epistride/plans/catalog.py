"""Registry of the catalog queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLAGSHIP = "event_value_summary"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Adds a query under ``name``; ``oracle`` is the DuckDB SQL for the same rows."""

    def add(query):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = query
        if oracle:
            ORACLES[name] = oracle
        return query

    return add


@register(
    "event_value_summary",
    """
    SELECT event_type, count(*) AS n, count(value) AS n_values, count(DISTINCT user_id) AS n_users,
           round(avg(value), 6) AS mean_value, round(max(value), 6) AS max_value
    FROM events GROUP BY event_type
    """,
)
def event_value_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("n_values"),
        F.countDistinct("user_id").alias("n_users"),
        F.round(F.avg("value"), 6).alias("mean_value"),
        F.round(F.max("value"), 6).alias("max_value"),
    )
