"""Writers: CSV tables, metadata beside them, reports, and inventories of fields."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables; columns in the order in which they first occur, gaps are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, first: list[str] | None = None, mode: str = "error") -> None:
    """A CSV table with a header: preferred columns first and the rest sorted, or the order of the frame. Null is empty."""
    columns = df.columns if first is None else [c for c in first if c in df.columns] + sorted(c for c in df.columns if c not in first)
    df.select(columns).write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def digest_of_files(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of each file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return {r.path: r.sha for r in files.select("path", F.sha2("content", 256).alias("sha")).collect()}  # one row per input file named by the caller


def metadata(spark: SparkSession, inputs: list[str], **facts) -> str:
    """JSON text about a run: its facts, time and the digests of its inputs."""
    return json.dumps({"created_utc": datetime.now(UTC).isoformat(), "inputs": {k: v for p in inputs for k, v in digest_of_files(spark, p).items()}, **facts}, sort_keys=True, default=str)


def write_metadata(spark: SparkSession, path: str, inputs: list[str], **facts) -> None:
    """Writes ``metadata`` beside a table, as one line of JSON in a folder."""
    spark.createDataFrame([(metadata(spark, inputs, **facts),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def table_text(df: DataFrame, most: int = 1000) -> str:
    """Rows of a small table as aligned text; a last line tells if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    cells = [df.columns, *[["" if v is None else str(v) for v in r] for r in rows[:most]]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = [" ".join(v.rjust(w) for v, w in zip(r, widths, strict=True)) for r in cells]
    return "\n".join([*lines, *["(more rows)"] * (len(rows) > most)])


def write_report(spark: SparkSession, path: str, title: str, tables: dict[str, DataFrame]) -> None:
    """Writes ``report`` as a text file in a folder."""
    spark.createDataFrame([(report(title, tables),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def report(title: str, tables: dict[str, DataFrame]) -> str:
    """A Markdown report of small result tables, with all their rows: aggregate before reporting."""
    parts = [f"# {title}"]
    for name, df in tables.items():
        rows = df.collect()
        cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
        parts += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    return "\n".join(parts) + "\n"


def field_inventory(rows: DataFrame, fields: list[str], episode: str = "episode_key") -> DataFrame:
    """Per field: rows and episodes that have it, episodes in which it varies, distinct values, least and most, and a label of its coverage.

    Numbers are compared as numbers and also have a mean and a deviation; all values are told as text.
    """
    long = rows.select(episode, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("x")).select(episode, "x.*")
    x = F.try_cast("v", "double") if hasattr(F, "try_cast") else F.col("v").try_cast("double")
    long = long.withColumn("x", x)
    each = long.groupBy("field", episode).agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("held"), F.count_distinct("v").alias("d"))
    numeric = F.count("v") == F.count("x")
    ends = {n: F.when(numeric, by(F.col("v"), F.col("x"))).otherwise(of("v")) for n, by, of in (("least", F.min_by, F.min), ("most", F.max_by, F.max))}
    values = long.groupBy("field").agg(F.count_distinct("v").alias("n_values"), *[c.alias(n) for n, c in ends.items()], F.when(numeric, F.avg("x")).alias("mean"), F.when(numeric, F.stddev_samp("x")).alias("std"))
    out = each.groupBy("field").agg(F.sum("n").alias("rows"), F.sum("held").alias("rows_held"), F.count_if(F.col("held") > 0).alias("episodes_held"), F.count_if(F.col("d") > 1).alias("episodes_varying"))
    share = F.col("rows_held") / F.col("rows")
    return out.join(values, "field").withColumn("coverage", F.when(share > 0.8, "primary").when(share > 0, "sparse").otherwise("empty"))
