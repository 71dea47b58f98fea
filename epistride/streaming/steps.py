"""The step feature table on a stream: rows that arrive in any order, in any batch, give what the batch table holds.

A stateful processor puts the rows of an episode in order and hands each on with the raw fields of the three rows before
it; everything else is the column code of ``operators.features``. State is gone after an episode's last step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from epistride.functions import values as V
from epistride.operators import features as X
from epistride.sources import ingest
from epistride.streaming.ordered import InOrder, rocksdb

#: Rows before a row whose raw fields it needs: means go over three rows, each of which looks at the one before.
BEFORE = 3
_OUT = "episode_key string, row string, stage int, " + ", ".join(f"{c}_{k} string" for k in range(1, BEFORE + 1) for c in X.RAW)
_ORDERED = Row(*[c.split()[0] for c in _OUT.split(", ")])


class WithPast(InOrder):
    """Each row with the raw fields of the rows before it and the furthest stage so far."""

    fields = "row string, stage int, " + ", ".join(f"{c} string" for c in X.RAW)
    memory = "stage int"
    start = (0,)
    before = BEFORE

    def emit(self, key, row, past, memo):
        stage = max(memo[0], row[1] or 0)
        none = (None,) * len(X.RAW)
        raw = [x for k in range(BEFORE) for x in (past[k][2:] if k < len(past) else none)]
        return _ORDERED(key[0], row[0], stage, *raw), (stage,)

    def kept(self, row):
        return (None, None, *row[2:])


def read_step_stream(spark: SparkSession, root: str) -> DataFrame:
    """Steps of the condition folders below ``root`` as their files come, with source_dir and ts (the file's time of change); broken lines are left out.

    The episode is known by its first fields alone, since a summary comes last: episode_key is that of task and condition.
    """
    lines = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    path = F.col("_metadata.file_path")
    lines = lines.select("value", F.regexp_extract(path, r"(.*/condition_[^/]*)/[^/]*$", 1).alias("source_dir"), F.col("_metadata.file_modification_time").alias("ts"))
    rows = lines.where("source_dir <> '' AND trim(value) <> ''").select("source_dir", "ts", F.from_json("value", ingest.STEP + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    rows = rows.where("r._corrupt IS NULL").select("source_dir", "ts", "r.*").drop("_corrupt")
    return rows.withColumn("episode_key", F.format_string("%s/condition_%04d", "task", "condition_id"))


def step_features(steps: DataFrame, first: int = 0, patience_s: int = 600, late: str = "10 minutes", points: int = 20) -> DataFrame:
    """The causal columns of ``operators.features.step_features`` for a stream of steps with episode_key and the event time ts.

    The stream must have the columns of ``ingest.STEP``, source_dir and ts. Steps count from ``first``. A row comes out as soon as all before it have, or when its gap is given
    up; rows without a step, repeated steps, rows after the last step and rows later than the watermark are left out. Labels of whole episodes
    are no columns, since they aren't known yet. State is a few rows for each open episode; after a step that is terminated or truncated it is one value, and
    nothing once the watermark has passed it by ``patience_s``.
    """
    rocksdb(steps.sparkSession)
    schema = steps.drop("ts").schema
    post = lambda c: F.coalesce(V.truth(F.col(f"post_action.{c}")), F.lit(False))
    told = steps.withWatermark("ts", late).select(
        "episode_key", "ts", (F.unix_millis("ts")).alias("time"), "step_id", X.stage().alias("stage"), (post("terminated") | post("truncated")).alias("ends"),
        F.to_json(F.struct(*[c for c in steps.columns if c != "ts"])).alias("row"), *[F.col(f"pre_action.{c}").alias(c) for c in X.RAW],
    )
    ordered = told.groupBy("episode_key").transformWithState(WithPast(first, 1000 * patience_s), _OUT, "Append", "EventTime")
    rows = ordered.select(F.from_json("row", schema).alias("r"), "stage", *[f"{c}_{k}" for k in range(1, BEFORE + 1) for c in X.RAW]).select("r.*", "stage", *[f"{c}_{k}" for k in range(1, BEFORE + 1) for c in X.RAW])
    rows = X.parsed(rows, {c: F.col(f"pre_action.{c}") for c in X.RAW}, points)
    for k in range(1, BEFORE + 1):
        rows = X.parsed(rows, {c: F.col(f"{c}_{k}") for c in X.RAW}, points, f"_{k}")
    groups = X.causal("", "_1")
    earlier = [X.causal(f"_{k}", f"_{k + 1}") for k in range(1, BEFORE)]
    after = X.followed() | {"label_coke_stage": F.col("stage")}
    means = {}
    for name, (source, group) in X.ROLLED.items():
        means[name] = F.array(*[g[group][source] for g in reversed(earlier)], groups[group][source])
    identity = ["task", "condition_id", "episode_key", "step_id", "source_dir"]
    out = rows.select(*identity, *[x.alias(c) for of in (*groups, after) for c, x in of.items()], *[F.array_compact(x).alias(c) for c, x in means.items()])
    mean = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c))
    return out.withColumns({c: mean(c) for c in means}).select(X.in_order(groups, identity, list(after)))
