"""Readers of episode folders: steps.jsonl, summary.json and error.json under condition folders, and CSV tables.

Polymorphic fields are read as JSON text and parsed by functions of ``epistride.functions.values``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistride.functions import values as V

#: Fields of a raw step; those whose form varies are read as text.
INFO = "success string, qpos string, is_grasped string, consecutive_grasp string, lifted_object string, lifted_object_significantly string, all_obj_keep_height string, moved_correct_obj string, moved_wrong_obj string, near_tgt_obj string, is_closest_to_tgt string, elapsed_steps string"
STEP = (
    "condition_id long, task string, step_id long, seed long, instruction string, "
    "pre_action struct<rgb_sha1: string, rgb_path: string, generated_text: string, depth: string, trace: string, parsed_action: string, raw_action: string, processed_action: string, env_action: string, inference_time_s: string>, "
    f"post_action struct<reward: string, terminated: string, truncated: string, predicted_terminated: string, info: struct<{INFO.replace(' string', ': string')}>>"
)
SUMMARY = "condition_id long, task string, num_steps long, max_steps long, success string, stop_reason string, elapsed_s double, reset_info struct<pose: struct<p: array<double>, q: array<double>>>"
_FOLDER = r"(.*/condition_[^/]*)/[^/]*$"


def _files(spark: SparkSession, root: str, name: str):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)


def _in_condition(df: DataFrame) -> DataFrame:
    """Keeps files whose folder begins with condition_, and names the folder."""
    path = F.col("_metadata.file_path")
    return df.withColumn("source_dir", F.regexp_extract(path, _FOLDER, 1)).where("source_dir <> ''")


def read_steps(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """Steps of all condition folders below ``root``, with source_dir and line (from 0, blank lines not counted).

    ``strict``: a broken line raises an error that names the file. Otherwise it is left out, a missing step_id becomes the
    line, and of lines with one step_id the last stays.
    """
    lines = _in_condition(_files(spark, root, "steps.jsonl").text(root)).where("trim(value) <> ''")
    row = F.from_json("value", STEP + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.select("source_dir", F.monotonically_increasing_id().alias("at"), "value", row.alias("r"))
    if strict:
        bad = F.raise_error(F.concat(F.lit("broken line in "), F.col("source_dir"), F.lit(": "), F.substring("value", 1, 80)))
        parsed = parsed.withColumn("r", F.when(F.col("r._corrupt").isNotNull(), bad).otherwise(F.col("r")))
    else:
        parsed = parsed.where("r._corrupt IS NULL")
    names = [f.name for f in T._parse_datatype_string(STEP).fields]
    out = parsed.select("source_dir", (F.row_number().over(Window.partitionBy("source_dir").orderBy("at")) - 1).cast("long").alias("line"), *[F.col(f"r.{n}").alias(n) for n in names])
    if not strict:
        out = out.withColumn("step_id", F.coalesce("step_id", "line"))
        last = Window.partitionBy("source_dir", "step_id").orderBy(F.desc("line"))
        out = out.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    return out


def require_unique_steps(steps: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Raises if a step occurs twice in a folder, or a wanted step is missing in one."""
    twice = steps.groupBy("source_dir", "step_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"step {twice[0].step_id} occurs {twice[0]['count']} times in {twice[0].source_dir}")
    if wanted:
        need = steps.select("source_dir").distinct().withColumn("step_id", F.explode(F.array(*[F.lit(w).cast("long") for w in wanted])))
        missing = need.join(steps, ["source_dir", "step_id"], "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"step {missing[0].step_id} is missing in {missing[0].source_dir}")
    return steps


def read_summaries(spark: SparkSession, root: str, name: str = "summary.json", schema: str = SUMMARY) -> DataFrame:
    """Documents of condition folders by source_dir; broken ones have nothing but their folder."""
    df = _files(spark, root, name).schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(root)
    return _in_condition(df.select("*", "_metadata"))


def episodes(steps: DataFrame, summaries: DataFrame) -> DataFrame:
    """Steps with their episode: ids from the summary, else from the first step; success from it, else from the last step."""
    s = summaries.select("source_dir", F.col("condition_id").alias("s_id"), V.truth(F.col("success")).alias("s_success"), F.col("num_steps").alias("s_steps"), F.col("max_steps").alias("s_max"))
    part = Window.partitionBy("source_dir")
    first = F.min_by("condition_id", "step_id").over(part)
    last = F.max_by("post_action.info.success", "step_id").over(part)
    n = F.count(F.lit(1)).over(part)
    out = steps.join(s, "source_dir", "left").withColumn("condition_id", F.coalesce("s_id", first))
    ok = F.coalesce("s_success", V.truth(last), F.lit(False))
    out = out.withColumn("label_episode_success", ok.cast("int")).withColumn("label_episode_failure", (~ok).cast("int"))
    out = out.withColumn("label_episode_num_steps", F.coalesce("s_steps", n)).withColumn("label_episode_max_steps", F.coalesce("s_max", F.col("label_episode_num_steps")))
    key = F.format_string("%s/condition_%04d", "task", "condition_id")
    return out.withColumn("episode_key", key).drop("s_id", "s_success", "s_steps", "s_max")


def pose(prefix: str, column: Column) -> list[Column]:
    """First three places of a pose as columns; null where there are fewer."""
    return [F.when(F.size(column["p"]) >= 3, F.get(column["p"], F.lit(i))).alias(f"{prefix}_{c}") for i, c in enumerate("xyz")]


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header: typed by a schema, else all text."""
    reader = spark.read.option("header", True).option("nullValue", "").option("nanValue", "nan")
    return (reader.schema(schema) if schema else reader).csv(path)


def roll_up(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summaries that can be read, errors of conditions without one, and counts by task."""
    summaries = read_summaries(spark, root).where("condition_id IS NOT NULL")
    errors = read_summaries(spark, root, "error.json", "condition_id long, task string, error string").where("condition_id IS NOT NULL")
    errors = errors.join(summaries.select("task", "condition_id"), ["task", "condition_id"], "left_anti")
    ok = V.truth(F.col("success"))
    total = summaries.groupBy("task").agg(F.count(F.lit(1)).alias("completed"), F.count_if(ok).alias("successes"), F.avg(F.coalesce(ok, F.lit(False)).cast("double")).alias("success_rate"))
    return summaries, errors, total


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that isn't complete yet."""
    return work.join(done, keys, "left_anti")
