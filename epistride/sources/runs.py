"""What has become of a plan of runs: states of condition folders, resuming, and roll-ups that a manifest makes valid at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.functions import values as V
from epistride.sources import ingest

MANIFEST = "version long, folder string, inputs string"
TABLES = ("summary", "errors", "aggregate")
_ERROR = "condition_id long, task string, error string"
_CONDITION = r"(.*/([^/]*)/condition_([^/]*))/([^/]*)$"


def _documents(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Documents of condition folders, with source_dir, task_dir, condition and whether each is broken (no JSON object)."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    place = [F.regexp_extract("_metadata.file_path", _CONDITION, i).alias(n) for i, n in ((1, "source_dir"), (2, "task_dir"), (3, "condition"))]
    told = files.select(*place, F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).where("source_dir <> ''")
    told = told.withColumn("condition", F.col("condition").try_cast("long")).select("source_dir", "task_dir", "condition", "r.*")
    return told.withColumn("broken", F.col("_corrupt").isNotNull()).drop("_corrupt")


def states(spark: SparkSession, root: str) -> DataFrame:
    """task_dir, condition, source_dir and state of every condition folder below ``root``.

    complete: its summary can be read; broken: it has one that can't; failed: it has only an error; running: neither.
    Folders are listed by Spark; of files only summaries are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    files = files.select(*[F.regexp_extract("path", _CONDITION, i).alias(n) for i, n in ((1, "source_dir"), (2, "task_dir"), (3, "condition"), (4, "file"))]).where("source_dir <> ''")
    folders = files.groupBy("source_dir", "task_dir", F.col("condition").try_cast("long").alias("condition")).agg(
        F.bool_or(F.col("file") == "summary.json").alias("has_summary"), F.bool_or(F.col("file") == "error.json").alias("has_error")
    )
    broken = _documents(spark, root, "summary.json", ingest.SUMMARY).where("broken").select(F.regexp_replace("source_dir", "^file:/*", "/").alias("at")).distinct().withColumn("bad", F.lit(True))
    state = F.when(F.col("bad"), "broken").when(F.col("has_summary"), "complete").when(F.col("has_error"), "failed").otherwise("running")
    return folders.withColumn("at", F.regexp_replace("source_dir", "^file:/*", "/")).join(broken, "at", "left").select("task_dir", "condition", "source_dir", state.alias("state"))


def pending(work: DataFrame, known: DataFrame, resume: bool = False, overwrite: bool = False) -> DataFrame:
    """The rows of ``work`` (task_dir, condition, ...) that are to be run, with their state (new where there is no folder).

    ``resume``: what is complete is left out, all else is run again. ``overwrite``: everything is. With neither, ValueError if any has a folder.
    A summary that can't be read doesn't count as complete.
    """
    told = work.join(known.select("task_dir", "condition", "state"), ["task_dir", "condition"], "left").withColumn("state", F.coalesce("state", F.lit("new")))
    if overwrite:
        return told
    if resume:
        return told.where("state <> 'complete'")
    taken = told.where("state <> 'new'").limit(1).collect()
    if taken:
        raise ValueError(f"{taken[0].task_dir}/condition {taken[0].condition} is {taken[0].state}: resume or overwrite")
    return told


def roll_up(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """summary (documents that can be read), errors (of folders without such a summary) and aggregate (a row a task folder).

    aggregate counts num_completed, num_success, num_failure, num_error and num_broken (summaries and errors that can't be
    read); success_rate is null where nothing is complete.
    """
    summaries = _documents(spark, root, "summary.json", ingest.SUMMARY)
    good = summaries.where("NOT broken").drop("broken")
    errors = _documents(spark, root, "error.json", _ERROR)
    errors = errors.join(good.select("source_dir"), "source_dir", "left_anti")
    failed = errors.where("NOT broken").drop("broken")
    ok = F.coalesce(V.truth(F.col("success")), F.lit(False))
    kinds = {"completed": F.lit(1), "success": ok.cast("int")}
    each = good.select("task_dir", *[x.alias(k) for k, x in kinds.items()], F.lit(0).alias("error"), F.lit(0).alias("broken"))
    none = [F.lit(0).alias(k) for k in kinds]
    each = each.unionByName(failed.select("task_dir", *none, F.lit(1).alias("error"), F.lit(0).alias("broken")))
    bad = summaries.where("broken").select("task_dir").unionByName(errors.where("broken").select("task_dir"))
    each = each.unionByName(bad.select("task_dir", *none, F.lit(0).alias("error"), F.lit(1).alias("broken")))
    n = {k: F.sum(k).cast("long") for k in ("completed", "success", "error", "broken")}
    aggregate = each.groupBy("task_dir").agg(
        n["completed"].alias("num_completed"), n["success"].alias("num_success"), (n["completed"] - n["success"]).alias("num_failure"), n["error"].alias("num_error"), n["broken"].alias("num_broken"),
        F.when(n["completed"] > 0, n["success"] / n["completed"]).alias("success_rate"),
    )
    return {"summary": good, "errors": failed, "aggregate": aggregate}


def _inputs(spark: SparkSession, root: str) -> str:
    """Tells whether the documents below ``root`` have changed: a digest of their paths, sizes and times."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{summary,error}.json").load(root)
    row = files.select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).first()
    return f"{row.n}:{row.h}"


def _manifest(spark: SparkSession, out: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest").orderBy(F.desc("version")).first()


def write_roll_up(spark: SparkSession, root: str, out: str) -> int:
    """Writes the tables of ``roll_up`` to ``out`` and returns their version; unchanged inputs keep the version that is there.

    The three tables go to a folder of their own, and one row of a manifest, written last, makes them valid together: readers
    see the old tables or the new ones, and a run that was stopped between any two writes is simply run again. Folders that
    the last two manifests don't name are deleted.
    """
    known, inputs = _manifest(spark, out), _inputs(spark, root)
    if known is not None and known.inputs == inputs:
        return known.version
    folder = f"tables-{uuid.uuid4().hex}"
    for name, table in roll_up(spark, root).items():
        table.write.parquet(f"{out}/{folder}/{name}")
    version = known.version + 1 if known is not None else 1
    spark.createDataFrame([(version, folder, inputs)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{out}/manifest")
    _clean(spark, out, {folder} | ({known.folder} if known is not None else set()))
    return version


def _clean(spark: SparkSession, out: str, named: set[str]) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("tables-") and name not in named:
            system.delete(status.getPath(), True)


def read_roll_up(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of the last version written to ``out``; ValueError if there is none."""
    known = _manifest(spark, out)
    if known is None:
        raise ValueError(f"no roll-up in {out}")
    return {name: spark.read.parquet(f"{out}/{known.folder}/{name}") for name in TABLES}
