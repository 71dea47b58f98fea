import json
import os

import pytest
from pyspark.sql import functions as F

from epistride.functions import stats, values
from epistride.operators import labels, models
from epistride.sources import ingest, sinks, walks
from epistride.streaming import online

SF = "/root/testdata/sf0.001"


def step(i, **extra):
    return {"condition_id": 7, "task": "pick", "step_id": i, "pre_action": {"depth": [1, 2, 3], "trace": [[[1, 2], [3, 4]]], "env_action": [0.1] * 7}, "post_action": {"reward": "NaN", "info": {"success": i == 2, "qpos": [0.1 * i]}}} | extra


@pytest.fixture
def root(tmp_path):
    def put(folder, name, text):
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / name).write_text(text)

    put("a/condition_0007", "steps.jsonl", "\n".join(json.dumps(step(i)) for i in range(3)) + "\n\n")
    put("a/condition_0008", "steps.jsonl", "\n".join(json.dumps(step(i, condition_id=8)) for i in (0, 1)))
    put("a/condition_0008", "summary.json", json.dumps({"condition_id": 8, "task": "pick", "num_steps": 2, "max_steps": 80, "success": "yes", "reset_info": {"pose": {"p": [1, 2, 3], "q": [1]}}}))
    put("a/condition_0009", "error.json", json.dumps({"condition_id": 9, "task": "pick", "error": "x"}))
    put("a/condition_0008", "error.json", json.dumps({"condition_id": 8, "task": "pick", "error": "late"}))
    put("a/other", "steps.jsonl", json.dumps(step(0)))
    return f"file://{tmp_path}"


def test_steps_and_episodes(spark, root):
    steps = ingest.require_unique_steps(ingest.read_steps(spark, root), [0, 1])
    got = {(r.episode_key, r.step_id): r for r in ingest.episodes(steps, ingest.read_summaries(spark, root)).collect()}
    assert sorted(got) == [("pick/condition_0007", 0), ("pick/condition_0007", 1), ("pick/condition_0007", 2), ("pick/condition_0008", 0), ("pick/condition_0008", 1)]
    assert got["pick/condition_0007", 0].label_episode_success == 1 and got["pick/condition_0007", 0].label_episode_max_steps == 3
    assert got["pick/condition_0008", 1].label_episode_success == 1 and got["pick/condition_0008", 1].label_episode_max_steps == 80
    with pytest.raises(ValueError, match="missing"):
        ingest.require_unique_steps(steps, [2])


def test_broken_and_repeated_lines(spark, root, tmp_path):
    lines = [json.dumps(step(0)), "{broken", json.dumps(step(0, seed=5)), json.dumps({k: v for k, v in step(9).items() if k != "step_id"})]
    (tmp_path / "a/condition_0007/steps.jsonl").write_text("\n".join(lines))
    with pytest.raises(Exception, match="broken line"):
        ingest.read_steps(spark, root).collect()
    lenient = [(r.step_id, r.seed) for r in ingest.read_steps(spark, root, strict=False).where("source_dir LIKE '%0007'").collect()]
    assert sorted(lenient) == [(0, 5), (2, None)]
    with pytest.raises(ValueError, match="occurs"):
        ingest.require_unique_steps(ingest.read_steps(spark, root, strict=False).union(ingest.read_steps(spark, root, strict=False)))


def test_roll_up_and_resume(spark, root):
    summaries, errors, total = ingest.roll_up(spark, root)
    assert [r.condition_id for r in errors.collect()] == [9] and total.first().completed == 1 and total.first().success_rate == 1.0
    work = spark.range(7, 11).withColumnRenamed("id", "condition_id")
    assert sorted(r[0] for r in ingest.remaining(work, summaries, ["condition_id"]).collect()) == [7, 9, 10]
    assert summaries.select(*ingest.pose("at", F.col("reset_info.pose"))).first().asDict() == {"at_x": 1.0, "at_y": 2.0, "at_z": 3.0}


def test_values(spark):
    rows = [("1", "Yes", "[0.5]", "[[[1,2],[3,4]]]"), ("NaN", "no", "2", "[[1,2]]"), ("x", "maybe", "[1,2]", "[1,2]"), ("", "", None, "[[1,2,3]]"), (None, None, "inf", "[]")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    out = df.select(values.number(F.col("a")), values.truth(F.col("b")), values.truth(F.col("b"), True), values.scalar(F.col("c")), F.size(values.trace(F.col("d"))), F.size(values.trace(F.col("d"), "comparator"))).collect()
    assert [tuple(r) for r in out] == [(1.0, True, True, 0.5, 2, 2), (None, False, False, 2.0, 1, -1), (None, None, False, None, 1, -1), (None, None, None, None, -1, -1), (None, None, None, None, -1, -1)] or [tuple(None if x == -1 else x for x in r) for r in out] == [(1.0, True, True, 0.5, 2, 2), (None, False, False, 2.0, 1, None), (None, None, False, None, 1, None), (None, None, None, None, None, None), (None, None, None, None, None, None)]
    with pytest.raises(ValueError):
        values.require(df, ["z"])
    with pytest.raises(ValueError):
        values.add_new(df, {"a": F.lit(1)})
    with pytest.raises(ValueError):
        values.features_only(["feat_x", "label_y"])
    assert values.existing(df, ["a", "z"]) == (["a"], ["z"])


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, None)], "x int, y string"), spark.createDataFrame([(2.0, 3)], "w double, x int")
    both = sinks.union_all([a, b])
    assert both.columns == ["x", "y", "w"]
    sinks.write_csv(both, f"file://{tmp_path}/t", ["y"])
    back = ingest.read_table(spark, f"file://{tmp_path}/t")
    assert back.columns == ["y", "w", "x"] and back.count() == 2
    assert "sha" not in sinks.metadata(spark, [f"file://{tmp_path}/t"], rows=2) and "| x | y |" in sinks.report("r", {"t": a})


def test_inventories(spark):
    df = spark.createDataFrame([("e", 1, None), ("e", 2, None), ("f", 1, None)], "episode_key string, a int, b string")
    got = {r.field: (r.rows_held, r.episodes_varying, r.coverage) for r in sinks.field_inventory(df, ["a", "b"]).collect()}
    assert got == {"a": (3, 1, "primary"), "b": (0, 0, "empty")}
    docs = spark.createDataFrame([('{"a": {"b": [1, "x"]}, "c": true}',), ("nope",)], "j string")
    paths = {r.path: r.n for r in walks.key_paths(docs, "j").collect()}
    assert paths == {"a": 1, "c": 1, "a.b": 1, "a.b[]": 2}


def test_folds_models_and_exact_p(spark):
    assert labels.fold_runs([(5, 1), (3, 2), (2, 1)], 2) == [(5, 0, 1, [0, 1]), (3, 0, 1, [1]), (3, 1, 2, [1, 0]), (2, 0, 1, [0, 1])]
    p = spark.range(1).select(stats.two_sided_p(F.lit(1.959964))).first()[0]
    assert abs(p - 0.05) < 1e-8
    rows = spark.createDataFrame([(f"e{i % 10}", float(i % 10 >= 5) * 4 + i % 3, int(i % 10 >= 5)) for i in range(200)], "episode_key string, feat_x double, y int")
    scored = models.grouped_oof(rows, ["feat_x"], "y").collect()
    assert len(scored) == 200 and all((r.score > 0.5) == (r.y == 1) for r in scored)
    two = models.clusters(rows, ["feat_x"], 2, tries=2)
    assert models.silhouette(two, ["feat_x"]) > 0.7 and {r.cluster for r in two.where("y = 1").collect()} == {0}


def test_streams(spark, tmp_path):
    events = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/events.parque[t]")
    q = online.write_files(online.causal_features(events), f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    q.awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out")
    from epistride.operators import sequence as S
    from epistride.plans.views import steps

    want = S.running_streak(steps(spark, SF), F.col("value") > 30).withColumn("best", S.best_so_far(F.col("value")))
    assert got.count() == want.count()
    assert got.join(want.select("episode_key", "step_id", F.col("best").alias("b"), F.col("streak").alias("s")), ["episode_key", "step_id"]).where("best <> b OR streak <> s").count() == 0
    w = online.windowed(events).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == want.count()
    s = online.sessions(events).writeStream.format("memory").queryName("s").outputMode("complete").trigger(availableNow=True).start()
    s.awaitTermination()
    assert spark.table("s").agg(F.sum("n")).first()[0] == want.count()
