"""The step features of a stream equal the batch table, whatever the order and batches of its rows."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from epistride.operators import features
from epistride.sources import ingest
from epistride.streaming import steps as T


def step(rng, condition, i, n):
    maybe = lambda x: rng.choice([x, x, x, None])
    pre = {
        "depth": maybe([rng.randrange(4) for _ in range(9)]), "trace": maybe([[[rng.random() * 9, rng.random() * 9] for _ in range(rng.randrange(1, 6))]]),
        "parsed_action": maybe([[rng.uniform(-1, 1) for _ in range(7)]]), "env_action": maybe([rng.uniform(-1, 1) for _ in range(7)]), "inference_time_s": rng.random(),
    }
    info = {"success": i == n - 1 and condition % 2 == 0, "qpos": [rng.random() / 4], "is_grasped": rng.random() < 0.3, "lifted_object": rng.random() < 0.1}
    return {"condition_id": condition, "task": "drawer", "step_id": i, "seed": 1, "pre_action": pre, "post_action": {"reward": rng.random(), "terminated": i == n - 1 and condition != 3, "truncated": False, "info": info}}


@pytest.fixture
def made(tmp_path):
    """Steps of four episodes (one without an end), whole for the batch and in shuffled pieces for the stream."""
    rng = random.Random(7)
    pieces: list[list[tuple[int, str]]] = [[] for _ in range(5)]
    for condition in range(4):
        n = rng.randrange(6, 14)
        lines = [json.dumps(step(rng, condition, i, n)) for i in range(n)]
        folder = tmp_path / "whole" / f"condition_{condition:04d}"
        os.makedirs(folder)
        (folder / "steps.jsonl").write_text("\n".join(lines))
        for line in lines:
            pieces[rng.randrange(5)].append((condition, line))
        pieces[rng.randrange(5)].append((condition, lines[0]))  # a repeated row
    return tmp_path, pieces


def put(tmp_path, number, piece):
    rng = random.Random(number)
    rng.shuffle(piece)
    for condition in {c for c, _ in piece}:
        folder = tmp_path / "live" / f"condition_{condition:04d}"
        os.makedirs(folder, exist_ok=True)
        (folder / f"steps-{number}.jsonl").write_text("\n".join([*(line for c, line in piece if c == condition), "{broken"]))


def run(spark, tmp_path, **options):
    out = T.step_features(T.read_step_stream(spark, f"file://{tmp_path}/live"), **options)
    q = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def held(spark, tmp_path, name):
    return spark.read.format("statestore").option("path", f"file://{tmp_path}/c").option("stateVarName", name).load().count()


def test_a_shuffled_and_restarted_stream_gives_the_batch_table(spark, made):
    tmp_path, pieces = made
    os.makedirs(tmp_path / "live")
    for number, piece in enumerate(pieces):  # a restart after each piece
        put(tmp_path, number, piece)
        run(spark, tmp_path)
    batch = ingest.read_steps(spark, f"file://{tmp_path}/whole")
    want = features.step_features(ingest.episodes(batch, ingest.read_summaries(spark, f"file://{tmp_path}/whole")))
    got = spark.read.parquet(f"file://{tmp_path}/out")
    same = [c for c in want.columns if c in got.columns and c != "source_dir"]
    assert sum(c.startswith("feat_") for c in same) == 46 and len(same) == len(want.columns) - 5
    a, b = ({(r.episode_key, r.step_id): r for r in x.select(same).collect()} for x in (got, want))
    assert len(a) == got.count() and a == b
    # Three episodes have ended; only the fourth keeps rows.
    assert held(spark, tmp_path, "before") == 3 and held(spark, tmp_path, "early") == 0
    assert got.select("source_dir").distinct().count() == 4


def test_gaps_are_given_up_after_a_while(spark, tmp_path):
    rng = random.Random(1)
    os.makedirs(tmp_path / "live" / "condition_0005")

    def arrives(name, steps, minutes):
        path = tmp_path / "live" / "condition_0005" / name
        path.write_text("\n".join(json.dumps(step(rng, 5, i, 99)) for i in steps))
        os.utime(path, (1_700_000_000 + 60 * minutes,) * 2)
        run(spark, tmp_path, patience_s=120, late="0 seconds")

    arrives("a.jsonl", [0, 1, 3], 0)
    got = lambda: sorted(r.step_id for r in spark.read.parquet(f"file://{tmp_path}/out").select("step_id").collect())
    assert got() == [0, 1] and held(spark, tmp_path, "early") == 1
    arrives("b.jsonl", [6], 10)  # later than patience: 2 is given up, 6 waits for 4 and 5
    assert got() == [0, 1, 3]
    arrives("c.jsonl", [4, 2, 5], 11)  # 2 comes too late
    assert got() == [0, 1, 3, 4, 5, 6] and held(spark, tmp_path, "early") == 0
    with (tmp_path / "live" / "condition_0005" / "d.jsonl").open("w") as f:
        f.write(json.dumps(step(rng, 5, 7, 8)))
    os.utime(tmp_path / "live" / "condition_0005" / "d.jsonl", (1_700_000_000 + 60 * 12,) * 2)
    run(spark, tmp_path, patience_s=120, late="0 seconds")
    assert got()[-1] == 7 and held(spark, tmp_path, "before") == 0 and held(spark, tmp_path, "at") == 1
    arrives("e.jsonl", [7, 0], 30)  # of an episode that has ended; its time clears the value
    os.makedirs(tmp_path / "live" / "condition_0006")
    (tmp_path / "live" / "condition_0006" / "a.jsonl").write_text(json.dumps(step(rng, 6, 0, 1)))
    os.utime(tmp_path / "live" / "condition_0006" / "a.jsonl", (1_700_000_000 + 60 * 60,) * 2)
    run(spark, tmp_path, patience_s=120, late="0 seconds")
    assert held(spark, tmp_path, "at") == 1 and len(got()) == 8
    row = spark.read.parquet(f"file://{tmp_path}/out").where(F.col("step_id") == 3).first()
    assert row.label_coke_stage is not None


def test_online_alerts_are_those_of_the_batch(spark, tmp_path):
    """Scores of events, shuffled and split over batches and restarts, against the detectors of the batch."""
    from pyspark.sql import Window

    from epistride.operators import labels as L
    from epistride.plans.views import steps
    from epistride.streaming.alerts import DETECTORS, alerts

    rows = steps(spark, "/root/testdata/sf0.001").where("episode_key < 12").select(
        F.col("episode_key").cast("string").alias("episode_key"), (F.col("episode_key") % 3).cast("int").alias("fold"), "step_id", F.when(F.col("step_id") % 7 != 3, F.col("value") / 1000).alias("score")
    )
    rows = rows.withColumn("ends", F.col("step_id") == F.max("step_id").over(Window.partitionBy("episode_key"))).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("step_id"))).cache()
    thresholds = spark.createDataFrame([(0, 0.05), (1, 0.08)], "fold int, threshold double")  # none for fold 2
    parts = rows.withColumn("part", F.pmod(F.xxhash64("episode_key", "step_id"), F.lit(4)))
    for part in range(4):
        parts.where(F.col("part") == part).drop("part").orderBy(F.rand(part)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
        out = alerts(stream, thresholds, late="1 hour", patience_s=3600)
        out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out")
    each = rows.join(thresholds, "fold", "left")
    want = each.withColumns(L.detector_alerts(F.col("score"), F.col("threshold"), Window.partitionBy("episode_key").orderBy("step_id")))
    columns = ["episode_key", "step_id", *DETECTORS]
    a, b = (sorted(tuple(r) for r in x.select(columns).collect()) for x in (got, want))
    assert a == b and all(any(r[2 + i] for r in a) for i in range(3))
    fired = {}
    for r in sorted(got.collect(), key=lambda r: r.step_id):
        before = fired.setdefault(r.episode_key, set())
        new = [d for d in DETECTORS if r[d] and d not in before]
        assert (r["first"] or "") == ",".join(new)
        fired[r.episode_key] |= set(new)
    assert held(spark, tmp_path, "memo") == 0 and held(spark, tmp_path, "before") == 0
