import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from epistride.functions import stats
from epistride.operators import addons, labels, models, progress, tables
from epistride.plans import catalog, library  # noqa: F401
from epistride.sources import sinks, walks

TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations pages".split()


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"file://{root}/{t}.parquet")
    return f"file://{root}"


def test_every_query_of_the_catalog_stands_empty_tables(spark, nothing):
    for name, query in catalog.QUERIES.items():
        rows = query(spark, nothing).collect()
        assert len(rows) <= 75, name


def test_sums_before_whatever_the_group(spark):
    rng = np.random.default_rng(0)
    rows = [(g, int(k), int(rng.integers(0, 9))) for g in ("a", None) for k in rng.permutation(3000)] + [("b", 5, 2)]
    data = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    for r in stats.sums_before(data, ["g"], "k", ["v"]).collect():
        r = r.asDict()
        own = [x for x in rows if x[0] == r["g"]] if r["k"] % 500 == 0 else None
        if own:
            assert r["before_v"] == sum(x[2] for x in own if x[1] < r["k"]) and r["all_v"] == sum(x[2] for x in own)
    texts = spark.createDataFrame([(f"k{i}",) for i in range(50)], "key string")
    assert [r.i for r in stats.numbered(texts, [], "key").orderBy("key").collect()] == list(range(50))


def greedy(sizes, folds):
    load, out = [0] * folds, {}
    for key, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        fold = min(range(folds), key=lambda f: (load[f], f))
        out[key] = fold
        load[fold] += n
    return out


def test_folds_go_one_by_one_to_the_emptiest(spark):
    rng = np.random.default_rng(1)
    for most in (2, 9, 60):
        sizes = [(int(k), int(n)) for k, n in enumerate(rng.integers(1, most, 120))] + [(500, 700), (501, 3)]
        rows = spark.createDataFrame([(k,) for k, n in sizes for _ in range(n)], "episode_key long")
        got = {r.episode_key: r.fold for r in labels.with_folds(rows, "episode_key", 5).distinct().collect()}
        assert got == greedy(sizes, 5)
    assert labels.with_folds(rows.limit(0), "episode_key").count() == 0
    assert len(labels.fold_runs([(10**9, 1), (1, 10**10)])) < 10


def test_pick_progress_by_hand(spark):
    kind = "episode_key string, step_id long, episode_success boolean, gt_is_grasped boolean, gt_lifted_object boolean, gt_lifted_object_significantly boolean, gt_success boolean, gt_object_init_x double, gt_object_init_y double"
    a = [("a", i, False, g, l, False, None, 3.0 if i == 0 else None, 4.0) for i, (g, l) in enumerate([(False, False), (True, False), (True, True), (None, False), (True, False)])]
    rows = spark.createDataFrame([*a, ("b", 0, True, None, None, None, True, None, 1.0)], kind)
    out = progress.pick_progress(rows).orderBy("episode_key", "step_id").collect()
    assert [r.gt_pick_phase for r in out] == [0, 1, 2, 0, 1, 4] and [r.gt_pick_phase_change for r in out] == [0, 1, 1, 1, 1, 0]
    assert [r.gt_grasp_streak for r in out] == [0, 1, 2, 0, 1, 0] and [r.gt_time_since_first_grasp for r in out] == [None, 0, 1, 2, 3, None]
    assert out[0].control_init_object_xy_radius == 5.0 and out[5].control_init_object_xy_radius is None
    assert {r.failure_mode_primary for r in out} == {"lifted_but_not_significantly_lifted", "success"}
    each = {r.episode_key: r for r in progress.episodes_of(progress.pick_progress(rows)).collect()}
    assert (each["a"].num_steps, each["a"].gt_grasp_duration_steps, each["a"].gt_first_lift_step, each["b"].episode_success) == (5, 3, 2, 1)


def test_move_progress_by_hand(spark):
    kind = "episode_key string, step_id long, episode_success boolean, gt_moved_correct_obj boolean, gt_near_tgt_obj boolean, gt_all_obj_keep_height boolean, gt_success boolean, " + ", ".join(f"gt_{s}_init_{c} double" for s in ("source", "target") for c in "xyz")
    at = (0.0, 0.0, 0.0, 2.0, 1.0, 2.0)
    rows = [("a", 0, False, True, False, True, False, *at), ("a", 1, False, True, False, None, False, *at), ("b", 0, False, False, False, False, False, *at[:5], None)]
    out = progress.move_progress(spark.createDataFrame(rows, kind)).orderBy("episode_key", "step_id").collect()
    assert [r.gt_height_violation for r in out] == [0, 1, 1] and [r.failure_mode_primary for r in out] == ["transport_not_completed"] * 2 + ["height_violation"]
    assert out[0].control_init_source_target_distance == 3.0 and out[2].control_init_source_target_dx is None
    assert (out[2].failure_mode_no_correct_move, out[2].failure_mode_height_violation, out[1].gt_correct_move_fraction) == (1, 1, 1.0)


def test_clusters_side_by_side(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(c + rng.normal() * 0.1), float(rng.normal() * 0.1)) for i, c in enumerate([0, 5, 9] * 40)] + [(999, None, 1.0)]
    data = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r.id: r.cluster for r in models.clusters(data, ["a", "b"], 3, 20).collect()}
    assert got.pop(999) is None and all(got[i] == 2 - i % 3 for i in got)
    one = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0)], "id long, a double, b double")
    assert {r.cluster for r in models.clusters(one, ["a", "b"], 2).collect()} == {0}
    assert models.clusters(data.limit(0), ["a"], 2).count() == 0
    best = max(models.cluster_quality(data.where("a IS NOT NULL"), ["a", "b"], tries=10).collect(), key=lambda r: r.silhouette)
    assert (best.k, best.cluster_sizes, best.eligible) == (3, "40;40;40", True)


def test_trace_depth_and_geometry_by_hand(spark):
    grid = [float(i % 4) for i in range(16)]  # depth grows to the right
    far = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [("a", 0, far((0, 0), (255, 0)), grid), ("a", 1, far((0, 0), (170, 0), (85, 0)), grid), ("a", 3, far((0, 0)), grid), ("a", 4, None, grid)]
    data = spark.createDataFrame(rows, "episode_key string, step_id long, trace array<struct<x: double, y: double>>, depth array<double>")
    out = addons.trace_depth(data, 4, 4).orderBy("step_id").collect()
    s = np.std(grid)
    assert math.isclose(out[0].feat_trace_depth_range_norm, 3 / s) and math.isclose(out[0].feat_trace_depth_gradient_norm, 3 / 19 / s)
    assert out[0].feat_trace_endpoint_depth_percentile == 1.0 and out[1].feat_trace_endpoint_depth_percentile == 0.5
    assert [r.feat_trace_endpoint_depth_percentile_drift_prev for r in out] == [None, 0.5, None, None] and [r.diag_trace_endpoint_depth_raw for r in out] == [3.0, 1.0, 0.0, None]
    got = addons.drawer_geometry(data, 4, 4, F.col("step_id") == 0).orderBy("step_id").collect()
    assert [r.feat_trace_direction_alignment for r in got] == [1.0, 1.0, None, None]
    assert got[0].feat_trace_backtracking_ratio == 0.0 and math.isclose(got[1].feat_trace_backtracking_ratio, 1 / 3)
    assert [r.feat_trace_depth_sign_change_count for r in got] == [0.0, 1.0, None, None]
    assert math.isclose(got[0].feat_trace_endpoint_vs_background_depth_contrast, 1.5 / s) and math.isclose(got[1].feat_trace_endpoint_vs_drawer_front_depth_contrast, -1 / s)
    drift = addons.plan_drift(data).orderBy("step_id").collect()
    assert [r.feat_trace_endpoint_drift_h1 for r in drift] == [None, 170.0, None, None] and math.isclose(drift[1].feat_trace_endpoint_cos_h1, 1.0)
    assert addons.drawer_geometry(data.limit(0), 4, 4, F.lit(True)).count() == 0


def test_motion_without_gripper(spark):
    names = [f"feat_{k}_{p}_jump_prev_l2" for k in ("model", "env") for p in ("translation", "rotation")]
    rows = spark.createDataFrame([("a", 0, 0.1, 0.2, 3.0, 4.0, None, 1.0), ("a", 1, 0.3, 0.1, 0.0, 2.0, 5.0, 12.0)], ["episode_key", "step_id", "post_drawer_qpos", "label_drawer_progress", *names])
    out = addons.action_mechanism(rows).orderBy("step_id").collect()
    assert (out[0].qpos_delta, out[0].model_motion_jump_no_gripper, out[0].env_motion_jump_no_gripper, out[1].env_motion_jump_no_gripper) == (None, 5.0, None, 13.0)
    assert math.isclose(out[1].qpos_delta, 0.2) and math.isclose(out[1].progress_delta, -0.1)


def test_guards(spark):
    left, right = spark.range(5).withColumn("a", F.lit(1)), spark.range(4).withColumn("b", F.lit(1))
    with pytest.raises(ValueError):
        tables.checked_join(left, right, ["id"])
    with pytest.raises(ValueError):
        tables.checked_join(left, left.union(left).withColumnRenamed("a", "b"), ["id"])
    assert tables.checked_join(left, left.withColumnRenamed("a", "b"), ["id"]).count() == 5
    with pytest.raises(ValueError):
        tables.renamed(left, {"none": "x"})
    assert tables.renamed(left.withColumn("b", F.lit(2)), {"a": "b", "b": "a"}).first().asDict() == {"id": 0, "b": 1, "a": 2}
    assert tables.bounded("bins", 5, 5) == 5
    with pytest.raises(ValueError):
        tables.bounded("bins", 4, 5)
    assert [r.t for r in spark.createDataFrame([(0.256,), (None,)], "x double").select(tables.percent(F.col("x")).alias("t")).collect()] == ["25.6%", "-"]


def test_inventories(spark, tmp_path):
    rows = spark.createDataFrame([(1, 9.0, "b"), (1, 10.0, None), (2, None, "a")], "episode_key int, x double, t string")
    found = {r.field: r for r in sinks.field_inventory(rows, ["x", "t"]).collect()}
    assert (found["x"].least, found["x"].most, found["x"].mean) == ("9.0", "10.0", 9.5) and (found["t"].least, found["t"].most, found["t"].mean) == ("a", "b", None)
    deep = '{"a": ' * 9 + "[1, 2, 2, 5, 7]" + "}" * 9
    paths = {r.path: (r.n, r.examples) for r in walks.key_paths(spark.createDataFrame([(deep,), ("no",)], "j string"), "j").collect()}
    assert paths[".".join("a" * 9)] == (1, []) and paths[".".join("a" * 9) + "[]"] == (5, ["1", "2", "5"])
    assert len(sinks.report("t", {"x": spark.range(300)}).splitlines()) == 306 and sinks.table_text(spark.range(3), 2).splitlines() == ["id", " 0", " 1", "(more rows)"]
    sinks.write_report(spark, f"file://{tmp_path}/r", "t", {"x": rows})
    sinks.write_metadata(spark, f"file://{tmp_path}/m", [], seed=1)
    assert "## x" in spark.read.text(f"file://{tmp_path}/r", wholetext=True).first()[0] and "seed" in spark.read.text(f"file://{tmp_path}/m").first()[0]


def test_digits_beyond_doubles_are_bad_in_query_and_sql(spark, tmp_path):
    texts = ["12 of 3", "1" * 309, "1" * 310, "9" * 400 + " x", "0" * 400 + "1", "1.2.3", ".", "", None, "0." + "1" * 400]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.bad for r in catalog.QUERIES["numeric_coercion"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == {i: bad for i, bad, _ in db.execute(catalog.ORACLES["numeric_coercion"]).fetchall()}
    assert [got[i] for i in range(len(texts))] == [False, False, True, True, False, True, True, True, True, False]
