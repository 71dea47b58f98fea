import json
import math
import os

import pytest

from epistride.operators import features
from epistride.sources import ingest

STEPS = [
    {"depth": [0, 1, 1, 1], "trace": [[[0, 0], [3, 4]]], "parsed_action": [[1, 0, 0, 0, 0, 0, 1]], "env_action": [0, 2, 0, 0, 0, 0, 0], "inference_time_s": 6.5},
    {"depth": "<DEPTH_0><DEPTH_1><DEPTH_2><DEPTH_1>", "trace": [[0, 0], [6, 8], [6, 8]], "parsed_action": [-1, 0, 0, 0, 0, 0, 0], "env_action": [0, 2, 0, 0, 0, 0]},
    {"depth": None, "trace": [], "parsed_action": None, "env_action": [0, 0, 0, 0, 0, 0, 1]},
    {"depth": [5], "trace": [7, 7], "env_action": [0, 1, 0, 0, 0, 0, 1]},
]
INFO = [{"qpos": [0.03]}, {"qpos": 0.3, "is_grasped": True}, {"success": "yes"}, {}]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    os.makedirs(root / "condition_0003")
    lines = [json.dumps({"condition_id": 3, "task": "pick", "step_id": i, "pre_action": p, "post_action": {"reward": 0.5, "terminated": i == 3, "info": INFO[i]}}) for i, p in enumerate(STEPS)]
    (root / "condition_0003" / "steps.jsonl").write_text("\n".join(lines))
    steps = ingest.read_steps(spark, f"file://{root}")
    return features.step_features(ingest.episodes(steps, ingest.read_summaries(spark, f"file://{root}"))).cache()


def test_columns(table):
    assert len(table.columns) == 68 and sum(c.startswith("feat_") for c in table.columns) == 46


def test_values(table):
    a, b, c, d = table.orderBy("step_id").collect()
    assert (a.feat_depth_token_count, a.feat_depth_unique_count, a.feat_depth_hamming_prev) == (4, 2, None)
    assert a.feat_depth_token_entropy == pytest.approx(-(0.25 * math.log2(0.25 + 1e-8) + 0.75 * math.log2(0.75 + 1e-8)))
    assert a.feat_depth_spatial_boundary_ratio == 0.5 and b.feat_depth_hamming_prev == 1 and b.feat_depth_change_ratio_rollmean == 0.25
    assert (c.feat_depth_token_count, c.feat_depth_token_entropy, c.feat_trace_num_points, c.feat_trace_spread) == (0, None, 0, None)
    assert (a.feat_trace_polyline_length, a.feat_trace_straightness, a.feat_trace_spread, b.feat_trace_endpoint_drift_prev) == (5.0, 1.0, 5.0, 5.0)
    assert (b.feat_trace_relplan_drift_prev, b.feat_trace_relplan_drift_norm_prev) == (5.0, 1.0) and b.feat_trace_relplan_cos_prev == pytest.approx(1.0)
    assert b.feat_trace_shape_drift_prev == pytest.approx(2.5) and d.feat_trace_num_points == 1 and d.feat_trace_straightness is None and d.feat_trace_endpoint_drift_prev is None
    assert (b.feat_model_translation_cosine_prev, b.feat_model_translation_direction_flip, b.feat_model_gripper_change_prev) == (-1.0, 1, 1.0)
    assert (b.feat_env_translation_norm, b.feat_env_action_jump_prev_l2, d.feat_env_action_jump_prev_l2, d.feat_env_action_jump_rollmean) == (None, None, 1.0, 1.0)
    assert (a.diag_inference_time_s, b.diag_inference_time_s, a.label_drawer_progress, b.label_drawer_progress) == (6.5, None, pytest.approx(0.2), 1.0)
    assert [r.label_coke_stage for r in (a, b, c, d)] == [0, 1, 4, 4] and a.label_episode_success == 0 and a.episode_key == "pick/condition_0003"


def test_episode_tables(table):
    e = features.episode_table(table).first()
    assert (e.label_coke_max_stage, e.label_coke_ever_grasped, e.label_drawer_max_progress) == (4, 1, 1.0)
    g = features.episode_aggregates(table).first()
    assert g.ep_max__feat_depth_token_count == 4 and len(g) == 2 + 3 * 46
