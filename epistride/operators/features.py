"""The step feature table: causal features of depth tokens, traces and actions, with labels from what followed the action.

Columns by role: identity, label_*, feat_* (only what a policy could know at the step), diag_* and post_*. All windows are over
one episode in order of steps, so the whole table needs one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistride.functions import arrays as A
from epistride.functions import values as V
from epistride.operators import sequence as S

#: Joint position of a drawer that counts as open.
OPEN = 0.15


def depth_tokens(text: Column) -> Column:
    """Numbers of a depth field: a list of numbers as it is, else all depth tokens in its text."""
    return F.coalesce(F.from_json(text, "array<int>"), A.parse_tokens(F.coalesce(text, F.lit(""))))


def action(text: Column) -> Column:
    """Seven numbers, perhaps wrapped in lists of one element."""
    found = V.singletons(text)
    return F.when(F.size(found) > 0, found)


def _action_features(kind: str, now: Column, before: Column) -> dict[str, Column]:
    t, u = A.translation(now), A.translation(before)
    cosine = A.cosine(t, u)
    name = lambda x: f"feat_{kind}_{x}"
    return {
        name("translation_norm"): A.norm(t),
        name("rotation_norm"): A.norm(A.rotation(now)),
        name("gripper"): A.gripper(now),
        name("action_jump_prev_l2"): A.distance(now, before),
        name("translation_jump_prev_l2"): A.distance(t, u),
        name("rotation_jump_prev_l2"): A.distance(A.rotation(now), A.rotation(before)),
        name("translation_cosine_prev"): cosine,
        name("translation_direction_flip"): (cosine < 0).cast("int"),
        name("gripper_change_prev"): F.abs(A.gripper(now) - A.gripper(before)),
    }


#: Columns of a row that features of it and of the next row are made of, and the fields they are parsed from.
PARSED = ("_depth", "_trace", "_line", "_plan", "_model", "_env")
RAW = ("depth", "trace", "parsed_action", "env_action")


def parsed(rows: DataFrame, raw: dict[str, Column], points: int = 20, suffix: str = "") -> DataFrame:
    """Adds the columns PARSED, with a suffix, from the texts of the fields RAW."""
    d, t, line, plan, model, env = (c + suffix for c in PARSED)
    rows = rows.withColumns({d: depth_tokens(raw["depth"]), t: V.trace(raw["trace"]), model: action(raw["parsed_action"]), env: action(raw["env_action"])})
    rows = rows.withColumn(line, A.resample(F.col(t), points))
    return rows.withColumn(plan, F.when(F.size(t) >= 2, F.array(A.last(F.col(t))["x"] - A.first(F.col(t))["x"], A.last(F.col(t))["y"] - A.first(F.col(t))["y"])))


def causal(now: str = "", was: str = "_was") -> tuple[dict[str, Column], ...]:
    """Features of depth, trace, model and env of a row, from its parsed columns and those of the row before (both named by suffixes)."""
    d, t, line, plan, model, env = (F.col(c + now) for c in PARSED)
    e, q, old_line, planned, old_model, old_env = (F.col(c + was) for c in PARSED)
    some, both = F.size(t) > 0, (F.size(t) > 0) & (F.size(q) > 0)
    n = F.when(F.size(d) > 0, F.size(d)).otherwise(F.lit(0))
    if_some = lambda x: F.when(some, x)
    if_both = lambda x: F.when(both, x)
    depth = {
        "feat_depth_token_count": n,
        "feat_depth_unique_count": F.when(n > 0, F.size(F.array_distinct(d))).otherwise(F.lit(0)),
        "feat_depth_token_entropy": A.entropy(d),
        "feat_depth_spatial_boundary_ratio": A.boundary_ratio(d),
        "feat_depth_hamming_prev": A.hamming(d, e),
        "feat_depth_change_ratio_prev": A.hamming(d, e) / F.nullif(F.size(d), F.lit(0)),
    }
    trace = {
        "feat_trace_num_points": F.when(some, F.size(t)).otherwise(F.lit(0)),
        "feat_trace_start_x": A.first(t)["x"], "feat_trace_start_y": A.first(t)["y"],
        "feat_trace_endpoint_x": A.last(t)["x"], "feat_trace_endpoint_y": A.last(t)["y"],
        "feat_trace_polyline_length": if_some(A.length(t)), "feat_trace_straightness": A.straightness(t),
        "feat_trace_mean_turn_angle_rad": A.turn_angle(t), "feat_trace_direction_angle_rad": A.direction(t),
        "feat_trace_spread": if_some(A.spread(t)), "feat_trace_curvature": A.curvature(t),
        "feat_trace_endpoint_drift_prev": if_both(A.gap(A.last(q), A.last(t))), "feat_trace_startpoint_drift_prev": if_both(A.gap(A.first(q), A.first(t))),
        "feat_trace_centroid_drift_prev": A.centroid_drift(t, q), "feat_trace_shape_drift_prev": A.shape_drift(line, old_line),
        "feat_trace_direction_change_prev_rad": F.abs(A.wrapped(A.direction(t) - A.direction(q))),
        "feat_trace_relplan_drift_prev": A.distance(plan, planned),
        "feat_trace_relplan_drift_norm_prev": F.when(A.norm(planned) >= A.EPS, A.distance(plan, planned) / A.norm(planned)),
        "feat_trace_relplan_cos_prev": A.cosine(plan, planned),
    }
    return depth, trace, _action_features("model", model, old_model), _action_features("env", env, old_env)


#: Means over the last rows, the feature each is made of, and the group it stands in.
ROLLED = {"feat_depth_change_ratio_rollmean": ("feat_depth_change_ratio_prev", 0), "feat_trace_shape_drift_rollmean": ("feat_trace_shape_drift_prev", 1), "feat_env_action_jump_rollmean": ("feat_env_action_jump_prev_l2", 3)}


def flag(name: str) -> Column:
    """A flag of what followed the action, from post_action.info."""
    return V.truth(F.col(f"post_action.info.{name}"))


def stage() -> Column:
    """How far an object was moved at a step: 1 grasped, 2 lifted, 3 significantly, 4 success."""
    names = ("is_grasped", "lifted_object", "lifted_object_significantly", "success")
    return F.greatest(*[F.when(F.coalesce(flag(c), F.lit(False)), F.lit(k)).otherwise(F.lit(0)) for k, c in enumerate(names, 1)])


def followed() -> dict[str, Column]:
    """What is known after the action, and how long it took."""
    post = lambda c: F.col(f"post_action.{c}")
    qpos = V.scalar(post("info.qpos"))
    return {
        "diag_inference_time_s": V.number(F.col("pre_action.inference_time_s")), "post_reward": V.number(post("reward")),
        "post_terminated": V.truth(post("terminated")), "post_truncated": V.truth(post("truncated")), "post_predicted_terminated": V.truth(post("predicted_terminated")),
        "post_env_success": flag("success"), "post_drawer_qpos": qpos, "label_drawer_progress": F.when(qpos.isNotNull(), V.progress(qpos, OPEN)),
        "post_is_grasped": flag("is_grasped"), "post_consecutive_grasp": flag("consecutive_grasp"), "post_lifted_object": flag("lifted_object"), "post_lifted_object_significantly": flag("lifted_object_significantly"),
    }


def in_order(groups: tuple[dict, ...], identity: list[str], after: list[str]) -> list[str]:
    """The columns of the table: each rolling mean stands after the group of its feature, but the last, which follows all."""
    depth, trace, model, env = groups
    means = list(ROLLED)
    return [*identity, *depth, means[0], *trace, means[1], *model, *env, means[2], *after]


def step_features(episodes: DataFrame, rolling: int = 3, points: int = 20) -> DataFrame:
    """The feature table of ``sources.ingest.episodes``.

    A missing field gives null features (0 tokens, 0 points); features about the previous row are null on the first row and
    wherever either side is missing.
    """
    rows = parsed(episodes, {c: F.col(f"pre_action.{c}") for c in RAW}, points)
    part = Window.partitionBy("episode_key").orderBy("step_id")
    rows = rows.withColumns({f"{c}_was": F.lag(c).over(part) for c in PARSED})
    groups = causal()
    after = followed() | {"label_coke_stage": F.max(stage()).over(part.rowsBetween(Window.unboundedPreceding, 0))}
    identity = ["task", "condition_id", "episode_key", "step_id", "source_dir", "label_episode_success", "label_episode_failure", "label_episode_num_steps", "label_episode_max_steps"]
    out = rows.select(*identity, *[x.alias(c) for part_of in (*groups, after) for c, x in part_of.items()])
    out = out.withColumns({name: S.rolling_mean(F.col(source), rolling) for name, (source, _) in ROLLED.items()})
    return out.select(in_order(groups, identity, list(after)))


def episode_table(features: DataFrame) -> DataFrame:
    """One row per episode: its labels, the furthest progress and stage, and what it has ever reached."""
    ever = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).cast("int").alias(f"label_coke_ever_{c.removeprefix('post_').removeprefix('is_').replace('_object', '')}")
    keys = ["task", "condition_id", "episode_key", "source_dir", "label_episode_success", "label_episode_failure", "label_episode_num_steps", "label_episode_max_steps"]
    return features.groupBy(*keys).agg(
        F.max("post_drawer_qpos").alias("label_drawer_max_qpos"), F.max("label_drawer_progress").alias("label_drawer_max_progress"),
        ever("post_is_grasped"), ever("post_lifted_object"), ever("post_lifted_object_significantly"), F.max("label_coke_stage").alias("label_coke_max_stage"),
    )


def episode_aggregates(features: DataFrame) -> DataFrame:
    """Mean, maximum and p90 of every feature per episode, as ep_mean__*, ep_max__* and ep_p90__*."""
    names = V.with_prefix(features, "feat_")
    kinds = {"mean": F.avg, "max": F.max, "p90": lambda c: F.percentile(c, 0.9)}
    return features.groupBy("task", "condition_id").agg(*[f(c).alias(f"ep_{k}__{c}") for k, f in kinds.items() for c in names])
