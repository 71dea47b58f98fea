"""Further columns of the step table: depth along the trace, geometry against successful directions, plan drift, motion without the gripper.

Frames have the columns episode_key and step_id; ``trace`` is a list of points (x, y from 0 to 255), ``depth`` a map of h by w
numbers, row by row. Where a trace or map is missing or flat, features are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistride.functions import arrays as A
from epistride.operators import sequence as S

#: Points of a resampled trace, dead zone of changes and radius of a patch in parts of the map, width of its border.
POINTS, DEAD, RADIUS, BORDER = 20, 0.02, 0.035, 0.1


def depth_along(trace: Column, depth: Column, h: int, w: int, n: int = POINTS) -> Column:
    """Depths at ``n`` points that lie evenly along a trace."""
    return F.transform(A.resample(trace, n), lambda p: A.bilinear(depth, h, w, p["x"], p["y"]))


def moves(values: Column) -> Column:
    n = F.size(values)
    return F.zip_with(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), F.slice(values, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b - a)


def trace_depth(steps: DataFrame, h: int, w: int) -> DataFrame:
    """Adds five features and two diagnostics of the depth along the trace; drifts only where a step follows its predecessor directly."""
    t, d = F.col("trace"), F.col("depth")
    rows = steps.withColumn("_s", A.population_std(d)).withColumn("_a", F.when((F.size(t) >= 2) & (F.col("_s") > A.EPS), depth_along(t, d, h, w)))
    a, end = F.col("_a"), A.last(t)
    change = F.transform(moves(a), F.abs)
    rows = rows.withColumns({
        "feat_trace_depth_std_norm": A.population_std(a) / F.col("_s"),
        "feat_trace_depth_gradient_norm": A.total(change) / F.size(change) / F.col("_s"),
        "feat_trace_depth_range_norm": (F.array_max(a) - F.array_min(a)) / F.col("_s"),
        "diag_trace_endpoint_depth_raw": F.when(F.size(t) > 0, A.bilinear(d, h, w, end["x"], end["y"])),
    })
    raw, share = F.col("diag_trace_endpoint_depth_raw"), F.col("feat_trace_endpoint_depth_percentile")
    rows = rows.withColumn("feat_trace_endpoint_depth_percentile", A.percentile_rank(d, raw))
    drifts = {"feat_trace_endpoint_depth_percentile_drift_prev": S.gap_aware_drift(share), "diag_trace_endpoint_depth_raw_drift_prev": S.gap_aware_drift(raw)}
    return rows.withColumns(drifts).drop("_s", "_a")


def unit_chord(trace: Column) -> Column:
    """The direction from the first to the last point at length 1; null for traces that end where they began."""
    x, y = A.last(trace)["x"] - A.first(trace)["x"], A.last(trace)["y"] - A.first(trace)["y"]
    size = F.hypot(x, y)
    return F.when((F.size(trace) >= 2) & (size > A.EPS), F.struct((x / size).alias("x"), (y / size).alias("y")))


def canonical_direction(rows: DataFrame, successful: Column) -> DataFrame:
    """One row _ux, _uy: the mean unit chord of successful traces, at length 1; null if there is none or they cancel."""
    u = unit_chord(F.col("trace"))
    mean = rows.where(successful).agg(F.avg(u["x"]).alias("x"), F.avg(u["y"]).alias("y"))
    size = F.hypot("x", "y")
    return mean.select(F.when(size > A.EPS, F.col("x") / size).alias("_ux"), F.when(size > A.EPS, F.col("y") / size).alias("_uy"))


def with_direction(rows: DataFrame, successful: Column) -> DataFrame:
    """Adds the canonical direction to every row, through a join with its one row."""
    one = F.lit(1).alias("_one")
    return rows.select("*", one).join(F.broadcast(canonical_direction(rows, successful).select("*", one)), "_one").drop("_one")


def patch_median(depth: Column, h: int, w: int, x: Column, y: Column, radius: float = RADIUS) -> Column:
    """The median depth of the cells within a circle about a point."""
    cx, cy, size = x / 255.0 * (w - 1), y / 255.0 * (h - 1), (radius * min(h, w)) ** 2
    inside = lambda v, i: (F.pow(i % w - cx, F.lit(2)) + F.pow(F.floor(i / w) - cy, F.lit(2))) <= size
    return A.median(F.transform(F.filter(F.transform(depth, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda c: inside(c["v"], c["i"])), lambda c: c["v"]))


def drawer_geometry(steps: DataFrame, h: int, w: int, successful: Column, n: int = POINTS) -> DataFrame:
    """Adds backtracking and alignment against the canonical direction, changes of sign of the depth, and two contrasts of the end of the trace."""
    t, d = F.col("trace"), F.col("depth")
    rows = with_direction(steps, successful).withColumn("_s", A.population_std(d))
    some, s = (F.size(t) >= 2) & (F.col("_s") > A.EPS), F.col("_s")
    u, end = unit_chord(t), A.last(t)
    inner = F.when(F.size(t) > 2, F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0)))).otherwise(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))))
    at_end = patch_median(d, h, w, end["x"], end["y"])
    front = A.median(F.filter(F.transform(inner, lambda p: patch_median(d, h, w, p["x"], p["y"])), lambda v: v.isNotNull()))
    return rows.withColumns({
        "feat_trace_backtracking_ratio": F.when(F.size(t) >= 2, A.backtracking(t, F.col("_ux"), F.col("_uy"))),
        "feat_trace_direction_alignment": u["x"] * F.col("_ux") + u["y"] * F.col("_uy"),
        "feat_trace_depth_sign_change_count": F.when(some, A.sign_changes(moves(depth_along(t, d, h, w, n)), DEAD * s).cast("double")),
        "feat_trace_endpoint_vs_background_depth_contrast": F.when(some, (at_end - A.median(A.pick(d, A.ring(h, w, BORDER)))) / s),
        "feat_trace_endpoint_vs_drawer_front_depth_contrast": F.when(some, (at_end - front) / s),
    }).drop("_s", "_ux", "_uy")


def plan_drift(steps: DataFrame) -> DataFrame:
    """Adds the change of the planned displacement (last point less first) from the previous row: its length, that by the plan's, and the cosine."""
    t = F.col("trace")
    plan = F.when(F.size(t) >= 2, F.array(A.last(t)["x"] - A.first(t)["x"], A.last(t)["y"] - A.first(t)["y"]))
    rows = steps.withColumn("_plan", plan)
    rows = rows.withColumn("_was", F.lag("_plan").over(S.in_order()))
    now, was = F.col("_plan"), F.col("_was")
    return rows.withColumns({
        "feat_trace_endpoint_drift_h1": A.distance(now, was),
        "feat_trace_endpoint_drift_h1_norm": F.when(A.norm(was) >= A.EPS, A.distance(now, was) / A.norm(was)),
        "feat_trace_endpoint_cos_h1": A.cosine(now, was),
    }).drop("_plan", "_was")


def action_mechanism(features: DataFrame) -> DataFrame:
    """Adds changes of the drawer and of progress, and the motion jumps of both actions without their gripper."""
    jump = lambda kind: F.sqrt(F.pow(f"feat_{kind}_translation_jump_prev_l2", F.lit(2)) + F.pow(f"feat_{kind}_rotation_jump_prev_l2", F.lit(2)))
    return features.withColumns({
        "qpos_delta": S.difference(F.col("post_drawer_qpos")), "progress_delta": S.difference(F.col("label_drawer_progress")),
        "model_motion_jump_no_gripper": jump("model"), "env_motion_jump_no_gripper": jump("env"),
    })
