"""Progress of pick and move episodes from ground-truth flags: a table of steps and one of episodes for each.

Flags are booleans; null counts as not set. All windows are over one episode in order of steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistride.operators import sequence as S


def on(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def first_step(flag: Column) -> Column:
    return F.min(F.when(flag, F.col("step_id"))).over(S.whole())


def streak(flag: Column) -> Column:
    """Rows in a row, up to this one, on which ``flag`` holds."""
    return (F.col("_place") - F.coalesce(F.max(F.when(~flag, F.col("_place"))).over(S.so_far()), F.lit(0))).cast("long")


def start(x: str) -> Column:
    """The value of the episode's first row, null included."""
    return F.first(x).over(S.in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def phase(flags: list[str]) -> Column:
    """The number of the last flag that is set, from 1; 0 without any."""
    out = F.lit(0)
    for k, flag in enumerate(flags, 1):
        out = F.when(on(flag), k).otherwise(out)
    return out


def since(first: Column) -> Column:
    return F.when(F.col("step_id") >= first, F.col("step_id") - first)


def modes(primary: Column, names: list[str]) -> dict[str, Column]:
    return {f"failure_mode_{n}": (primary == n).cast("int") for n in names}


# Names of failure modes, in the order of the stages that they miss.
PICK_MODES = ["never_grasped", "grasped_but_not_lifted", "lifted_but_not_significantly_lifted", "significant_lift_but_not_success"]
MOVE_MODES = ["no_correct_move", "transport_not_completed", "height_violation"]


def pick_progress(steps: DataFrame) -> DataFrame:
    """Adds phase, streaks, first steps, durations and failure mode to the steps of pick episodes.

    ``steps`` has episode_success, gt_is_grasped, gt_lifted_object, gt_lifted_object_significantly, gt_success (booleans)
    and gt_object_init_x, gt_object_init_y.
    """
    flags = {"grasp": "gt_is_grasped", "lift": "gt_lifted_object", "significant_lift": "gt_lifted_object_significantly", "success": "gt_success"}
    rows = steps.withColumns({"_place": F.row_number().over(S.in_order()), "gt_pick_phase": phase(list(flags.values()))})
    rows = rows.withColumns({f"gt_first_{n}_step": first_step(on(c)) for n, c in flags.items()})
    rows = rows.withColumns({f"gt_{n}_duration_steps": F.count_if(on(c)).over(S.whole()) for n, c in flags.items() if n != "success"})
    missed = F.when(F.coalesce(start("episode_success"), F.lit(False)), "success")
    for name, stage in zip(PICK_MODES, ("grasp", "lift", "significant_lift"), strict=False):
        missed = missed.when(F.col(f"gt_first_{stage}_step").isNull(), name)
    rows = rows.withColumn("failure_mode_primary", missed.otherwise(PICK_MODES[-1]))
    return rows.withColumns({
        "gt_pick_phase_change": S.changes(F.col("gt_pick_phase")), "gt_grasp_streak": streak(on("gt_is_grasped")), "gt_lift_streak": streak(on("gt_lifted_object")),
        "gt_time_since_first_grasp": since(F.col("gt_first_grasp_step")),
        "control_init_object_xy_radius": F.hypot(start("gt_object_init_x"), start("gt_object_init_y")), **modes(F.col("failure_mode_primary"), PICK_MODES),
    }).drop("_place")


def move_progress(steps: DataFrame) -> DataFrame:
    """Adds phase, streaks, shares, first steps, geometry and failure modes to the steps of move episodes.

    ``steps`` has episode_success, gt_moved_correct_obj, gt_near_tgt_obj, gt_all_obj_keep_height, gt_success (booleans) and
    gt_source_init_x to gt_target_init_z. An episode violates the height once a step says so outright; on single steps an
    unknown height counts as violated. Modes other than the primary one may hold together.
    """
    flags = {"correct_move": "gt_moved_correct_obj", "near_target": "gt_near_tgt_obj", "success": "gt_success"}
    rows = steps.withColumns({"_place": F.row_number().over(S.in_order()), "gt_move_phase": phase(list(flags.values()))})
    rows = rows.withColumns({f"gt_first_{n}_step": first_step(on(c)) for n, c in flags.items()} | {"gt_first_height_violation_step": first_step(F.coalesce(~F.col("gt_all_obj_keep_height"), F.lit(False)))})
    rows = rows.withColumns({f"gt_{n}_duration_steps": F.count_if(on(c)).over(S.whole()) for n, c in flags.items() if n != "success"})
    won = F.coalesce(start("episode_success"), F.lit(False))
    never = {n: F.col(f"gt_first_{n}_step").isNull() for n in ("correct_move", "near_target", "height_violation")}
    primary = F.when(won, "success").when(~never["height_violation"], "height_violation").when(never["correct_move"], "no_correct_move").when(never["near_target"], "transport_not_completed").otherwise("other_failure")
    away = [start(f"gt_target_init_{c}") - start(f"gt_source_init_{c}") for c in "xyz"]
    known = away[0].isNotNull() & away[1].isNotNull() & away[2].isNotNull()
    dx, dy, dz = (F.when(known, x) for x in away)
    return rows.withColumns({
        "gt_move_phase_change": S.changes(F.col("gt_move_phase")), "gt_correct_move_streak": streak(on("gt_moved_correct_obj")),
        "gt_correct_move_fraction": S.cumulative_fraction(on("gt_moved_correct_obj")), "gt_time_since_first_correct_move": since(F.col("gt_first_correct_move_step")),
        "gt_height_violation": (~on("gt_all_obj_keep_height")).cast("int"), "gt_height_violation_streak": streak(~on("gt_all_obj_keep_height")),
        "gt_correct_move_fraction_episode": F.col("gt_correct_move_duration_steps") / F.count(F.lit(1)).over(S.whole()),
        "control_init_source_target_dx": dx, "control_init_source_target_dy": dy, "control_init_source_target_dz": dz,
        "control_init_source_target_distance": F.sqrt(dx * dx + dy * dy + dz * dz), "control_init_source_target_xy_distance": F.hypot(dx, dy), "failure_mode_primary": primary,
        "failure_mode_no_correct_move": (~won & never["correct_move"]).cast("int"), "failure_mode_transport_not_completed": (~won & ~never["correct_move"] & never["near_target"]).cast("int"),
        "failure_mode_height_violation": (~won & ~never["height_violation"]).cast("int"),
    }).drop("_place")


def episodes_of(progress: DataFrame, keys: tuple[str, ...] = ("episode_key",)) -> DataFrame:
    """One row per episode from either table: what is the same on all its steps, and their number."""
    same = [c for c in progress.columns if c.startswith(("gt_first_", "failure_mode_", "control_init_")) or c.endswith(("_duration_steps", "_fraction_episode"))]
    return progress.groupBy(*keys).agg(F.coalesce(F.max("episode_success"), F.lit(False)).cast("int").alias("episode_success"), F.count(F.lit(1)).alias("num_steps"), *[F.max(c).alias(c) for c in same])
