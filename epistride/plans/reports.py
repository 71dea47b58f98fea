"""Catalog: progress tables, associations, intervals, grids, keys, add-on columns and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from epistride.functions import arrays as A
from epistride.operators import addons
from epistride.operators import models as M
from epistride.operators import progress as P
from epistride.operators import tables as B
from epistride.plans.catalog import register
from epistride.plans.evaluation import EPISODES, episodes
from epistride.plans.relations import LAST
from epistride.plans.views import POINTS, STEPS, read, steps, vectors

r6 = lambda c: F.round(c, 6)

FLAGGED = STEPS + LAST + """, f AS (SELECT s.*, last_type = 'purchase' AS ok, coalesce(k >= 40, false) AS g, coalesce(k >= 60, false) AS l, coalesce(k >= 80, false) AS sg, coalesce(k >= 97, false) AS sx,
  CASE WHEN event_type = 'error' THEN NULL ELSE event_type <> 'signup' END AS keeps FROM steps s JOIN ends USING (episode_key))"""


def flagged(spark, sf):
    """Steps with flags that stand for the ground truth of a simulator."""
    rows = steps(spark, sf)
    last = rows.groupBy("episode_key").agg((F.max_by("event_type", "step_id") == "purchase").alias("episode_success"))
    k = F.col("k")
    flags = {"gt_is_grasped": k >= 40, "gt_lifted_object": k >= 60, "gt_lifted_object_significantly": k >= 80, "gt_success": k >= 97, "gt_object_init_x": F.col("value"), "gt_object_init_y": F.col("p")}
    more = {"gt_moved_correct_obj": k >= 40, "gt_near_tgt_obj": k >= 60, "gt_all_obj_keep_height": F.when(F.col("event_type") != "error", F.col("event_type") != "signup")}
    ends = {f"gt_{side}_init_{c}": x for side, n in (("source", 1), ("target", 2)) for c, x in zip("xyz", (F.col("value") / n, F.col("p") * n, k.cast("double")), strict=True)}
    return rows.join(last, "episode_key").withColumns(flags | more | ends)


PICK = FLAGGED + """, w AS (SELECT *, CASE WHEN sx THEN 4 WHEN sg THEN 3 WHEN l THEN 2 WHEN g THEN 1 ELSE 0 END AS phase,
  step_id - coalesce(max(step_id) FILTER (WHERE NOT g) OVER o, -1) AS grasp_streak, step_id - coalesce(max(step_id) FILTER (WHERE NOT l) OVER o, -1) AS lift_streak,
  min(step_id) FILTER (WHERE g) OVER e AS first_grasp, min(step_id) FILTER (WHERE l) OVER e AS first_lift, min(step_id) FILTER (WHERE sg) OVER e AS first_sg, min(step_id) FILTER (WHERE sx) OVER e AS first_sx,
  count(*) FILTER (WHERE g) OVER e AS grasps, count(*) FILTER (WHERE sg) OVER e AS sgs, first_value(value) OVER o AS ix, first_value(p) OVER o AS iy
  FROM f WINDOW e AS (PARTITION BY episode_key), o AS (PARTITION BY episode_key ORDER BY step_id)),
m AS (SELECT *, CASE WHEN ok THEN 'success' WHEN first_grasp IS NULL THEN 'never_grasped' WHEN first_lift IS NULL THEN 'grasped_but_not_lifted' WHEN first_sg IS NULL THEN 'lifted_but_not_significantly_lifted' ELSE 'significant_lift_but_not_success' END AS mode FROM w)
"""


@register("pick_progress", PICK + """SELECT episode_key, step_id, phase AS gt_pick_phase, CAST(coalesce(phase <> lag(phase) OVER (PARTITION BY episode_key ORDER BY step_id), false) AS INTEGER) AS gt_pick_phase_change, grasp_streak AS gt_grasp_streak, lift_streak AS gt_lift_streak,
  CASE WHEN step_id >= first_grasp THEN step_id - first_grasp END AS gt_time_since_first_grasp, first_sx AS gt_first_success_step, grasps AS gt_grasp_duration_steps, mode AS failure_mode_primary FROM m""")
def pick_progress(spark, sf):
    names = "gt_pick_phase gt_pick_phase_change gt_grasp_streak gt_lift_streak gt_time_since_first_grasp gt_first_success_step gt_grasp_duration_steps failure_mode_primary".split()
    return P.pick_progress(flagged(spark, sf)).select("episode_key", "step_id", *names)


@register("pick_episodes", PICK + "SELECT episode_key, CAST(any_value(ok) AS INTEGER) AS episode_success, count(*) AS num_steps, any_value(first_grasp) AS gt_first_grasp_step, any_value(first_lift) AS gt_first_lift_step, any_value(first_sg) AS gt_first_significant_lift_step, any_value(first_sx) AS gt_first_success_step, any_value(sgs) AS gt_significant_lift_duration_steps, any_value(mode) AS failure_mode_primary, CAST(any_value(mode) = 'grasped_but_not_lifted' AS INTEGER) AS failure_mode_grasped_but_not_lifted, round(sqrt(any_value(ix) * any_value(ix) + any_value(iy) * any_value(iy)), 5) AS radius FROM m GROUP BY episode_key")
def pick_episodes(spark, sf):
    names = "episode_success num_steps gt_first_grasp_step gt_first_lift_step gt_first_significant_lift_step gt_first_success_step gt_significant_lift_duration_steps failure_mode_primary failure_mode_grasped_but_not_lifted".split()
    return P.episodes_of(P.pick_progress(flagged(spark, sf))).select("episode_key", *names, F.round("control_init_object_xy_radius", 5).alias("radius"))


MOVE = FLAGGED + """, w AS (SELECT *, CASE WHEN sx THEN 3 WHEN l THEN 2 WHEN g THEN 1 ELSE 0 END AS phase, NOT coalesce(keeps, false) AS broken,
  step_id - coalesce(max(step_id) FILTER (WHERE NOT g) OVER o, -1) AS move_streak, step_id - coalesce(max(step_id) FILTER (WHERE coalesce(keeps, false)) OVER o, -1) AS height_streak,
  count(*) FILTER (WHERE g) OVER o AS moved, min(step_id) FILTER (WHERE g) OVER e AS first_move, min(step_id) FILTER (WHERE l) OVER e AS first_near, min(step_id) FILTER (WHERE keeps = false) OVER e AS first_break,
  count(*) FILTER (WHERE g) OVER e AS moves, count(*) OVER e AS n, first_value(value) OVER o AS ix, first_value(p) OVER o AS iy, first_value(k) OVER o AS iz
  FROM f WINDOW e AS (PARTITION BY episode_key), o AS (PARTITION BY episode_key ORDER BY step_id)),
m AS (SELECT *, CASE WHEN ok THEN 'success' WHEN first_break IS NOT NULL THEN 'height_violation' WHEN first_move IS NULL THEN 'no_correct_move' WHEN first_near IS NULL THEN 'transport_not_completed' ELSE 'other_failure' END AS mode FROM w)
"""


@register("move_progress", MOVE + """SELECT episode_key, step_id, phase AS gt_move_phase, move_streak AS gt_correct_move_streak, round(moved / (step_id + 1), 6) AS gt_correct_move_fraction, CASE WHEN step_id >= first_move THEN step_id - first_move END AS gt_time_since_first_correct_move,
  CAST(broken AS INTEGER) AS gt_height_violation, height_streak AS gt_height_violation_streak, first_break AS gt_first_height_violation_step, mode AS failure_mode_primary FROM m""")
def move_progress(spark, sf):
    out = P.move_progress(flagged(spark, sf))
    return out.select("episode_key", "step_id", "gt_move_phase", "gt_correct_move_streak", r6("gt_correct_move_fraction").alias("gt_correct_move_fraction"), *"gt_time_since_first_correct_move gt_height_violation gt_height_violation_streak gt_first_height_violation_step failure_mode_primary".split())


@register("move_episodes", MOVE + "SELECT episode_key, count(*) AS num_steps, any_value(moves) AS gt_correct_move_duration_steps, round(any_value(moves) / count(*), 6) AS fraction, any_value(first_near) AS gt_first_near_target_step, CAST(NOT any_value(ok) AND any_value(first_move) IS NULL AS INTEGER) AS failure_mode_no_correct_move, CAST(NOT any_value(ok) AND any_value(first_move) IS NOT NULL AND any_value(first_near) IS NULL AS INTEGER) AS failure_mode_transport_not_completed, CAST(NOT any_value(ok) AND any_value(first_break) IS NOT NULL AS INTEGER) AS failure_mode_height_violation, CASE WHEN any_value(iz) IS NOT NULL THEN round(sqrt(power(any_value(ix) / 2, 2) + power(any_value(iy), 2)), 5) END AS distance FROM m GROUP BY episode_key")
def move_episodes(spark, sf):
    out = P.episodes_of(P.move_progress(flagged(spark, sf)))
    names = "gt_first_near_target_step failure_mode_no_correct_move failure_mode_transport_not_completed failure_mode_height_violation".split()
    return out.select("episode_key", "num_steps", "gt_correct_move_duration_steps", r6("gt_correct_move_fraction_episode").alias("fraction"), *names, F.round("control_init_source_target_distance", 5).alias("distance"))


@register("parser_health", "SELECT event_type, count(*) AS steps, count(*) FILTER (WHERE value IS NULL) AS value_missing, count(*) FILTER (WHERE json_extract(props, '$.k') IS NULL) AS k_missing FROM events GROUP BY event_type")
def parser_health(spark, sf):
    return B.parser_health(read(spark, sf, "events"), ["event_type"], {"value": F.col("value").isNotNull(), "k": F.get_json_object("props", "$.k").isNotNull()})


def erfc_sql(x: str) -> str:
    """erfc(x) by the series of functions.stats.erfc."""
    more = f"lambda acc, nth: {{'t': acc.t * 2 * {x} * {x} / (2 * nth.t + 1), 's': acc.s + acc.t * 2 * {x} * {x} / (2 * nth.t + 1)}}"
    terms = "list_transform(range(1, 141), lambda nth: {'t': CAST(nth AS DOUBLE), 's': 0.0::DOUBLE})"
    return f"CASE WHEN {x} < 6 THEN 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_reduce({terms}, {more}, {{'t': {x}::DOUBLE, 's': {x}::DOUBLE}}).s ELSE 0 END"


_P = erfc_sql("x")

ASSOCIATED = STEPS + LAST + """, el AS (SELECT task, episode_key, y, unnest(['value', 'p', 'k']) AS feature, unnest([v, p, k]) AS x, unnest([hv, hp, hk]) AS held, n FROM
  (SELECT task, episode_key, last_type = 'error' AS y, avg(value) AS v, avg(p) AS p, avg(k) AS k, count(value) AS hv, count(p) AS hp, count(k) AS hk, count(*) AS n FROM steps JOIN ends USING (episode_key) GROUP BY 1, 2, 3)),
rk AS (SELECT *, rank() OVER (PARTITION BY task, feature ORDER BY x) + (count(*) OVER (PARTITION BY task, feature, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY task, feature, x) AS t FROM el WHERE x IS NOT NULL),
gr AS (SELECT task, feature, count(x) AS n, count(*) FILTER (WHERE y) AS a, count(*) FILTER (WHERE NOT y) AS b, sum(r) FILTER (WHERE y) AS rs, sum(t * t - 1.0) AS ties, avg(x) FILTER (WHERE y) AS ma, avg(x) FILTER (WHERE NOT y) AS mb, var_samp(x) FILTER (WHERE y) AS va, var_samp(x) FILTER (WHERE NOT y) AS vb FROM rk GROUP BY 1, 2),
cv AS (SELECT task, feature, sum(held) / sum(n) AS share FROM el GROUP BY 1, 2),
zz AS (SELECT *, rs - a * (a + 1) / 2.0 AS u, greatest(abs(rs - a * (a + 1) / 2.0 - a * b / 2.0) - 0.5, 0) / sqrt(a * b / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))) / sqrt(2.0) AS x FROM gr),
tt AS (SELECT * FROM zz)
"""


@register("associations", ASSOCIATED + f"SELECT tt.task, tt.feature, n AS episode_count, round(share, 6) AS step_coverage, round(mb, 5) AS success_mean, round(ma, 5) AS failure_mean, round(CASE WHEN a >= 2 AND b >= 2 THEN (ma - mb) / sqrt(((a - 1) * va + (b - 1) * vb) / (a + b - 2)) END, 5) AS cohen_d, round(CASE WHEN a * b > 0 THEN u / (a * b) END, 6) AS auc, round(CASE WHEN a * b > 0 THEN {_P} END, 5) AS p FROM tt JOIN cv ON cv.task = tt.task AND cv.feature = tt.feature")
def associations(spark, sf):
    rows = steps(spark, sf)
    last = rows.groupBy("episode_key").agg((F.max_by("event_type", "step_id") == "error").alias("y"))
    out = B.associations(rows.join(last, "episode_key"), ["value", "p", "k"], ["task"], F.col("y"))
    return out.select("task", "feature", "episode_count", r6("step_coverage").alias("step_coverage"), *[F.round(c, 5).alias(c) for c in ("success_mean", "failure_mean", "cohen_d")], r6("auc").alias("auc"), F.round("p", 5).alias("p"))


@register("wilson_intervals", EPISODES + ", g AS (SELECT task, count(*) FILTER (WHERE y) AS k, count(*) AS n, 1.959963984540054 AS z FROM ep GROUP BY task) SELECT task, k AS failures, n AS episodes, round(greatest((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 0), 6) AS low, round(least((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 1), 6) AS high FROM g")
def wilson_intervals(spark, sf):
    g = episodes(spark, sf).groupBy("task").agg(F.count_if("y").alias("failures"), F.count(F.lit(1)).alias("episodes"))
    g = g.withColumn("w", B.wilson(F.col("failures"), F.col("episodes")))
    return g.select("task", "failures", "episodes", r6("w.low").alias("low"), r6("w.high").alias("high"))


@register("bh_adjusted", "WITH x AS (SELECT l_returnflag AS grp, l_orderkey, l_linenumber, l_extendedprice / 200000.0 AS p FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY p DESC) AS d, count(*) OVER (PARTITION BY grp) AS m FROM x), q AS (SELECT *, min(p * m / (m - d + 1)) OVER (PARTITION BY grp ORDER BY p DESC) AS q FROM r) SELECT grp, count(*) AS n, count(*) FILTER (WHERE q <= 0.05) AS rejected, round(max(least(q, 1)), 6) AS largest FROM q GROUP BY grp")
def bh_adjusted(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_extendedprice") / 200000.0).cast("double").alias("p"))
    out = B.bh_adjusted(rows, "p", ["grp"])
    return out.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("q") <= 0.05).alias("rejected"), r6(F.max("q")).alias("largest"))


@register("drawer_grid", "SELECT CAST(d * 9 + x * 3 + y AS BIGINT) AS condition_id, ['top', 'middle', 'bottom'][d + 1] AS drawer_level, round(0.65 + 0.1 * x, 6)::DOUBLE AS robot_x, round(-0.2 + 0.2 * y, 6)::DOUBLE AS robot_y, 113 AS max_steps FROM range(3) a(d), range(3) b(x), range(3) c(y)")
def drawer_grid(spark, sf):
    return B.conditions(spark, {"drawer_level": ["top", "middle", "bottom"], "robot_x": [0.65, 0.75, 0.85], "robot_y": [-0.2, 0.0, 0.2]}, max_steps=113)


@register("near_grid", "SELECT CAST(i AS BIGINT) AS condition_id, CAST(i AS BIGINT) AS obj_episode_id, 0.35::DOUBLE AS robot_x, 80 AS max_steps FROM range(60) t(i)")
def near_grid(spark, sf):
    return B.conditions(spark, {"obj_episode_id": list(range(60))}, robot_x=0.35, max_steps=80)


@register("build_keys", """SELECT '{"p_brand":' || to_json(p_brand) || ',"p_size":' || to_json(p_size) || ',"p_type":' || to_json(p_type) || '}' AS build_key, count(*) AS n FROM part GROUP BY 1""")
def build_keys(spark, sf):
    return read(spark, sf, "part").groupBy(B.build_key(["p_type", "p_size", "p_brand"]).alias("build_key")).agg(F.count(F.lit(1)).alias("n"))


@register("rename_backfill", "SELECT n_nationkey, n_regionkey AS old_key, n_nationkey AS n_regionkey, n_name AS label FROM nation")
def rename_backfill(spark, sf):
    """A column gives way to another under its name and stays under a new one."""
    rows = B.renamed(read(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name"), {"n_regionkey": "old_key", "n_name": "label"}, {"n_regionkey": "n_nationkey"})
    return rows.select("n_nationkey", "old_key", "n_regionkey", "label")


@register("checked_join", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def checked_join(spark, sf):
    """Two halves of a table joined again, or an error if their keys don't match one to one."""
    rows = read(spark, sf, "orders")
    return B.checked_join(rows.select("o_orderkey", "o_custkey"), rows.select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@register("quaternions", "WITH q AS (SELECT vec_id, list_transform(embedding[1:8], lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(e[1]*e[5]-e[2]*e[6]-e[3]*e[7]-e[4]*e[8], 6) AS w, round(e[1]*e[6]+e[2]*e[5]+e[3]*e[8]-e[4]*e[7], 6) AS x, round(e[1]*e[7]-e[2]*e[8]+e[3]*e[5]+e[4]*e[6], 6) AS y, round(e[1]*e[8]+e[2]*e[7]-e[3]*e[6]+e[4]*e[5], 6) AS z FROM q")
def quaternions(spark, sf):
    v = F.col("v")
    q = vectors(spark, sf).withColumn("q", B.quaternion_product(F.slice(v, 1, 4), F.slice(v, 5, 4)))
    return q.select("vec_id", *[r6(F.get("q", F.lit(i))).alias(c) for i, c in enumerate("wxyz")])


@register("static_compare", """WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y, (a.vec_id % 7 + 1) / (a.vec_id % 3 + 1.0) AS speedup FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
e AS (SELECT vec_id, speedup, i, CAST(x[i + 1] AS DOUBLE) AS x, CAST(y[i + 1] AS DOUBLE) AS y FROM p, range(64) t(i))
SELECT vec_id, round(count(*) FILTER (WHERE floor((x + 1) * 32) = floor((y + 1) * 32)) / 64.0, 6) AS token_agreement, round(sqrt(sum(power(y - x, 2)) FILTER (WHERE i >= 62)), 6) AS end_distance, round(sqrt(sum(power(y - x, 2)) FILTER (WHERE i < 7)), 6) AS action_l2, round(max(y - x) FILTER (WHERE i = 6), 6) AS gripper_difference, round(any_value(speedup), 6) AS speedup FROM e GROUP BY vec_id""")
def static_compare(spark, sf):
    rows = vectors(spark, sf).withColumn("action", F.slice("v", 1, 7))
    seconds = lambda m: (F.col("vec_id") % m + 1).cast("double")
    side = lambda s: rows.select("vec_id", *[F.col(c).alias(f"{c}_{s}") for c in ("tokens", "trace", "action")])
    pairs = side("a").join(side("b").withColumn("vec_id", F.col("vec_id") - 1), "vec_id").withColumn("seconds_a", seconds(7)).withColumn("seconds_b", seconds(3))
    return B.static_compare(pairs).select("vec_id", *[r6(c).alias(c) for c in ("token_agreement", "end_distance", "action_l2")], r6(F.get("action_difference", F.lit(6))).alias("gripper_difference"), r6("speedup").alias("speedup"))


def mapped(spark, sf):
    """Vectors as the steps of an episode for each label: a trace of their points and a map of 8 by 8."""
    grown = lambda p: F.struct(((p["x"] + 1) * 127).alias("x"), ((p["y"] + 1) * 127).alias("y"))
    return vectors(spark, sf).select(F.col("label").alias("episode_key"), F.col("vec_id").alias("step_id"), F.transform("trace", grown).alias("trace"), F.col("v").alias("depth"))


@register("plan_drift", POINTS + """, pl AS (SELECT label, vec_id, (max(x) FILTER (WHERE i = 31) - max(x) FILTER (WHERE i = 0)) * 127 AS px, (max(y) FILTER (WHERE i = 31) - max(y) FILTER (WHERE i = 0)) * 127 AS py FROM pts GROUP BY 1, 2),
d AS (SELECT *, lag(px) OVER w AS qx, lag(py) OVER w AS qy FROM pl WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id, round(sqrt(power(px - qx, 2) + power(py - qy, 2)), 5) AS h1, round(sqrt(power(px - qx, 2) + power(py - qy, 2)) / sqrt(qx * qx + qy * qy), 5) AS h1_norm, round((px * qx + py * qy) / (sqrt(px * px + py * py) * sqrt(qx * qx + qy * qy)), 5) AS cos_h1 FROM d""")
def plan_drift(spark, sf):
    r5 = lambda c: F.round(c, 5)
    return addons.plan_drift(mapped(spark, sf)).select(F.col("step_id").alias("vec_id"), r5("feat_trace_endpoint_drift_h1").alias("h1"), r5("feat_trace_endpoint_drift_h1_norm").alias("h1_norm"), r5("feat_trace_endpoint_cos_h1").alias("cos_h1"))


@register("trace_depth_table")
def trace_depth_table(spark, sf):
    """Depth along traces, with drifts from the step before."""
    out = addons.trace_depth(mapped(spark, sf), 8, 8)
    return out.select("episode_key", "step_id", *[r6(c).alias(c) for c in out.columns if c.startswith(("feat_", "diag_"))])


@register("drawer_geometry")
def drawer_geometry(spark, sf):
    """Geometry of traces against the mean direction of the first five labels."""
    out = addons.drawer_geometry(mapped(spark, sf), 8, 8, F.col("episode_key") < 5)
    return out.select("episode_key", "step_id", *[r6(c).alias(c) for c in out.columns if c.startswith("feat_")])


@register("drill_down", STEPS + "SELECT step_id, event_type, round(value, 6) AS value, round(p, 6) AS p, k FROM steps WHERE episode_key = 3")
def drill_down(spark, sf):
    """The steps of one episode, in order."""
    return steps(spark, sf).where("episode_key = 3").orderBy("step_id").select("step_id", "event_type", r6("value").alias("value"), r6("p").alias("p"), "k")


@register("feature_sets", "SELECT * FROM (VALUES ('A0_action_magnitude_proxy', 1), ('A1_action_structured', 10), ('A2_trace_only', 10), ('A3_depth_trace', 17), ('A4_depth_trace_action', 27), ('Action', 10), ('Action+Depth', 17), ('Action+Trace', 20), ('Action+Depth+Trace', 27), ('Depth+Trace', 17)) t(spec, n_features)")
def feature_sets(spark, sf):
    every = [f for family in B.FEATURES.values() for f in family]
    return spark.createDataFrame([(s, len(B.features_of(s, every))) for s in (B.ABLATIONS | B.MODALITIES)], "spec string, n_features int")


@register("cluster_quality")
def cluster_quality(spark, sf):
    """Two to four clusters of episodes: how far apart they are, and whether none is a single episode."""
    return M.cluster_quality(episodes(spark, sf).select("episode_key", "m_value", "m_k"), ["m_value", "m_k"], tries=100)
