"""Tables about tables: parser health, associations with the outcome, intervals, grids of conditions, checked joins, comparisons."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.functions import arrays as A
from epistride.functions import stats as T

# Families of step features, and the sets of families that are compared.
FEATURES = {
    "action_proxy": ["feat_model_translation_norm"],
    "action_structured": [
        "feat_model_translation_norm", "feat_model_rotation_norm", "feat_model_gripper", "feat_model_action_jump_prev_l2", "feat_model_translation_jump_prev_l2",
        "feat_model_rotation_jump_prev_l2", "feat_model_translation_cosine_prev", "feat_model_translation_direction_flip", "feat_model_gripper_change_prev", "feat_model_action_jump_rollmean",
    ],
    "trace": [
        "feat_trace_num_points", "feat_trace_polyline_length", "feat_trace_straightness", "feat_trace_mean_turn_angle_rad", "feat_trace_spread",
        "feat_trace_curvature", "feat_trace_endpoint_drift_prev", "feat_trace_shape_drift_prev", "feat_trace_direction_change_prev_rad", "feat_trace_shape_drift_rollmean",
    ],
    "depth": [
        "feat_depth_token_count", "feat_depth_unique_count", "feat_depth_token_entropy", "feat_depth_spatial_boundary_ratio", "feat_depth_hamming_prev",
        "feat_depth_change_ratio_prev", "feat_depth_change_ratio_rollmean",
    ],
}
ABLATIONS = {
    "A0_action_magnitude_proxy": ["action_proxy"], "A1_action_structured": ["action_structured"], "A2_trace_only": ["trace"],
    "A3_depth_trace": ["depth", "trace"], "A4_depth_trace_action": ["depth", "trace", "action_structured"],
}
MODALITIES = {
    "Action": ["action_structured"], "Action+Depth": ["action_structured", "depth"], "Action+Trace": ["action_structured", "trace"],
    "Action+Depth+Trace": ["action_structured", "depth", "trace"], "Depth+Trace": ["depth", "trace"],
}


def features_of(spec: str, columns: list[str]) -> list[str]:
    """The features of a registered set that a table has, each once, in order of the registry."""
    wanted = [f for family in (ABLATIONS | MODALITIES)[spec] for f in FEATURES[family]]
    return [f for f in dict.fromkeys(wanted) if f in columns]


def parser_health(rows: DataFrame, by: list[str], parts: dict[str, Column]) -> DataFrame:
    """Rows of each group, and for each part how many rows it is missing from; a part is a column that holds where it is there."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("steps"), *[F.count_if(~F.coalesce(there, F.lit(False))).alias(f"{n}_missing") for n, there in parts.items()])


def associations(steps: DataFrame, features: list[str], by: list[str], failed: Column, episode: str = "episode_key") -> DataFrame:
    """Per group and feature: episodes, share of steps that have it, means of both outcomes, Cohen's d, AUC of failure, and its two-sided p.

    An episode counts by the mean of its steps; ``failed`` is the same on all steps of an episode.
    """
    long = steps.select(*by, episode, failed.alias("_bad"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("f")).select(*by, episode, "_bad", "f.*")
    keys = [*by, "feature"]
    each = long.groupBy(*keys, episode, "_bad").agg(F.avg("x").alias("x"), F.count("x").alias("held"), F.count(F.lit(1)).alias("steps"))
    bad, x = F.col("_bad"), F.col("x")
    out = each.groupBy(*keys).agg(
        F.count(x).alias("episode_count"), (F.sum("held") / F.sum("steps")).alias("step_coverage"), F.avg(F.when(~bad, x)).alias("success_mean"),
        F.avg(F.when(bad, x)).alias("failure_mean"), T.cohen_d(x, bad).alias("cohen_d"),
    )
    ranks = T.rank_metrics(each, "x", bad, keys).select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("auroc").alias("auc"), T.two_sided_p(F.col("z")).alias("p"))
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out.join(ranks, same, "left").drop(*[f"_{c}" for c in keys])


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """low and high of the Wilson interval of a share; null without trials."""
    p, zz = k / F.nullif(n, F.lit(0)), z * z
    middle, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.when(n > 0, F.struct(F.greatest((middle - half) / (1 + zz / n), F.lit(0.0)).alias("low"), F.least((middle + half) / (1 + zz / n), F.lit(1.0)).alias("high")))


def bh_adjusted(rows: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Adds q: p values adjusted for the false discovery rate in each group; null p stay null and don't count.

    Distinct values are counted once and stay cached with their ranks, since edges, totals and windows read them in turn.
    """
    counts = rows.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c")).persist()
    ranked = T.sums_before(counts, by, "_p", ["_c"]).withColumn("_r", F.col("_p") * F.col("all__c") / (F.col("before__c") + F.col("_c"))).persist()
    ranked = T.least_from(ranked, by, "_p", "_r", "_q", counts)  # a larger p never gets a smaller q
    found = ranked.select(*[F.col(c).alias(f"_b_{c}") for c in by], "_p", F.least("_q", F.lit(1.0)).alias("q"))
    same = F.col(p) == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return rows.join(found, same, "left").drop("_p", *[f"_b_{c}" for c in by])


def conditions(spark: SparkSession, axes: dict[str, list], **fixed) -> DataFrame:
    """A numbered grid: every combination of the axes, the first outermost, with the same fixed columns on each."""
    rows = [dict(zip(axes, values, strict=True)) for values in itertools.product(*axes.values())]
    table = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], ["condition_id", *axes])
    return table.withColumns({k: F.lit(v) for k, v in fixed.items()}) if fixed else table


def build_key(fields: list[str]) -> Column:
    """A canonical JSON text of some columns, sorted by name: rows with the same text can share what is built from them."""
    return F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"})


def renamed(rows: DataFrame, names: dict[str, str], backfill: dict[str, str] | None = None) -> DataFrame:
    """Renames columns, all at once (so that names can be swapped), then fills in new columns from others."""
    missing = [c for c in names if c not in rows.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    out = rows.select(*[F.col(c).alias(names.get(c, c)) for c in rows.columns])
    return out.withColumns({new: F.col(old) for new, old in (backfill or {}).items()})


def checked_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Joins two tables that must hold the same keys, each once; raises ValueError, and joins nothing, if they don't."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = count(left, "_l").join(count(right, "_r"), keys, "full")
    wrong = both.where("_l IS NULL OR _r IS NULL OR _l > 1 OR _r > 1").limit(3).collect()
    if wrong:
        raise ValueError(f"rows don't match one to one, e.g. {[tuple(r[k] for k in keys) for r in wrong]}")
    return left.join(right, keys)


def bounded(name: str, value, least=None, most=None):
    """A parameter within its bounds, or ValueError."""
    if (least is not None and value < least) or (most is not None and value > most):
        raise ValueError(f"{name} must be from {least} to {most}, not {value}")
    return value


def percent(x: Column, digits: int = 1) -> Column:
    """A share as text; a dash for null."""
    return F.coalesce(F.concat(F.format_number(100 * x, digits), F.lit("%")), F.lit("-"))


def quaternion_product(a: Column, b: Column) -> Column:
    """Hamilton's product of two lists w, x, y, z."""
    p, q = [F.get(a, F.lit(i)) for i in range(4)], [F.get(b, F.lit(i)) for i in range(4)]
    return F.array(
        p[0] * q[0] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3], p[0] * q[1] + p[1] * q[0] + p[2] * q[3] - p[3] * q[2],
        p[0] * q[2] - p[1] * q[3] + p[2] * q[0] + p[3] * q[1], p[0] * q[3] + p[1] * q[2] - p[2] * q[1] + p[3] * q[0],
    )


def static_compare(pairs: DataFrame) -> DataFrame:
    """Two backends on the same frame: agreement of depth tokens, distances of traces, of actions by dimension, and speedup.

    ``pairs`` has tokens_a, trace_a, action_a, seconds_a and the same with _b; sides that differ in size give null.
    """
    c = F.col
    pair = lambda name: (c(f"{name}_a"), c(f"{name}_b"))
    return pairs.withColumns({
        "token_agreement": 1 - A.hamming(*pair("tokens")) / F.nullif(F.size("tokens_a"), F.lit(0)),
        "start_distance": A.gap(A.first(c("trace_a")), A.first(c("trace_b"))), "end_distance": A.gap(A.last(c("trace_a")), A.last(c("trace_b"))),
        "action_l2": A.distance(*pair("action")), "action_difference": F.when(A.same_size(*pair("action")), F.zip_with(*pair("action"), lambda x, y: y - x)),
        "speedup": c("seconds_a") / F.nullif(c("seconds_b"), F.lit(0.0)),
    })
