"""How early and how widely scores hold: prefixes of episodes, leads of alerts, thresholds learnt on other groups, correlations with outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistride.functions import stats as T
from epistride.operators.labels import far_threshold

#: Groups that one list of other groups may hold; it goes with every row of a histogram.
MOST_GROUPS = 256


def prefix_scores(steps: DataFrame, score: str, keys: list[str], percents: tuple[int, ...] = (10, 25, 50, 75, 100)) -> DataFrame:
    """For each episode (``keys``, one of them episode_key) and percentage the largest score of its first steps: percent and top.

    A step counts if its place (from 0) is below that percentage of the episode's steps, so that the first always does.
    One window finds the places, one aggregation all maxima.
    """
    episode = Window.partitionBy(*keys)
    rows = steps.select(*keys, F.col(score).alias("_s"), (F.row_number().over(episode.orderBy("step_id")) - 1).alias("_i"), F.count(F.lit(1)).over(episode).alias("_n"))
    tops = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") * 100 < q * F.col("_n"), F.col("_s"))).alias(f"_p{q}") for q in percents])
    return tops.select(*keys, F.explode(F.array(*[F.struct(F.lit(q).alias("percent"), F.col(f"_p{q}").alias("top")) for q in percents])).alias("x")).select(*keys, "x.*")


def prefix_metrics(steps: DataFrame, score: str, failed: str, by: list[str], percents: tuple[int, ...] = (10, 25, 50, 75, 100)) -> DataFrame:
    """The columns of ``rank_metrics`` for failed episodes at each percentage seen, by group; ``failed`` is the same on all steps of an episode."""
    tops = prefix_scores(steps, score, [*by, "episode_key", failed], percents)
    return T.rank_metrics(tops, "top", F.col(failed), [*by, "percent"])


def lead_times(alerts: DataFrame) -> DataFrame:
    """Adds l_end (steps from the first alert to the end), l_onset (to the onset, negative if it came before) and l_norm (l_onset over all steps).

    ``alerts``: one row an episode with first_alert, onset and num_steps; null where there is no alert or no onset.
    """
    first, n = F.col("first_alert"), F.col("num_steps")
    return alerts.withColumns({"l_end": n - first, "l_onset": F.col("onset") - first, "l_norm": (F.col("onset") - first) / F.nullif(n, F.lit(0))})


def point_biserial(rows: DataFrame, features: list[str], failed: Column, by: list[str]) -> DataFrame:
    """Per group and feature n, r (correlation with the outcome as 0 and 1) and t (r over its error, n - 2 degrees of freedom).

    Rows without the feature are left out; r is null where the feature or the outcome doesn't vary, t too where r is 1.
    """
    long = rows.select(*by, failed.cast("double").alias("_y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("f")).select(*by, "_y", "f.*").where("x IS NOT NULL AND _y IS NOT NULL")
    varies = (F.min("x") < F.max("x")) & (F.min("_y") < F.max("_y"))
    out = long.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"), F.when(varies, F.covar_pop("x", "_y") / F.nullif(F.stddev_pop("x") * F.stddev_pop("_y"), F.lit(0.0))).alias("r"))
    return out.withColumn("t", F.when(F.abs("r") < 1, F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))))


def leave_one_group_out(steps: DataFrame, score: str, group: str, most: float = 0.1) -> DataFrame:
    """For each group, held out: the threshold that keeps false alarms of all other groups' successful episodes to ``most``, and how it does in the group.

    ``steps`` has the group, episode_key, success and the score. Returns held_out, threshold, n_success, n_failure, far, detection (null
    without such episodes) and auroc of the largest scores. Distinct scores and maxima of episodes stand for their rows, and each goes to the
    other groups, of which there may be MOST_GROUPS; with a single group the threshold is null.
    """
    known = [r[0] for r in steps.select(group).where(F.col(group).isNotNull()).distinct().limit(MOST_GROUPS + 1).collect()]
    if len(known) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    tops = steps.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("own"), "episode_key", "success").agg(F.max(score).alias("m"))
    seen = steps.where(F.col(group).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(group).alias("own"), F.col(score).alias("s")).agg(F.lit(1).alias("one"))
    learnt = tops.where("success").select("own", "episode_key", F.lit(True).alias("success"), F.col("m").alias("s"))
    learnt = learnt.unionByName(seen.select("own", F.lit(None).cast(dict(tops.dtypes)["episode_key"]).alias("episode_key"), F.lit(False).alias("success"), "s"))
    every = F.array(*[F.lit(g) for g in sorted(known)]) if known else F.array().cast(f"array<{dict(tops.dtypes)['own']}>")
    learnt = learnt.withColumn("held_out", F.explode(F.array_except(every, F.array("own"))))
    thresholds = far_threshold(learnt, "s", ["held_out"], most).withColumnRenamed("held_out", "_g")
    tested = tops.join(thresholds, F.col("own") == F.col("_g"), "left")
    good, alarm = F.col("success"), F.col("m") >= F.col("threshold")
    share = lambda of: F.count_if(of & alarm) / F.nullif(F.count_if(of), F.lit(0))
    out = tested.groupBy("own", "threshold").agg(F.count_if(good).alias("n_success"), F.count_if(~good).alias("n_failure"), share(good).alias("far"), share(~good).alias("detection"))
    ranks = T.rank_metrics(tops, "m", ~F.col("success"), ["own"]).select(F.col("own").alias("held_out"), "auroc")
    return out.withColumnRenamed("own", "held_out").join(ranks, "held_out", "left")
