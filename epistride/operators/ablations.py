"""Sets of features against each other: nested out-of-fold scores at each horizon, and what they tell of steps, episodes and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistride.functions import stats as T
from epistride.operators.models import nested_folds, nested_scores, settled

BY = ["horizon", "spec"]
#: Scores of an episode; "max" is the retrospective one: whether any alert would have come.
HOW = ("max", "mean", "last")


def scored_sets(steps: DataFrame, specs: dict[str, list[str]], horizons: tuple[int, ...] = (5, 10, 20), folds: int = 5, inner: int = 3, most: float = 0.1) -> DataFrame:
    """Valid steps once for each horizon and set of features, with horizon, spec, label, fold, score and fold_threshold.

    ``steps`` has episode_key, step_id, onset (null for successes) and the features. A step is valid before the onset, whatever
    the horizon, so folds are dealt once, and these rows are kept, since scores are made from them when they are read.
    Without valid steps there are no rows.
    """
    step, onset = F.col("step_id"), F.col("onset")
    valid = steps.where(onset.isNull() | (step < onset)).withColumn("success", onset.isNull()).persist()
    within = lambda h: (onset.isNotNull() & (step + h >= onset)).cast("int")
    dealt = settled(nested_folds(valid, folds, inner).withColumns({f"_label{h}": within(h) for h in horizons}))
    valid.unpersist()
    out = nested_scores(dealt, specs, {h: f"_label{h}" for h in horizons}, folds, inner, most)
    return out.drop(*[f"_label{h}" for h in horizons]).withColumn("label", within(F.col("horizon")))


def episode_scores(scored: DataFrame) -> DataFrame:
    """Each episode of ``scored_sets``: its largest, mean and last score, steps from the first alert within the horizon to the onset (lead), and premature."""
    step, start = F.col("step_id"), F.col("onset") - F.col("horizon")
    alert = F.col("score") >= F.col("fold_threshold")
    scores = [F.max("score").alias("max"), F.avg("score").alias("mean"), F.max_by("score", "step_id").alias("last")]
    out = scored.groupBy(*BY, "episode_key", "success", "onset", "fold_threshold").agg(
        *scores, F.min(F.when(alert & (step >= start), step)).alias("_first"), F.coalesce(F.bool_or(alert & (step < start)), F.lit(False)).alias("premature")
    )
    return out.withColumn("lead", F.col("onset") - F.col("_first")).drop("_first")


def ablations(scored: DataFrame) -> DataFrame:
    """One row per horizon and set: counts, AUROC and average precision of steps and of each score of episodes, and how alerts fare.

    Metrics are null where a class is missing; rates have at least one episode below the line.
    Mean scores that differ only by the rounding of their sums may count as tied or not. ``scored`` and the scores of
    episodes are read several times, so they stay cached with the session.
    """
    scored = scored.select(*BY, "episode_key", "step_id", "onset", "success", "label", "score", "fold_threshold").persist()
    each = episode_scores(scored).persist()
    step = T.rank_metrics(scored, "score", F.col("label") == 1, BY)
    step = step.select(*BY, (F.col("n_pos") + F.col("n_neg")).alias("n_steps"), F.col("n_pos").alias("positive_steps"), F.col("auroc").alias("step_auroc"), F.col("average_precision").alias("step_auprc"))
    ranked = T.rank_metrics(_long(each), "score", ~F.col("success"), [*BY, "how"])
    of = lambda how, c: F.max(F.when(F.col("how") == how, F.col(c)))
    episode = ranked.groupBy(*BY).agg(*[of(h, c).alias(f"episode_{short}_{h}") for h in HOW for c, short in (("auroc", "auroc"), ("average_precision", "auprc"))])
    good, bad, n = F.col("success"), ~F.col("success"), F.count_if
    rate = lambda x, of: n(x) / F.greatest(F.lit(1), n(of))
    alarm, found, early = good & (F.col("max") >= F.col("fold_threshold")), bad & F.col("lead").isNotNull(), bad & F.col("premature")
    alerts = each.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n_episodes"), n(bad).alias("n_failures"), F.median("fold_threshold").alias("threshold_median"), n(alarm).alias("false_alarms"), rate(alarm, good).alias("far"),
        n(found).alias("detected"), rate(found, bad).alias("detection_rate"), n(early).alias("premature"), rate(early, bad).alias("premature_rate"), F.avg("lead").alias("mean_lead"), F.median("lead").alias("median_lead"),
    )
    return alerts.join(step, BY).join(episode, BY)


def intervals(scored: DataFrame, draws: int = 1000) -> DataFrame:
    """horizon, spec, how ("step" or a score of episodes) and the 95 % intervals of AUROC and average precision over resampled episodes."""
    each = _long(episode_scores(scored)).select(*BY, "how", "episode_key", "score", (~F.col("success")).cast("int").alias("label"))
    rows = scored.select(*BY, F.lit("step").alias("how"), "episode_key", "score", "label").unionByName(each)
    units = scored.select("episode_key").distinct()
    d = T.cluster_bootstrap(rows, units, "episode_key", "score", "label", draws, by=[*BY, "how"])
    ends: list[Column] = [F.percentile(m, q).alias(f"{m}_{side}") for m in ("auroc", "ap") for side, q in (("lo", 0.025), ("hi", 0.975))]
    return d.groupBy(*BY, "how").agg(F.count(F.lit(1)).alias("draws"), *ends)


def _long(each: DataFrame) -> DataFrame:
    return each.select(*BY, "episode_key", "success", *HOW).unpivot([*BY, "episode_key", "success"], list(HOW), "how", "score")
