"""Online labels, alerts, thresholds, detectors and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from epistride.functions.stats import numbered, sums_before


def online_labels(steps: DataFrame, horizons: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """A row per step and horizon: valid before the onset (always without one), label 1 if the onset is within the horizon."""
    step, onset = F.col("step_id"), F.col("onset")
    valid = (onset.isNull() | (step < onset)).cast("int")
    rows = steps.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("valid", valid)
    soon = onset.isNotNull() & (F.col("valid") == 1) & (step + F.col("horizon") >= onset)
    return rows.withColumn("label", soon.cast("int"))


def far_threshold(scores: DataFrame, score: str, by: list[str], most: float = 0.1) -> DataFrame:
    """The smallest observed score that at most floor(most * n + 1e-12) successful episodes reach; infinity if none does.

    ``scores`` has episode_key, success and the score. A threshold fits if it is above the (allowed + 1)-th largest of the
    successful episodes' maxima, so one row per distinct maximum is enough.
    """
    top = scores.where("success").groupBy(*by, "episode_key").agg(F.max(score).alias("m")).groupBy(*by, "m").agg(F.count(F.lit(1)).alias("c"))
    ranked = sums_before(top.where("m IS NOT NULL"), by, "m", ["c"])
    reach = F.col("all_c") - F.col("before_c")
    limit = ranked.where(reach > F.floor(most * F.col("all_c") + 1e-12)).groupBy(*by).agg(F.max("m").alias("limit"))
    return scores.join(limit, by, "left").groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("limit").isNull() | (F.col(score) > F.col("limit")), F.col(score))), F.lit(float("inf"))).alias("threshold"))


def detector_alerts(score: Column, threshold: Column, part: WindowSpec) -> dict[str, Column]:
    """T0: a score reaches the threshold; T1: the mean of three scores does; T2: two scores in a row do. ``part``: steps in order."""
    frame = part.rowsBetween(-2, 0)
    hit = score >= threshold
    return {
        "T0": F.coalesce(hit, F.lit(False)),
        "T1": F.coalesce(F.when(F.count(score).over(frame) == 3, F.avg(score).over(frame) >= threshold), F.lit(False)),
        "T2": F.coalesce(hit & F.lag(hit).over(part), F.lit(False)),
    }


def premature_events(scores: DataFrame, by: list[str]) -> DataFrame:
    """One row per premature alert of a failed episode: a score at or above ``threshold`` more than the horizon before the onset.

    ``scores`` has ``by``, episode_key, step_id, onset, horizon, score and threshold, which may differ by fold. Adds to these
    distance (steps to the onset), over_horizon (distance less the horizon) and first (the episode's earliest). Rows
    without onset, score or threshold are no alerts.
    """
    distance = F.col("onset") - F.col("step_id")
    early = scores.where((F.col("score") >= F.col("threshold")) & (distance > F.col("horizon")))
    columns = list(dict.fromkeys([*by, "horizon", "episode_key", "step_id", "onset", "score", "threshold"]))
    place = Window.partitionBy(*dict.fromkeys([*by, "horizon", "episode_key"])).orderBy("step_id")
    return early.select(*columns, distance.alias("distance"), (distance - F.col("horizon")).alias("over_horizon"), (F.row_number().over(place) == 1).alias("first"))


def fold_runs(sizes: list[tuple[int, int]], folds: int = 5) -> list[tuple[int, int, int, list[int]]]:
    """Deals groups, the largest first, each into the fold with the fewest rows so far (the lower one on ties).

    ``sizes`` holds how many groups there are of each size. Groups of a size are dealt in runs: (size, first and last + 1 of
    the run by rank in the size, folds in turn). A run goes through the folds that lie within one group of the emptiest as
    long as no other comes within its reach, so that runs are few, however many groups there are.
    """
    load, out = [0] * folds, []
    for n, c in sorted(sizes, reverse=True):
        start = 0
        while start < c:
            turn = sorted(range(folds), key=lambda f: (load[f], f))
            low = load[turn[0]]
            near = [f for f in turn if load[f] < low + n]
            rest = [load[f] for f in turn if load[f] >= low + n]
            rounds = (min(rest) - low) // n if rest else c
            take = min(c - start, rounds * len(near))
            out.append((n, start, start + take, near))
            for k, f in enumerate(near):
                load[f] += n * (take // len(near) + (k < take % len(near)))
            start += take
    return out


def with_folds(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """Adds the fold of each row's group: the largest groups first (ties by key), each into the fold with the fewest rows so far.

    Only the histogram of group sizes comes to the driver; a group finds its fold from its rank among those of its size.
    """
    return rows.join(deal(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group, folds), group)


def deal(sizes: DataFrame, group: str, folds: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, group and fold of groups whose numbers of rows (n) are known; as ``with_folds``, for each value of ``by`` (few) by itself."""
    counts: dict[tuple, list[tuple[int, int]]] = {}
    for r in sizes.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("c")).collect():
        counts.setdefault(tuple(r[b] for b in by), []).append((r.n, r.c))
    kinds = dict(sizes.dtypes)
    schema = ", ".join([*[f"`{b}` {kinds[b]}" for b in by], "size long, first long, last long, turn array<int>"])
    runs = sizes.sparkSession.createDataFrame([(*b, *run) for b, c in counts.items() for run in fold_runs(c, folds)], schema)
    ranked = numbered(sizes.withColumnRenamed("n", "size"), [*by, "size"], group).select(*by, group, "size", "i")
    found = ranked.join(runs, [*by, "size"]).where((F.col("i") >= F.col("first")) & (F.col("i") < F.col("last")))
    return found.select(*by, group, F.get("turn", ((F.col("i") - F.col("first")) % F.size("turn")).cast("int")).alias("fold"))
