"""Detectors T0, T1 and T2 on a stream of scores: thresholds of each fold are a table, and alerts outlive their batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from epistride.streaming.ordered import InOrder, rocksdb

DETECTORS = ("T0", "T1", "T2")
_OUT = "episode_key string, fold int, step_id long, score double, threshold double, T0 boolean, T1 boolean, T2 boolean, first string"
_ALERT = Row(*[c.split()[0] for c in _OUT.split(", ")])


class Alerts(InOrder):
    """T0: a score reaches the threshold; T1: the mean of three scores does; T2: two scores in a row do.

    Scores that are null give no alert. What is remembered is the set of detectors that have fired in the episode.
    """

    fields = "step long, fold int, score double, threshold double"
    memory = "fired int"
    start = (0,)
    before = 2

    def emit(self, key, row, past, memo):
        step, fold, score, threshold = row
        known = threshold is not None
        hit = known and score is not None and score >= threshold
        last = [score, *(p[2] for p in past)]
        three = len(last) == 3 and None not in last
        mean = known and three and (last[2] + last[1] + last[0]) / 3 >= threshold
        again = bool(hit and past and past[0][2] is not None and past[0][3] is not None and past[0][2] >= past[0][3])
        flags = (bool(hit), bool(mean), again)
        new = [d for i, d in enumerate(DETECTORS) if flags[i] and not memo[0] >> i & 1]
        fired = memo[0] | sum(1 << i for i, f in enumerate(flags) if f)
        return _ALERT(key[0], fold, step, score, threshold, *flags, ",".join(new) or None), (fired,)


def alerts(scores: DataFrame, thresholds: DataFrame, first: int = 0, patience_s: int = 600, late: str = "10 minutes") -> DataFrame:
    """Every step of a stream of scores with its alerts, and in ``first`` the detectors that fire for the first time in their episode.

    ``scores``: episode_key (text), fold, step_id, score, ends (the episode's last step) and ts (event time). ``thresholds``: a
    table with a threshold for each fold, read anew for each batch; the one known when a row comes holds for it. Steps of folds
    without a threshold give no alert. Order, gaps, late and repeated rows, and how state ends: see ``ordered.InOrder``.
    """
    rocksdb(scores.sparkSession)
    told = scores.withWatermark("ts", late).join(thresholds.select("fold", "threshold"), "fold", "left")
    told = told.select(
        F.col("episode_key").cast("string").alias("episode_key"), "ts", F.unix_millis("ts").alias("time"), F.col("step_id").cast("long").alias("step_id"), F.coalesce("ends", F.lit(False)).alias("ends"),
        F.col("step_id").cast("long").alias("step"), F.col("fold").cast("int").alias("fold"), F.col("score").cast("double").alias("score"), F.col("threshold").cast("double").alias("threshold"),
    )
    return told.groupBy("episode_key").transformWithState(Alerts(first, 1000 * patience_s), _OUT, "Append", "EventTime")
