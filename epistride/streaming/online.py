"""Causal operators on streams: windows over event time, and per-episode state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "episode_key long, step_id long, value double, best double, roll3 double, streak long"
STATE = "n long, best double, a double, b double, streak long"


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need a time with a zone; times without one count as those of the session."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type in windows of event time; rows later than the watermark are left out."""
    time = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = _timed(events).withWatermark("ts", late).groupBy(time, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users that end after a gap."""
    out = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def causal_features(events: DataFrame, above: float = 30.0) -> DataFrame:
    """Per step the best value so far, the mean of the last three and the streak of values over ``above``; state is five numbers per episode.

    Rows of an episode must arrive in order between batches; inside a batch they are sorted by ts and event_id.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, best, a, b, streak = state.get if state.exists else (0, float("-inf"), None, None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for value in rows["value"]:
            best = max(best, value)
            last = [x for x in (a, b, value) if x is not None]
            streak = streak + 1 if value > above else 0
            out.append((key[0], n, value, best, sum(last) / len(last), streak))
            n, a, b = n + 1, b, value
        state.update((n, best, a, b, streak))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    rows = events.select(F.col("user_id").alias("episode_key"), "event_id", "ts", "value")
    return rows.groupBy("episode_key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def write_files(df: DataFrame, path: str, checkpoint: str):
    """Appends a stream to files exactly once, for as long as the checkpoint is kept; runs until the input is used up."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
