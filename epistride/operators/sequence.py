"""Window and sequence operators over ordered episodes.

Frames take the columns episode_key and step_id; each function adds or aggregates columns and shares one window
partitioning, so that a chain of them needs a single exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_episode():
    return Window.partitionBy("episode_key")


def in_order():
    return by_episode().orderBy("step_id")


def so_far():
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole():
    return by_episode().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def previous(x: str | Column, n: int = 1) -> Column:
    """The value n rows before; missing values stay missing and are not carried on."""
    return F.lag(x, n).over(in_order())


def difference(x: Column) -> Column:
    return x - F.lag(x).over(in_order())


def gap_aware_drift(x: Column) -> Column:
    """Absolute change from the previous row, only where the step follows the previous one directly."""
    return F.when(F.col("step_id") - F.lag("step_id").over(in_order()) == 1, F.abs(difference(x)))


def rolling_mean(x: Column, rows: int = 3, least: int = 1) -> Column:
    """Mean over the last rows, nulls left out; null with fewer than ``least`` values."""
    frame = in_order().rowsBetween(1 - rows, 0)
    return F.when(F.count(x).over(frame) >= least, F.avg(x).over(frame))


def twice_in_a_row(flag: Column) -> Column:
    return F.coalesce(flag & F.lag(flag).over(in_order()), F.lit(False))


def best_so_far(x: Column) -> Column:
    return F.max(x).over(so_far())


def with_onset(steps: DataFrame, progress: str = "p", window: int = 10, eps: float = 0.02, min_start: int = 20) -> DataFrame:
    """Adds onset: the first place of the episode from which progress never recovers; null if there is none.

    At place t the best so far grows by less than eps within the window, and no later value exceeds it by 2 eps. There is
    none in episodes of no more than min_start + window steps. One exchange, and no join.
    """
    frame = steps.withColumns({
        "_pos": (F.row_number().over(in_order()) - 1).cast("long"), "_best": best_so_far(F.col(progress)),
        "_later": F.max(progress).over(in_order().rowsBetween(window, Window.unboundedFollowing)),
    })
    frame = frame.withColumn("_ahead", F.lead("_best", window).over(in_order()))
    still = (F.col("_pos") >= min_start) & (F.col("_ahead") - F.col("_best") < eps) & (F.col("_later") - F.col("_best") < 2 * eps)
    return frame.withColumn("onset", F.min(F.when(still, F.col("_pos"))).over(whole())).drop("_pos", "_best", "_later", "_ahead")


def plateau_onset(steps: DataFrame, progress: str = "p", window: int = 10, eps: float = 0.02, min_start: int = 20) -> DataFrame:
    """episode_key, num_steps, max_progress and onset of each episode; see ``with_onset``."""
    frame = with_onset(steps.select("episode_key", "step_id", progress), progress, window, eps, min_start)
    return frame.groupBy("episode_key").agg(F.count(F.lit(1)).alias("num_steps"), F.max(progress).alias("max_progress"), F.min("onset").alias("onset"))


def running_streak(steps: DataFrame, flag: Column, name: str = "streak") -> DataFrame:
    """Adds the number of consecutive rows up to this one on which ``flag`` holds."""
    held = steps.withColumn("_held", F.coalesce(flag, F.lit(False)))
    held = held.withColumn("_island", F.sum((~F.col("_held")).cast("int")).over(so_far()))
    island = Window.partitionBy("episode_key", "_island").orderBy("step_id")
    streak = F.sum(F.col("_held").cast("long")).over(island.rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn(name, F.when(F.col("_held"), streak).otherwise(F.lit(0)).cast("long")).drop("_held", "_island")


def sustained_flag(steps: DataFrame, flag: Column, run: int = 3) -> DataFrame:
    """episode_key, num_steps, fraction, max_streak, sustained, onset_step, onset_frac and lead_to_end of a flag over each episode.

    It is sustained if it holds on ``run`` rows in a row; the onset is the step at which the first such run begins, as a share
    of the last place, and the lead the places from there to the end. Both null without one. A null flag doesn't hold.
    """
    first = F.lag("step_id", run - 1).over(in_order())
    rows = running_streak(steps.select("episode_key", "step_id", flag.alias("_flag")), F.col("_flag")).withColumn("_first", first)
    each = rows.groupBy("episode_key").agg(
        F.count(F.lit(1)).alias("num_steps"), F.avg(F.coalesce("_flag", F.lit(False)).cast("double")).alias("fraction"),
        F.max("streak").alias("max_streak"), F.min(F.when(F.col("streak") == run, F.col("_first"))).alias("onset_step"),
    )
    end = F.col("num_steps") - 1
    return each.select("episode_key", "num_steps", "fraction", "max_streak", F.col("onset_step").isNotNull().cast("int").alias("sustained"), "onset_step", (F.col("onset_step") / F.greatest(end, F.lit(1))).alias("onset_frac"), (end - F.col("onset_step")).alias("lead_to_end"))


def longest_run(steps: DataFrame, flag: Column) -> DataFrame:
    return running_streak(steps, flag).groupBy("episode_key").agg(F.max("streak").alias("longest_run"))


def first_run(steps: DataFrame, flag: Column, k: int) -> DataFrame:
    """The first step of the first run of at least k rows; null if there is none."""
    runs = running_streak(steps.withColumn("_pos", F.row_number().over(in_order()) - 1), flag)
    return runs.groupBy("episode_key").agg(F.min(F.when(F.col("streak") >= k, F.col("_pos") - k + 1)).cast("long").alias("first_run"))


def changes(x: Column) -> Column:
    """1 where the value differs from the previous row's, 0 on the first row."""
    return F.coalesce((x != F.lag(x).over(in_order())).cast("int"), F.lit(0))


def cumulative_fraction(flag: Column) -> Column:
    return F.sum(flag.cast("int")).over(so_far()) / F.row_number().over(in_order())


def since_first(flag: Column) -> Column:
    """Steps since the first on which ``flag`` holds; null before it."""
    first = F.min(F.when(flag, F.col("step_id"))).over(whole())
    return F.when(F.col("step_id") >= first, F.col("step_id") - first)


def turning_rate(steps: DataFrame, x: str) -> DataFrame:
    """Share of sign changes between successive differences that aren't zero; 0 with fewer than two of them."""
    moves = steps.withColumn("_d", difference(F.col(x))).where("_d <> 0")
    turned = moves.withColumn("_t", (F.signum("_d") != F.lag(F.signum("_d")).over(in_order())).cast("int"))
    rates = turned.groupBy("episode_key").agg(F.coalesce(F.avg("_t"), F.lit(0.0)).alias("turning_rate"))
    return steps.select("episode_key").distinct().join(rates, "episode_key", "left").select("episode_key", F.coalesce("turning_rate", F.lit(0.0)).alias("turning_rate"))


def total_variation(steps: DataFrame, x: str) -> DataFrame:
    d = steps.withColumn("_d", F.abs(difference(F.col(x))))
    total = F.coalesce(F.sum("_d"), F.lit(0.0))
    return d.groupBy("episode_key").agg(total.alias("total_variation"), (total / F.greatest(F.lit(1), F.count(F.lit(1)) - 1)).alias("variation_per_step"))


def amplitude_turning(steps: DataFrame, x: str, eps: float) -> DataFrame:
    """Turns at rows where both neighbouring changes exceed eps: their rate among such rows (null if none) and among inner rows."""
    before, after = F.col(x) - F.lag(x).over(in_order()), F.lead(x).over(in_order()) - F.col(x)
    rows = steps.withColumn("_a", before).withColumn("_b", after)
    fit = (F.abs("_a") > eps) & (F.abs("_b") > eps)
    turn = fit & (F.signum("_a") != F.signum("_b"))
    n, t = F.count_if(fit), F.count_if(turn)
    return rows.groupBy("episode_key").agg(n.alias("eligible"), t.alias("turns"), (t / F.nullif(n, F.lit(0))).alias("qualified_rate"), (t / F.greatest(F.lit(1), F.count(F.lit(1)) - 2)).alias("all_pairs_rate"))


def series(steps: DataFrame, x: str) -> DataFrame:
    """One row per episode with its values in order."""
    return steps.groupBy("episode_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_id", F.col(x).alias("v")))), lambda r: r["v"]).alias("series"))


def peaks(values: Column, prominence: float | None = None) -> Column:
    """Places of strict inner maxima; a flat top counts once at its middle. With a prominence, lower ones are left out."""
    n = F.size(values)
    at = lambda i: F.get(values, i)
    rise = F.filter(F.sequence(F.lit(1), n - 2), lambda i: at(i - 1) < at(i))
    end = lambda i: F.get(F.filter(F.sequence(i, n - 1), lambda j: at(j) != at(i)), F.lit(0))
    tops = F.transform(rise, lambda i: F.struct(i.alias("i"), end(i).alias("e")))
    tops = F.filter(tops, lambda t: t["e"].isNotNull() & (at(t["e"]) < at(t["i"])))
    found = F.transform(tops, lambda t: F.floor((t["i"] + t["e"] - 1) / 2).cast("int"))
    if prominence is not None:

        def height(p: Column) -> Column:
            left = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), p), lambda j: at(j) > at(p))), F.lit(-1))
            right = F.coalesce(F.array_min(F.filter(F.sequence(p, n - 1), lambda j: at(j) > at(p))), n)
            low = lambda a, b: F.array_min(F.slice(values, a + 1, b - a))
            return at(p) - F.greatest(low(left + 1, p + 1), low(p, right))

        found = F.filter(found, lambda p: height(p) >= prominence)
    return F.when(n >= 3, found).otherwise(F.array().cast("array<int>"))


def arg_extreme(value: Column, step: Column, largest: bool) -> Column:
    """The step of the smallest or largest value, the first on ties; nulls are left out."""
    order = F.struct((-value if largest else value).alias("v"), step.alias("s"))
    return F.min(F.when(value.isNotNull(), order))["s"]


def exact_mean(x: Column, digits: int = 4) -> Column:
    """The mean of numbers of so many decimals, from a sum of whole numbers: no order of summation shows in it."""
    scale = 10**digits
    return F.sum(F.round(x * scale).cast("long")).cast("double") / (scale * F.count(x))
