"""Catalog: window and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from epistride.operators import sequence as S
from epistride.plans.catalog import register
from epistride.plans.views import STEPS, WINDOW_SQL, steps

r6 = lambda c: F.round(c, 6)


@register("step_view", STEPS + "SELECT episode_key, step_id, task, event_type, round(value, 6) AS value, round(p, 6) AS p, k FROM steps WHERE task = 't1'")
def step_view(spark, sf):
    return steps(spark, sf).where("task = 't1'").select("episode_key", "step_id", "task", "event_type", r6("value").alias("value"), r6("p").alias("p"), "k")


@register("lag_diff", STEPS + f"SELECT episode_key, step_id, round(lag(value) OVER w, 6) AS prev_value, round(value - lag(value) OVER w, 6) AS diff FROM steps {WINDOW_SQL}")
def lag_diff(spark, sf):
    return steps(spark, sf).select("episode_key", "step_id", r6(S.previous("value")).alias("prev_value"), r6(S.difference(F.col("value"))).alias("diff"))


@register("gap_aware_drift", STEPS + f", g AS (SELECT * FROM steps WHERE event_type <> 'view') SELECT episode_key, step_id, round(CASE WHEN step_id - lag(step_id) OVER w = 1 THEN abs(value - lag(value) OVER w) END, 6) AS drift FROM g {WINDOW_SQL}")
def gap_aware_drift(spark, sf):
    return steps(spark, sf).where("event_type <> 'view'").select("episode_key", "step_id", r6(S.gap_aware_drift(F.col("value"))).alias("drift"))


_HOLED = ", h AS (SELECT *, CASE WHEN event_type <> 'click' THEN value END AS v FROM steps)"
_THREE = "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"


def _holed(spark, sf):
    return steps(spark, sf).withColumn("v", F.when(F.col("event_type") != "click", F.col("value")))


@register("roll3_min1", STEPS + _HOLED + f" SELECT episode_key, step_id, round(avg(v) OVER (PARTITION BY episode_key ORDER BY step_id {_THREE}), 6) AS rollmean FROM h")
def roll3_min1(spark, sf):
    return _holed(spark, sf).select("episode_key", "step_id", r6(S.rolling_mean(F.col("v"))).alias("rollmean"))


@register("roll3_min3", STEPS + _HOLED + f" SELECT episode_key, step_id, round(CASE WHEN count(v) OVER w3 = 3 THEN avg(v) OVER w3 END, 6) AS rollmean FROM h WINDOW w3 AS (PARTITION BY episode_key ORDER BY step_id {_THREE})")
def roll3_min3(spark, sf):
    return _holed(spark, sf).select("episode_key", "step_id", r6(S.rolling_mean(F.col("v"), 3, 3)).alias("rollmean"))


@register("two_consecutive", STEPS + f"SELECT episode_key, step_id, (value > 50 AND coalesce(lag(value > 50) OVER w, false)) AS alert FROM steps {WINDOW_SQL}")
def two_consecutive(spark, sf):
    return steps(spark, sf).select("episode_key", "step_id", S.twice_in_a_row(F.col("value") > 50).alias("alert"))


@register("best_so_far", STEPS + f"SELECT episode_key, step_id, round(max(p) OVER w, 6) AS best FROM steps {WINDOW_SQL}")
def best_so_far(spark, sf):
    return steps(spark, sf).select("episode_key", "step_id", r6(S.best_so_far(F.col("p"))).alias("best"))


ONSETS = """, b AS (SELECT *, max(p) OVER (PARTITION BY episode_key ORDER BY step_id) AS best,
  max(p) OVER (PARTITION BY episode_key ORDER BY step_id ROWS BETWEEN 10 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM steps),
a AS (SELECT *, lead(best, 10) OVER (PARTITION BY episode_key ORDER BY step_id) AS ahead FROM b),
onsets AS (SELECT episode_key, count(*) AS num_steps, max(p) AS max_progress,
  min(step_id) FILTER (WHERE step_id >= 20 AND ahead - best < 0.02 AND later - best < 0.04) AS onset FROM a GROUP BY episode_key)
"""


@register("plateau_onset", STEPS + ONSETS + "SELECT episode_key, num_steps, round(max_progress, 6) AS max_progress, onset, round(onset / num_steps, 6) AS onset_frac FROM onsets")
def plateau_onset(spark, sf):
    found = S.plateau_onset(steps(spark, sf))
    return found.select("episode_key", "num_steps", r6("max_progress").alias("max_progress"), "onset", r6(F.col("onset") / F.col("num_steps")).alias("onset_frac"))


STREAKS = """, f AS (SELECT *, value > 30 AS flag, sum(CASE WHEN value > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY episode_key ORDER BY step_id) AS z FROM steps),
streaks AS (SELECT *, CASE WHEN flag THEN count(*) FILTER (WHERE flag) OVER (PARTITION BY episode_key, z ORDER BY step_id) ELSE 0 END AS streak FROM f)
"""


@register("running_streak", STEPS + STREAKS + "SELECT episode_key, step_id, streak FROM streaks")
def running_streak(spark, sf):
    return S.running_streak(steps(spark, sf), F.col("value") > 30).select("episode_key", "step_id", "streak")


@register("longest_run", STEPS + STREAKS + "SELECT episode_key, max(streak) AS longest_run FROM streaks GROUP BY episode_key")
def longest_run(spark, sf):
    return S.longest_run(steps(spark, sf), F.col("value") > 30)


@register("first_run_k", STEPS + STREAKS + "SELECT episode_key, min(step_id - 2) FILTER (WHERE streak >= 3) AS first_run FROM streaks GROUP BY episode_key")
def first_run_k(spark, sf):
    return S.first_run(steps(spark, sf), F.col("value") > 30, 3)


PHASE = "CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END"


def phase():
    t = F.col("event_type")
    return F.when(t == "purchase", 3).when(t == "click", 2).when(t == "view", 1).otherwise(0)


@register("phase_change", STEPS + f"SELECT episode_key, step_id, CAST({PHASE} AS INTEGER) AS phase, CAST(coalesce({PHASE} <> lag({PHASE}) OVER w, false) AS INTEGER) AS changed FROM steps {WINDOW_SQL}")
def phase_change(spark, sf):
    rows = steps(spark, sf).withColumn("phase", phase())
    return rows.select("episode_key", "step_id", "phase", S.changes(F.col("phase")).alias("changed"))


@register("cum_fraction", STEPS + f"SELECT episode_key, step_id, round(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w / (step_id + 1), 6) AS fraction FROM steps {WINDOW_SQL}")
def cum_fraction(spark, sf):
    return steps(spark, sf).select("episode_key", "step_id", r6(S.cumulative_fraction(F.col("event_type") == "click")).alias("fraction"))


@register("time_since_first", STEPS + "SELECT episode_key, step_id, CASE WHEN step_id >= f THEN step_id - f END AS since FROM (SELECT *, min(step_id) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY episode_key) AS f FROM steps)")
def time_since_first(spark, sf):
    return steps(spark, sf).select("episode_key", "step_id", S.since_first(F.col("event_type") == "purchase").alias("since"))


@register("partition_totals", STEPS + "SELECT episode_key, step_id, count(*) FILTER (WHERE event_type = 'click') OVER e AS clicks, count(*) OVER e AS n, round(max(value) OVER e, 6) AS top FROM steps WINDOW e AS (PARTITION BY episode_key)")
def partition_totals(spark, sf):
    return steps(spark, sf).select("episode_key", "step_id", F.count_if(F.col("event_type") == "click").over(S.by_episode()).alias("clicks"), F.count(F.lit(1)).over(S.by_episode()).alias("n"), r6(F.max("value").over(S.by_episode())).alias("top"))


@register("turning_rate", STEPS + f", d AS (SELECT *, k - lag(k) OVER w AS d FROM steps {WINDOW_SQL}), t AS (SELECT *, CASE WHEN sign(d) <> lag(sign(d)) OVER w THEN 1.0 WHEN lag(sign(d)) OVER w IS NOT NULL THEN 0.0 END AS t FROM d WHERE d <> 0 {WINDOW_SQL}) SELECT s.episode_key, round(coalesce(avg(t), 0), 6) AS turning_rate FROM (SELECT DISTINCT episode_key FROM steps) s LEFT JOIN t USING (episode_key) GROUP BY s.episode_key")
def turning_rate(spark, sf):
    return S.turning_rate(steps(spark, sf), "k").select("episode_key", r6("turning_rate").alias("turning_rate"))


@register("total_variation", STEPS + f", d AS (SELECT *, abs(value - lag(value) OVER w) AS d FROM steps {WINDOW_SQL}) SELECT episode_key, round(coalesce(sum(d), 0), 4) AS total_variation, round(coalesce(sum(d), 0) / greatest(1, count(*) - 1), 6) AS variation_per_step FROM d GROUP BY episode_key")
def total_variation(spark, sf):
    return S.total_variation(steps(spark, sf), "value").select("episode_key", F.round("total_variation", 4).alias("total_variation"), r6("variation_per_step").alias("variation_per_step"))


@register("amplitude_turning", STEPS + f", d AS (SELECT *, p - lag(p) OVER w AS a, lead(p) OVER w - p AS b FROM steps {WINDOW_SQL}), c AS (SELECT episode_key, count(*) AS n, count(*) FILTER (WHERE abs(a) > 0.05 AND abs(b) > 0.05) AS eligible, count(*) FILTER (WHERE abs(a) > 0.05 AND abs(b) > 0.05 AND sign(a) <> sign(b)) AS turns FROM d GROUP BY episode_key) SELECT episode_key, eligible, turns, round(turns / nullif(eligible, 0), 6) AS qualified_rate, round(turns / greatest(1, n - 2), 6) AS all_pairs_rate FROM c")
def amplitude_turning(spark, sf):
    return S.amplitude_turning(steps(spark, sf), "p", 0.05).select("episode_key", "eligible", "turns", r6("qualified_rate").alias("qualified_rate"), r6("all_pairs_rate").alias("all_pairs_rate"))


#: Islands of equal values, and their neighbours: a peak is an island over both.
PEAKS = f""", c AS (SELECT *, CASE WHEN k = lag(k) OVER w THEN 0 ELSE 1 END AS new FROM steps {WINDOW_SQL}),
i AS (SELECT *, sum(new) OVER (PARTITION BY episode_key ORDER BY step_id) AS island FROM c),
g AS (SELECT episode_key, island, min(k) AS v, min(step_id) AS l, max(step_id) AS r FROM i GROUP BY 1, 2),
n AS (SELECT *, lag(v) OVER (PARTITION BY episode_key ORDER BY island) AS before, lead(v) OVER (PARTITION BY episode_key ORDER BY island) AS after FROM g),
peaks AS (SELECT episode_key, (l + r) // 2 AS pos, v FROM n WHERE before < v AND after < v)
"""


@register("local_peaks", STEPS + PEAKS + "SELECT episode_key, CAST(pos AS BIGINT) AS pos FROM peaks")
def local_peaks(spark, sf):
    return S.series(steps(spark, sf), "k").select("episode_key", F.explode(S.peaks(F.col("series")).cast("array<long>")).alias("pos"))


@register(
    "prominent_peaks",
    STEPS + PEAKS + """, b AS (SELECT p.episode_key, p.pos, p.v,
  coalesce(max(s.step_id) FILTER (WHERE s.step_id < p.pos AND s.k > p.v), -1) AS l, coalesce(min(s.step_id) FILTER (WHERE s.step_id > p.pos AND s.k > p.v), 1000000) AS r
  FROM peaks p JOIN steps s USING (episode_key) GROUP BY 1, 2, 3),
h AS (SELECT b.episode_key, b.pos, b.v - greatest(min(s.k) FILTER (WHERE s.step_id > b.l AND s.step_id <= b.pos), min(s.k) FILTER (WHERE s.step_id >= b.pos AND s.step_id < b.r)) AS prom
  FROM b JOIN steps s USING (episode_key) GROUP BY b.episode_key, b.pos, b.v),
q AS (SELECT *, pos - lag(pos) OVER (PARTITION BY episode_key ORDER BY pos) AS gap FROM h WHERE prom >= 30)
SELECT s.episode_key, count(q.pos) AS peaks, round(count(q.pos) * 10.0 / s.n, 6) AS per10, round(median(gap), 6) AS median_gap
FROM (SELECT episode_key, count(*) AS n FROM steps GROUP BY 1) s LEFT JOIN q USING (episode_key) GROUP BY s.episode_key, s.n""",
)
def prominent_peaks(spark, sf):
    found = S.series(steps(spark, sf), "k").withColumn("at", S.peaks(F.col("series"), 30))
    gaps = F.zip_with(F.slice("at", 2, F.size("at")), F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda b, a: b - a)
    gaps = F.array_sort(gaps)
    n = F.size("gaps")
    middle = (F.get("gaps", F.floor((n - 1) / 2).cast("int")) + F.get("gaps", F.floor(n / 2).cast("int"))) / 2
    return found.withColumn("gaps", gaps).select("episode_key", F.size("at").cast("long").alias("peaks"), r6(F.size("at") * 10.0 / F.size("series")).alias("per10"), r6(middle).alias("median_gap"))


def with_onset(spark, sf):
    return S.with_onset(steps(spark, sf))


ALIGNED = STEPS + ONSETS + ", al AS (SELECT s.*, o.onset, s.step_id - o.onset AS rel FROM steps s JOIN onsets o USING (episode_key) WHERE o.onset IS NOT NULL) "


@register("event_aligned", ALIGNED + "SELECT rel, count(*) AS n, CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS DOUBLE) / (10000 * count(value)) AS mean_value FROM al WHERE rel BETWEEN -20 AND 20 GROUP BY rel")
def event_aligned(spark, sf):
    rows = with_onset(spark, sf).withColumn("rel", F.col("step_id") - F.col("onset")).where(F.col("rel").between(-20, 20))
    return rows.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), S.exact_mean(F.col("value")).alias("mean_value"))


@register("arg_extreme", ALIGNED + "SELECT episode_key, arg_min(rel, value * 1000000 + rel * 0.0000001) AS low_rel, min(rel) FILTER (WHERE value = hi) AS high_rel FROM (SELECT *, max(value) OVER (PARTITION BY episode_key) AS hi FROM al WHERE rel BETWEEN -10 AND 2) GROUP BY episode_key")
def arg_extreme(spark, sf):
    rows = with_onset(spark, sf).withColumn("rel", F.col("step_id") - F.col("onset")).where(F.col("rel").between(-10, 2))
    return rows.groupBy("episode_key").agg(S.arg_extreme(F.col("value"), F.col("rel"), False).alias("low_rel"), S.arg_extreme(F.col("value"), F.col("rel"), True).alias("high_rel"))


@register("near_minus_pre", ALIGNED + "SELECT episode_key, round(avg(value) FILTER (WHERE rel BETWEEN -3 AND 1) - avg(value) FILTER (WHERE rel BETWEEN -10 AND -1), 6) AS delta FROM al GROUP BY episode_key")
def near_minus_pre(spark, sf):
    rows = with_onset(spark, sf).where("onset IS NOT NULL").withColumn("rel", F.col("step_id") - F.col("onset"))
    part = lambda a, b: F.avg(F.when(F.col("rel").between(a, b), F.col("value")))
    return rows.groupBy("episode_key").agg(r6(part(-3, 1) - part(-10, -1)).alias("delta"))


@register("time_bins", STEPS + ", f AS (SELECT *, least(floor(step_id / greatest(count(*) OVER (PARTITION BY episode_key) - 1, 1) * 20), 19) AS bin FROM steps), e AS (SELECT episode_key, task, bin, avg(value) AS m FROM f GROUP BY 1, 2, 3) SELECT task, CAST(bin AS BIGINT) AS bin, count(*) AS n_episodes, round(avg(m), 6) AS mean_value FROM e GROUP BY task, bin")
def time_bins(spark, sf):
    n = F.count(F.lit(1)).over(S.by_episode())
    rows = steps(spark, sf).withColumn("bin", F.least(F.floor(F.col("step_id") / F.greatest(n - 1, F.lit(1)) * 20), F.lit(19)).cast("long"))
    each = rows.groupBy("episode_key", "task", "bin").agg(F.avg("value").alias("m"))
    return each.groupBy("task", "bin").agg(F.count(F.lit(1)).alias("n_episodes"), r6(F.avg("m")).alias("mean_value"))


@register("phase_bucket", ALIGNED + "SELECT episode_key, CASE WHEN rel BETWEEN -20 AND -11 THEN 'baseline' WHEN rel BETWEEN -10 AND -1 THEN 'pre' WHEN rel BETWEEN 0 AND 9 THEN 'post' END AS phase, count(*) AS n, round(avg(value), 6) AS mean_value FROM al WHERE rel BETWEEN -20 AND 9 GROUP BY 1, 2")
def phase_bucket(spark, sf):
    rel = F.col("step_id") - F.col("onset")
    rows = with_onset(spark, sf).withColumn("phase", F.when(rel.between(-20, -11), "baseline").when(rel.between(-10, -1), "pre").when(rel.between(0, 9), "post"))
    return rows.where("phase IS NOT NULL").groupBy("episode_key", "phase").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean_value"))


@register("first_crossing", ALIGNED + "SELECT episode_key, min(step_id) FILTER (WHERE value > 60 AND rel < -10) AS early, min(step_id) FILTER (WHERE value > 60 AND rel BETWEEN -10 AND -1) AS in_window FROM al GROUP BY episode_key")
def first_crossing(spark, sf):
    rows = with_onset(spark, sf).where("onset IS NOT NULL").withColumn("rel", F.col("step_id") - F.col("onset"))
    first = lambda where: F.min(F.when((F.col("value") > 60) & where, F.col("step_id")))
    return rows.groupBy("episode_key").agg(first(F.col("rel") < -10).alias("early"), first(F.col("rel").between(-10, -1)).alias("in_window"))


_PAIRS = ", pr AS (SELECT a.episode_key, a.step_id, a.event_type AS ta, b.event_type AS tb, a.k AS ka, b.k AS kb FROM steps a JOIN steps b ON b.episode_key = a.episode_key + 1 AND b.step_id = a.step_id) "


@register("first_divergence", STEPS + _PAIRS + ", fd AS (SELECT *, min(step_id) FILTER (WHERE ta IS DISTINCT FROM tb) OVER (PARTITION BY episode_key) AS first_type FROM pr) SELECT episode_key, min(first_type) AS first_type, min(step_id) FILTER (WHERE ka IS DISTINCT FROM kb) AS first_k, count(*) FILTER (WHERE step_id <= first_type) AS compared FROM fd GROUP BY episode_key")
def first_divergence(spark, sf):
    """Two runs step by step, up to the first step on which their types differ."""
    rows = steps(spark, sf).select("episode_key", "step_id", "event_type", "k")
    other = rows.select((F.col("episode_key") - 1).alias("episode_key"), "step_id", F.col("event_type").alias("other_type"), F.col("k").alias("other_k"))
    pairs = rows.join(other, ["episode_key", "step_id"])
    differs = ~F.col("event_type").eqNullSafe(F.col("other_type"))
    pairs = pairs.withColumn("first_type", F.min(F.when(differs, F.col("step_id"))).over(S.by_episode()))
    return pairs.groupBy("episode_key").agg(F.min("first_type").alias("first_type"), F.min(F.when(~F.col("k").eqNullSafe(F.col("other_k")), F.col("step_id"))).alias("first_k"), F.count_if(F.col("step_id") <= F.col("first_type")).alias("compared"))


@register("sustained_flag", STEPS + """, f AS (SELECT *, coalesce(value > 60, false) AS flag, sum(CASE WHEN value > 60 THEN 0 ELSE 1 END) OVER (PARTITION BY episode_key ORDER BY step_id) AS z FROM steps),
s AS (SELECT *, CASE WHEN flag THEN count(*) FILTER (WHERE flag) OVER (PARTITION BY episode_key, z ORDER BY step_id) ELSE 0 END AS streak FROM f),
e AS (SELECT episode_key, count(*) AS num_steps, avg(CAST(flag AS INTEGER)) AS fraction, max(streak) AS max_streak, min(step_id - 2) FILTER (WHERE streak = 3) AS onset_step FROM s GROUP BY 1)
SELECT episode_key, num_steps, round(fraction, 6) AS fraction, max_streak, CAST(onset_step IS NOT NULL AS INTEGER) AS sustained, onset_step, round(onset_step / greatest(num_steps - 1, 1), 6) AS onset_frac, num_steps - 1 - onset_step AS lead_to_end FROM e""")
def sustained_flag(spark, sf):
    """Where a high value first lasts three steps, and how long before the end."""
    out = S.sustained_flag(steps(spark, sf), F.col("value") > 60)
    return out.withColumns({c: F.round(c, 6) for c in ("fraction", "onset_frac")})
