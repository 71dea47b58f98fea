"""Catalog: prefixes of episodes, leads of alerts, groups left out, correlations with outcomes, exact rank tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from epistride.functions import stats as T
from epistride.operators import ablations as A
from epistride.operators import generalize as G
from epistride.operators import sequence as S
from epistride.plans.catalog import register
from epistride.plans.evaluation import ALERTS, EPISODES, episodes, r6, with_threshold
from epistride.plans.relations import LAST
from epistride.plans.reports import erfc_sql
from epistride.plans.sequences import with_onset
from epistride.plans.views import STEPS, read, steps


def judged(spark, sf):
    """Steps with a score that stands for a model's, and whether their episode failed."""
    rows = steps(spark, sf)
    last = rows.groupBy("episode_key").agg((F.max_by("event_type", "step_id") == "error").alias("failed"))
    return rows.join(last, "episode_key").withColumn("score", F.round(F.col("value") / 1000, 6))


_JUDGED = STEPS + LAST + ", j AS (SELECT s.*, last_type = 'error' AS failed, round(value / 1000, 6) AS score FROM steps s JOIN ends USING (episode_key))"
_AUC = """r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {s}) + (count(*) OVER (PARTITION BY {by}, {s}) - 1) / 2.0 AS rk FROM {of}),
u AS (SELECT {by}, count(*) FILTER (WHERE failed) AS p, count(*) FILTER (WHERE NOT failed) AS q, sum(rk) FILTER (WHERE failed) AS rs FROM r GROUP BY ALL)"""


@register("prefix_auroc", _JUDGED + """, i AS (SELECT *, row_number() OVER (PARTITION BY episode_key ORDER BY step_id) - 1 AS i, count(*) OVER (PARTITION BY episode_key) AS n FROM j),
t AS (SELECT task, percent, episode_key, failed, max(score) AS top FROM i, (VALUES (10), (25), (50), (75), (100)) c(percent) WHERE i * 100 < percent * n GROUP BY ALL),
""" + _AUC.format(by="task, percent", s="top", of="t") + "SELECT task, CAST(percent AS INTEGER) AS percent, p AS failures, q AS successes, CASE WHEN p * q > 0 THEN round((rs - p * (p + 1) / 2.0) / (p * q), 6) END AS auroc FROM u")
def prefix_auroc(spark, sf):
    out = G.prefix_metrics(judged(spark, sf), "score", "failed", ["task"])
    return out.select("task", "percent", F.col("n_pos").alias("failures"), F.col("n_neg").alias("successes"), r6("auroc").alias("auroc"))


@register("alert_leads", ALERTS + """, f AS (SELECT horizon, episode_key, onset, min(step_id) FILTER (WHERE t0) AS first_alert FROM fired WHERE onset IS NOT NULL GROUP BY ALL),
n AS (SELECT episode_key, count(*) AS num_steps FROM steps GROUP BY 1)
SELECT CAST(horizon AS INTEGER) AS horizon, episode_key, first_alert, num_steps - first_alert AS l_end, onset - first_alert AS l_onset, round((onset - first_alert) / num_steps, 6) AS l_norm FROM f JOIN n USING (episode_key)""")
def alert_leads(spark, sf):
    """One row for each failed episode and horizon: how long before its onset and its end the first score reached the threshold."""
    rows = with_threshold(spark, sf).where("onset IS NOT NULL")
    first = rows.groupBy("horizon", "episode_key", "onset").agg(F.min(F.when(F.col("score") >= F.col("threshold"), F.col("step_id"))).alias("first_alert"))
    n = steps(spark, sf).groupBy("episode_key").agg(F.count(F.lit(1)).alias("num_steps"))
    out = G.lead_times(first.join(n, "episode_key"))
    return out.select("horizon", "episode_key", "first_alert", "l_end", "l_onset", r6("l_norm").alias("l_norm"))


@register("point_biserial", EPISODES + """, l AS (SELECT task, y, unnest(['m_value', 'm_p', 'm_k']) AS feature, unnest([m_value, m_p, m_k]) AS x FROM ep),
c AS (SELECT task, feature, count(*) AS n, corr(x, CAST(y AS DOUBLE)) AS r FROM l WHERE x IS NOT NULL GROUP BY ALL)
SELECT task, feature, n, CASE WHEN isfinite(r) THEN round(r, 6) END AS r, CASE WHEN isfinite(r) AND abs(r) < 1 THEN round(r * sqrt((n - 2) / (1 - r * r)), 5) END AS t FROM c""")
def point_biserial(spark, sf):
    out = G.point_biserial(episodes(spark, sf), ["m_value", "m_p", "m_k"], F.col("y"), ["task"])
    return out.select("task", "feature", "n", r6("r").alias("r"), F.round("t", 5).alias("t"))


@register("leave_one_task_out", _JUDGED + """, e AS (SELECT task, episode_key, failed, max(score) AS m FROM j GROUP BY ALL),
g AS (SELECT DISTINCT task AS held_out FROM j),
k AS (SELECT held_out, score AS t FROM g JOIN j ON task <> held_out GROUP BY ALL UNION ALL SELECT held_out, 'Infinity'::DOUBLE FROM g),
a AS (SELECT held_out, t FROM k JOIN e ON task <> held_out AND NOT failed GROUP BY 1, 2 HAVING count(*) FILTER (WHERE m >= t) <= floor(0.1 * count(*) + 1e-12)),
h AS (SELECT held_out, min(t) AS threshold FROM a GROUP BY 1),
""" + _AUC.format(by="task", s="m", of="e") + """
SELECT held_out, threshold, q AS n_success, p AS n_failure, round(count(*) FILTER (WHERE NOT failed AND m >= threshold) / nullif(q, 0), 6) AS far, round(count(*) FILTER (WHERE failed AND m >= threshold) / nullif(p, 0), 6) AS detection,
  CASE WHEN p * q > 0 THEN round((rs - p * (p + 1) / 2.0) / (p * q), 6) END AS auroc FROM e JOIN h ON task = held_out JOIN u USING (task) GROUP BY held_out, threshold, p, q, rs""")
def leave_one_task_out(spark, sf):
    rows = judged(spark, sf).withColumn("success", ~F.col("failed"))
    out = G.leave_one_group_out(rows, "score", "task")
    return out.select("held_out", "threshold", "n_success", "n_failure", *[r6(c).alias(c) for c in ("far", "detection", "auroc")])


@register("mann_whitney_u", """WITH RECURSIVE x AS (SELECT s_nationkey AS nation, s_acctbal AS s, s_suppkey % 3 = 0 AS failed FROM supplier),
f AS (SELECT 0 AS n1, 0 AS n2, 0 AS u, 1::DOUBLE AS c, 0 AS level UNION ALL
  SELECT n1, n2, u, sum(c) AS c, any_value(level) AS level FROM (SELECT n1 + 1 AS n1, n2, u + n2 AS u, c, level + 1 AS level FROM f UNION ALL SELECT n1, n2 + 1, u, c, level + 1 FROM f) WHERE n1 <= 8 AND n2 <= 128 GROUP BY n1, n2, u),
""" + _AUC.format(by="nation", s="s", of="x") + f""",
h AS (SELECT nation, max(n) AS most, sum(CAST(n AS DOUBLE) * (n * n - 1)) AS ties FROM (SELECT nation, s, count(*) AS n FROM x GROUP BY ALL) GROUP BY 1),
v AS (SELECT nation, p, q, most, rs - p * (p + 1) / 2.0 AS u, greatest(abs(rs - p * (p + 1) / 2.0 - p * q / 2.0) - 0.5, 0) / sqrt(p * q / 12.0 * ((p + q + 1) - ties / ((p + q) * (p + q - 1.0)))) / sqrt(2) AS x FROM u JOIN h USING (nation)),
e AS (SELECT nation, least(1.0, 2 * sum(f.c) FILTER (WHERE f.u >= greatest(v.u, p * q - v.u)) / sum(f.c)) AS p_exact FROM v JOIN f ON f.n1 = least(p, q) AND f.n2 = greatest(p, q) AND least(p, q) <= 8 AND p * q > 0 AND most = 1 GROUP BY 1)
SELECT v.nation, p AS n_pos, q AS n_neg, CASE WHEN p * q > 0 THEN CAST(u AS DOUBLE) END AS u, CASE WHEN p * q > 0 THEN round(coalesce(p_exact, {erfc_sql('x')}), 9) END AS p, p_exact IS NOT NULL AS exact FROM v LEFT JOIN e USING (nation)""")
def mann_whitney_u(spark, sf):
    """Whether balances of every third supplier differ from the others' in their nation: exact where samples are small."""
    rows = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("s"), (F.col("s_suppkey") % 3 == 0).alias("y"))
    out = T.mann_whitney(rows, "s", F.col("y"), ["nation"])
    return out.select("nation", "n_pos", "n_neg", F.col("u").cast("double").alias("u"), F.round("p", 9).alias("p"), "exact")


#: Sets of features that are compared: the value alone, with its changes, counts alone, counts and means, all of them.
SETS = {
    "A0": ["feat_value"],
    "A1": ["feat_value", "feat_value_jump"],
    "A2": ["feat_k", "feat_k_jump"],
    "A3": ["feat_k", "feat_k_jump", "feat_value_mean"],
    "A4": ["feat_value", "feat_value_jump", "feat_k", "feat_k_jump", "feat_value_mean"],
}


@register("ablation_table")
def ablation_table(spark, sf):
    """Each set of features at each horizon: nested out-of-fold scores of all valid steps, and what they tell of steps, episodes and alerts."""
    rows = with_onset(spark, sf)
    value, k = F.col("value"), F.col("k").cast("double")
    rows = rows.select("episode_key", "step_id", "onset", value.alias("feat_value"), S.difference(value).alias("feat_value_jump"), k.alias("feat_k"), S.difference(k).alias("feat_k_jump"), S.rolling_mean(value).alias("feat_value_mean"))
    return A.ablations(A.scored_sets(rows, SETS))
