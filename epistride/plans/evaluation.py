"""Catalog: labels, alerts, detectors, statistics and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epistride.functions import stats as T
from epistride.operators import labels as L
from epistride.operators import models as M
from epistride.operators import sequence as S
from epistride.plans.catalog import register
from epistride.plans.relations import LAST
from epistride.plans.sequences import ONSETS, with_onset
from epistride.plans.views import STEPS, read, steps

r6 = lambda c: F.round(c, 6)

def n_of():
    return F.count(F.lit(1))


LABELS = STEPS + ONSETS + """, lab AS (SELECT s.*, o.onset, horizon, CAST(onset IS NULL OR step_id < onset AS INTEGER) AS valid, round(value / 1000, 6) AS score
  FROM steps s JOIN onsets o USING (episode_key), (VALUES (5), (10), (20)) h(horizon)),
ol AS (SELECT *, CAST(valid = 1 AND onset IS NOT NULL AND step_id + horizon >= onset AS INTEGER) AS label FROM lab)
"""


def labelled(spark, sf, horizons=(5, 10, 20)):
    """Steps with their labels by horizon, and a score that stands for a model's."""
    return L.online_labels(with_onset(spark, sf), horizons).withColumn("score", F.round(F.col("value") / 1000, 6)).withColumn("success", F.col("onset").isNull())


@register("online_labels", LABELS + "SELECT CAST(horizon AS INTEGER) AS horizon, valid, label, count(*) AS n FROM ol GROUP BY horizon, valid, label")
def online_labels(spark, sf):
    return labelled(spark, sf).groupBy("horizon", "valid", "label").agg(n_of().alias("n"))


@register("onset_validation", STEPS + ONSETS + "SELECT episode_key, onset, CASE WHEN episode_key % 2 = 0 THEN onset ELSE onset + 1 END AS manual, onset IS NOT DISTINCT FROM (CASE WHEN episode_key % 2 = 0 THEN onset ELSE onset + 1 END) AS onset_match FROM onsets")
def onset_validation(spark, sf):
    found = S.plateau_onset(steps(spark, sf))
    manual = F.when(F.col("episode_key") % 2 == 0, F.col("onset")).otherwise(F.col("onset") + 1)
    return found.select("episode_key", "onset", manual.alias("manual"), F.col("onset").eqNullSafe(manual).alias("onset_match"))


THRESHOLDS = LABELS + """, mx AS (SELECT horizon, episode_key, max(score) AS m FROM ol WHERE valid = 1 AND onset IS NULL GROUP BY 1, 2),
cand AS (SELECT DISTINCT horizon, score AS t FROM ol WHERE valid = 1 UNION ALL SELECT DISTINCT horizon, 'Infinity'::DOUBLE FROM ol),
ok AS (SELECT c.horizon, t FROM cand c JOIN mx USING (horizon) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE m >= t) <= floor(0.1 * count(*) + 1e-12)),
th AS (SELECT horizon, min(t) AS threshold FROM ok GROUP BY horizon)
"""


def with_threshold(spark, sf):
    rows = labelled(spark, sf).where("valid = 1")
    return rows.join(L.far_threshold(rows, "score", ["horizon"]), "horizon")


@register("far_threshold", THRESHOLDS + "SELECT CAST(horizon AS INTEGER) AS horizon, CAST(threshold AS DOUBLE) AS threshold FROM th")
def far_threshold(spark, sf):
    return L.far_threshold(labelled(spark, sf).where("valid = 1"), "score", ["horizon"])


ALERTS = THRESHOLDS + """, v AS (SELECT ol.*, threshold FROM ol JOIN th USING (horizon) WHERE valid = 1),
fired AS (SELECT *, score >= threshold AS t0, coalesce(CASE WHEN count(score) OVER w3 = 3 THEN avg(score) OVER w3 >= threshold END, false) AS t1,
  coalesce(score >= threshold AND lag(score >= threshold) OVER w, false) AS t2 FROM v
  WINDOW w AS (PARTITION BY horizon, episode_key ORDER BY step_id), w3 AS (PARTITION BY horizon, episode_key ORDER BY step_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
d AS (SELECT horizon, episode_key, onset, step_id, unnest(['T0', 'T1', 'T2']) AS detector, unnest([t0, t1, t2]) AS alert FROM fired),
e AS (SELECT horizon, detector, episode_key, onset, bool_or(alert) AS any_alert, bool_or(alert AND step_id >= onset - horizon) AS in_window, min(step_id) FILTER (WHERE alert AND step_id < onset - horizon) AS early FROM d GROUP BY ALL)
"""


@register("detectors", ALERTS + "SELECT CAST(horizon AS INTEGER) AS horizon, detector, round(count(*) FILTER (WHERE onset IS NULL AND any_alert) / greatest(1, count(*) FILTER (WHERE onset IS NULL)), 6) AS far, round(count(*) FILTER (WHERE in_window) / greatest(1, count(*) FILTER (WHERE onset IS NOT NULL)), 6) AS detection, round(count(*) FILTER (WHERE early IS NOT NULL) / greatest(1, count(*) FILTER (WHERE onset IS NOT NULL)), 6) AS premature, round(avg(onset - early), 6) AS mean_lead FROM e GROUP BY horizon, detector")
def detectors(spark, sf):
    rows = with_threshold(spark, sf)
    alerts = L.detector_alerts(F.col("score"), F.col("threshold"), Window.partitionBy("horizon", "episode_key").orderBy("step_id"))
    rows = rows.withColumns(alerts).select("horizon", "episode_key", "onset", "step_id", F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), F.col(n).alias("alert")) for n in alerts])).alias("d"))
    alert, start = F.col("d.alert"), F.col("onset") - F.col("horizon")
    each = rows.groupBy("horizon", F.col("d.detector").alias("detector"), "episode_key", "onset").agg(F.bool_or(alert).alias("any_alert"), F.bool_or(alert & (F.col("step_id") >= start)).alias("in_window"), F.min(F.when(alert & (F.col("step_id") < start), F.col("step_id"))).alias("early"))
    bad, good = F.col("onset").isNotNull(), F.col("onset").isNull()
    share = lambda x, of: r6(F.count_if(x) / F.greatest(F.lit(1), F.count_if(of)))
    return each.groupBy("horizon", "detector").agg(share(good & F.col("any_alert"), good).alias("far"), share(F.coalesce("in_window", F.lit(False)), bad).alias("detection"), share(F.col("early").isNotNull(), bad).alias("premature"), r6(F.avg(F.col("onset") - F.col("early"))).alias("mean_lead"))


@register("premature_alerts", ALERTS + ", p AS (SELECT horizon, episode_key, onset, min(step_id) AS first_alert, count(*) AS n FROM v WHERE onset IS NOT NULL AND score >= threshold AND step_id < onset - horizon GROUP BY 1, 2, 3) SELECT CAST(horizon AS INTEGER) AS horizon, count(*) AS episodes, CAST(sum(n) AS BIGINT) AS alerts, round(median(onset - first_alert), 6) AS median_distance, max(onset - first_alert) AS max_distance FROM p GROUP BY horizon")
def premature_alerts(spark, sf):
    rows = with_threshold(spark, sf).where(F.col("onset").isNotNull() & (F.col("score") >= F.col("threshold")) & (F.col("step_id") < F.col("onset") - F.col("horizon")))
    each = rows.groupBy("horizon", "episode_key", "onset").agg(F.min("step_id").alias("first_alert"), n_of().alias("n"))
    d = F.col("onset") - F.col("first_alert")
    return each.groupBy("horizon").agg(n_of().alias("episodes"), F.sum("n").alias("alerts"), r6(F.median(d)).alias("median_distance"), F.max(d).alias("max_distance"))


BY_TASK = LABELS + """, mx AS (SELECT horizon, task, episode_key, max(score) AS m FROM ol WHERE valid = 1 AND onset IS NULL GROUP BY 1, 2, 3),
cand AS (SELECT DISTINCT horizon, task, score AS t FROM ol WHERE valid = 1 UNION ALL SELECT DISTINCT horizon, task, 'Infinity'::DOUBLE FROM ol),
ok AS (SELECT c.horizon, c.task, t FROM cand c LEFT JOIN mx ON mx.horizon = c.horizon AND mx.task = c.task GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE m >= t) <= floor(0.1 * count(m) + 1e-12)),
th AS (SELECT horizon, task, min(t) AS threshold FROM ok GROUP BY 1, 2),
al AS (SELECT ol.*, threshold FROM ol JOIN th ON th.horizon = ol.horizon AND th.task = ol.task WHERE valid = 1 AND score >= threshold AND onset - step_id > ol.horizon)
"""


@register("premature_events", BY_TASK + "SELECT task, CAST(horizon AS INTEGER) AS horizon, episode_key, step_id, onset, onset - step_id AS distance, onset - step_id - horizon AS over_horizon, score, threshold, row_number() OVER (PARTITION BY task, horizon, episode_key ORDER BY step_id) = 1 AS first FROM al")
def premature_events(spark, sf):
    """Each premature alert, with a threshold for each task."""
    rows = labelled(spark, sf).where("valid = 1")
    rows = rows.join(L.far_threshold(rows, "score", ["horizon", "task"]), ["horizon", "task"])
    return L.premature_events(rows, ["task", "horizon"])


@register("episode_scores", LABELS + "SELECT episode_key, round(max(score), 6) AS top, CAST(sum(CAST(round(score * 1000000) AS BIGINT)) AS DOUBLE) / count(score) AS mean_micro, round(arg_max(score, step_id), 6) AS last FROM ol WHERE valid = 1 AND horizon = 5 GROUP BY episode_key")
def episode_scores(spark, sf):
    """Largest, mean (in millionths, from whole numbers, so that no order of summation shows) and last score of each episode."""
    rows = labelled(spark, sf, (5,)).where("valid = 1")
    return rows.groupBy("episode_key").agg(r6(F.max("score")).alias("top"), (F.sum(F.round(F.col("score") * 1000000).cast("long")).cast("double") / F.count("score")).alias("mean_micro"), r6(F.max_by("score", "step_id")).alias("last"))


@register("rank_metrics", """WITH x AS (SELECT lang, n_chars AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS rk FROM x),
u AS (SELECT lang, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS q, sum(rk) FILTER (WHERE y) AS rs FROM r GROUP BY 1),
h AS (SELECT lang, s, count(*) FILTER (WHERE y) AS pos, count(*) AS n FROM x GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER (PARTITION BY lang ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY lang ORDER BY s DESC) AS k FROM h),
a AS (SELECT lang, sum(pos * tp / k) / sum(pos) AS ap, sum(CAST(n AS DOUBLE) * (n * n - 1)) AS ties FROM c GROUP BY 1)
SELECT lang, p AS n_pos, q AS n_neg, CASE WHEN p * q > 0 THEN round((rs - p * (p + 1) / 2.0) / (p * q), 6) END AS auroc, round(ap, 6) AS average_precision, CASE WHEN p * q > 0 THEN CAST(rs - p * (p + 1) / 2.0 AS DOUBLE) END AS u,
  CASE WHEN p * q > 0 THEN round(greatest(abs(rs - p * (p + 1) / 2.0 - p * q / 2.0) - 0.5, 0) / sqrt(p * q / 12.0 * ((p + q + 1) - ties / ((p + q) * (p + q - 1.0)))), 5) END AS z FROM u JOIN a USING (lang)""")
def rank_metrics(spark, sf):
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select("lang", "n_chars", (F.col("quality") == 1).alias("y"))
    out = T.rank_metrics(rows, "n_chars", F.col("y"), ["lang"])
    return out.select("lang", "n_pos", "n_neg", r6("auroc").alias("auroc"), r6("average_precision").alias("average_precision"), F.col("u").cast("double").alias("u"), F.round("z", 5).alias("z"))


@register("pairwise_auc", STEPS + LAST + ", t AS (SELECT DISTINCT e.episode_key, task, last_type = 'error' AS y, round(top) AS s FROM ends e JOIN steps USING (episode_key)) SELECT a.task, round(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END), 6) AS auc FROM t a JOIN t b ON a.task = b.task AND a.y AND NOT b.y GROUP BY a.task")
def pairwise_auc(spark, sf):
    """Wins of failures over successes, ties half; from ranks instead of pairs."""
    ends = steps(spark, sf).groupBy("episode_key", "task").agg((F.max_by("event_type", "step_id") == "error").alias("y"), F.round(F.max("value")).alias("s"))
    return T.rank_metrics(ends, "s", F.col("y"), ["task"]).where("auroc IS NOT NULL").select("task", r6("auroc").alias("auc"))


EPISODES = STEPS + LAST + ", ep AS (SELECT e.episode_key, any_value(task) AS task, last_type = 'error' AS y, avg(value) AS m_value, avg(p) AS m_p, avg(k) AS m_k FROM ends e JOIN steps USING (episode_key) GROUP BY 1, 3)"


def episodes(spark, sf):
    return steps(spark, sf).groupBy("episode_key", "task").agg((F.max_by("event_type", "step_id") == "error").alias("y"), F.avg("value").alias("m_value"), F.avg("p").alias("m_p"), F.avg("k").alias("m_k"))


@register("effect_table", EPISODES + ", l AS (SELECT task, y, unnest(['m_value', 'm_p', 'm_k']) AS metric, unnest([m_value, m_p, m_k]) AS x FROM ep), g AS (SELECT task, metric, count(*) FILTER (WHERE y) AS n, count(*) FILTER (WHERE NOT y) AS m, avg(x) FILTER (WHERE y) AS a, avg(x) FILTER (WHERE NOT y) AS b, var_samp(x) FILTER (WHERE y) AS va, var_samp(x) FILTER (WHERE NOT y) AS vb FROM l GROUP BY 1, 2) SELECT task, metric, n AS n_fail, m AS n_ok, round(a - b, 5) AS effect, round((a - b) / sqrt(((n - 1) * va + (m - 1) * vb) / (n + m - 2)), 5) AS d, n < 3 OR m < 3 AS small_n FROM g")
def effect_table(spark, sf):
    rows = episodes(spark, sf).unpivot(["task", "y"], ["m_value", "m_p", "m_k"], "metric", "x")
    y, x = F.col("y"), F.col("x")
    n, m = F.count_if(y), F.count_if(~y)
    return rows.groupBy("task", "metric").agg(n.alias("n_fail"), m.alias("n_ok"), F.round(F.avg(F.when(y, x)) - F.avg(F.when(~y, x)), 5).alias("effect"), F.round(T.cohen_d(x, y, None), 5).alias("d"), ((n < 3) | (m < 3)).alias("small_n"))


@register("threshold_margins", EPISODES + " SELECT task, round(max(m_value) FILTER (WHERE NOT y), 6) AS top_ok, round(min(m_value) FILTER (WHERE y), 6) AS low_fail, round(min(m_value) FILTER (WHERE y) - max(m_value) FILTER (WHERE NOT y), 6) AS margin FROM ep GROUP BY task")
def threshold_margins(spark, sf):
    y, x = F.col("y"), F.col("m_value")
    ok, bad = F.max(F.when(~y, x)), F.min(F.when(y, x))
    return episodes(spark, sf).groupBy("task").agg(r6(ok).alias("top_ok"), r6(bad).alias("low_fail"), r6(bad - ok).alias("margin"))


#: Draws of the reference: of units, and of episodes.
DRAWS = 2000
CLUSTER_DRAWS = 1000
BOOT = EPISODES + f""", ix AS (SELECT y, m_value, row_number() OVER (PARTITION BY y ORDER BY episode_key) - 1 AS i, count(*) OVER (PARTITION BY y) AS n FROM ep),
dr AS (SELECT y, b, CAST(('0x' || substr(md5(concat_ws('-', 42, b, i)), 1, 8)) AS BIGINT) % n AS j FROM ix, range(1, {DRAWS + 1}) r(b)),
df AS (SELECT b, avg(m_value) FILTER (WHERE ix.y) - avg(m_value) FILTER (WHERE NOT ix.y) AS diff FROM dr JOIN ix ON ix.y = dr.y AND ix.i = dr.j GROUP BY b)
"""


@register("bootstrap_ci", BOOT + "SELECT round(quantile_cont(diff, 0.025), 5) AS lo, round(quantile_cont(diff, 0.975), 5) AS hi, round(avg(diff), 5) AS mean FROM df")
def bootstrap_ci(spark, sf):
    units = T.numbered(episodes(spark, sf).select("y", "m_value", "episode_key"), ["y"], "episode_key")
    d = T.bootstrap_difference(units, "m_value", "y", DRAWS)
    return d.agg(F.round(F.percentile("diff", 0.025), 5).alias("lo"), F.round(F.percentile("diff", 0.975), 5).alias("hi"), F.round(F.avg("diff"), 5).alias("mean"))


BINNED = STEPS + LAST + f""", f AS (SELECT s.episode_key, task, last_type = 'error' AS failed, value, CAST(least(floor(step_id / greatest(count(*) OVER (PARTITION BY s.episode_key) - 1, 1) * 20), 19) AS BIGINT) AS bin FROM steps s JOIN ends e ON e.episode_key = s.episode_key),
ix AS (SELECT *, row_number() OVER (PARTITION BY task, failed, bin ORDER BY episode_key) - 1 AS i, count(*) OVER (PARTITION BY task, failed, bin) AS n FROM (SELECT task, failed, bin, episode_key, avg(value) AS m FROM f GROUP BY 1, 2, 3, 4 HAVING count(value) > 0)),
dr AS (SELECT task, failed, bin, b, CAST(('0x' || substr(md5(concat_ws('-', 43, task, failed, bin, b, i)), 1, 8)) AS BIGINT) % n AS i FROM ix, range(1, {DRAWS + 1}) r(b)),
bm AS (SELECT task, failed, bin, b, avg(m) AS mean FROM dr JOIN ix USING (task, failed, bin, i) GROUP BY 1, 2, 3, 4),
ci AS (SELECT task, failed, bin, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM bm GROUP BY 1, 2, 3)
"""


@register("bin_bootstrap", BINNED + "SELECT task, failed, bin, n_episodes, round(mean, 5) AS mean, round(lo, 5) AS lo, round(hi, 5) AS hi FROM ci JOIN (SELECT task, failed, bin, count(*) AS n_episodes, avg(m) AS mean FROM ix GROUP BY 1, 2, 3) USING (task, failed, bin)")
def bin_bootstrap(spark, sf):
    """Mean value of episodes in each twentieth of their course by task and outcome, with its 95 % interval over resampled episodes."""
    by = ["task", "failed", "bin"]
    n = n_of().over(S.by_episode())
    rows = steps(spark, sf).withColumn("bin", F.least(F.floor(F.col("step_id") / F.greatest(n - 1, F.lit(1)) * 20), F.lit(19)).cast("long"))
    last = rows.groupBy("episode_key").agg((F.max_by("event_type", "step_id") == "error").alias("failed"))
    each = rows.join(last, "episode_key").groupBy(*by, "episode_key").agg(F.avg("value").alias("m")).where("m IS NOT NULL")
    ends = T.bootstrap_mean(T.numbered(each, by, "episode_key"), "m", by, DRAWS).groupBy(*by).agg(F.percentile("mean", 0.025).alias("lo"), F.percentile("mean", 0.975).alias("hi"))
    out = each.groupBy(*by).agg(n_of().alias("n_episodes"), F.avg("m").alias("mean")).join(ends, by)
    return out.select(*by, "n_episodes", *[F.round(c, 5).alias(c) for c in ("mean", "lo", "hi")])


@register("cluster_bootstrap", LABELS + f""", un AS (SELECT episode_key, row_number() OVER (ORDER BY episode_key) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT episode_key FROM ol)),
pk AS (SELECT b, CAST(('0x' || substr(md5(concat_ws('-', 7, b, i)), 1, 8)) AS BIGINT) % n AS j FROM un, range(1, {CLUSTER_DRAWS + 1}) r(b)),
ml AS (SELECT b, episode_key, count(*) AS c FROM pk JOIN un ON un.i = pk.j GROUP BY 1, 2),
hs AS (SELECT b, score, sum(c) FILTER (WHERE label = 1) AS pos, sum(c) FILTER (WHERE label = 0) AS neg FROM ol JOIN ml USING (episode_key) WHERE horizon = 10 AND valid = 1 AND score IS NOT NULL GROUP BY 1, 2),
cu AS (SELECT b, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce(sum(coalesce(neg, 0)) OVER (PARTITION BY b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under,
  sum(coalesce(pos, 0)) OVER (PARTITION BY b ORDER BY score DESC) AS tp, sum(coalesce(pos, 0) + coalesce(neg, 0)) OVER (PARTITION BY b ORDER BY score DESC) AS k FROM hs),
me AS (SELECT b, sum(pos * (under + neg / 2.0)) / (sum(pos) * sum(neg)) AS auroc, sum(pos * tp / k) / sum(pos) AS ap FROM cu GROUP BY b HAVING sum(pos) > 0 AND sum(neg) > 0)
SELECT count(*) AS draws, round(quantile_cont(auroc, 0.025), 6) AS auroc_lo, round(quantile_cont(auroc, 0.975), 6) AS auroc_hi, round(quantile_cont(ap, 0.025), 6) AS ap_lo, round(quantile_cont(ap, 0.975), 6) AS ap_hi FROM me""")
def cluster_bootstrap(spark, sf):
    """95 % intervals of AUROC and average precision over resampled episodes, from the draws that hold both classes."""
    rows = labelled(spark, sf, (10,)).where("valid = 1")
    units = steps(spark, sf).select("episode_key").distinct()
    d = T.cluster_bootstrap(rows, units, "episode_key", "score", "label", CLUSTER_DRAWS)
    ends = [r6(F.percentile(m, q)).alias(f"{m}_{n}") for m in ("auroc", "ap") for n, q in (("lo", 0.025), ("hi", 0.975))]
    return d.agg(n_of().alias("draws"), *ends)


@register("feature_scan", "WITH d AS (SELECT doc_id, label, vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x, label % 3 AS task, vec_id % 2 = 0 AS y FROM (SELECT vec_id AS doc_id, * FROM embeddings), range(64) r(i)), g AS (SELECT task, i, count(*) FILTER (WHERE y) AS n, count(*) FILTER (WHERE NOT y) AS m, avg(x) FILTER (WHERE y) - avg(x) FILTER (WHERE NOT y) AS e, var_samp(x) FILTER (WHERE y) AS va, var_samp(x) FILTER (WHERE NOT y) AS vb FROM d GROUP BY 1, 2), c AS (SELECT task, i, e / sqrt(((n - 1) * va + (m - 1) * vb) / (n + m - 2)) AS d FROM g) SELECT CAST(i AS INTEGER) AS feature, round(avg(abs(d)), 6) AS mean_abs_d, min(d) > 0 OR max(d) < 0 AS same_sign FROM c GROUP BY i HAVING count(d) = 3 ORDER BY avg(abs(d)) DESC, i LIMIT 25")
def feature_scan(spark, sf):
    rows = read(spark, sf, "embeddings").select((F.col("label") % 3).alias("task"), (F.col("vec_id") % 2 == 0).alias("y"), F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "x"))
    d = rows.groupBy("task", "feature").agg(T.cohen_d(F.col("x"), F.col("y")).alias("d"))
    out = d.groupBy("feature").agg(F.avg(F.abs("d")).alias("m"), ((F.min("d") > 0) | (F.max("d") < 0)).alias("same_sign"), F.count("d").alias("n")).where("n = 3")
    return out.orderBy(F.desc("m"), "feature").limit(25).select("feature", r6("m").alias("mean_abs_d"), "same_sign")


@register("family_scores", EPISODES + ", mo AS (SELECT avg(m_value) AS a1, stddev_pop(m_value) AS s1, avg(m_p) AS a2, stddev_pop(m_p) AS s2, avg(m_k) AS a3, stddev_pop(m_k) AS s3 FROM ep) SELECT episode_key, round(((m_value - a1) / s1 + (m_p - a2) / s2) / 2, 5) AS family_signal, round((m_k - a3) / s3, 5) AS family_other FROM ep, mo")
def family_scores(spark, sf):
    out = M.family_scores(episodes(spark, sf), {"signal": ["m_value", "m_p"], "other": ["m_k"]})
    return out.select("episode_key", F.round("family_signal", 5).alias("family_signal"), F.round("family_other", 5).alias("family_other"))


@register("adjusted_rand", "WITH x AS (SELECT label AS a, CAST(vec_id % 4 AS INTEGER) AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM x GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS i, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS l, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS r, (SELECT sum(n) FROM c) AS t) SELECT round((i - l * r / (t * (t - 1) / 2)) / ((l + r) / 2 - l * r / (t * (t - 1) / 2)), 6) AS ari FROM s")
def adjusted_rand(spark, sf):
    rows = read(spark, sf, "embeddings").withColumn("b", (F.col("vec_id") % 4).cast("int"))
    return T.adjusted_rand(rows, "label", "b").select(r6("ari").alias("ari"))


@register("group_kfold")
def group_kfold(spark, sf):
    """Rows and episodes of each fold."""
    rows = L.with_folds(steps(spark, sf), "episode_key")
    return rows.groupBy("fold").agg(n_of().alias("n"), F.countDistinct("episode_key").alias("episodes"))


@register("oof_logistic")
def oof_logistic(spark, sf):
    """Out-of-fold scores of every valid step at horizon 10."""
    rows = labelled(spark, sf, (10,)).where("valid = 1").select("episode_key", "step_id", "label", F.col("value").alias("feat_value"), F.col("k").cast("double").alias("feat_k"))
    return M.grouped_oof(rows, ["feat_value", "feat_k"], "label", folds=5).select("episode_key", "step_id", "fold", "label", r6("score").alias("score"))


@register("cluster_modes")
def cluster_modes(spark, sf):
    """Two clusters of episodes, cluster 0 with the larger mean value."""
    return M.clusters(episodes(spark, sf).select("episode_key", "m_value", "m_k"), ["m_value", "m_k"], 2, tries=100).select("episode_key", "cluster")


@register("cluster_stability")
def cluster_stability(spark, sf):
    """Agreement of two clusters of failed episodes with those found without each of them."""
    failed = episodes(spark, sf).where("y").select("episode_key", "m_value", "m_k")
    return M.cluster_stability(failed, ["m_value", "m_k"], "episode_key").select("episode_key", r6("ari").alias("ari"))
