"""Catalog: predicates, joins, aggregations, sets and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epistride.functions import values as V
from epistride.operators import sequence as S
from epistride.plans.catalog import register
from epistride.plans.sequences import ALIGNED, ONSETS, with_onset
from epistride.plans.views import STEPS, WINDOW_SQL, read, steps
from epistride.sources import walks

r6 = lambda c: F.round(c, 6)

def n_of():
    return F.count(F.lit(1))



# Predicates and projections


@register("numeric_coercion", "SELECT doc_id, NOT coalesce(isfinite(try_cast(regexp_replace(text, '[^0-9.]', '', 'g') AS DOUBLE)), false) AS bad, CASE WHEN lower(lang) IN ('en', 'de') THEN true WHEN lang = 'fr' THEN false END AS flag FROM documents")
def numeric_coercion(spark, sf):
    """Whether the digits and points of a text are no finite number (infinities are nulls, as everywhere), and a truth value of its language."""
    lang = F.col("lang")
    spelled = F.when(F.lower(lang).isin("en", "de"), "yes").when(lang == "fr", "no").otherwise("maybe")
    return read(spark, sf, "documents").select("doc_id", V.number(F.regexp_replace("text", "[^0-9.]", "")).isNull().alias("bad"), V.truth(spelled).alias("flag"))


@register("clip_progress", STEPS + "SELECT episode_key, step_id, round(least(greatest(coalesce(value, 0) / 100, 0), 1), 6) AS progress FROM steps")
def clip_progress(spark, sf):
    return steps(spark, sf).select("episode_key", "step_id", r6(V.progress(F.col("value"), 100)).alias("progress"))


@register("range_filter", STEPS + "SELECT episode_key, step_id, k FROM steps WHERE step_id BETWEEN 10 AND 20 AND task = 't2' AND k IS NOT NULL")
def range_filter(spark, sf):
    return steps(spark, sf).where(F.col("step_id").between(10, 20) & (F.col("task") == "t2") & F.col("k").isNotNull()).select("episode_key", "step_id", "k")


@register("condition_grid", "SELECT CAST(o * 25 + x * 5 + y AS BIGINT) AS condition_id, CAST(o AS BIGINT) AS orientation, CAST(round(-0.35 + 0.1 * x, 6) AS DOUBLE) AS init_x, CAST(round(-0.02 + 0.11 * y, 6) AS DOUBLE) AS init_y FROM range(3) a(o), range(5) b(x), range(5) c(y)")
def condition_grid(spark, sf):
    """Grid of conditions, the orientation outermost; built by explosion, so that no join is needed."""
    grid = spark.range(3).withColumnRenamed("id", "orientation").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return grid.select((F.col("orientation") * 25 + F.col("x") * 5 + F.col("y")).alias("condition_id"), "orientation", r6(-0.35 + 0.1 * F.col("x")).alias("init_x"), r6(-0.02 + 0.11 * F.col("y")).alias("init_y"))


@register("positional_selection", "SELECT CAST(p AS INTEGER) AS place, r_name FROM (VALUES (0, 3), (1, 0), (2, 4)) v(p, i) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region) USING (i)")
def positional_selection(spark, sf):
    """Rows by a list of places: its order is kept, repeats are dropped, places are checked."""
    wanted = list(dict.fromkeys([3, 0, 4, 3]))
    rows = read(spark, sf, "region").select("r_name", (F.row_number().over(Window.orderBy("r_regionkey")) - 1).alias("i"))
    places = F.posexplode(F.array(*map(F.lit, wanted))).alias("place", "i")
    return spark.range(1).select(places).join(rows, "i").select("place", "r_name")


LAST = ", ends AS (SELECT episode_key, arg_max(event_type, step_id) AS last_type, max(value) AS top, count(*) AS n FROM steps GROUP BY 1)"


@register("stop_reason", STEPS + LAST + " SELECT episode_key, CASE WHEN last_type = 'purchase' THEN 'success' WHEN last_type = 'error' THEN 'truncated' WHEN top > 150 THEN 'policy_terminated' WHEN n >= 70 THEN 'max_steps' ELSE 'unknown' END AS stop_reason FROM ends")
def stop_reason(spark, sf):
    ends = steps(spark, sf).groupBy("episode_key").agg(F.max_by("event_type", "step_id").alias("last_type"), F.max("value").alias("top"), n_of().alias("n"))
    last = F.col("last_type")
    reason = F.when(last == "purchase", "success").when(last == "error", "truncated").when(F.col("top") > 150, "policy_terminated").when(F.col("n") >= 70, "max_steps").otherwise("unknown")
    return ends.select("episode_key", reason.alias("stop_reason"))


@register("coke_stage", STEPS + "SELECT episode_key, step_id, CAST(max(CASE event_type WHEN 'purchase' THEN 4 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) OVER w AS INTEGER) AS stage FROM steps " + WINDOW_SQL)
def coke_stage(spark, sf):
    t = F.col("event_type")
    return steps(spark, sf).select("episode_key", "step_id", S.best_so_far(F.when(t == "purchase", 4).when(t == "click", 2).when(t == "view", 1).otherwise(0)).alias("stage"))


@register("failure_mode", STEPS + LAST + ", fl AS (SELECT e.episode_key, last_type, top, bool_or(event_type = 'click') AS clicked, bool_or(k > 95) AS high FROM ends e JOIN steps USING (episode_key) GROUP BY 1, 2, 3) SELECT episode_key, clicked, high, CASE WHEN last_type <> 'error' THEN 'success' WHEN high THEN 'height_violation' WHEN NOT clicked THEN 'no_contact' WHEN top < 100 THEN 'no_progress' ELSE 'partial_progress_stall' END AS mode FROM fl")
def failure_mode(spark, sf):
    ends = steps(spark, sf).groupBy("episode_key").agg(F.max_by("event_type", "step_id").alias("last"), F.max("value").alias("top"), F.bool_or(F.col("event_type") == "click").alias("clicked"), F.bool_or(F.col("k") > 95).alias("high"))
    mode = F.when(F.col("last") != "error", "success").when(F.col("high"), "height_violation").when(~F.col("clicked"), "no_contact").when(F.col("top") < 100, "no_progress").otherwise("partial_progress_stall")
    return ends.select("episode_key", "clicked", "high", mode.alias("mode"))


DYNAMICS = ", dy AS (SELECT episode_key, k, abs(p - lag(p) OVER w) AS d FROM steps " + WINDOW_SQL + "), de AS (SELECT episode_key, median(d) AS mid, avg(CASE WHEN d < 0.02 THEN 1.0 ELSE 0.0 END) FILTER (WHERE d IS NOT NULL) AS low, sum(d) AS tv FROM dy GROUP BY 1)"


@register("dynamics_class", STEPS + DYNAMICS + " SELECT episode_key, CASE WHEN CAST(low > 0.2 AS INTEGER) + CAST(mid < 0.08 AS INTEGER) > CAST(tv > 9 AS INTEGER) + CAST(mid > 0.15 AS INTEGER) THEN 'stagnation' WHEN CAST(low > 0.2 AS INTEGER) + CAST(mid < 0.08 AS INTEGER) < CAST(tv > 9 AS INTEGER) + CAST(mid > 0.15 AS INTEGER) THEN 'burst' WHEN tv > 9 THEN 'burst_tie' ELSE 'mixed' END AS class FROM de")
def dynamics_class(spark, sf):
    e = _dynamics(spark, sf)
    still = (F.col("low") > 0.2).cast("int") + (F.col("mid") < 0.08).cast("int")
    burst = (F.col("tv") > 9).cast("int") + (F.col("mid") > 0.15).cast("int")
    return e.select("episode_key", F.when(still > burst, "stagnation").when(still < burst, "burst").when(F.col("tv") > 9, "burst_tie").otherwise("mixed").alias("class"))


def _dynamics(spark, sf):
    rows = steps(spark, sf).withColumn("d", F.abs(S.difference(F.col("p"))))
    return rows.groupBy("episode_key").agg(F.percentile("d", 0.5).alias("mid"), F.avg((F.col("d") < 0.02).cast("double")).alias("low"), F.sum("d").alias("tv"), (F.max_by("event_type", "step_id") == "error").alias("failed"))


@register("rule_flags", STEPS + DYNAMICS + LAST + ", rl AS (SELECT *, mid < 0.1 AS rule_a, low > 0.14 AS rule_b, last_type = 'error' AS failed FROM de JOIN ends USING (episode_key)) SELECT rule, count(*) FILTER (WHERE hit AND failed) AS tp, count(*) FILTER (WHERE NOT hit AND NOT failed) AS tn, count(*) FILTER (WHERE hit AND NOT failed) AS fp, count(*) FILTER (WHERE NOT hit AND failed) AS fn, round(count(*) FILTER (WHERE hit AND failed) / greatest(1, count(*) FILTER (WHERE failed)), 6) AS recall FROM (SELECT 'a' AS rule, rule_a AS hit, failed FROM rl UNION ALL SELECT 'b', rule_b, failed FROM rl) GROUP BY rule")
def rule_flags(spark, sf):
    """Confusion counts of two threshold rules."""
    rows = _dynamics(spark, sf)
    rules = F.explode(F.array(F.struct(F.lit("a").alias("rule"), (F.col("mid") < 0.1).alias("hit")), F.struct(F.lit("b").alias("rule"), (F.col("low") > 0.14).alias("hit"))))
    rows = rows.select("failed", rules.alias("r")).select("failed", "r.*")
    hit, bad = F.col("hit"), F.col("failed")
    tp = F.count_if(hit & bad)
    return rows.groupBy("rule").agg(tp.alias("tp"), F.count_if(~hit & ~bad).alias("tn"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"), r6(tp / F.greatest(F.lit(1), F.count_if(bad))).alias("recall"))


@register("risk_group", STEPS + ONSETS + ", rg AS (SELECT s.value, CASE WHEN onset IS NULL THEN 'success' WHEN step_id < onset - 10 THEN 'failure_pre_window' WHEN step_id < onset THEN 'failure_h_window' END AS grp FROM steps s JOIN onsets USING (episode_key)) SELECT grp, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, round(max(value), 6) AS top FROM rg WHERE grp IS NOT NULL GROUP BY grp")
def risk_group(spark, sf):
    at, onset = F.col("step_id"), F.col("onset")
    rows = with_onset(spark, sf).withColumn("grp", F.when(onset.isNull(), "success").when(at < onset - 10, "failure_pre_window").when(at < onset, "failure_h_window")).where("grp IS NOT NULL")
    part = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = rows.groupBy("grp").agg(n_of().alias("n"), r6(F.avg("value")).alias("mean"), part.alias("q"), r6(F.max("value")).alias("top"))
    return out.select("grp", "n", "mean", r6(F.col("q")[1]).alias("median"), r6(F.col("q")[0]).alias("p10"), r6(F.col("q")[2]).alias("p90"), "top")


@register("hash_keys", "SELECT doc_id, sha256(text) AS sha, format('{}/condition_{:04d}', lang, doc_id) AS key FROM documents")
def hash_keys(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.format_string("%s/condition_%04d", "lang", "doc_id").alias("key"))


@register("mode_name", "WITH s AS (SELECT label, vec_id % 7 AS g, abs(avg(embedding[1])) AS a, abs(avg(embedding[2])) AS b, abs(avg(embedding[3])) AS c FROM embeddings GROUP BY 1, 2), o AS (SELECT label, g, name, v, row_number() OVER (PARTITION BY label, g ORDER BY v DESC, name) AS r FROM (SELECT label, g, unnest(['depth', 'trace', 'action']) AS name, unnest([a, b, c]) AS v FROM s)), w AS (SELECT label, g, max(name) FILTER (WHERE r = 1) AS n1, max(name) FILTER (WHERE r = 2) AS n2, max(v) FILTER (WHERE r = 1) AS v1, max(v) FILTER (WHERE r = 2) AS v2, max(v) FILTER (WHERE r = 3) AS v3 FROM o GROUP BY 1, 2) SELECT label, g AS grp, CASE WHEN v1 - v2 >= 0.02 THEN n1 || '_dominant' WHEN v1 + v2 > v3 + 0.02 THEN n1 || '_' || n2 ELSE 'mixed' END AS mode FROM w")
def mode_name(spark, sf):
    """Names a profile by its one or two largest parts; ties go by name."""
    e = read(spark, sf, "embeddings").withColumn("grp", F.col("vec_id") % 7)
    part = lambda name, i: F.struct((-F.abs(F.avg(F.col("embedding")[i]))).alias("v"), F.lit(name).alias("name"))
    top = e.groupBy("label", "grp").agg(F.array_sort(F.array(part("depth", 0), part("trace", 1), part("action", 2))).alias("o"))
    v, name = (lambda i: -F.col("o")[i]["v"]), (lambda i: F.col("o")[i]["name"])
    mode = F.when(v(0) - v(1) >= 0.02, F.concat(name(0), F.lit("_dominant"))).when(v(0) + v(1) > v(2) + 0.02, F.concat(name(0), F.lit("_"), name(1))).otherwise("mixed")
    return top.select("label", "grp", mode.alias("mode"))


# Joins


@register("labels_join", "SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels l USING (doc_id)")
def labels_join(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@register("onset_left_join", STEPS + ONSETS + "SELECT s.episode_key, s.step_id, o.onset, s.step_id - o.onset AS relative FROM steps s LEFT JOIN onsets o ON s.episode_key = o.episode_key AND o.onset > 25")
def onset_left_join(spark, sf):
    rows = steps(spark, sf)
    found = S.plateau_onset(rows).where("onset > 25").select("episode_key", "onset")
    return rows.join(found, "episode_key", "left").select("episode_key", "step_id", "onset", (F.col("step_id") - F.col("onset")).alias("relative"))


@register("agg_multi_join", "SELECT o_custkey, count(*) AS n, CAST(round(sum(o_totalprice) * 100) AS BIGINT) AS ep_sum_cents, round(max(o_totalprice), 4) AS ep_max_price, round(quantile_cont(o_totalprice, 0.9), 4) AS ep_p90_price, c.c_nationkey FROM orders JOIN customer c ON o_custkey = c_custkey GROUP BY o_custkey, c.c_nationkey")
def agg_multi_join(spark, sf):
    each = read(spark, sf, "orders").groupBy("o_custkey").agg(n_of().alias("n"), F.round(F.sum("o_totalprice") * 100).cast("long").alias("ep_sum_cents"), F.round(F.max("o_totalprice"), 4).alias("ep_max_price"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("ep_p90_price"))
    return each.join(read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")


@register("map_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def map_lookup(spark, sf):
    """Nations and regions are fixed lists; Spark broadcasts them by their size."""
    c, n, r = (read(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@register("outer_align", "SELECT key, a, b FROM (SELECT coalesce(x.k, y.k) AS key, a, b FROM (SELECT o_custkey AS k, count(*) AS a FROM orders WHERE o_totalprice > 200000 GROUP BY 1) x FULL JOIN (SELECT o_custkey AS k, count(*) AS b FROM orders WHERE o_totalprice <= 50000 GROUP BY 1) y ON x.k = y.k) WHERE a IS NOT NULL AND b IS NOT NULL")
def outer_align(spark, sf):
    o = read(spark, sf, "orders").withColumnRenamed("o_custkey", "key")
    part = lambda where, name: o.where(where).groupBy("key").agg(n_of().alias(name))
    return part("o_totalprice > 200000", "a").join(part("o_totalprice <= 50000", "b"), "key", "full").na.drop(subset=["a", "b"])


@register("payload_alignment_errors", STEPS + ", x AS (SELECT * FROM steps WHERE event_type <> 'view') SELECT s.episode_key, s.step_id, CASE WHEN x.k IS NULL THEN 'missing step' WHEN x.value > 100 THEN 'out of range' END AS error FROM steps s LEFT JOIN x USING (episode_key, step_id)")
def payload_alignment_errors(spark, sf):
    rows = steps(spark, sf)
    other = rows.where("event_type <> 'view'").select("episode_key", "step_id", F.col("k").alias("seen"), F.col("value").alias("v"))
    error = F.when(F.col("seen").isNull(), "missing step").when(F.col("v") > 100, "out of range")
    return rows.join(other, ["episode_key", "step_id"], "left").select("episode_key", "step_id", error.alias("error"))


@register("positional_guard", STEPS + "SELECT count(*) FILTER (WHERE a.episode_key IS NULL OR b.episode_key IS NULL) AS unmatched, count(*) AS n FROM steps a FULL JOIN (SELECT * FROM steps WHERE step_id <> 7) b ON a.episode_key = b.episode_key AND a.step_id = b.step_id")
def positional_guard(spark, sf):
    rows = steps(spark, sf).select("episode_key", "step_id")
    both = rows.withColumn("a", F.lit(1)).join(rows.where("step_id <> 7").withColumn("b", F.lit(1)), ["episode_key", "step_id"], "full")
    return both.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"), n_of().alias("n"))


_RUNS = ", pr AS (SELECT a.episode_key, a.step_id, a.event_type = b.event_type AS same, abs(a.p - b.p) AS gap, a.value AS va, b.value AS vb FROM steps a JOIN steps b ON b.episode_key = a.episode_key + 1 AND b.step_id = a.step_id) "


@register("paired_runs", STEPS + _RUNS + "SELECT episode_key, count(*) AS n, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS exact_rate, round(avg(CASE WHEN gap <= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS near_rate, round(min(gap), 6) AS min_gap, round(max(gap), 6) AS max_gap, round(sum(va) / sum(vb), 5) AS ratio FROM pr GROUP BY episode_key")
def paired_runs(spark, sf):
    rows = steps(spark, sf)
    other = rows.select((F.col("episode_key") - 1).alias("episode_key"), "step_id", F.col("event_type").alias("t2"), F.col("p").alias("p2"), F.col("value").alias("v2"))
    pairs = rows.join(other, ["episode_key", "step_id"]).withColumn("gap", F.abs(F.col("p") - F.col("p2")))
    rate = lambda c: r6(F.avg(c.cast("double")))
    return pairs.groupBy("episode_key").agg(n_of().alias("n"), rate(F.col("event_type") == F.col("t2")).alias("exact_rate"), rate(F.col("gap") <= 0.1).alias("near_rate"), r6(F.min("gap")).alias("min_gap"), r6(F.max("gap")).alias("max_gap"), F.round(F.sum("value") / F.sum("v2"), 5).alias("ratio"))


@register("key_set_diff", "SELECT side, count(*) AS n FROM (SELECT 'both' AS side, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'left', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'right', k FROM (SELECT DISTINCT o_custkey AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer)) GROUP BY side")
def key_set_diff(spark, sf):
    a, b = read(spark, sf, "customer").select(F.col("c_custkey").alias("k")), read(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    both, left, right = a.intersect(b), a.join(b, "k", "left_anti"), b.join(a, "k", "left_anti").distinct()
    tagged = [x.select(F.lit(n).alias("side"), "k") for n, x in (("both", both), ("left", left), ("right", right))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("side").agg(n_of().alias("n"))


@register("semi_join_keys", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def semi_join_keys(spark, sf):
    keys = read(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return read(spark, sf, "supplier").join(keys, "s_suppkey", "left_semi").select("s_suppkey", "s_nationkey")


@register("broadcast_constants", STEPS + "SELECT horizon, detector, count(*) AS n FROM steps, (VALUES (5), (10), (20)) h(horizon), (VALUES ('T0'), ('T1')) d(detector) WHERE step_id >= horizon GROUP BY ALL")
def broadcast_constants(spark, sf):
    rows = steps(spark, sf).select("step_id", F.explode(F.array(*map(F.lit, (5, 10, 20)))).alias("horizon")).withColumn("detector", F.explode(F.array(F.lit("T0"), F.lit("T1"))))
    return rows.where("step_id >= horizon").groupBy("horizon", "detector").agg(n_of().alias("n"))


# Aggregations


@register("episode_aggregates", STEPS + "SELECT episode_key, arg_min(event_type, step_id) AS first_type, CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS DOUBLE) / (10000 * count(value)) AS mean, round(quantile_cont(value, 0.9), 6) AS p90, round(median(value), 6) AS median, count(DISTINCT k) AS n_k, round(stddev_samp(value), 5) AS std1, round(stddev_pop(value), 5) AS std0 FROM steps GROUP BY episode_key")
def episode_aggregates(spark, sf):
    return steps(spark, sf).groupBy("episode_key").agg(F.min_by("event_type", "step_id").alias("first_type"), S.exact_mean(F.col("value")).alias("mean"), r6(F.percentile("value", 0.9)).alias("p90"), r6(F.median("value")).alias("median"), F.countDistinct("k").alias("n_k"), F.round(F.stddev_samp("value"), 5).alias("std1"), F.round(F.stddev_pop("value"), 5).alias("std0"))


@register("success_rate", STEPS + LAST + ", t AS (SELECT DISTINCT episode_key, task FROM steps) SELECT task, count(*) AS n, count(*) FILTER (WHERE last_type <> 'error') AS successes, round(avg(CASE WHEN last_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM ends JOIN t USING (episode_key) GROUP BY task")
def success_rate(spark, sf):
    ends = steps(spark, sf).groupBy("episode_key", "task").agg((F.max_by("event_type", "step_id") != "error").alias("ok"))
    return ends.groupBy("task").agg(n_of().alias("n"), F.count_if("ok").alias("successes"), r6(F.avg(F.col("ok").cast("double"))).alias("rate"))


@register("flag_aggregates", STEPS + "SELECT episode_key, count(*) FILTER (WHERE event_type = 'click') AS clicks, bool_or(event_type = 'error') AS any_error, bool_and(value > 0) AS all_positive, min(step_id) FILTER (WHERE event_type = 'purchase') AS first_purchase, min(step_id) FILTER (WHERE event_type <> 'view') AS first_other, round(avg(CASE WHEN k > 50 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM steps GROUP BY episode_key")
def flag_aggregates(spark, sf):
    t = F.col("event_type")
    return steps(spark, sf).groupBy("episode_key").agg(F.count_if(t == "click").alias("clicks"), F.bool_or(t == "error").alias("any_error"), F.bool_and(F.col("value") > 0).alias("all_positive"), F.min(F.when(t == "purchase", F.col("step_id"))).alias("first_purchase"), F.min(F.when(t != "view", F.col("step_id"))).alias("first_other"), r6(F.avg((F.col("k") > 50).cast("double"))).alias("coverage"))


@register("transitions", STEPS + ", z AS (SELECT * FROM steps WHERE event_type <> 'login'), y AS (SELECT *, (event_type = 'click') <> lag(event_type = 'click') OVER w AS t FROM z " + WINDOW_SQL + ") SELECT episode_key, count(*) FILTER (WHERE t) AS n FROM y GROUP BY episode_key")
def transitions(spark, sf):
    rows = steps(spark, sf).where("event_type <> 'login'").withColumn("c", F.col("event_type") == "click")
    return rows.withColumn("t", F.col("c") != F.lag("c").over(S.in_order())).groupBy("episode_key").agg(F.count_if("t").alias("n"))


@register("value_share", STEPS + "SELECT task, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY task), 6) AS share FROM steps GROUP BY task, event_type")
def value_share(spark, sf):
    rows = steps(spark, sf).groupBy("task", "event_type").agg(n_of().alias("n"))
    return rows.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("task"))))


@register("corr_by_group", STEPS + "SELECT task, round(corr(value, k), 6) AS r FROM steps GROUP BY task")
def corr_by_group(spark, sf):
    return steps(spark, sf).groupBy("task").agg(r6(F.corr("value", F.col("k").cast("double"))).alias("r"))


@register("group_success_table", STEPS + LAST + ", t AS (SELECT e.episode_key, last_type = 'error' AS failed, task, n, top FROM ends e JOIN (SELECT DISTINCT episode_key, task FROM steps) USING (episode_key)) SELECT task, failed, count(*) AS n_episodes, count(*) FILTER (WHERE top > 150) AS sustained, round(avg(CASE WHEN top > 150 THEN 1.0 ELSE 0.0 END), 6) AS fraction, round(avg(n), 6) AS mean_steps, round(median(top), 6) AS median_top FROM t GROUP BY task, failed")
def group_success_table(spark, sf):
    ends = steps(spark, sf).groupBy("episode_key", "task").agg((F.max_by("event_type", "step_id") == "error").alias("failed"), n_of().alias("n"), F.max("value").alias("top"))
    high = F.col("top") > 150
    return ends.groupBy("task", "failed").agg(n_of().alias("n_episodes"), F.count_if(high).alias("sustained"), r6(F.avg(high.cast("double"))).alias("fraction"), r6(F.avg("n")).alias("mean_steps"), r6(F.median("top")).alias("median_top"))


@register("window_summary", ALIGNED + ", dq AS (SELECT *, p - lag(p) OVER (PARTITION BY episode_key ORDER BY step_id) AS dq FROM al) SELECT episode_key, count(*) FILTER (WHERE rel BETWEEN -10 AND -1) AS pre_n, round(avg(value) FILTER (WHERE rel BETWEEN -10 AND -1), 6) AS pre_mean, round(quantile_cont(value, 0.9) FILTER (WHERE rel BETWEEN -10 AND -1), 6) AS pre_p90, round(avg(CASE WHEN abs(dq) < 0.05 THEN 1.0 ELSE 0.0 END) FILTER (WHERE rel BETWEEN -10 AND -1 AND dq IS NOT NULL), 6) AS pre_stall, round(avg(CASE WHEN dq > 0.0001 THEN 1.0 ELSE 0.0 END) FILTER (WHERE rel BETWEEN 0 AND 9 AND dq IS NOT NULL), 6) AS post_positive, round(sum(greatest(dq, 0)) FILTER (WHERE rel BETWEEN 0 AND 9) / nullif(sum(value) FILTER (WHERE rel BETWEEN 0 AND 9), 0), 8) AS post_gain FROM dq GROUP BY episode_key")
def window_summary(spark, sf):
    rows = with_onset(spark, sf).where("onset IS NOT NULL").withColumn("rel", F.col("step_id") - F.col("onset")).withColumn("dq", S.difference(F.col("p")))
    pre, post, dq = F.col("rel").between(-10, -1), F.col("rel").between(0, 9), F.col("dq")
    return rows.groupBy("episode_key").agg(
        F.count_if(pre).alias("pre_n"), r6(F.avg(F.when(pre, F.col("value")))).alias("pre_mean"), r6(F.percentile(F.when(pre, F.col("value")), 0.9)).alias("pre_p90"),
        r6(F.avg(F.when(pre, (F.abs(dq) < 0.05).cast("double")))).alias("pre_stall"), r6(F.avg(F.when(post, (dq > 0.0001).cast("double")))).alias("post_positive"),
        F.round(F.sum(F.when(post, F.greatest(dq, F.lit(0.0)))) / F.nullif(F.sum(F.when(post, F.col("value"))), F.lit(0.0)), 8).alias("post_gain"),
    )


@register("prefix_checkpoints", STEPS + LAST + ", c AS (SELECT episode_key, cutoff, last_type = 'error' AS failed, bool_or(event_type = 'purchase' AND step_id <= cutoff) AS seen FROM steps JOIN ends USING (episode_key), (SELECT unnest([10, 20, 30, 40, 50, 60, 70]) AS cutoff) GROUP BY 1, 2, 3) SELECT CAST(cutoff AS INTEGER) AS cutoff, count(*) FILTER (WHERE seen AND NOT failed) AS success_seen, count(*) FILTER (WHERE seen AND failed) AS failure_seen, round(count(*) FILTER (WHERE NOT seen AND failed) / greatest(1, count(*) FILTER (WHERE failed)), 6) AS absence_recall, round(count(*) FILTER (WHERE NOT seen AND NOT failed) / greatest(1, count(*) FILTER (WHERE NOT failed)), 6) AS absence_false_alarm FROM c GROUP BY cutoff")
def prefix_checkpoints(spark, sf):
    """How many episodes have had an event by each cutoff; one row per episode is enough, as only the first event counts."""
    ends = steps(spark, sf).groupBy("episode_key").agg((F.max_by("event_type", "step_id") == "error").alias("failed"), F.coalesce(F.min(F.when(F.col("event_type") == "purchase", F.col("step_id"))), F.lit(1 << 40)).alias("first"))
    rows = ends.select("failed", "first", F.explode(F.sequence(F.lit(10), F.lit(70), F.lit(10))).alias("cutoff")).withColumn("seen", F.col("first") <= F.col("cutoff"))
    seen, bad = F.col("seen"), F.col("failed")
    share = lambda x, of: r6(F.count_if(x & of) / F.greatest(F.lit(1), F.count_if(of)))
    return rows.groupBy("cutoff").agg(F.count_if(seen & ~bad).alias("success_seen"), F.count_if(seen & bad).alias("failure_seen"), share(~seen, bad).alias("absence_recall"), share(~seen, ~bad).alias("absence_false_alarm"))


@register("gt_episode_summary", STEPS + LAST + ", s AS (SELECT episode_key, task, bool_or(event_type = 'click') AS any_click, min(step_id) FILTER (WHERE event_type = 'click') AS first_click, min(step_id) FILTER (WHERE event_type = 'purchase') AS first_buy FROM steps GROUP BY 1, 2) SELECT s.episode_key, task, last_type <> 'error' AS success, any_click, first_click, coalesce(first_buy, 81) AS first_milestone FROM s JOIN ends USING (episode_key)")
def gt_episode_summary(spark, sf):
    t = F.col("event_type")
    return steps(spark, sf).groupBy("episode_key", "task").agg((F.max_by("event_type", "step_id") != "error").alias("success"), F.bool_or(t == "click").alias("any_click"), F.min(F.when(t == "click", F.col("step_id"))).alias("first_click"), F.coalesce(F.min(F.when(t == "purchase", F.col("step_id"))), F.lit(81)).alias("first_milestone"))


@register("stage_profile", STEPS + ", g AS (SELECT *, k // 25 AS stage, k // 25 - lag(k // 25) OVER w AS d FROM steps " + WINDOW_SQL + ") SELECT episode_key, min(step_id) FILTER (WHERE d <> 0) AS first_change, max(stage) AS max_stage, bool_or(coalesce(d < 0, false)) AS decreases, round(avg(CASE WHEN stage = 3 THEN 1.0 ELSE 0.0 END), 6) AS top_share FROM g GROUP BY episode_key")
def stage_profile(spark, sf):
    rows = steps(spark, sf).withColumn("stage", F.floor(F.col("k") / 25)).withColumn("d", S.difference(F.col("stage")))
    return rows.groupBy("episode_key").agg(F.min(F.when(F.col("d") != 0, F.col("step_id"))).alias("first_change"), F.max("stage").alias("max_stage"), F.bool_or(F.coalesce(F.col("d") < 0, F.lit(False))).alias("decreases"), r6(F.avg((F.col("stage") == 3).cast("double"))).alias("top_share"))


@register("dedupe_first", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedupe_first(spark, sf):
    first = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return read(spark, sf, "events").withColumn("r", F.row_number().over(first)).where("r = 1").select("user_id", "event_id")


# Sets, sort and top-k


@register("topk_per_group", STEPS + "SELECT task, episode_key, step_id, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY abs(value) DESC, episode_key, step_id) AS r FROM steps) WHERE r <= 5")
def topk_per_group(spark, sf):
    order = Window.partitionBy("task").orderBy(F.desc(F.abs("value")), "episode_key", "step_id")
    return steps(spark, sf).withColumn("r", F.row_number().over(order)).where("r <= 5").select("task", "episode_key", "step_id", "r")


@register("global_topk", STEPS + "SELECT episode_key, round(avg(abs(value)), 6) AS effect FROM steps GROUP BY episode_key HAVING count(*) FILTER (WHERE value IS NULL) = 0 ORDER BY avg(abs(value)) DESC, episode_key LIMIT 25")
def global_topk(spark, sf):
    e = steps(spark, sf).groupBy("episode_key").agg(F.avg(F.abs("value")).alias("m"), F.count_if(F.col("value").isNull()).alias("gaps")).where("gaps = 0")
    return e.orderBy(F.desc("m"), "episode_key").limit(25).select("episode_key", r6("m").alias("effect"))


@register("sign_consistency", "WITH d AS (SELECT i, label % 3 AS g, avg(embedding[i + 1]) AS d FROM embeddings, range(64) r(i) GROUP BY 1, 2) SELECT CAST(i AS INTEGER) AS feature, count(*) FILTER (WHERE abs(d) >= 0.01) AS n_large FROM d GROUP BY i HAVING count(*) FILTER (WHERE abs(d) >= 0.01) >= 2 AND (min(d) > 0 OR max(d) < 0)")
def sign_consistency(spark, sf):
    rows = read(spark, sf, "embeddings").select((F.col("label") % 3).alias("g"), F.posexplode("embedding").alias("feature", "v"))
    d = rows.groupBy("feature", "g").agg(F.avg("v").alias("d"))
    out = d.groupBy("feature").agg(F.count_if(F.abs("d") >= 0.01).alias("n_large"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    return out.where("n_large >= 2 AND (lo > 0 OR hi < 0)").select("feature", "n_large")


@register("union_sources", "SELECT 'document' AS kind, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark")
def union_sources(spark, sf):
    part = lambda name, key, kind: read(spark, sf, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.char_length("text").cast("long").alias("n"))
    return part("documents", "doc_id", "document").unionByName(part("benchmark", "item_id", "benchmark"))


@register("distinct_keys", "SELECT DISTINCT lang, source FROM documents")
def distinct_keys(spark, sf):
    return read(spark, sf, "documents").select("lang", "source").distinct().orderBy("lang", "source")


@register("global_limits", STEPS + "SELECT round(least(0, min(value)) - 0.05 * (max(value) - least(0, min(value))), 6) AS lo, round(max(value) + 0.05 * (max(value) - least(0, min(value))), 6) AS hi FROM steps")
def global_limits(spark, sf):
    """A shared axis range, padded by 5 % of its span."""
    e = steps(spark, sf).agg(F.least(F.lit(0.0), F.min("value")).alias("a"), F.max("value").alias("b"))
    pad = F.when(F.col("b") > F.col("a"), 0.05 * (F.col("b") - F.col("a"))).otherwise(F.lit(0.5))
    return e.select(r6(F.col("a") - pad).alias("lo"), r6(F.col("b") + pad).alias("hi"))


SEARCHED = """WITH x AS (SELECT 'kind' AS path, 'str' AS type, event_id AS ev, 0 AS place, concat(chr(39), event_type, chr(39)) AS text FROM events
UNION ALL SELECT 'props.k', 'int', event_id, 1, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) FROM events
UNION ALL SELECT 'parts[].Kind', CASE WHEN i = 0 THEN 'int' ELSE 'str' END, event_id, 2 + i, CASE WHEN i = 0 THEN CAST(user_id AS VARCHAR) ELSE concat(chr(39), event_type, chr(39)) END FROM events, range(2) r(i)),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ev, place) AS i FROM x)
"""


@register("key_search", SEARCHED + "SELECT path, count(*) AS n, array_to_string(list_sort(list(DISTINCT type)), ',') AS types, array_to_string(list(text ORDER BY i) FILTER (WHERE i <= 3), ' ') AS examples FROM r GROUP BY path")
def key_search(spark, sf):
    """Keys with a k in JSON texts of events, their types and first three values; of lists the first two elements."""
    part = lambda c: F.struct(F.col(c).alias("Kind"))
    texts = read(spark, sf, "events").select("event_id", F.concat(F.lit('{"kind":"'), "event_type", F.lit('","props":'), "props", F.lit(',"parts":['), F.concat_ws(",", F.to_json(part("user_id")), F.to_json(part("event_type")), F.to_json(part("value"))), F.lit("]}")).alias("body"))
    found = walks.key_paths(texts, "body", "event_id", terms=["K"], elements=2, distinct=False)
    return found.select("path", "n", F.array_join("types", ",").alias("types"), F.array_join("examples", " ").alias("examples"))


@register("first_values", "WITH x AS (SELECT event_id, unnest(['event_type', 'value', 'user_id']) AS field, unnest(['string', 'double', 'bigint']) AS type, unnest([event_type, CAST(value AS VARCHAR), CAST(user_id AS VARCHAR)]) AS v FROM events), d AS (SELECT field, type, v, min(event_id) AS ev FROM x WHERE v <> '' GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY ev) AS i FROM d) SELECT field, type, array_to_string(list(v ORDER BY i), ' ') AS first_values FROM r WHERE i <= 20 GROUP BY 1, 2")
def first_values(spark, sf):
    """The first twenty different values of fields of events."""
    found = walks.first_values(read(spark, sf, "events"), ["event_type", "value", "user_id"], ["event_id"])
    return found.select("field", "type", F.array_join("first_values", " ").alias("first_values"))


@register("truth_values", """WITH x AS (SELECT event_id % 6 AS form, json_extract(props, '$.k') AS k, value, event_type FROM events),
t AS (SELECT form, CASE form WHEN 0 THEN CAST(CAST(k AS BIGINT) % 2 = 1 AS VARCHAR) WHEN 1 THEN CASE WHEN value IS NULL THEN NULL ELSE CAST(value <> 0 AS VARCHAR) END WHEN 2 THEN CASE WHEN event_type = 'click' THEN 'true' END WHEN 3 THEN 'true' WHEN 4 THEN NULL ELSE CASE WHEN CAST(k AS BIGINT) = 1 THEN 'true' WHEN CAST(k AS BIGINT) = 0 THEN 'false' END END AS truth FROM x)
SELECT form, count(*) AS n, count(*) FILTER (WHERE truth = 'true') AS yes, count(*) FILTER (WHERE truth = 'false') AS no FROM t GROUP BY form""")
def truth_values(spark, sf):
    """Truth of JSON values: numbers, texts of words and of numbers, truth values and lists."""
    k, form = F.get_json_object("props", "$.k").cast("long"), F.col("event_id") % 6
    word = F.when(F.col("event_type") == "click", " Yes ").otherwise(F.col("event_type"))
    text = F.when(form == 0, (k % 2).cast("string")).when(form == 1, F.col("value").cast("string")).when(form == 2, F.concat(F.lit('"'), word, F.lit('"'))).when(form == 3, "true").when(form == 4, "[1]")
    text = text.when(form == 5, F.concat(F.lit('"'), k.cast("string"), F.lit('"')))
    rows = read(spark, sf, "events").select(form.alias("form"), V.truth_of(F.try_parse_json(text)).alias("truth"))
    return rows.groupBy("form").agg(n_of().alias("n"), F.count_if("truth").alias("yes"), F.count_if(~F.col("truth")).alias("no"))
