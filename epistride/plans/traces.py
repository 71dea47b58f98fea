"""Catalog: queries over token grids, polylines, actions and maps of the vector table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epistride.functions import arrays as A
from epistride.functions import sql
from epistride.operators import addons
from epistride.plans.catalog import register
from epistride.plans.sequences import ONSETS
from epistride.plans.views import POINTS, STEPS, read, steps, vectors

r6 = lambda c: F.round(c, 6)

def by_label():
    return Window.partitionBy("label").orderBy("vec_id")


TOKENS = "WITH tok AS (SELECT vec_id, label, i, CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 32) AS INTEGER) AS t FROM embeddings, range(64) r(i))"


@register("token_entropy", TOKENS + ", c AS (SELECT vec_id, t, count(*) / 64.0 AS s FROM tok GROUP BY 1, 2) SELECT vec_id, round(-sum(s * log2(s + 1e-8)), 6) AS entropy, CAST(count(*) AS INTEGER) AS n_unique FROM c GROUP BY vec_id")
def token_entropy(spark, sf):
    return vectors(spark, sf).select("vec_id", r6(A.entropy(F.col("tokens"))).alias("entropy"), F.size(F.array_distinct("tokens")).alias("n_unique"))


@register("grid_boundary", TOKENS + ", p AS (SELECT a.vec_id, count(*) AS n FROM tok a JOIN tok b ON a.vec_id = b.vec_id AND ((b.i = a.i + 1 AND a.i % 8 < 7) OR b.i = a.i + 8) WHERE a.t <> b.t GROUP BY 1) SELECT e.vec_id, CAST(8 AS INTEGER) AS height, round(coalesce(n, 0) / 112.0, 6) AS boundary FROM embeddings e LEFT JOIN p USING (vec_id)")
def grid_boundary(spark, sf):
    return vectors(spark, sf).select("vec_id", A.grid_height(F.size("tokens")).alias("height"), r6(A.boundary_ratio(F.col("tokens"))).alias("boundary"))


@register("hamming_prev", TOKENS + ", q AS (SELECT vec_id, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings), h AS (SELECT a.vec_id, count(*) FILTER (WHERE a.t <> b.t) AS n FROM q JOIN tok a ON a.vec_id = q.vec_id JOIN tok b ON b.vec_id = q.prev AND a.i = b.i GROUP BY 1) SELECT q.vec_id, CAST(n AS INTEGER) AS hamming, round(n / 64.0, 6) AS change_ratio FROM q LEFT JOIN h USING (vec_id)")
def hamming_prev(spark, sf):
    d = A.hamming(F.col("tokens"), F.lag("tokens").over(by_label()))
    return vectors(spark, sf).withColumn("hamming", d).select("vec_id", "hamming", r6(F.col("hamming") / F.size("tokens")).alias("change_ratio"))


SEGMENTS = POINTS + """, seg AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM pts WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
len AS (SELECT vec_id, sum(sqrt(dx * dx + dy * dy)) AS length, arg_min(x, i) AS x0, arg_min(y, i) AS y0, arg_max(x, i) AS x1, arg_max(y, i) AS y1,
  sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2)) AS spread, avg(x) AS cx, avg(y) AS cy FROM seg GROUP BY vec_id),
lc AS (SELECT *, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) AS chord FROM len)
"""


@register("polyline_stats", SEGMENTS + "SELECT vec_id, round(length, 6) AS length, round(chord / length, 6) AS straightness, round(length / chord, 5) AS curvature, round(spread, 6) AS spread FROM lc")
def polyline_stats(spark, sf):
    t = F.col("trace")
    return vectors(spark, sf).select("vec_id", r6(A.length(t)).alias("length"), r6(A.straightness(t)).alias("straightness"), F.round(A.curvature(t), 5).alias("curvature"), r6(A.spread(t)).alias("spread"))


@register("polygon_area", POINTS + ", nx AS (SELECT a.vec_id, a.x * b.y - b.x * a.y AS c FROM pts a JOIN pts b ON a.vec_id = b.vec_id AND b.i = (a.i + 1) % 32) SELECT vec_id, round(abs(sum(c)) / 2, 6) AS area FROM nx GROUP BY vec_id")
def polygon_area(spark, sf):
    return vectors(spark, sf).select("vec_id", r6(A.area(F.col("trace"))).alias("area"))


@register("turn_angle", SEGMENTS + ", tn AS (SELECT vec_id, dx, dy, lead(dx) OVER w AS ex, lead(dy) OVER w AS ey FROM seg WINDOW w AS (PARTITION BY vec_id ORDER BY i)) SELECT vec_id, round(avg(acos(least(1.0, greatest(-1.0, (dx * ex + dy * ey) / (sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey)))))), 6) AS turn FROM tn WHERE ex IS NOT NULL GROUP BY vec_id")
def turn_angle(spark, sf):
    return vectors(spark, sf).select("vec_id", r6(A.turn_angle(F.col("trace"))).alias("turn"))


@register("direction_wrap", SEGMENTS + ", dr AS (SELECT l.vec_id, label, atan2(y1 - y0, x1 - x0) AS a FROM lc l JOIN embeddings e ON l.vec_id = e.vec_id), df AS (SELECT vec_id, a, a - lag(a) OVER (PARTITION BY label ORDER BY vec_id) + pi() AS d FROM dr) SELECT vec_id, round(a, 6) AS direction, round(d - 2 * pi() * floor(d / (2 * pi())) - pi(), 6) AS change FROM df")
def direction_wrap(spark, sf):
    rows = vectors(spark, sf).withColumn("a", A.direction(F.col("trace")))
    return rows.select("vec_id", r6("a").alias("direction"), r6(A.wrapped(F.col("a") - F.lag("a").over(by_label()))).alias("change"))


RESAMPLED = SEGMENTS + """, al AS (SELECT vec_id, i, x, y, dx, dy, coalesce(sum(sqrt(dx * dx + dy * dy)) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS far, sqrt(dx * dx + dy * dy) AS d FROM seg),
tg AS (SELECT vec_id, j, length * j / 19 AS t FROM lc, range(20) r(j)),
pk AS (SELECT tg.vec_id, tg.j, tg.t, least(max(al.i), 30) AS i FROM tg JOIN al ON al.vec_id = tg.vec_id AND al.far <= tg.t GROUP BY 1, 2, 3),
rs AS (SELECT pk.vec_id, j, x + (t - far) / d * dx AS x, y + (t - far) / d * dy AS y FROM pk JOIN al ON al.vec_id = pk.vec_id AND al.i = pk.i)
"""


@register("resample20", RESAMPLED + "SELECT vec_id, CAST(j AS INTEGER) AS j, round(x, 5) AS x, round(y, 5) AS y FROM rs")
def resample20(spark, sf):
    rows = vectors(spark, sf).select("vec_id", F.posexplode(A.resample(F.col("trace"), 20)).alias("j", "q"))
    return rows.select("vec_id", "j", F.round("q.x", 5).alias("x"), F.round("q.y", 5).alias("y"))


@register("shape_drift", RESAMPLED + """, pv AS (SELECT vec_id, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings),
sd AS (SELECT pv.vec_id, avg(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS shape FROM pv JOIN rs a ON a.vec_id = pv.vec_id JOIN rs b ON b.vec_id = pv.prev AND a.j = b.j GROUP BY 1)
SELECT pv.vec_id, round(sqrt(power(a.x1 - b.x1, 2) + power(a.y1 - b.y1, 2)), 6) AS endpoint, round(sqrt(power(a.x0 - b.x0, 2) + power(a.y0 - b.y0, 2)), 6) AS startpoint, round(sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)), 6) AS centroid, round(shape, 5) AS shape
FROM pv JOIN lc a ON a.vec_id = pv.vec_id LEFT JOIN lc b ON b.vec_id = pv.prev LEFT JOIN sd ON sd.vec_id = pv.vec_id""")
def shape_drift(spark, sf):
    rows = vectors(spark, sf).withColumn("r", A.resample(F.col("trace"), 20))
    rows = rows.withColumn("pt", F.lag("trace").over(by_label())).withColumn("pr", F.lag("r").over(by_label()))
    t, p = F.col("trace"), F.col("pt")
    return rows.select("vec_id", r6(A.gap(A.last(t), A.last(p))).alias("endpoint"), r6(A.gap(A.first(t), A.first(p))).alias("startpoint"), r6(A.centroid_drift(t, p)).alias("centroid"), F.round(A.shape_drift(F.col("r"), F.col("pr")), 5).alias("shape"))


@register("relplan", SEGMENTS + ", rp AS (SELECT l.vec_id, x1 - x0 AS px, y1 - y0 AS py, lag(x1 - x0) OVER w AS qx, lag(y1 - y0) OVER w AS qy FROM lc l JOIN embeddings e ON l.vec_id = e.vec_id WINDOW w AS (PARTITION BY label ORDER BY l.vec_id)) SELECT vec_id, round(sqrt(power(px - qx, 2) + power(py - qy, 2)), 6) AS drift, round(sqrt(power(px - qx, 2) + power(py - qy, 2)) / sqrt(qx * qx + qy * qy), 5) AS drift_norm, round((px * qx + py * qy) / (sqrt(px * px + py * py) * sqrt(qx * qx + qy * qy)), 6) AS cos FROM rp")
def relplan(spark, sf):
    t = F.col("trace")
    rows = vectors(spark, sf).withColumn("plan", F.array(A.last(t)["x"] - A.first(t)["x"], A.last(t)["y"] - A.first(t)["y"]))
    rows = rows.withColumn("before", F.lag("plan").over(by_label()))
    p, q = F.col("plan"), F.col("before")
    return rows.select("vec_id", r6(A.distance(p, q)).alias("drift"), F.round(F.when(A.norm(q) >= A.EPS, A.distance(p, q) / A.norm(q)), 5).alias("drift_norm"), r6(A.cosine(p, q)).alias("cos"))


ACTIONS = """WITH ac AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v, lag(vec_id) OVER (PARTITION BY label, i ORDER BY vec_id) AS prev, lag(CAST(embedding[i + 1] AS DOUBLE)) OVER (PARTITION BY label, i ORDER BY vec_id) AS u FROM embeddings, range(7) r(i)),
ag AS (SELECT vec_id, sqrt(sum(v * v) FILTER (WHERE i < 3)) AS tn, sqrt(sum(v * v) FILTER (WHERE i BETWEEN 3 AND 5)) AS rn, sqrt(sum((v - u) * (v - u))) AS full_jump, sqrt(sum((v - u) * (v - u)) FILTER (WHERE i < 3)) AS tj, sqrt(sum((v - u) * (v - u)) FILTER (WHERE i BETWEEN 3 AND 5)) AS rj,
  sum(v * u) / (sqrt(sum(v * v)) * sqrt(sum(u * u))) AS c, abs(max(v - u) FILTER (WHERE i = 6)) AS g FROM ac GROUP BY vec_id)
"""


@register("action_jumps", ACTIONS + "SELECT vec_id, round(tn, 6) AS translation_norm, round(rn, 6) AS rotation_norm, round(full_jump, 6) AS action_jump, round(tj, 6) AS translation_jump, round(rj, 6) AS rotation_jump, round(sqrt(tj * tj + rj * rj), 6) AS motion_jump, round(c, 6) AS cosine, CAST(c < 0 AS INTEGER) AS direction_flip, round(g, 6) AS gripper_change FROM ag")
def action_jumps(spark, sf):
    rows = vectors(spark, sf).withColumn("a", F.slice("v", 1, 7)).withColumn("b", F.lag("a").over(by_label()))
    a, b = F.col("a"), F.col("b")
    jump = lambda part: A.distance(part(a), part(b))
    c = A.cosine(a, b)
    return rows.select(
        "vec_id", r6(A.norm(A.translation(a))).alias("translation_norm"), r6(A.norm(A.rotation(a))).alias("rotation_norm"), r6(A.distance(a, b)).alias("action_jump"),
        r6(jump(A.translation)).alias("translation_jump"), r6(jump(A.rotation)).alias("rotation_jump"), r6(F.hypot(jump(A.translation), jump(A.rotation))).alias("motion_jump"),
        r6(c).alias("cosine"), (c < 0).cast("int").alias("direction_flip"), r6(F.abs(A.gripper(a) - A.gripper(b))).alias("gripper_change"),
    )


@register("array_compare", "SELECT a.vec_id, b.vec_id AS other_id, (a.embedding = b.embedding) AS exact, (list_max(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) <= 0.25) AS near, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: power(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))), 6) AS l2, round(list_max(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 6) AS max_abs FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND b.label = a.label")
def array_compare(spark, sf):
    rows = vectors(spark, sf).select("vec_id", "label", "v")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), "label", F.col("vec_id").alias("other_id"), F.col("v").alias("w"))
    pairs = rows.join(other, ["vec_id", "label"])
    gap = F.array_max(F.zip_with("v", "w", lambda x, y: F.abs(x - y)))
    return pairs.select("vec_id", "other_id", (F.col("v") == F.col("w")).alias("exact"), A.near(F.col("v"), F.col("w"), 0.25).alias("near"), r6(A.distance(F.col("v"), F.col("w"))).alias("l2"), r6(gap).alias("max_abs"))


@register("backtracking", SEGMENTS + ", u AS (SELECT avg((x1 - x0) / chord) AS mx, avg((y1 - y0) / chord) AS my FROM lc WHERE label_ok), n AS (SELECT mx / sqrt(mx * mx + my * my) AS ux, my / sqrt(mx * mx + my * my) AS uy FROM u) SELECT s.vec_id, round(sum(greatest(-(dx * ux + dy * uy), 0)) / sum(abs(dx * ux + dy * uy)), 5) AS backtracking, round(max((x1 - x0) * ux + (y1 - y0) * uy) / max(chord), 5) AS alignment FROM seg s, n JOIN lc ON lc.vec_id = s.vec_id WHERE dx IS NOT NULL GROUP BY s.vec_id".replace(" WHERE label_ok", " JOIN embeddings e ON e.vec_id = lc.vec_id WHERE e.label < 5").replace("FROM seg s, n JOIN lc ON lc.vec_id = s.vec_id", "FROM seg s JOIN lc ON lc.vec_id = s.vec_id, n"))
def backtracking(spark, sf):
    """Movement against the mean direction of the first five labels, and alignment with it."""
    rows = vectors(spark, sf)
    t = F.col("trace")
    vx, vy = A.last(t)["x"] - A.first(t)["x"], A.last(t)["y"] - A.first(t)["y"]
    rows = addons.with_direction(rows, F.col("label") < 5)
    ux, uy = F.col("_ux"), F.col("_uy")
    return rows.select("vec_id", F.round(A.backtracking(t, ux, uy), 5).alias("backtracking"), F.round((vx * ux + vy * uy) / A.chord(t), 5).alias("alignment"))


CELLS = """WITH cl AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i)),
spot AS (SELECT vec_id, px - floor(px) AS u, py - floor(py) AS w, CAST(floor(px) AS BIGINT) AS x0, CAST(floor(py) AS BIGINT) AS y0 FROM (SELECT vec_id, (vec_id * 37 % 256) / 255.0 * 7 AS px, (vec_id * 91 % 256) / 255.0 * 7 AS py FROM embeddings)),
sm AS (SELECT spot.vec_id, sum(cl.v * (CASE WHEN cl.c = x0 THEN 1 - u ELSE 0 END + CASE WHEN cl.c = least(x0 + 1, 7) THEN u ELSE 0 END) * (CASE WHEN cl.r = y0 THEN 1 - w ELSE 0 END + CASE WHEN cl.r = least(y0 + 1, 7) THEN w ELSE 0 END)) AS d FROM spot JOIN cl USING (vec_id) GROUP BY 1)
"""


@register("bilinear_percentile", CELLS + "SELECT sm.vec_id, round(any_value(d), 6) AS depth, round(count(*) FILTER (WHERE v <= d) / 64.0, 6) AS percentile FROM sm JOIN cl USING (vec_id) GROUP BY sm.vec_id")
def bilinear_percentile(spark, sf):
    i = F.col("vec_id")
    rows = vectors(spark, sf).withColumn("d", A.bilinear(F.col("v"), 8, 8, (i * 37 % 256).cast("double"), (i * 91 % 256).cast("double")))
    return rows.select("vec_id", r6("d").alias("depth"), r6(A.percentile_rank(F.col("v"), F.col("d"))).alias("percentile"))


@register("trace_depth", "WITH cl AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i)), fr AS (SELECT vec_id, stddev_pop(v) AS s FROM cl GROUP BY 1), tr AS (SELECT *, v - lag(v) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM cl WHERE i % 9 = 0) SELECT vec_id, round(stddev_pop(v) / any_value(s), 6) AS std_norm, round(avg(abs(d)) / any_value(s), 6) AS gradient_norm, round((max(v) - min(v)) / any_value(s), 6) AS range_norm FROM tr JOIN fr USING (vec_id) GROUP BY vec_id")
def trace_depth(spark, sf):
    """Variation of the map along its diagonal, in units of its own deviation."""
    rows = vectors(spark, sf).withColumn("s", A.population_std(F.col("v"))).withColumn("t", A.pick(F.col("v"), list(range(0, 64, 9))))
    t, n = F.col("t"), F.size("t")
    moves = F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n), lambda a, b: F.abs(b - a))
    by = lambda x: r6(F.when(F.col("s") > A.EPS, x / F.col("s")))
    return rows.select("vec_id", by(A.population_std(t)).alias("std_norm"), by(A.total(moves) / F.size(moves)).alias("gradient_norm"), by(F.array_max(t) - F.array_min(t)).alias("range_norm"))


@register("depth_geometry", "WITH cl AS (SELECT vec_id, i, i // 8 AS r, i % 8 AS c, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i)), fr AS (SELECT vec_id, stddev_pop(v) AS s, median(v) FILTER (WHERE r IN (0, 7) OR c IN (0, 7)) AS border, median(v) FILTER (WHERE r BETWEEN 3 AND 4 AND c BETWEEN 3 AND 4) AS patch FROM cl GROUP BY 1), d AS (SELECT vec_id, i, v - lag(v) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM cl WHERE i % 9 = 0), sg AS (SELECT d.vec_id, sign(d) AS g, lag(sign(d)) OVER (PARTITION BY d.vec_id ORDER BY i) AS h FROM d JOIN fr ON fr.vec_id = d.vec_id WHERE abs(d) > 0.02 * s) SELECT fr.vec_id, round((patch - border) / s, 6) AS contrast, CAST(count(*) FILTER (WHERE g <> h) AS INTEGER) AS sign_changes FROM fr LEFT JOIN sg USING (vec_id) GROUP BY fr.vec_id, patch, border, s")
def depth_geometry(spark, sf):
    """A patch in the middle against the border of the map, and changes of sign along its diagonal."""
    rows = vectors(spark, sf).withColumn("s", A.population_std(F.col("v"))).withColumn("t", A.pick(F.col("v"), list(range(0, 64, 9))))
    t, v = F.col("t"), F.col("v")
    moves = F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t)), lambda a, b: b - a)
    contrast = (A.median(A.pick(v, [27, 28, 35, 36])) - A.median(A.pick(v, A.ring(8, 8)))) / F.col("s")
    return rows.select("vec_id", r6(contrast).alias("contrast"), A.sign_changes(moves, 0.02 * F.col("s")).alias("sign_changes"))


@register("regex_tokens", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS INTEGER) AS n_names, list_sum(list_transform(regexp_extract_all(text, '[0-9]{1,6}'), lambda x: CAST(x AS BIGINT))) IS NOT NULL AS has_numbers FROM documents")
def regex_tokens(spark, sf):
    text = F.col("text")
    return read(spark, sf, "documents").select("doc_id", F.size(F.regexp_extract_all(text, F.lit("[A-Z][a-z]+"), F.lit(0))).alias("n_names"), (F.size(F.regexp_extract_all(text, F.lit("[0-9]{1,6}"), F.lit(0))) > 0).alias("has_numbers"))


@register("consecutive_points", POINTS + ", q AS (SELECT vec_id, i, round(x * 4) AS x, round(y * 4) AS y FROM pts), g AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS d FROM q WINDOW w AS (PARTITION BY vec_id ORDER BY i)) SELECT vec_id, CAST(count(*) FILTER (WHERE d IS NULL OR d > 1e-8) AS INTEGER) AS n_kept FROM g GROUP BY vec_id")
def consecutive_points(spark, sf):
    whole = F.transform("trace", lambda p: F.struct(F.round(p["x"] * 4).alias("x"), F.round(p["y"] * 4).alias("y")))
    return vectors(spark, sf).select("vec_id", F.size(A.without_repeats(whole)).alias("n_kept"))


@register("sql_functions", STEPS + ONSETS + """, pts AS (SELECT label, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y, vec_id FROM embeddings, range(32) t(i)),
seg AS (SELECT label, vec_id, i, x, y, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS d FROM pts WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
ln AS (SELECT label, vec_id, sqrt(power(arg_max(x, i) - arg_min(x, i), 2) + power(arg_max(y, i) - arg_min(y, i), 2)) / sum(d) AS s FROM seg GROUP BY 1, 2),
lb AS (SELECT label, round(avg(s), 6) AS straight, count(*) AS n FROM ln GROUP BY label)
SELECT o.episode_key, o.onset, lb.n, lb.straight FROM onsets o JOIN lb ON lb.label = o.episode_key""")
def sql_functions(spark, sf):
    """Onsets of episodes and the straightness of the lines that bear their number, in SQL alone."""
    steps(spark, sf).createOrReplaceTempView("sql_functions_steps")
    vectors(spark, sf).createOrReplaceTempView("sql_functions_vectors")
    sql.install(spark, "sql_functions_steps")
    return spark.sql("SELECT o.episode_key, o.onset, l.n, l.straight FROM plateau_onsets() o JOIN (SELECT label, count(1) AS n, round(avg(straightness(trace)), 6) AS straight FROM sql_functions_vectors GROUP BY 1) l ON l.label = o.episode_key")
