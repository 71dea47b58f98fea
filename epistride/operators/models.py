"""Grouped out-of-fold scores and clustering."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistride.functions.stats import adjusted_rand
from epistride.operators.fits import logistic, vector
from epistride.operators.labels import deal, far_threshold, with_folds


def _constant(values: list, kind: str) -> Column:
    """One literal of nested values, which is read once and not built anew for each row."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def grouped_oof(rows: DataFrame, features: list[str], label: str, group: str = "episode_key", folds: int = 5, balanced: bool = True, indicators: bool = True) -> DataFrame:
    """Rows with fold and score: each fold is scored by a logistic fit to the others, all of them fitted side by side.

    Neither weights nor indicators gives the plain model of trace depth. One class in training gives 1 or 0.
    """
    dealt = with_folds(rows, group, folds)
    fits = logistic(dealt, {"": features}, [label], [F.col("fold") != f for f in range(folds)], balanced, indicators)

    @F.pandas_udf("double")
    def score(x: pd.Series, fold: pd.Series) -> pd.Series:
        return pd.Series(fits.scores(np.array(x.tolist(), float).reshape(len(x), -1), "", 0, fold.to_numpy()))

    return dealt.withColumn("score", score(vector(fits.features), F.col("fold")))


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, worked out once, with nothing left of the plan that they come from: in spark.checkpoint.dir where that is set, else on the executors."""
    return rows.checkpoint() if rows.sparkSession.conf.get("spark.checkpoint.dir", None) else rows.localCheckpoint()


def nested_folds(rows: DataFrame, folds: int = 5, inner: int = 3) -> DataFrame:
    """Rows with the fold of their episode, and for each fold f the inner fold of the episodes outside it (_in{f}, null inside).

    Folds are dealt from the sizes of episodes, the inner ones of all folds at once, and meet the rows in one join. Rows are
    read twice.
    """
    key = "episode_key"
    sizes = settled(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    outer = settled(sizes.join(deal(sizes, key, folds), key))
    left = outer.withColumn("_out", F.explode(F.array(*map(F.lit, range(folds))))).where("_out <> fold").select("_out", key, "n")
    again = deal(left, key, inner, ("_out",)).groupBy(key).agg(*[F.max(F.when(F.col("_out") == f, F.col("fold"))).alias(f"_in{f}") for f in range(folds)])
    return rows.join(outer.drop("n").join(again, key, "left"), key)


def nested_scores(dealt: DataFrame, sets: dict[str, list[str]], labels: dict[int, str], folds: int = 5, inner: int = 3, most: float = 0.1) -> DataFrame:
    """Rows of ``nested_folds`` once for each set of features and label: spec, horizon, score and fold_threshold.

    ``sets`` has features by spec, ``labels`` columns by horizon. The fits of all sets, labels, folds and inner folds go on side
    by side; a pass over the rows gives the largest score of each successful episode by the inner fits, of which thresholds are
    made, and another the scores, when they are read.
    """
    fold, within = F.col("fold"), F.array(*[f"_in{f}" for f in range(folds)])
    masks = [fold != f for f in range(folds)] + [(fold != f) & (within[f] != j) for f in range(folds) for j in range(inner)]
    fits = logistic(dealt, sets, list(labels.values()), [F.coalesce(m, F.lit(False)) for m in masks], True, True)
    each = [(spec, i, h) for spec in sets for i, h in enumerate(labels)]
    key = dict(dealt.dtypes)["episode_key"]

    def tops(batches):
        """The largest score of each successful episode of a batch by the fits of each outer fold that leave out its inner fold."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), len(fits.features))
            own, put = batch.column("fold").to_numpy(), _matrix(batch.column("within"), folds)
            code = batch.column("episode_key").dictionary_encode()
            names, at = code.dictionary, code.indices.to_numpy()
            for outer in range(folds):
                some = np.flatnonzero((own != outer) & ~np.isnan(put[:, outer]))
                if not len(some):
                    continue
                mask = folds + outer * inner + put[some, outer].astype(int)
                held = np.unique(at[some])
                for number, (spec, i, _) in enumerate(each):
                    top = np.full(len(names), -np.inf)
                    np.maximum.at(top, at[some], fits.scores(x[some], spec, i, mask))
                    n = len(held)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int32)), pa.array(np.full(n, outer, np.int32)), names.take(pa.array(held)), pa.array(top[held])], ["number", "outer", "episode_key", "score"])

    told = F.create_map(*[x for n, (spec, _, h) in enumerate(each) for x in (F.lit(n), F.struct(F.lit(spec).alias("spec"), F.lit(h).alias("horizon")))])
    train = dealt.where("success").select(vector(fits.features).alias("x"), "fold", within.cast("array<double>").alias("within"), "episode_key")
    top = train.mapInArrow(tops, f"number int, outer int, episode_key {key}, score double").groupBy("number", "outer", "episode_key").agg(F.max("score").alias("score")).persist()
    found = far_threshold(top.withColumn("success", F.lit(True)), "score", ["number", "outer"], most).select("number", "outer", "threshold").collect()  # a row for each set, label and fold
    top.unpersist()
    found = dealt.sparkSession.createDataFrame([tuple(r) for r in found], "number int, fold int, _th double")

    @F.pandas_udf("array<double>")
    def scores(x: pd.Series, fold: pd.Series) -> pd.Series:
        values, own = np.array(x.tolist(), float).reshape(len(x), -1), fold.to_numpy()
        return pd.Series(list(np.column_stack([fits.scores(values, spec, i, own) for spec, i, _ in each])))

    kept = [c for c in dealt.columns if not c.startswith("_in")]
    out = dealt.select(*kept, F.posexplode(scores(vector(fits.features), fold)).alias("number", "score"))  # a row for each set and label
    out = out.join(F.broadcast(found), ["number", "fold"], "left").withColumn("_f", told[F.col("number")])
    return out.select(*kept, "_f.spec", "_f.horizon", "score", F.coalesce("_th", F.lit(float("inf"))).alias("fold_threshold"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), width)


def nested_oof(rows: DataFrame, features: list[str], label: str, folds: int = 5, inner: int = 3, most: float = 0.1) -> DataFrame:
    """Rows with fold, score and fold_threshold; the threshold of a fold is learnt from the other folds alone.

    The episodes of the other folds are dealt again into ``inner`` folds, whose out-of-fold scores give the threshold that
    at most a share of ``most`` of the successful ones reach. ``rows`` has episode_key, success, the label and the features;
    rows whose fold has no successful episode to learn from get infinity.
    """
    return nested_scores(nested_folds(rows, folds, inner), {"": features}, {0: label}, folds, inner, most).drop("spec", "horizon")


def family_scores(rows: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """Adds one column per family: gaps filled with the median, each feature in standard units (0 if constant), and their mean."""
    stats = rows.agg(*[F.median(c).alias(f"m_{c}") for cs in families.values() for c in cs]).first()
    filled = {c: F.coalesce(F.col(c), F.lit(stats[f"m_{c}"])) for cs in families.values() for c in cs}
    moments = rows.agg(*[f(x).alias(f"{n}_{c}") for c, x in filled.items() for n, f in (("a", F.avg), ("s", F.stddev_pop))]).first()
    unit = lambda c: (filled[c] - moments[f"a_{c}"]) / moments[f"s_{c}"] if moments[f"s_{c}"] else F.lit(0.0)
    return rows.withColumns({f"family_{name}": sum((unit(c) for c in cs), F.lit(0.0)) / len(cs) for name, cs in families.items()})


def contrast(centre) -> float:
    """The first feature's mean against that of the others: what clusters are numbered by."""
    return float(centre[0] - (sum(centre[1:]) / len(centre[1:]) if len(centre) > 1 else 0.0))


#: Rows, by the smallest hashes, that starting centres are drawn from; rounds at most.
STARTS, ROUNDS = 4096, 100
#: Points at most that each task holds, so that fits go side by side, each to its end in one task; more points are passed over round by round.
WHOLE = 1 << 17


def clusters(rows: DataFrame, features: list[str], k: int, tries: int = 10, seed: int = 0) -> DataFrame:
    """Adds a cluster by the best of several k-means fits, numbered by ``contrast``, largest first.

    All fits go on side by side: a round is one pass over the rows, whose tasks return sums for every fit. Rows with a
    null feature get a null cluster; an empty table stays empty; features that hold fewer than k distinct rows give fewer
    clusters.
    """
    found = _best(rows.select(_point(features).alias("x"), F.lit(-1).alias("part")), len(features), k, [-1], tries, seed)
    return rows.withColumn("cluster", _nearest([F.col(c).cast("double") for c in features], found[0]))


def cluster_stability(rows: DataFrame, features: list[str], part: str, k: int = 2, tries: int = 100, seed: int = 0) -> DataFrame:
    """For each value of ``part``, the adjusted Rand index of the clusters of all rows and of a fit without that part, over the other rows.

    With the key of an episode as ``part`` one episode is left out at a time. Up to WHOLE points, the fits without each part
    share their starts and the sums of the points that lie alike in all of them, so that work grows with points and parts, not
    with their product, as long as a part sways the centres little. Beyond, the fits go on side by side, a pass over the rows
    a round, so such tables are better left out by folds than by rows: the result has a row for each part. Parts without which the others lie in one cluster give none, rows with a null feature or part take
    no part.
    """
    x = _point(features)
    ready = rows.where(F.col(part).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v))).persist()
    if ready.limit(WHOLE + 1).count() <= WHOLE:
        return _stability(ready.select(part, x.alias("x")), len(features), part, k, tries, seed)
    parts = sorted(r[0] for r in ready.select(part).distinct().collect())  # the parts named by the caller
    whole = _best(ready.select(x.alias("x"), F.lit(-1).alias("part")), len(features), k, [-1], tries, seed)[0]
    numbers = rows.sparkSession.createDataFrame(list(enumerate(parts)), f"_n int, `{part}` {dict(rows.dtypes)[part]}")
    placed = ready.select(part, x.alias("x")).join(numbers, part).select("x", F.col("_n").alias("part"))
    found = _best(placed, len(features), k, list(range(len(parts))), tries, seed)
    ready.unpersist()
    fits = _constant([{"n": n, "c": c} for n, c in enumerate(found)], "array<struct<n int, c array<array<double>>>>")
    far = lambda c: F.aggregate(F.zip_with(c, F.col("x"), lambda p, v: (v - p) * (v - p)), F.lit(0.0), lambda s, v: s + v)
    away = F.transform(F.filter(fits, lambda e: e["n"] != F.col("part")), lambda e: F.struct(e["n"].alias("_n"), F.transform(e["c"], far).alias("d")))
    each = placed.select("part", "x", F.explode(away).alias("o")).select(_nearest([F.get("x", F.lit(i)) for i in range(len(features))], whole).alias("a"), "o._n", (F.array_position("o.d", F.array_min("o.d")) - 1).alias("b"))
    several = each.groupBy("_n").agg(F.min("a").alias("_l"), F.max("a").alias("_m")).where("_l < _m").select("_n")
    return adjusted_rand(each.join(several, "_n"), "a", "b", ["_n"]).join(numbers, "_n").select(part, "ari")


def _stability(points: DataFrame, width: int, part: str, k: int, tries: int, seed: int) -> DataFrame:
    """``cluster_stability`` of at most WHOLE points, which each task holds: a few tries a task, each with the fits without every part; the cheapest fit of a part gives its index."""
    spark, kind = points.sparkSession, dict(points.dtypes)[part]
    drawn = points.orderBy(F.xxhash64("x"), "x").collect()  # at most WHOLE
    parts = sorted({r[part] for r in drawn})
    number = {p: i for i, p in enumerate(parts)}
    x, own = np.array([r.x for r in drawn]).reshape(-1, width), np.array([number[r[part]] for r in drawn], int)
    first = _near(x, np.array(_whole(points, width, k, tries, seed))) if len(x) else own
    x, each = x - (x.mean(axis=0) if len(x) else 0.0), 2

    def run(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                best, index = np.full(len(parts), np.inf), np.full(len(parts), np.nan)
                for t in range(b * each, min(tries, (b + 1) * each)):
                    cost, cells = _without_each(x, own, first, k, np.random.default_rng([seed, t]))
                    less = cost < best
                    best[less], index[less] = cost[less], _rand(cells[less])
                n = np.flatnonzero(~np.isnan(index))
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(best[n]), pa.array(np.full(len(n), b)), pa.array(index[n])], ["_n", "cost", "b", "ari"])

    numbers = spark.createDataFrame(list(enumerate(parts)), f"_n int, `{part}` {kind}")
    blocks = -(-tries // each) if parts else 0
    found = spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(run, "_n int, cost double, b long, ari double")
    return found.groupBy("_n").agg(F.min_by("ari", F.struct("cost", "b")).alias("ari")).join(numbers, "_n").select(part, "ari")


#: Pairs of a part and a point that are looked at at once.
PAIRS = 1 << 20


def _without_each(z: np.ndarray, own: np.ndarray, first: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """For each part, a fit to the points of all others from one start: its cost, and how many points are in each of the ``first`` clusters and its own.

    A part that holds a starting point starts anew from the others'. A point's cluster is the same in all fits whose centres
    lie so near the middle ones that its nearest of these stays nearest: twice their distance is less than it is nearer than
    the next. Sums over such points are made once and the part's own taken off; only the rest is looked at part by part.
    """
    parts, firsts, (n, d) = own.max() + 1, first.max() + 1, z.shape
    picked = _picked(z[:STARTS], k, rng)
    centres = np.repeat(z[None, picked], parts, axis=0)
    for o in np.unique(own[picked]):
        rest = z[own != o][:STARTS]
        if len(rest):
            centres[o] = rest[_picked(rest, k, rng)]
    squares, far = (z**2).sum(axis=1), 1e-9 * (1 + np.abs(z).max())
    every = squares.sum() - np.bincount(own, squares, parts)
    cost, cells = np.zeros(parts), np.zeros((parts, firsts, k))
    live = np.arange(parts)
    for _ in range(ROUNDS):
        at = np.full(parts, -1)
        at[live] = np.arange(len(live))
        c, middle = centres[live], np.median(centres[live], axis=0)
        away = np.sqrt(((z[:, None] - middle[None]) ** 2).sum(axis=2))
        near = away.argmin(axis=1)
        two = np.partition(away, 1, axis=1) if k > 1 else np.stack([away[:, 0], np.full(n, np.inf)], axis=1)
        margin = two[:, 1] - two[:, 0]
        order = np.argsort(margin)
        reach = np.searchsorted(margin[order], 2 * np.sqrt(((c - middle) ** 2).sum(axis=2)).max(axis=1) + far, side="right")
        box, mine = first * k + near, at[own] >= 0
        slot, boxes = at[own[mine]] * (firsts * k) + box[mine], firsts * k
        put = np.bincount(box, minlength=boxes) - np.bincount(slot, minlength=len(live) * boxes).reshape(-1, boxes).astype(float)
        slot = at[own[mine]] * k + near[mine]
        sums = np.stack([np.bincount(near, z[:, f], k) - np.bincount(slot, z[mine, f], len(live) * k).reshape(-1, k) for f in range(d)], axis=2)
        upto = np.cumsum(reach)
        low = 0
        while low < len(live):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, side="right")))
            fit = np.repeat(np.arange(low, high), reach[low:high])
            point = order[np.arange(len(fit)) - np.repeat(upto[low:high] - reach[low:high] - (upto[low - 1] if low else 0), reach[low:high])]
            now = _nearest_by_fit(z, c, fit, point)
            other = (now != near[point]) & (own[point] != live[fit])
            fit, point, now = fit[other], point[other], now[other]
            fit, span = fit - low, high - low
            put[low:high] += (np.bincount(fit * boxes + first[point] * k + now, minlength=span * boxes) - np.bincount(fit * boxes + box[point], minlength=span * boxes)).reshape(span, boxes)
            for f in range(d):
                sums[low:high, :, f] += (np.bincount(fit * k + now, z[point, f], span * k) - np.bincount(fit * k + near[point], z[point, f], span * k)).reshape(span, k)
            low = high
        cells[live] = put.reshape(-1, firsts, k)
        counts = cells[live].sum(axis=1)
        cost[live] = every[live] - 2 * (c * sums).sum(axis=(1, 2)) + (counts * (c**2).sum(axis=2)).sum(axis=1)
        moved = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], c)
        still = np.abs(moved - c).max(axis=(1, 2)) > 1e-9 * (1 + np.abs(c).max())
        centres[live] = moved
        live = live[still]
        if not len(live):
            break
    return cost, cells


def _nearest_by_fit(z: np.ndarray, centres: np.ndarray, fit: np.ndarray, point: np.ndarray) -> np.ndarray:
    away = np.stack([sum((z[point, f] - centres[fit, j, f]) ** 2 for f in range(z.shape[1])) for j in range(centres.shape[1])])
    return away.argmin(axis=0)


def _rand(cells: np.ndarray) -> np.ndarray:
    """The adjusted Rand index of each table of counts; NaN where the rows are one."""
    pairs = lambda v: v * (v - 1) / 2
    rows, columns, m = cells.sum(axis=2), cells.sum(axis=1), cells.sum(axis=(1, 2))
    left, right = pairs(rows).sum(axis=1), pairs(columns).sum(axis=1)
    expected, best = left * right / np.maximum(pairs(m), 1), (left + right) / 2
    same = best == expected
    out = np.where(same, 1.0, (pairs(cells).sum(axis=(1, 2)) - expected) / np.where(same, 1.0, best - expected))
    return np.where((rows > 0).sum(axis=1) > 1, out, np.nan)


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([((some[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) for some in np.split(x, range(1 << 14, len(x), 1 << 14))])


def _fit(x: np.ndarray, k: int, tries: int, rng) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres, rows of each and cost of the best of several fits; the first STARTS rows are those that starts are drawn from."""
    middle = x.mean(axis=0)
    z = x - middle
    sample, at = z[:STARTS], np.arange(tries)
    c = sample[rng.integers(len(sample), size=tries)][:, None]
    d = np.full((tries, len(sample)), np.inf)
    while c.shape[1] < k:  # each further one is drawn by its squared distance from those before
        d = np.minimum(d, sum((sample[None, :, f] - c[:, -1, None, f]) ** 2 for f in range(z.shape[1])))
        upto = d.cumsum(axis=1)
        pick = np.minimum((upto <= rng.random((tries, 1)) * upto[:, -1:]).sum(axis=1), len(sample) - 1)
        c = np.concatenate([c, sample[pick][:, None]], axis=1)
    counts, costs = np.zeros((tries, k)), np.zeros(tries)
    for _ in range(ROUNDS):
        counts[at], sums, costs[at] = _assigned(z, c[at])
        moved = np.where(counts[at][:, :, None] > 0, sums / np.maximum(counts[at], 1)[:, :, None], c[at])
        still = np.abs(moved - c[at]).max(axis=(1, 2)) > 1e-9 * (1 + np.abs(c).max())
        at = at[still]
        c[at] = moved[still]
        if not len(at):
            break
    best = int(costs.argmin())
    return c[best] + middle, counts[best], float(costs[best])


def _assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and sums of each cluster of every fit, and its cost, block by block."""
    fits, k, d = centres.shape
    counts, sums, costs = np.zeros((fits, k)), np.zeros((fits, k, d)), np.zeros(fits)
    half = (centres**2).sum(axis=2) / 2
    for start in range(0, len(x), 2048):
        some = x[start : start + 2048]
        top, near = some @ centres[:, 0].T - half[:, 0], np.zeros((len(some), fits), np.int8)
        for j in range(1, k):
            s = some @ centres[:, j].T - half[:, j]
            near[s > top] = j
            np.maximum(top, s, out=top)
        for j in range(k):
            own = (near == j).astype(float)
            counts[:, j] += own.sum(axis=0)
            sums[:, j] += own.T @ some
        costs += (some**2).sum() - 2 * top.sum(axis=0)
    return counts, sums, costs


def _point(features: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def _nearest(x: list[Column], centres: list[list[float]]) -> Column:
    """Number of the nearest centre; null where a component is, or without centres."""
    if not centres:
        return F.lit(None).cast("int")
    away = F.array(*[sum((F.pow(f - v, F.lit(2)) for f, v in zip(x, c, strict=True)), F.lit(0.0)) for c in centres])
    return F.nullif(F.array_position(away, F.array_min(away)) - 1, F.lit(-1)).cast("int")


def _best(points: DataFrame, width: int, k: int, omit: list[int], tries: int, seed: int) -> list[list[list[float]]]:
    """For each part in ``omit``, the centres of the best fit to the points of all other parts, in order; none without points."""
    points = points.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v))).persist()
    if omit == [-1] and points.limit(WHOLE + 1).count() <= WHOLE:
        out = [_whole(points, width, k, tries, seed)]
        points.unpersist()
        return out
    drawn = points.orderBy(F.xxhash64("x"), "x").limit(STARTS).collect()
    x, part = np.array([r.x for r in drawn]).reshape(-1, width), np.array([r.part for r in drawn])
    rng = np.random.default_rng(seed)
    samples = [x[part != o] if o >= 0 else x for o in omit]
    live = [i for i, sample in enumerate(samples) if len(sample)]
    out: list[list[list[float]]] = [[] for _ in omit]
    if live:
        centres = np.array([_spread(samples[i], k, rng) for i in live for _ in range(tries)])
        left = np.repeat([omit[i] for i in live], tries)
        for _ in range(ROUNDS):
            counts, sums, costs = _round(points, centres, left)
            moved = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centres)
            if np.allclose(moved, centres, rtol=0, atol=1e-9 * (1 + np.abs(centres).max())):
                break
            centres = moved
        for n, i in enumerate(live):
            best = n * tries + int(costs[n * tries : (n + 1) * tries].argmin())
            out[i] = sorted((c for c, m in zip(centres[best].tolist(), counts[best].tolist(), strict=True) if m), key=contrast, reverse=True)
    points.unpersist()
    return out


def _whole(points: DataFrame, width: int, k: int, tries: int, seed: int) -> list[list[float]]:
    """The centres of the best fit to at most WHOLE points, which each task holds: a few fits a task, each to its end."""
    drawn = points.select("x").orderBy(F.xxhash64("x"), "x").collect()  # at most WHOLE
    if not drawn:
        return []
    x, each = np.array([r.x for r in drawn]).reshape(-1, width), 4
    blocks = -(-tries // each)

    def run(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                centres, counts, cost = _fit(x, k, min(each, tries - b * each), np.random.default_rng([seed, b]))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([cost]), pa.array([counts.tolist()]), pa.array([centres.ravel().tolist()])], ["b", "cost", "n", "c"])

    best = min(points.sparkSession.range(0, blocks, 1, blocks).mapInArrow(run, "b long, cost double, n array<double>, c array<double>").collect(), key=lambda r: (r.cost, r.b))
    return sorted((c for c, m in zip(np.reshape(best.c, (k, width)).tolist(), best.n, strict=True) if m), key=contrast, reverse=True)


def _spread(sample: np.ndarray, k: int, rng) -> np.ndarray:
    """Starting centres, as ``_picked``."""
    return sample[_picked(sample, k, rng)]


def _picked(sample: np.ndarray, k: int, rng) -> np.ndarray:
    """Numbers of the rows that fits start from: each further one is drawn by its squared distance from those before."""
    out = rng.integers(len(sample), size=1)
    while len(out) < k:
        d = ((sample[:, None] - sample[None, out]) ** 2).sum(axis=2).min(axis=1)
        out = np.concatenate([out, rng.choice(len(sample), size=1, p=d / d.sum() if d.sum() else None)])
    return out


def _round(points: DataFrame, centres: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and sums of each cluster of every fit, and its cost, over the rows that aren't of the part it leaves out; a task returns one row for each fit."""
    fits, k, d = centres.shape
    middle = centres.mean(axis=(0, 1))

    def run(batches):
        counts, sums, costs = np.zeros((fits, k)), np.zeros((fits, k, d)), np.zeros(fits)
        for batch in batches:
            every = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            part = batch.column("part").to_numpy(zero_copy_only=False)
            for o in np.unique(left):
                at, x = np.flatnonzero(left == o), every[part != o] if o >= 0 else every
                n, s, c = _assigned(x - middle, centres[at] - middle)
                counts[at] += n
                sums[at] += s + n[:, :, None] * middle
                costs[at] += c
        flat = np.concatenate([counts, sums.reshape(fits, -1), costs[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(fits, dtype=np.int32)), pa.array(list(flat), pa.list_(pa.float64()))], ["t", "v"])

    width = k + k * d + 1
    total = points.mapInArrow(run, "t int, v array<double>").groupBy("t").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width)]).orderBy("t").collect()
    v = np.array([r[1:] for r in total])
    return v[:, :k], v[:, k:-1].reshape(fits, k, d), v[:, -1]


def silhouette(rows: DataFrame, features: list[str], cluster: str = "cluster") -> float:
    """Mean silhouette with squared distances, which needs no pairs of rows."""
    ready = VectorAssembler(inputCols=features, outputCol="z").transform(rows.withColumn("c", F.col(cluster).cast("double")))
    return ClusteringEvaluator(featuresCol="z", predictionCol="c").evaluate(ready)


def cluster_quality(rows: DataFrame, features: list[str], most: int = 4, tries: int = 100, smallest: int = 2) -> DataFrame:
    """k, silhouette (squared distances), sizes, smallest size and whether it suffices, for k from 2 to ``most`` (below the number of rows)."""
    n, out = rows.count(), []
    for k in range(2, min(most, n - 1) + 1):
        found = clusters(rows, features, k, tries).persist()
        sizes = sorted((r["count"] for r in found.groupBy("cluster").count().collect()), reverse=True)  # at most k rows
        value = silhouette(found, features) if len(sizes) > 1 else None
        out.append((k, value, ";".join(map(str, sizes)), sizes[-1], sizes[-1] >= smallest and len(sizes) == k))
        found.unpersist()
    return rows.sparkSession.createDataFrame(out, "k int, silhouette double, cluster_sizes string, min_cluster_size long, eligible boolean")
