import itertools

import numpy as np
import pytest

from epistride.operators import ablations, labels, models

SCORED = "horizon int, spec string, episode_key long, step_id long, onset long, success boolean, label int, score double, fold_threshold double"


def scored(n=9, steps=8):
    rng = np.random.default_rng(3)
    out = []
    for h, spec, e in itertools.product((2, 4), ("A", "B"), range(n)):
        onset = 5 if e % 3 == 0 else None
        for s in range(steps if onset is None else onset):
            out.append((h, spec, e, s, onset, onset is None, int(onset is not None and s + h >= onset), float(rng.integers(9)) / 8, 0.75))  # eighths: means of equal scores are equal in any order
    return out


def auroc(y, s):
    return np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])


def precision(y, s):
    cuts = [(y[s >= v].mean(), (y[s == v] == 1).sum()) for v in np.unique(s)]
    return sum(p * n for p, n in cuts) / y.sum()


def test_metrics(spark):
    rows = spark.createDataFrame(scored(), SCORED)
    t = rows.toPandas()
    got = {(r.horizon, r.spec): r for r in ablations.ablations(rows).collect()}
    assert len(got) == 4
    for at, g in t.groupby(["horizon", "spec"]):
        r, y, s = got[at], g.label.to_numpy(), g.score.to_numpy()
        assert (r.n_steps, r.positive_steps, r.n_episodes, r.n_failures) == (len(g), y.sum(), 9, 3)
        assert r.step_auroc == pytest.approx(auroc(y, s)) and r.step_auprc == pytest.approx(precision(y, s))
        e = g.sort_values("step_id").groupby("episode_key").agg(success=("success", "first"), max=("score", "max"), mean=("score", "mean"), last=("score", "last"))
        for how in ("max", "mean", "last"):
            v = e[how].to_numpy()
            assert r[f"episode_auroc_{how}"] == pytest.approx(auroc(1 - e.success.to_numpy().astype(int), v))
        bad = g[~g.success & (g.score >= 0.75)]
        inside, early = bad[bad.step_id >= 5 - at[0]], bad[bad.step_id < 5 - at[0]]
        assert r.false_alarms == (e[e.success]["max"] >= 0.75).sum() and r.far == pytest.approx(r.false_alarms / 6)
        assert r.detected == inside.episode_key.nunique() and r.premature == early.episode_key.nunique()
        leads = (5 - inside.groupby("episode_key").step_id.min()).to_numpy()
        assert (r.mean_lead, r.median_lead) == ((leads.mean(), np.median(leads)) if len(leads) else (None, None))


def test_intervals_and_empty(spark):
    rows = spark.createDataFrame(scored(), SCORED)
    got = ablations.intervals(rows, 30).collect()
    assert len(got) == 16 and all(0 <= r.auroc_lo <= r.auroc_hi <= 1 and r.draws <= 30 for r in got)
    assert ablations.ablations(rows.limit(0)).count() == 0


def test_sets_side_by_side(spark):
    rng = np.random.default_rng(5)
    made = [(e, s, 6 if e % 3 == 0 else None, float(rng.normal() + (e % 3 == 0) * s / 3), None if rng.random() < 0.1 else float(rng.normal())) for e in range(9) for s in range(8)]
    steps = spark.createDataFrame(made, "episode_key long, step_id long, onset long, feat_a double, feat_b double")
    got = ablations.scored_sets(steps, {"A": ["feat_a"], "AB": ["feat_a", "feat_b"]}, (2, 4), folds=2, inner=2).toPandas()
    valid = steps.where("onset IS NULL OR step_id < onset").selectExpr("*", "onset IS NULL AS success", "CAST(onset IS NOT NULL AND step_id + 4 >= onset AS INT) AS label")
    alone = models.nested_oof(valid, ["feat_a", "feat_b"], "label", folds=2, inner=2).toPandas()
    assert len(got) == 4 * len(alone)
    both = got[(got.spec == "AB") & (got.horizon == 4)].merge(alone, on=["episode_key", "step_id"])
    assert len(both) == len(alone) and (both.label_x == both.label_y).all()
    assert np.allclose(both.score_x, both.score_y) and np.allclose(both.fold_threshold_x, both.fold_threshold_y)


def test_inner_folds_of_all_folds_at_once(spark):
    """The same inner folds as if the episodes outside each fold were dealt by themselves, and no plan that grows with the folds."""
    sizes = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]
    rows = spark.createDataFrame([(e, s) for e, n in enumerate(sizes) for s in range(n)], "episode_key long, step_id long")
    got = models.nested_folds(rows, 3, 2).drop("step_id").toPandas()
    assert len(got) == sum(sizes) and len(got.drop_duplicates()) == len(sizes)
    for f in range(3):
        rest = got[got.fold != f]
        alone = {r.episode_key: r.fold for r in labels.with_folds(spark.createDataFrame(rest[["episode_key"]]), "episode_key", 2).collect()}
        assert dict(zip(rest.episode_key, rest[f"_in{f}"], strict=True)) == alone and got[got.fold == f][f"_in{f}"].isna().all()


def test_scores_are_read_from_rows_that_are_worked_out(spark):
    """Each round and metric plans anew what lies below it: the windows and joins of folds and thresholds aren't among that."""
    steps = spark.createDataFrame([(e, s, 5 if e % 3 == 0 else None, float((e * s) % 7)) for e in range(9) for s in range(8)], "episode_key long, step_id long, onset long, feat_a double")
    plan = ablations.scored_sets(steps, {"A": ["feat_a"]}, (2,), folds=2, inner=2)._jdf.queryExecution().analyzed().toString()
    assert "Window" not in plan and plan.count("Join") == 1


def best_split(x):
    """The two clusters with the least cost, by trying all."""
    splits = [np.array([0, *bits]) for bits in itertools.product((0, 1), repeat=len(x) - 1) if any(bits)]
    cost = lambda s: sum(((x[s == k] - x[s == k].mean(axis=0)) ** 2).sum() for k in (0, 1))
    return min(splits, key=cost)


def rand(a, b):
    """The adjusted Rand index from the pairs themselves."""
    pairs = list(itertools.combinations(range(len(a)), 2))
    both, left, right = (sum(f(i, j) for i, j in pairs) for f in (lambda i, j: a[i] == a[j] and b[i] == b[j], lambda i, j: a[i] == a[j], lambda i, j: b[i] == b[j]))
    expected = left * right / len(pairs)
    return (both - expected) / ((left + right) / 2 - expected)


@pytest.mark.parametrize("whole", [models.WHOLE, 0])
def test_stability_and_clusters_with_points_held_or_passed_over(spark, monkeypatch, whole):
    """Few points are held by each task, more are passed over; both find the clusters with the least cost, far from the origin too."""
    monkeypatch.setattr(models, "WHOLE", whole)
    x = np.random.default_rng(8).normal(size=(9, 2)) + np.array([[1e5, 0]] * 5 + [[1e5 + 1.5, 1]] * 4)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "e long, a double, b double")
    want = best_split(x)
    got = {r.e: r.cluster for r in models.clusters(rows, ["a", "b"], 2, tries=20).collect()}
    assert rand(want, np.array([got[i] for i in range(9)])) == 1
    aris = {r.e: r.ari for r in models.cluster_stability(rows, ["a", "b"], "e", tries=20).collect()}
    assert aris == pytest.approx({i: rand(want[np.arange(9) != i], best_split(x[np.arange(9) != i])) for i in range(9) if len(set(want[np.arange(9) != i])) == 2})


def test_stability(spark):
    x = np.random.default_rng(8).normal(size=(9, 2)) + np.array([[0, 0]] * 5 + [[1.5, 1]] * 4)
    rows = spark.createDataFrame([(10 + i, *map(float, v)) for i, v in enumerate(x)] + [(99, None, 1.0)], "e long, a double, b double")
    got = {r.e: r.ari for r in models.cluster_stability(rows, ["a", "b"], "e").collect()}
    whole = best_split(x)
    want = {10 + i: rand(whole[np.arange(9) != i], best_split(x[np.arange(9) != i])) for i in range(9) if len(set(whole[np.arange(9) != i])) == 2}
    assert got == pytest.approx(want)
    assert models.cluster_stability(rows.limit(0), ["a", "b"], "e").count() == 0


@pytest.mark.parametrize("case", range(6))
def test_fits_without_each_part_are_plain_fits(monkeypatch, case):
    """Sums that all fits share change no fit: the same costs and clusters as a fit of its own to the points outside each part."""
    rng = np.random.default_rng(case)
    n, k, seed = 40 + 20 * case, 1 + case % 3, np.random.default_rng(case)
    z = np.round(rng.normal(size=(n, 2)) * 9) if case % 2 else rng.normal(size=(n, 2))
    own = np.arange(n) if case < 3 else np.unique(rng.integers(0, 7, n), return_inverse=True)[1]
    first = rng.integers(0, 2, n)
    monkeypatch.setattr(models, "PAIRS", 64)
    cost, cells = models._without_each(z, own, first, k, np.random.default_rng(case))
    picked = models._picked(z, k, seed)
    starts = {o: (z[own != o])[models._picked(z[own != o], k, seed)] for o in np.unique(own[picked])}
    for o in range(own.max() + 1):
        x, c = z[own != o], starts.get(o, z[picked])
        for _ in range(100):
            d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
            near = d.argmin(axis=1)
            moved = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
            if np.abs(moved - c).max() < 1e-9:
                break
            c = moved
        want = np.zeros((2, k))
        np.add.at(want, (first[own != o], near), 1)
        assert cost[o] == pytest.approx(d.min(axis=1).sum()) and (cells[o] == want).all()


def test_leaving_out_each_point_takes_no_product_of_points_and_parts(monkeypatch):
    """Four times the points: far fewer than 16 times the pairs of a part and a point are looked at."""
    plain, looked = models._nearest_by_fit, []
    monkeypatch.setattr(models, "_nearest_by_fit", lambda z, c, fit, point: looked.append(len(fit)) or plain(z, c, fit, point))
    share = []
    for n in (1000, 4000):
        z = np.random.default_rng(1).normal(size=(n, 2)) * [5, 1]
        looked.clear()
        models._without_each(z, np.arange(n), (z[:, 0] > 0).astype(int), 2, np.random.default_rng(2))
        share.append(sum(looked) / n)
    assert share[1] < 2 * share[0] and share[1] < 400
