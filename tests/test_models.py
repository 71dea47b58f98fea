import numpy as np
import pytest

from epistride.operators import labels, models

SCHEMA = "episode_key long, step_id long, label int, success boolean, feat_a double, feat_b double"


def made(n=24, steps=12):
    rng = np.random.default_rng(5)
    out = []
    for e in range(n):
        bad = e % 3 == 0
        for s in range(steps):
            y = int(bad and s > 5 and rng.random() < 0.9)
            out.append((e, s, y, not bad, None if rng.random() < 0.1 else float(y + rng.normal()), float(rng.normal() + s / 9)))
    return out


def plain(train, test, balanced=True, indicators=True):
    """The same model by gradient descent to the end: y, features (nan for gaps) of training rows; scores of test rows."""
    y, x = train
    fill = np.nanmedian(x, axis=0)
    gaps = np.isnan(x).any(axis=0) & indicators
    ready = lambda v: np.concatenate([np.where(np.isnan(v), fill, v), np.isnan(v)[:, gaps].astype(float)], axis=1)
    a = ready(x)
    m, s = a.mean(axis=0), a.std(axis=0)
    one = lambda v: np.c_[np.ones(len(v)), (ready(v) - m) / np.where(s > 0, s, 1)]
    z, w = one(x), np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    b, keep = np.zeros(z.shape[1]), np.r_[0, np.ones(z.shape[1] - 1)]
    for _ in range(15000):
        b -= 5e-3 * (z.T @ (w * (1 / (1 + np.exp(-z @ b)) - y)) + keep * b)
    return 1 / (1 + np.exp(-one(test) @ b))


@pytest.mark.parametrize("kind", [(True, True), (False, False)])
def test_out_of_fold_scores(spark, kind):
    got = models.grouped_oof(spark.createDataFrame(made(), SCHEMA), ["feat_a", "feat_b"], "label", balanced=kind[0], indicators=kind[1]).toPandas()
    assert len(got) == 288 and got.groupby("episode_key").fold.nunique().max() == 1
    x, y = got[["feat_a", "feat_b"]].to_numpy(float), got.label.to_numpy()
    for f in range(5):
        own = (got.fold == f).to_numpy()
        assert np.allclose(plain((y[~own], x[~own]), x[own], *kind), got.score[own], atol=1e-6)


def test_nested_thresholds(spark):
    rows = spark.createDataFrame(made(), SCHEMA)
    got = models.nested_oof(rows, ["feat_a", "feat_b"], "label").toPandas()
    assert len(got) == 288
    for f in range(5):
        rest = got[got.fold != f]
        part = {r.episode_key: r.fold for r in labels.with_folds(spark.createDataFrame(rest[["episode_key"]]), "episode_key", 3).collect()}
        j, x, y = rest.episode_key.map(part).to_numpy(), rest[["feat_a", "feat_b"]].to_numpy(float), rest.label.to_numpy()
        score = np.zeros(len(rest))
        for k in range(3):
            score[j == k] = plain((y[j != k], x[j != k]), x[j == k])
        top = rest.assign(score=score)[rest.success].groupby("episode_key").score.max().to_numpy()
        fits = [t for t in [*sorted(top), np.inf] if (top >= t).sum() <= int(0.1 * len(top) + 1e-12)]
        assert np.allclose(got.fold_threshold[got.fold == f], min(fits), atol=1e-6)


def test_one_class_and_empty(spark):
    rows = spark.createDataFrame([(e, 0, 1, False, 1.0, None) for e in range(6)], SCHEMA)
    assert {r.score for r in models.grouped_oof(rows, ["feat_a", "feat_b"], "label").collect()} == {1.0}
    assert {r.fold_threshold for r in models.nested_oof(rows, ["feat_a"], "label").collect()} == {float("inf")}
    assert models.grouped_oof(rows.limit(0), ["feat_a"], "label").count() == 0
