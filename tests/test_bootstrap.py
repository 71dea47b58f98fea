import hashlib

import numpy as np
import pytest

from epistride.functions import draws, stats
from epistride.plans import evaluation

SF = "/root/testdata/sf0.001"


def drawn(n, *parts):
    return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:8], 16) % n


def test_registered_draws(spark):
    """The registered interval is that of 2000 draws made in Python."""
    rows = sorted((r.episode_key, r.y, r.m_value) for r in evaluation.episodes(spark, SF).collect())
    x = {y: [m for _, own, m in rows if own == y] for y in (True, False)}
    mean = {y: [np.mean([m for i in range(len(v)) if (m := v[drawn(len(v), 42, b, i)]) is not None]) for b in range(1, 2001)] for y, v in x.items()}
    lo, hi = np.percentile(np.subtract(mean[True], mean[False]), [2.5, 97.5])
    got = evaluation.bootstrap_ci(spark, SF).first()
    assert (got.lo, got.hi) == pytest.approx((lo, hi), abs=2e-5)
    wide = evaluation.cluster_bootstrap(spark, SF).first()
    assert wide.draws == 1000 and wide.auroc_lo < wide.auroc_hi and wide.ap_lo < wide.ap_hi


def test_registered_folds_and_starts(spark, monkeypatch):
    tries, fit = [], evaluation.M.clusters
    monkeypatch.setattr(evaluation.M, "clusters", lambda *a, tries=10, seen=tries: seen.append(tries) or fit(*a, tries=1))
    assert evaluation.cluster_modes(spark, SF).count() > 0 and tries == [100]
    assert {r.fold for r in evaluation.oof_logistic(spark, SF).select("fold").distinct().collect()} == set(range(5))


def test_cluster_draws_skip_a_single_class(spark):
    episodes = {"a": [(0.5, 1), (0.2, 0)], "b": [(0.5, 0), (0.9, 0), (None, 1)], "c": [(0.1, 0)], "d": [(0.9, 0), (0.2, 0)]}
    rows = spark.createDataFrame([(k, s, y) for k, v in episodes.items() for s, y in v], "key string, score double, label int")
    want, keys = {}, sorted(episodes)
    for b in range(1, 31):
        own = [(s, y) for i in range(4) for s, y in episodes[keys[drawn(4, 7, b, i)]] if s is not None]
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        if pos and neg:
            auroc = np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])
            ap = np.mean([sum(q >= p for q in pos) / sum(q >= p for q, _ in own) for p in pos])
            want[b] = (auroc, ap)
    got = {r.draw: (r.auroc, r.ap) for r in stats.cluster_bootstrap(rows, rows.select("key").distinct(), "key", "score", "label", 30).collect()}
    assert 0 < len(want) < 30 and got.keys() == want.keys()
    assert all(got[b] == pytest.approx(want[b]) for b in want)


def test_heads_are_those_of_md5():
    prefixes = [b"43-t0-true-%d-" % b for b in (3, 12, 777)] + [b"", b"x" * 51, b"x" * 60]
    for first, last in ((0, 120), (9995, 10004)):
        found = {(prefixes[k], i + j): int(v) for some, i, h in draws.heads(prefixes, first, last) for k, row in zip(some, h, strict=True) for j, v in enumerate(row)}
        assert found == {(p, i): int(hashlib.md5(p + str(i).encode()).hexdigest()[:8], 16) for p in prefixes for i in range(first, last)}


@pytest.mark.parametrize(("cell", "held"), [(1 << 23, 1 << 22), (500, 1 << 22), (500, 7)])
def test_means_from_cells_of_draws(spark, monkeypatch, cell, held):
    """Cells cut the draws, and ranges the values, of any group; nulls in values are left out."""
    for name, value in (("CELL", cell), ("HELD", held), ("PIECE", 5)):
        monkeypatch.setattr(draws, name, value)
    x = {"a": [1.0, 5.0, None, 2.5] * 5, "b": [4.0], "c": [None]}
    rows = spark.createDataFrame([(g, i, len(v), m) for g, v in x.items() for i, m in enumerate(v)] + [(None, 0, 1, 1.0)], "g string, i long, n long, x double")
    got = {(r.g, r.draw): r.mean for r in stats.bootstrap_mean(rows, "x", ["g"], 200).collect()}
    picked = {(g, b): [m for i in range(len(v)) if (m := v[drawn(len(v), 43, g, b, i)]) is not None] for g, v in x.items() for b in range(1, 201)}
    assert got.keys() == picked.keys()
    assert all(got[k] == (pytest.approx(np.mean(v)) if v else None) for k, v in picked.items())
