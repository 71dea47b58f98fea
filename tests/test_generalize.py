"""Prefixes, leads, groups left out, correlations and exact rank tests against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epistride.functions import stats as T
from epistride.operators import fits, generalize


def auroc(rows):
    pairs = [(a > b) + (a == b) / 2 for a, y in rows for b, z in rows if y and not z]
    return sum(pairs) / len(pairs) if pairs else None


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(2)
    return [(f"g{e % 4}", e, s, bool(e % 3 == 0), None if rng.random() < 0.1 else float(rng.integers(12))) for e in range(40) for s in range(int(rng.integers(1, 14)))]


def test_prefixes(spark, made):
    steps = spark.createDataFrame(made, "task string, episode_key long, step_id long, failed boolean, score double")
    got = {(r.task, r.percent): r.auroc for r in generalize.prefix_metrics(steps, "score", "failed", ["task"], (10, 50, 100)).collect()}
    for (task, percent), value in got.items():
        tops = []
        for _, g in itertools.groupby((r for r in made if r[0] == task), lambda r: r[1]):
            g = list(g)
            seen = [r[4] for i, r in enumerate(g) if i * 100 < percent * len(g) and r[4] is not None]
            if seen:
                tops.append((max(seen), g[0][3]))
        assert value == pytest.approx(auroc(tops))
    assert len(got) == 12


def test_groups_left_out(spark, made):
    steps = spark.createDataFrame(made, "task string, episode_key long, step_id long, failed boolean, score double").withColumn("success", ~F.col("failed"))
    got = {r.held_out: r for r in generalize.leave_one_group_out(steps, "score", "task", 0.2).collect()}
    for task in ("g0", "g1", "g2", "g3"):
        top = lambda rows: {e: max((r[4] for r in g if r[4] is not None), default=None) for e, g in itertools.groupby(rows, lambda r: r[1])}
        others, own = [r for r in made if r[0] != task], [r for r in made if r[0] == task]
        good = [m for e, m in top(others).items() if e % 3]
        allowed = math.floor(0.2 * sum(m is not None for m in good) + 1e-12)
        threshold = min((s for s in {r[4] for r in others if r[4] is not None} if sum(m is not None and m >= s for m in good) <= allowed), default=math.inf)
        r = got[task]
        assert r.threshold == threshold
        mine = top(own)
        alarms = [m is not None and m >= threshold for e, m in mine.items() if e % 3]
        assert (r.n_success, r.far) == (len(alarms), pytest.approx(sum(alarms) / len(alarms)))
        assert r.auroc == pytest.approx(auroc([(m, e % 3 == 0) for e, m in mine.items() if m is not None]))
    one = generalize.leave_one_group_out(steps.where("task = 'g1'"), "score", "task").collect()
    assert len(one) == 1 and one[0].threshold is None
    assert generalize.leave_one_group_out(steps.limit(0), "score", "task").count() == 0


def test_correlations_and_leads(spark, made):
    rows = spark.createDataFrame([(g, s, f) for g, _, _, f, s in made], "task string, x double, y boolean").withColumn("flat", F.lit(1.0))
    got = {(r.task, r.feature): r for r in generalize.point_biserial(rows, ["x", "flat"], F.col("y"), ["task"]).collect()}
    x, y = np.array([(s, f) for g, _, _, f, s in made if g == "g1" and s is not None]).T
    r = np.corrcoef(x.astype(float), y.astype(float))[0, 1]
    assert got["g1", "x"].r == pytest.approx(r) and got["g1", "x"].t == pytest.approx(r * math.sqrt((len(x) - 2) / (1 - r * r)))
    assert got["g1", "flat"].r is None and got["g1", "flat"].t is None
    leads = generalize.lead_times(spark.createDataFrame([(5, 15, 40), (None, 15, 40), (20, 15, 40), (3, None, 0)], "first_alert int, onset int, num_steps int")).collect()
    assert [(a.l_end, a.l_onset, a.l_norm) for a in leads] == [(35, 10, 0.25), (None, None, None), (20, -5, -0.125), (-3, None, None)]


def test_exact_and_normal_p(spark):
    table = {(r.n1, r.n2, r.u): (r.orders, r.tail) for r in T.u_distribution(spark, 3, 4).collect()}
    orders = {}
    for places in itertools.combinations(range(7), 3):
        u = sum(p > q for p in places for q in set(range(7)) - set(places))
        orders[u] = orders.get(u, 0) + 1
    assert {u: c for (a, b, u), (c, _) in table.items() if (a, b) == (3, 4)} == orders
    assert table[3, 4, 12][1] == pytest.approx(1 / 35) and table[3, 4, 0][1] == 1
    rows = [("small", float(x), x in (9, 10, 11)) for x in range(12)] + [("tied", float(x // 2), x > 8) for x in range(12)] + [("large", float(x), x % 3 == 0) for x in range(60)] + [("one", 1.0, True)]
    got = {r.g: r for r in T.mann_whitney(spark.createDataFrame(rows, "g string, s double, y boolean"), "s", F.col("y"), ["g"]).collect()}
    assert got["small"].exact and got["small"].p == pytest.approx(2 / 220)
    assert not got["tied"].exact and not got["large"].exact and got["one"].p is None
    for z in (0.0, 0.3, 1.959964, 3.5, 6.0, 9.0, None):
        p = spark.range(1).select(T.two_sided_p(F.lit(z).cast("double"))).first()[0]
        assert p is None if z is None else p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-13)


def test_medians_by_their_bits(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=200) * 10.0 ** rng.integers(-200, 200, 200), [0.0, -0.0, 1e308, -1e308, 5e-324], np.full(30, 2.5)])
    table = np.column_stack([x, np.where(rng.random(len(x)) < 0.3, np.nan, rng.integers(-3, 3, len(x)) * 1.0), np.full(len(x), np.nan)])
    rows = [([0.0], r.tolist(), [bool(i % 2), i < 7, False]) for i, r in enumerate(table)]
    points = spark.createDataFrame(rows, "y array<double>, x array<double>, m array<boolean>").repartition(3)
    masks = np.array([r[2] for r in rows])
    held = np.array([[(~np.isnan(table[masks[:, t], c])).sum() for c in range(3)] for t in range(3)])
    got = fits._medians(points, held)
    want = [[np.nanmedian(table[masks[:, t], c]) if held[t, c] else 0.0 for c in range(3)] for t in range(3)]
    assert np.allclose(got, want, rtol=1e-12, atol=0)
