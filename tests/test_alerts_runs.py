import json

import numpy as np
from pyspark.sql import functions as F

from epistride.functions import stats
from epistride.functions import values as V
from epistride.operators import labels, sequence, tables


def test_sustained_flag(spark):
    episodes = {1: "TTFTTTT", 2: "TTFTT", 3: "T", 4: "NTTT", 5: "FTTTTT"}
    flags = {"T": True, "F": False, "N": None}
    rows = spark.createDataFrame([(k, 10 * i if k == 5 else i, flags[c]) for k, v in episodes.items() for i, c in enumerate(v)], "episode_key int, step_id int, f boolean")
    got = {r.episode_key: tuple(r)[1:] for r in sequence.sustained_flag(rows, F.col("f")).collect()}
    assert got[1] == (7, 6 / 7, 4, 1, 3, 0.5, 3) and got[2] == (5, 0.8, 2, 0, None, None, None) and got[3] == (1, 1.0, 1, 0, None, None, None)
    assert got[4] == (4, 0.75, 3, 1, 1, 1 / 3, 2) and got[5][4] == 10  # the step, not the place
    assert sequence.sustained_flag(rows.limit(0), F.col("f")).count() == 0
    assert {r.episode_key: r.onset_step for r in sequence.sustained_flag(rows, F.col("f"), 1).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 10}


def test_premature_events(spark):
    rows = [("a", 0, i, 20, 5, s, t) for i, (s, t) in enumerate([(0.9, 0.5), (0.4, 0.5), (0.5, 0.5), (None, 0.5)])]
    rows += [("a", 0, 14, 20, 5, 0.9, 0.5), ("a", 0, 15, 20, 5, 0.9, 0.5), ("b", 1, 2, None, 5, 0.9, 0.5), ("c", 1, 2, 20, 5, 0.9, 0.95), ("c", 1, 3, 20, 5, 0.9, None)]
    scores = spark.createDataFrame(rows, "episode_key string, fold int, step_id int, onset int, horizon int, score double, threshold double")
    got = sorted((r.episode_key, r.step_id, r.distance, r.over_horizon, r.first) for r in labels.premature_events(scores, ["fold"]).collect())
    assert got == [("a", 0, 20, 15, True), ("a", 2, 18, 13, False), ("a", 14, 6, 1, False)]
    assert labels.premature_events(scores.limit(0), ["fold"]).count() == 0


def test_truth_of_values(spark):
    cases = [(True, True), (False, False), (2, True), (0, False), (0.0, False), (-0.5, True), (10**25, True), ("1", True), (" YES ", True), ("no", False), ("0", False), ("1.0", None), ("", None), ("2", None), (None, None), ([1], None), ({"a": 1}, None)]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(cases)] + [(99, None), (100, "no json")], "i int, t string")
    got = {r.i: r.y for r in rows.select("i", V.truth_of(F.try_parse_json("t")).alias("y")).collect()}
    assert got == {i: y for i, (_, y) in enumerate(cases)} | {99: None, 100: None}


def test_adjusted_p_go_range_by_range(spark, monkeypatch):
    rng = np.random.default_rng(2)
    p = np.round(rng.random((2, 300)) ** 3, 3)
    rows = [("ab"[g], float(x)) for g in range(2) for x in p[g]] + [("a", None), (None, 0.2), ("c", 0.5)]
    monkeypatch.setattr(stats, "EDGES", 50)
    got = sorted(((r.g, r.p, r.q) for r in tables.bh_adjusted(spark.createDataFrame(rows, "g string, p double"), "p", ["g"]).collect()), key=str)
    want = [("a", None, None), (None, 0.2, 0.2), ("c", 0.5, 0.5)]
    for g in range(2):
        x = np.sort(p[g])
        q = np.minimum(np.minimum.accumulate((x * len(x) / np.arange(1, len(x) + 1))[::-1])[::-1], 1)
        want += [("ab"[g], float(a), float(b)) for a, b in zip(x, q)]
    want.sort(key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(b[2] == a[2] or abs(a[2] - b[2]) < 1e-12 for a, b in zip(got, want))
