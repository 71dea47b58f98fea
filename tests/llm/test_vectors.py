import math
import operator
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from epistride.llm import mtree, multiindex


def rows_of(rng, n=900, copies=60):
    base = rng.normal(size=(n, 24))
    near = base[:copies] + rng.normal(size=(copies, 24)) * 0.08
    same = np.repeat(base[5:6], 30, axis=0)
    x = np.concatenate([base, near, same]) / 5
    return [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]


ODD = [(5000, None), (5100, []), (5200, [0.0] * 24), (5300, [float("nan")] * 24), (5400, [float("inf")] + [0.0] * 23), (5500, [None] + [0.5] * 23), (5600, [0.5, -0.25]), (None, [1.0] * 24), (0, [0.25] * 24), (5700, [1e30] * 24), (5701, [-2e30] * 24), (5702, [2e30] * 23 + [-1e38])]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = rows_of(np.random.default_rng(4)) + ODD
    return rows, spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "vec_id long, embedding array<float>, n int, v string, id int").repartition(3)


def ranked(scores, k):
    """The k largest of (score, id): scores beyond a long are given as the nearest long and ranked as doubles."""
    told = [(max(min(s, 2**63 - 1), -(2**63)), i, 0.0 if -(2**63) < s < 2**63 - 1 else float(s)) for s, i in scores]
    return [(n, i, s) for n, (s, i, _) in enumerate(sorted(told, key=lambda x: (-x[0], -x[2], x[1]))[:k], 1)]


def best(rows, k):
    full = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v] + [0] * (24 - len(v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out, asked = [], set()
    for q, v in full:
        if q % 100 == 0 and q not in asked:
            asked.add(q)
            out += [(q, *x) for x in ranked([(sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in full if i != q], k)]
    return out


def test_top_k(vectors, monkeypatch):
    rows, data = vectors
    rows = [r for r in rows if r != ODD[8]]  # a query's id that repeats with another vector asks once, with either
    data = data.where("NOT (vec_id = 0 AND embedding[0] = 0.25)")
    monkeypatch.setattr(mtree, "PAGE", 200)
    monkeypatch.setattr(mtree, "LEAF", 16)
    monkeypatch.setattr(mtree, "QUERIES", 3)
    got = mtree.top_k(data, F.col("vec_id") % 100 == 0, 10)
    assert sorted(map(tuple, got.collect())) == sorted(best(rows, 10))


@pytest.mark.parametrize("sizes", [[8192.0, 9000.5], [65536.0, 3e5], [8192.0, 1e6, 3e5, 2e9], [1e4, 2e9, 2e12]])
def test_large_components_take_part(spark, monkeypatch, sizes):
    rng = np.random.default_rng(6)
    rows = rows_of(rng, 500, 20)
    for n, size in enumerate(sizes):
        for m in range(3):
            v = [float(np.float32(x)) for x in rng.normal(size=24)]
            v[m] = size * (-1) ** m
            if size > 1e9:
                # Far apart from the others' large components, so that scores fit a long.
                v = [0.0] * 24
                v[5 + n] = size if m == 0 else 0.25
            rows.append((2000 + 100 * (3 * n + m), v))
            rows.append((7000 + 10 * (3 * n + m) + 1, v[:6] + [x / 3 for x in v[6:]] if size < 1e9 else [0.5] * 24))
    for name, value in (("PAGE", 150), ("LEAF", 16), ("QUERIES", 3)):
        monkeypatch.setattr(mtree, name, value)
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = mtree.top_k(data, F.col("vec_id") % 100 == 0, 10).collect()
    assert sorted(map(tuple, got)) == sorted(best([(i, v + [0.0] * (24 - len(v))) for i, v in rows], 10))


@pytest.mark.parametrize("size", [2**20, 2**26, 2**29, 2**40])
def test_scores_are_exact_beyond_doubles(monkeypatch, size):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(mtree, "LEAF", 16)
    base = rng.integers(-size, size, (6, 16))
    x = np.concatenate([base[i % 6 : i % 6 + 1] + rng.integers(-1, 2, (1, 16)) for i in range(300)])
    x = np.concatenate([x, rng.integers(-500, 500, (100, 16))])
    tree = mtree.Tree.load(mtree.Tree(np.arange(400), x, float((x.astype(float) ** 2).sum(axis=1).max())).dump())
    for q in (0, 7, 350):
        want = sorted(((sum(int(a) * int(b) for a, b in zip(x[q], w, strict=True)), -i) for i, w in enumerate(x) if i != q), reverse=True)[:10]
        assert sorted(tree.search(x[q], q, 10, []), reverse=True) == want


def test_wide_and_large(spark):
    """Sums over 1024 components that no double holds."""
    rng = np.random.default_rng(9)
    rows = [(50 * i, [float(np.float32(x)) for x in rng.normal(size=1024) * 10 ** (i % 6)]) for i in range(40)]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, 10).collect()
    assert sorted(map(tuple, got)) == sorted(best(rows, 10))


def test_squares_beyond_doubles(spark, monkeypatch):
    """Components near the largest double beside ordinary and small ones: scores stay exact, and no row is refused."""
    rng = np.random.default_rng(8)
    sizes = [1e160, 1e308, 1.0, 1e-3, 3e5, 1e40, 0.0]
    rows = [(20 * i, [float(x) for x in rng.uniform(-1, 1, 6) * sizes[i % 7]]) for i in range(90)]
    rows += [(9001, rows[5][1]), (9003, rows[5][1]), (9005, [1.7e308] * 6), (9100, [-1.7e308] * 6), (9107, [1.0, None, 1.0]), (9109, None)]
    integer = {i: [math.floor(Fraction(x) * 1024) for x in v] for i, v in rows if v and None not in v}
    # Scores beyond a long rank by their value as doubles of one unit, which no two different ones share here.
    want = []
    for q in (i for i in integer if i % 100 == 0):
        scores = {i: sum(map(operator.mul, integer[q], v)) for i, v in integer.items() if i != q}
        first = sorted(scores, key=lambda i: (-scores[i], i))[:10]
        want += [(q, r + 1, i, min(max(scores[i], mtree.LEAST), mtree.MOST)) for r, i in enumerate(first)]
    monkeypatch.setattr(mtree, "PAGE", 30)
    monkeypatch.setattr(mtree, "LEAF", 8)
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 10).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_equal_hashes_do_not_make_a_class(spark, monkeypatch):
    monkeypatch.setattr(multiindex.F, "xxhash64", lambda *c: F.hash(*c).cast("long"))
    data = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1e200, 1e200]), (5, [1e-200, 1e-200])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in multiindex.link_vectors(data).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4)]


def test_few_candidates_and_empty(spark):
    data = spark.createDataFrame([(0, [0.5]), (1, [0.25]), (2, [0.25])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, mtree.top_k(data, F.col("vec_id") % 100 == 0).collect())) == [(0, 1, 1, 512 * 256), (0, 2, 2, 512 * 256)]
    assert mtree.top_k(data.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert multiindex.link_vectors(data.limit(0)).count() == 0


def test_bounds_spare_distances(monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.integers(-900, 900, (20, 8))
    monkeypatch.setattr(mtree, "LEAF", 96)
    x = np.concatenate([c + rng.integers(-15, 15, (200, 8)) for c in centres]).astype(np.int64)
    tree = mtree.Tree(np.arange(len(x)), x, float((x**2).sum(axis=1).max()))
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, rows):
            out = super().__getitem__(rows)
            seen.append(len(out))
            return out.view(np.ndarray)

    tree.vectors = tree.vectors.view(Counted)
    found = sorted(tree.search(x[7], 7, 5, []), reverse=True)
    scores = x @ x[7]
    scores[7] = -(10**9)
    assert [s for s, _ in found] == sorted(scores.tolist(), reverse=True)[:5] and sum(seen) < len(x) / 2


def links_of(rows, threshold):
    full = [(i, np.array([*v, *[0.0] * (24 - len(v))])) for i, v in rows if i is not None and v and any(v) and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    x = np.array([np.float32(v).astype(float) for _, v in full])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    return [i for i, _ in full], near


def test_links(vectors, monkeypatch):
    rows, data = vectors
    monkeypatch.setattr(multiindex, "CELL", 60)
    monkeypatch.setattr(multiindex, "LIVING", 40)
    monkeypatch.setattr(multiindex, "VISITING", 70)
    ids, near = links_of(rows, 0.9)
    got = multiindex.link_vectors(data, 0.9).collect()
    assert len(got) == len(rows)
    found, real = sum(r.n_links for r in got), int(near.sum())
    assert 0.99 * real <= found <= real and real > 900
    component = brute.component_of(set(ids), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    same = sum(component.get(r.vec_id, r.vec_id) == r.component_id for r in got)
    assert same >= 0.99 * len(got)
    alone = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None or 5000 <= r.vec_id < 5600}
    assert alone == {i: (0, i, True) for i, _ in ODD[:6]} | {None: (0, None, True)}


def test_multi_sequence_visits_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(9)
    got = [a[i] + b[j] for i, j in multiindex.multi_sequence(a, b, 63)]
    assert np.allclose(got, np.sort((a[:, None] + b).ravel()))
