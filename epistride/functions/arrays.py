"""Array, token-grid, polyline and action-vector functions: Column to Column, all inside the JVM.

Polylines are arrays of structs (x, y), grids of tokens flat arrays, actions arrays of 7 (translation, rotation, gripper).
A missing or malformed input gives null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def same_size(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(a) == F.size(b))


# Tokens


def parse_tokens(text: Column) -> Column:
    """Numbers of all depth tokens in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"<DEPTH_(\d+)>"), F.lit(1)), lambda x: x.cast("int"))


def entropy(tokens: Column) -> Column:
    """Entropy in bits, with 1e-8 added inside the logarithm; null for no tokens."""
    n = F.size(tokens)
    share = F.transform(F.array_distinct(tokens), lambda v: F.size(F.filter(tokens, lambda x: x == v)) / n)
    return F.when(n > 0, -F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p + EPS)))


def grid_height(n: Column) -> Column:
    """The largest divisor of n that isn't above its square root."""
    return F.get(F.filter(F.sequence(F.floor(F.sqrt(n)).cast("int"), F.lit(1), F.lit(-1)), lambda h: n % h == 0), F.lit(0))


def boundary_ratio(tokens: Column) -> Column:
    """Share of unequal pairs among horizontal and vertical neighbours of the grid."""
    n = F.size(tokens)
    h = grid_height(n)
    w = (n / h).cast("int")
    at = lambda i: F.get(tokens, i)
    across = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i % w < w - 1) & (at(i) != at(i + 1))))
    down = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i + w < n) & (at(i) != at(i + w))))
    pairs = h * (w - 1) + (h - 1) * w
    return F.when(n > 1, (across + down) / pairs)


def hamming(a: Column, b: Column) -> Column:
    """Places at which two arrays of one size differ; null otherwise."""
    return F.when(same_size(a, b), F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)))


# Polylines


def gap(p: Column, q: Column) -> Column:
    return F.hypot(q["x"] - p["x"], q["y"] - p["y"])


def first(points: Column) -> Column:
    return F.get(points, F.lit(0))


def last(points: Column) -> Column:
    return F.get(points, F.size(points) - 1)


def segments(points: Column) -> Column:
    """Differences of successive points."""
    n = F.size(points)
    at = lambda i: F.get(points, i)
    steps = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct((at(i + 1)["x"] - at(i)["x"]).alias("x"), (at(i + 1)["y"] - at(i)["y"]).alias("y")))
    return F.when(n >= 2, steps).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def length(points: Column) -> Column:
    return F.aggregate(segments(points), F.lit(0.0), lambda a, s: a + F.hypot(s["x"], s["y"]))


def chord(points: Column) -> Column:
    return gap(first(points), last(points))


def straightness(points: Column) -> Column:
    """Chord over length."""
    return F.when((F.size(points) >= 2) & (length(points) >= EPS), chord(points) / length(points))


def curvature(points: Column) -> Column:
    """Length over chord."""
    return F.when((length(points) >= EPS) & (chord(points) >= EPS), length(points) / chord(points))


def spread(points: Column) -> Column:
    """Diagonal of the bounding box; 0 for fewer than two points."""
    side = lambda c: F.array_max(F.transform(points, lambda p: p[c])) - F.array_min(F.transform(points, lambda p: p[c]))
    return F.when(F.size(points) >= 2, F.hypot(side("x"), side("y"))).otherwise(F.lit(0.0))


def area(points: Column) -> Column:
    """Area of the closed polygon, by the shoelace formula; 0 for fewer than three points."""
    n = F.size(points)
    at = lambda i: F.get(points, i % n)
    twice = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + at(i)["x"] * at(i + 1)["y"] - at(i + 1)["x"] * at(i)["y"])
    return F.when(n >= 3, F.abs(twice) / 2).otherwise(F.lit(0.0))


def clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))


def turn_angle(points: Column) -> Column:
    """Mean angle between successive segments; null where none has two neighbours of some length."""
    s = segments(points)
    pairs = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.size(s)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    size = lambda v: F.hypot(v["x"], v["y"])
    fit = F.filter(pairs, lambda p: (size(p["a"]) >= EPS) & (size(p["b"]) >= EPS))
    angle = F.transform(fit, lambda p: F.acos(clipped((p["a"]["x"] * p["b"]["x"] + p["a"]["y"] * p["b"]["y"]) / (size(p["a"]) * size(p["b"])))))
    return F.when(F.size(angle) > 0, total(angle) / F.size(angle))


def direction(points: Column) -> Column:
    """Angle from the first to the last point."""
    a, b = first(points), last(points)
    return F.when((F.size(points) >= 2) & (chord(points) >= EPS), F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


def wrapped(angle: Column) -> Column:
    """The same angle from -pi up to pi."""
    return F.pmod(angle + F.pi(), 2 * F.pi()) - F.pi()


def without_repeats(points: Column, eps: float = EPS) -> Column:
    """Points but those within eps of the point before."""
    return F.filter(points, lambda p, i: (i == 0) | (gap(F.get(points, i - 1), p) > eps))


def resample(points: Column, n: int = 20) -> Column:
    """n points at equal distances along a line; a single point, or a line without length, gives its first point n times."""
    every = F.sequence(F.lit(0), F.lit(n - 1))

    def line(p: Column, steps: Column, along: Column) -> Column:
        whole = last(along)

        def between(t: Column, i: Column) -> Column:
            a, b, d = F.get(p, i), F.get(p, i + 1), F.get(steps, i)
            u = F.when(d >= EPS, (t - F.get(along, i)) / d).otherwise(F.lit(0.0))
            return F.struct((a["x"] + u * (b["x"] - a["x"])).alias("x"), (a["y"] + u * (b["y"] - a["y"])).alias("y"))

        def place(j: Column) -> Column:
            t = whole * j / (n - 1)
            i = F.least(F.greatest(F.size(F.filter(along, lambda c: c <= t)) - 1, F.lit(0)), F.size(p) - 2)
            return let(F.struct(t.alias("t"), i.alias("i")), lambda q: between(q["t"], q["i"]))

        flat = F.transform(every, lambda _: F.struct(first(p)["x"].alias("x"), first(p)["y"].alias("y")))
        return F.when((F.size(p) == 1) | (whole < EPS), flat).otherwise(F.transform(every, place))

    sums = lambda steps: F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d)))
    lengths = lambda p: F.transform(segments(p), lambda s: F.hypot(s["x"], s["y"]))
    return F.when(F.size(points) >= 1, let(points, lambda p: let(lengths(p), lambda steps: let(sums(steps), lambda along: line(p, steps, along)))))


def centroid_drift(a: Column, b: Column) -> Column:
    mean = lambda p, c: total(F.transform(p, lambda q: q[c])) / F.size(p)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.hypot(mean(a, "x") - mean(b, "x"), mean(a, "y") - mean(b, "y")))


def shape_drift(a: Column, b: Column) -> Column:
    """Mean distance of two resampled lines, point by point."""
    return F.when(same_size(a, b), total(F.zip_with(a, b, gap)) / F.size(a))


def backtracking(points: Column, ux: float, uy: float) -> Column:
    """Share of the movement along a direction that goes against it."""
    along = F.transform(segments(points), lambda s: s["x"] * ux + s["y"] * uy)
    moved = total(F.transform(along, F.abs))
    return F.when(moved > EPS, total(F.transform(along, lambda v: F.greatest(-v, F.lit(0.0)))) / moved)


# Actions


def cosine(a: Column, b: Column, clip: bool = False) -> Column:
    """Null where sizes differ or a norm is below 1e-8."""
    value = dot(a, b) / (norm(a) * norm(b))
    return F.when(same_size(a, b) & (norm(a) >= EPS) & (norm(b) >= EPS), clipped(value) if clip else value)


def distance(a: Column, b: Column) -> Column:
    return F.when(same_size(a, b), norm(F.zip_with(a, b, lambda x, y: x - y)))


def translation(action: Column) -> Column:
    return F.when(F.size(action) >= 7, F.slice(action, 1, 3))


def rotation(action: Column) -> Column:
    return F.when(F.size(action) >= 7, F.slice(action, 4, 3))


def gripper(action: Column) -> Column:
    return F.when(F.size(action) >= 7, F.get(action, F.lit(6)))


def near(a: Column, b: Column, tolerance: float) -> Column:
    """Whether arrays of one size agree within a tolerance; false for other sizes or nulls."""
    far = F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y) > tolerance), lambda d: F.coalesce(d, F.lit(True)))
    return F.coalesce(same_size(a, b) & ~far, F.lit(False))


# Maps of values in rows and columns


def bilinear(values: Column, h: int, w: int, x: Column, y: Column) -> Column:
    """The map at a point given in coordinates from 0 to 255, between the four cells about it."""
    px, py = (F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0)) / 255 for c in (x, y))
    px, py = px * (w - 1), py * (h - 1)
    x0, y0 = F.floor(px).cast("int"), F.floor(py).cast("int")
    x1, y1 = F.least(x0 + 1, F.lit(w - 1)), F.least(y0 + 1, F.lit(h - 1))
    u, v = px - x0, py - y0
    at = lambda i, j: F.get(values, i * w + j)
    return (at(y0, x0) * (1 - u) + at(y0, x1) * u) * (1 - v) + (at(y1, x0) * (1 - u) + at(y1, x1) * u) * v


def percentile_rank(values: Column, x: Column) -> Column:
    """Share of finite cells that aren't above x."""
    fit = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when((F.size(fit) > 0) & x.isNotNull(), F.size(F.filter(fit, lambda v: v <= x)) / F.size(fit))


def population_std(values: Column) -> Column:
    off = lambda mean: F.sqrt(total(F.transform(values, lambda v: (v - mean) * (v - mean))) / F.size(values))
    return F.when(F.size(values) > 0, let(total(values) / F.size(values), off))


def median(values: Column) -> Column:
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return let(F.array_sort(values), middle)


def sign_changes(values: Column, dead: Column) -> Column:
    """Changes of sign between successive values whose size is above the dead band."""
    signs = F.transform(F.filter(values, lambda v: F.abs(v) > dead), F.signum)
    n = F.size(signs)
    turns = F.zip_with(F.slice(signs, 1, F.greatest(n - 1, F.lit(0))), F.slice(signs, 2, n), lambda a, b: a != b)
    return F.size(F.filter(turns, lambda t: t))


def ring(h: int, w: int, share: float = 0.1) -> list[int]:
    """Cells within the border of a map."""
    b = max(1, int(min(h, w) * share))
    return [i * w + j for i in range(h) for j in range(w) if i < b or j < b or i >= h - b or j >= w - b]


def pick(values: Column, cells: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(i) for i in cells]), lambda i: F.get(values, i))
