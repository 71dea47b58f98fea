"""The column functions, and onsets, labels and alerts of steps, as functions of Spark SQL.

``install`` makes them in a session. They are SQL functions, which the analyzer replaces by their bodies, so that a query
gets the plan that it has with the functions of ``arrays``, ``values``, ``operators.sequence`` and ``operators.labels``:

    install(spark, steps="my_steps")
    spark.sql("SELECT episode_key, max(straightness(trace)) FROM my_steps JOIN plateau_onsets() USING (episode_key) GROUP BY 1")
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from epistride.functions import arrays as A
from epistride.functions import values as V

LINE, NUMBERS, EPS = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>", "ARRAY<INT>", f"{A.EPS}D"


def _side(c: str) -> str:
    return f"array_max(transform(points, most_{c} -> most_{c}.{c})) - array_min(transform(points, least_{c} -> least_{c}.{c}))"


def _finite(x: str) -> str:
    return f"CASE WHEN isnan({x}) OR abs({x}) = double('infinity') THEN NULL ELSE {x} END"


def _known(more: str = "") -> str:
    texts = lambda words: ", ".join(f"'{w}'" for w in words)
    return f"CASE WHEN lower(trim(text)) IN ({texts(V.TRUE)}) THEN true WHEN lower(trim(text)) IN ({texts(V.FALSE)}) THEN false {more} END"


def _gap(a: str, b: str) -> str:
    return f"hypot({b}.x - {a}.x, {b}.y - {a}.y)"


_FIRST, _LAST = "get(points, 0)", "get(points, size(points) - 1)"

#: Name: parameters, type and body. Later bodies call earlier functions.
SCALARS: dict[str, tuple[str, str, str]] = {
    "finite": ("x DOUBLE", "DOUBLE", _finite("x")),
    "number": ("text STRING", "DOUBLE", _finite("try_cast(trim(text) AS DOUBLE)")),
    "truth": ("text STRING", "BOOLEAN", _known()),
    "strict_truth": ("text STRING", "BOOLEAN", _known("WHEN lower(trim(text)) <> '' THEN false")),
    "progress": ("x DOUBLE, scale DOUBLE", "DOUBLE", "least(greatest(coalesce(nanvl(x, 0.0D), 0.0D) / scale, 0.0D), 1.0D)"),
    "entropy": (f"tokens {NUMBERS}", "DOUBLE", "CASE WHEN size(tokens) > 0 THEN -aggregate(transform(array_distinct(tokens), v -> size(filter(tokens, x -> x = v)) / size(tokens)), "
                f"0.0D, (a, p) -> a + p * log2(p + {EPS})) END"),
    "hamming": (f"a {NUMBERS}, b {NUMBERS}", "INT", "CASE WHEN size(a) > 0 AND size(a) = size(b) THEN size(filter(zip_with(a, b, (x, y) -> NOT (x = y)), d -> d)) END"),
    "segments": (f"points {LINE}", LINE, "CASE WHEN size(points) >= 2 THEN transform(sequence(0, size(points) - 2), i -> struct(get(points, i + 1).x - get(points, i).x AS x, "
                 f"get(points, i + 1).y - get(points, i).y AS y)) ELSE CAST(array() AS {LINE}) END"),
    "path_length": (f"points {LINE}", "DOUBLE", "aggregate(segments(points), 0.0D, (a, s) -> a + hypot(s.x, s.y))"),
    "chord": (f"points {LINE}", "DOUBLE", _gap(_FIRST, _LAST)),
    "straightness": (f"points {LINE}", "DOUBLE", f"CASE WHEN size(points) >= 2 AND path_length(points) >= {EPS} THEN chord(points) / path_length(points) END"),
    "curvature": (f"points {LINE}", "DOUBLE", f"CASE WHEN path_length(points) >= {EPS} AND chord(points) >= {EPS} THEN path_length(points) / chord(points) END"),
    "spread": (f"points {LINE}", "DOUBLE", f"CASE WHEN size(points) >= 2 THEN hypot({_side('x')}, {_side('y')}) ELSE 0.0D END"),
    "direction": (f"points {LINE}", "DOUBLE", f"CASE WHEN size(points) >= 2 AND chord(points) >= {EPS} THEN atan2({_LAST}.y - {_FIRST}.y, {_LAST}.x - {_FIRST}.x) END"),
    "wrapped": ("angle DOUBLE", "DOUBLE", "pmod(angle + pi(), 2 * pi()) - pi()"),
}

_IN_ORDER = "PARTITION BY episode_key ORDER BY step_id"


def _onset(steps: str, progress: str, window: int, eps: float, min_start: int) -> str:
    """Steps with their onset, by one exchange; see ``sequence.with_onset``."""
    still = f"_pos >= {min_start} AND _ahead - _best < {eps}D AND _later - _best < {2 * eps}D"
    return f"""(SELECT * EXCEPT (_pos, _best, _later, _ahead), min(CASE WHEN {still} THEN _pos END) OVER (PARTITION BY episode_key ORDER BY step_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS onset FROM
      (SELECT *, lead(_best, {window}) OVER ({_IN_ORDER}) AS _ahead FROM
        (SELECT *, CAST(row_number() OVER ({_IN_ORDER}) - 1 AS BIGINT) AS _pos,
                max({progress}) OVER ({_IN_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _best,
                max({progress}) OVER ({_IN_ORDER} ROWS BETWEEN {window} FOLLOWING AND UNBOUNDED FOLLOWING) AS _later
         FROM {steps})))"""


def install(spark: SparkSession, steps: str | None = None, progress: str = "p", window: int = 10, eps: float = 0.02, min_start: int = 20, horizons: tuple[int, ...] = (5, 10, 20), scores: str | None = None) -> list[str]:
    """Makes the functions in the session, in place of those of the same names, and returns their names.

    The scalar ones (SCALARS) always. With the name of a view or table ``steps`` (episode_key, step_id and ``progress``):
    ``plateau_onsets()`` (episode_key, num_steps, max_progress, onset) and ``online_labels()`` (episode_key, step_id, onset, horizon, valid, label). With
    ``scores`` (episode_key, step_id, score, threshold): ``detector_alerts()`` (those, T0, T1, T2). Table functions read the view
    as it is when a query runs. Nulls and empty inputs give what the Python functions give.
    """

    def make(name: str, parameters: str, returns: str, body: str) -> str:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
        return name

    made = [make(name, *function) for name, function in SCALARS.items()]
    if steps is not None:
        types = dict(spark.table(steps).dtypes)
        key, value = types["episode_key"], types[progress]
        found = _onset(f"(SELECT episode_key, step_id, {progress} FROM {steps})", progress, window, eps, min_start)
        made.append(make("plateau_onsets", "", f"TABLE (episode_key {key}, num_steps BIGINT, max_progress {value}, onset BIGINT)",
                         f"SELECT episode_key, count(1) AS num_steps, max({progress}) AS max_progress, min(onset) AS onset FROM {found} GROUP BY episode_key"))
        near = "onset IS NOT NULL AND valid = 1 AND step_id + horizon >= onset"
        rows = f"(SELECT *, explode(array({', '.join(map(str, horizons))})) AS horizon, CAST(onset IS NULL OR step_id < onset AS INT) AS valid FROM {found})"
        made.append(make("online_labels", "", f"TABLE (episode_key {key}, step_id {types['step_id']}, onset BIGINT, horizon INT, valid INT, label INT)",
                         f"SELECT episode_key, step_id, onset, horizon, valid, CAST({near} AS INT) AS label FROM {rows}"))
    if scores is not None:
        types = dict(spark.table(scores).dtypes)
        columns = ", ".join(f"{c} {types[c]}" for c in ("episode_key", "step_id", "score", "threshold"))
        three = f"OVER ({_IN_ORDER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
        made.append(make("detector_alerts", "", f"TABLE ({columns}, T0 BOOLEAN, T1 BOOLEAN, T2 BOOLEAN)",
                         f"SELECT episode_key, step_id, score, threshold, coalesce(score >= threshold, false), coalesce(CASE WHEN count(score) {three} = 3 THEN avg(score) {three} >= threshold END, false), "
                         f"coalesce(score >= threshold AND lag(score >= threshold) OVER ({_IN_ORDER}), false) FROM {scores}"))  # fmt: skip
    return made
