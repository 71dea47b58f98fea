"""Many logistic fits side by side: every set of features, label and mask of rows from one table of arrays.

Each step is a pass whose tasks return sums of a bounded size: medians are found by narrowing the bits of the values,
moments and slopes are added up. Nothing of a row's size leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistride.functions.values import features_only, finite

#: Newton rounds at most; a fit whose largest step is below CLOSE is done.
NEWTON, CLOSE = 50, 1e-9
#: Bits of a value that one pass of the search for medians settles.
BITS = 8
_SIGN = np.uint64(1 << 63)


def _sums(points: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Adds up, by key, the arrays that ``of`` (labels, features, masks of a batch) gives: a row a key leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                y, x, m = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) for c in "yxm")
                for t, v in of(y, x, m == 1).items():
                    total[t] = total[t] + v if t in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["t", "v"])

    def add(table: pa.Table) -> pa.Table:
        rows = table.column("v").to_pylist()
        v = np.sum([np.frombuffer(r) for r in sorted(rows)], axis=0)
        return pa.table({"t": table.column("t").combine_chunks()[:1], "v": pa.array([v.tobytes()], pa.binary())})

    added = points.mapInArrow(run, "t int, v binary").groupBy("t").applyInArrow(add, "t int, v binary")
    return {r.t: np.frombuffer(r.v) for r in added.collect()}  # a row a key


def _ordered(x: np.ndarray) -> np.ndarray:
    """Numbers whose order as unsigned integers is that of the doubles."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _value(key: int) -> float:
    bits = np.array([key], np.uint64)
    return float(np.where(bits & _SIGN, bits ^ _SIGN, ~bits).view(np.float64)[0])


def _medians(points: DataFrame, held: np.ndarray) -> np.ndarray:
    """The exact median of each feature in each mask, of which ``held`` has the numbers of values; 0 where there is none.

    The two middle values are found from their highest bits down: a pass counts the values by their next bits.
    """
    masks, width = held.shape
    ranks = np.stack([(held - 1) // 2, held // 2]).astype(np.int64)
    prefix = np.zeros((2, masks, width), np.uint64)
    for shift in range(64 - BITS, -1, -BITS):

        def count(y, x, m, prefix=prefix, shift=shift):
            known, keys = ~np.isnan(x), _ordered(x)
            digits = ((keys >> np.uint64(shift)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            high = keys >> np.uint64(shift + BITS) if shift + BITS < 64 else np.zeros_like(keys)
            out = {}
            for t in range(masks):
                c = np.zeros((2, width, 1 << BITS))
                for w in range(width):
                    own = m[:, t] & known[:, w]
                    for side in range(2):
                        c[side, w] = np.bincount(digits[own & (high[:, w] == prefix[side, t, w]), w], minlength=1 << BITS)
                out[t] = c.ravel()
            return out

        counts = _sums(points, count)
        for t, c in counts.items():
            upto = np.cumsum(c.reshape(2, width, -1), axis=2)
            for side in range(2):
                for w in range(width):
                    if held[t, w]:
                        digit = int(np.searchsorted(upto[side, w], ranks[side, t, w], side="right"))
                        ranks[side, t, w] -= int(upto[side, w, digit - 1]) if digit else 0
                        prefix[side, t, w] = prefix[side, t, w] << np.uint64(BITS) | np.uint64(digit)
    low, high = (np.array([[_value(int(k)) for k in row] for row in side]).reshape(masks, width) for side in prefix)
    return np.where(held > 0, low + (high - low) / 2, 0.0)


@dataclass
class Fits:
    """Fitted coefficients: of fit number ``number(spec, label, mask)`` the row of each array."""

    features: list[str]
    sets: dict[str, list[int]]
    labels: int
    masks: int
    fill: np.ndarray  # by mask, over all features
    start: dict[str, np.ndarray]  # by spec: labels x masks
    slope: dict[str, np.ndarray]  # labels x masks x features of the set
    gap: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, spec: str, label: int, masks: np.ndarray) -> np.ndarray:
        """Score of each row (NaN: a gap) by the fit of a set and label to the mask given for that row."""
        v = x[:, self.sets[spec]]
        missing = np.isnan(v)
        v = np.where(missing, self.fill[masks][:, self.sets[spec]], v)
        eta = self.start[spec][label, masks] + (self.slope[spec][label, masks] * v).sum(axis=1) + (self.gap[spec][label, masks] * missing).sum(axis=1)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-eta))


def vector(features: list[str]) -> Column:
    """The features as doubles; null where they aren't finite numbers."""
    return F.array(*[finite(F.col(c).cast("double")) for c in features])


def logistic(rows: DataFrame, sets: dict[str, list[str]], labels: list[str], masks: list[Column], balanced: bool, indicators: bool) -> Fits:
    """Logistic fits of each label to the rows of each mask by each set of features.

    Gaps (null, NaN, infinite) are filled with the exact median of the mask's rows (0 without any); ``indicators`` adds a
    column for each feature with gaps there. Columns are scaled by their population deviation (1 if that is 0), and
    coefficients but the intercept are penalised by half their squares; ``balanced`` gives both classes the same weight. A fit
    to one class gives 1 or 0, a fit to no rows 0. A round of Newton's method is one pass for all fits that aren't done.
    """
    features = sorted({f for s in sets.values() for f in features_only(s)})
    at_of = {f: i for i, f in enumerate(features)}
    index = {name: [at_of[f] for f in s] for name, s in sets.items()}
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism  # few bytes a row, but much work: parts by size would leave most cores idle
    points = rows.select(F.array(*[F.col(c).cast("double") for c in labels]).alias("y"), vector(features).alias("x"), F.array(*masks).alias("m")).repartition(tasks).persist()
    width, masks, labels = len(features), len(masks), len(labels)  # columns stay on the driver

    def first(y, x, m):
        known = ~np.isnan(x)
        z = np.where(known, x, 0.0)
        return {t: np.concatenate([known[m[:, t]].sum(axis=0), z[m[:, t]].sum(axis=0), (y[m[:, t]] == 0).sum(axis=0), (y[m[:, t]] == 1).sum(axis=0)]).astype(float) for t in range(masks)}

    found = _sums(points, first)
    none = np.zeros(2 * width + 2 * labels)
    totals = np.array([found.get(t, none) for t in range(masks)]).reshape(masks, -1)
    held, counts = totals[:, :width], np.stack([totals[:, 2 * width : 2 * width + labels], totals[:, 2 * width + labels :]], axis=2)  # masks x labels x classes
    fill = _medians(points, held) if width else np.zeros((masks, 0))
    n = np.maximum(counts.sum(axis=2).max(axis=1), 0)[:, None] if labels else np.zeros((masks, 1))
    gaps = n - held
    mean = (totals[:, width : 2 * width] + gaps * fill) / np.maximum(n, 1)

    def second(y, x, m):
        return {t: ((np.where(np.isnan(x[m[:, t]]), fill[t], x[m[:, t]]) - mean[t]) ** 2).sum(axis=0) for t in range(masks)}

    spread = _sums(points, second)
    sd = np.sqrt(np.array([spread.get(t, np.zeros(width)) for t in range(masks)]).reshape(masks, width) / np.maximum(n, 1))
    share = gaps / np.maximum(n, 1)
    scale = np.where(sd > 0, sd, 1.0)
    if indicators:  # a feature without gaps in training has no indicator
        gap_scale = np.where(share > 0, np.maximum(np.sqrt(share * (1 - share)), 1e-300), np.inf)
        gap_scale[share == 1] = 1.0
    keys = [(s, i, t) for s in sets for i in range(labels) for t in range(masks)]
    live = {k: j for j, k in enumerate(keys) if counts[k[2], k[1]].min() > 0}
    columns = {s: len(ix) * (2 if indicators else 1) for s, ix in index.items()}
    beta = {k: np.zeros(1 + columns[k[0]]) for k in keys}
    at, loss, step = {k: b.copy() for k, b in beta.items()}, dict.fromkeys(keys, np.inf), {k: b.copy() for k, b in beta.items()}

    def weights(i: int, t: int) -> np.ndarray:
        return counts[t, i].sum() / (2 * np.maximum(counts[t, i], 1)) if balanced else np.ones(2)

    for _ in range(NEWTON):
        if not live:
            break

        def slopes(y, x, m, live=live, at=at):
            out = {}
            for t in {k[2] for k in live}:  # a mask's rows are scaled once, for all sets and labels; a column lies in one piece
                own = m[:, t]
                v, z = y[own].T, np.ascontiguousarray(x[own].T)
                gap = np.isnan(z)
                z = [np.ones((1, z.shape[1])), (np.where(gap, fill[t, :, None], z) - mean[t, :, None]) / scale[t, :, None]]
                every = np.concatenate([*z, (gap - share[t, :, None]) / gap_scale[t, :, None]] if indicators else z)
                for s, ix in index.items():
                    z = every[[0, *(1 + w for w in ix), *(1 + width + w for w in ix if indicators)]]
                    for i in range(labels):
                        if (s, i, t) in live:
                            w, eta = weights(i, t), at[s, i, t] @ z
                            c, e = np.where(v[i] == 1, w[1], w[0]), np.exp(-np.abs(eta))
                            p = np.where(eta >= 0, 1.0, e) / (1 + e)
                            bend = (z * (c * p * (1 - p))) @ z.T
                            out[live[s, i, t]] = np.concatenate([[(c * (np.maximum(eta, 0) + np.log1p(e) - v[i] * eta)).sum()], z @ (c * (p - v[i])), bend.ravel()])
            return out

        sums, going = _sums(points, slopes), {}
        for k, j in live.items():
            d = len(beta[k])
            value, g, h = sums[j][0], sums[j][1 : 1 + d], sums[j][1 + d :].reshape(d, d)
            keep = np.r_[0.0, np.ones(d - 1)]
            value += 0.5 * (keep * at[k] ** 2).sum()
            if value > loss[k] + 1e-9 * abs(loss[k]):  # too far: half the way
                step[k] = step[k] / 2
            else:
                beta[k], loss[k] = at[k], value
                step[k] = -np.linalg.lstsq(h + np.diag(keep), g + keep * beta[k], rcond=None)[0]
            at[k] = beta[k] + step[k]
            if np.abs(step[k]).max() > CLOSE:
                going[k] = j
            else:
                beta[k] = at[k]
        live = going
    points.unpersist()
    start, slope, gap_of = {}, {}, {}
    for s, ix in index.items():
        w = len(ix)
        start[s], slope[s], gap_of[s] = np.zeros((labels, masks)), np.zeros((labels, masks, w)), np.zeros((labels, masks, w))
        for i in range(labels):
            for t in range(masks):
                b = beta[s, i, t]
                if counts[t, i].min() == 0:
                    start[s][i, t] = np.inf if counts[t, i, 1] else -np.inf
                    continue
                slope[s][i, t] = b[1 : 1 + w] / scale[t, ix]
                start[s][i, t] = b[0] - (slope[s][i, t] * mean[t, ix]).sum()
                if indicators:
                    gap_of[s][i, t] = b[1 + w :] / gap_scale[t, ix]
                    start[s][i, t] -= (gap_of[s][i, t] * share[t, ix]).sum()
    return Fits(features, index, labels, masks, fill, start, slope, gap_of)
