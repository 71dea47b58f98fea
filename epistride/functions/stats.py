"""Rank statistics and intervals from histograms of scores: exact with ties; sums over an order go range by range."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epistride.functions.draws import SPAN, TILE, WIDE, multiplicities, packed, resampled_means, weighted


def histogram(rows: DataFrame, score: str, positive: Column, by: list[str]) -> DataFrame:
    """Positives and negatives of each distinct score in each group; null scores are left out."""
    return rows.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


#: Ranges of an order at most (as many as shuffle partitions below), and rows of the sample that their edges come from.
RANGES, EDGES = 256, 4096


def _range_of(rows: DataFrame, at: str, most: int = RANGES) -> Column:
    """The range of an order in which ``at`` lies: the number of edges, from a bounded sample of distinct values, that it reaches."""
    key = F.xxhash64(at)
    sample = sorted(r[0] for r in rows.select(at).where(F.col(at).isNotNull()).distinct().orderBy(key, at).limit(EDGES).collect())
    ranges = min(most, RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = sorted(set(sample[:: -(-len(sample) // ranges)] if sample else []))

    def reached(low: int, high: int) -> Column:  # between so many edges: halved, so that a row meets few of them
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(at) >= edges[middle], reached(middle + 1, high)).otherwise(reached(low, middle))

    return reached(0, len(edges))


def least_from(rows: DataFrame, by: list[str], at: str, value: str, name: str, like: DataFrame | None = None) -> DataFrame:
    """Adds the least ``value`` over the rows of the group with the same or a larger ``at``, which is distinct within a group.

    Each range of the order is a window of its own, and gets the least value of the ranges after it. ``like`` as in ``sums_before``.
    """
    rows = rows.withColumn("_part", _range_of(rows if like is None else like, at))
    after = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)  # at most RANGES rows a group
    later = rows.groupBy(*by, "_part").agg(F.min(value).alias("_m")).withColumn("_later", F.min("_m").over(after))
    later = later.select(*[F.col(c).alias(f"_t_{c}") for c in by], F.col("_part").alias("_t_part"), "_later")
    same = F.col("_part") == F.col("_t_part")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    own = F.min(value).over(Window.partitionBy(*by, "_part").orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0))  # a frame that ends with the partition is made anew for each row
    out = rows.withColumn("_own", own).join(later, same)
    return out.select(*[c for c in rows.columns if c != "_part"], F.least("_own", "_later").alias(name))


def sums_before(rows: DataFrame, by: list[str], at: str, values: list[str], like: DataFrame | None = None) -> DataFrame:
    """Adds for each of ``values`` its sum over the rows of the group with a smaller ``at`` (before_*), and over the group (all_*).

    ``at`` is distinct within a group and may be of any type with an order (null first). Edges from a bounded sample,
    of ``like`` where it has the same values and is cheaper to read, cut the order into ranges; each range is a window of its own and gets the total of the ranges before it, so that no task
    holds a group, however large.
    """
    part = _range_of(rows if like is None else like, at)
    rows = rows.withColumn("_part", part)
    totals = rows.groupBy(*by, "_part").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    every = Window.partitionBy(*(by or [F.lit(1)]))  # at most RANGES rows a group
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"_b_{v}": F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)) for v in values} | {f"all_{v}": F.sum(f"_s_{v}").over(every) for v in values}
    totals = totals.withColumns(sums).select(*[F.col(c).alias(f"_t_{c}") for c in by], F.col("_part").alias("_t_part"), *sums)
    same = F.col("_part") == F.col("_t_part")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    own = Window.partitionBy(*by, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"_o_{v}": F.coalesce(F.sum(v).over(own), F.lit(0)) for v in values}).join(totals, same)
    return out.select(*[c for c in rows.columns if c != "_part"], *[(F.col(f"_o_{v}") + F.col(f"_b_{v}")).alias(f"before_{v}") for v in values], *[f"all_{v}" for v in values])


def numbered(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """Adds i, the place of each row in its group by the distinct ``key`` (from 0), and n, the rows of the group."""
    out = sums_before(rows.withColumn("_one", F.lit(1).cast("long")), by, key, ["_one"])
    return out.select(*rows.columns, F.col("before__one").alias("i"), F.col("all__one").alias("n"))


def rank_metrics(rows: DataFrame, score: str, positive: Column, by: list[str]) -> DataFrame:
    """Per group n_pos, n_neg, auroc (ties count half), average_precision (tied scores are one threshold), u and z of Mann-Whitney.

    z has the corrections for ties and continuity. Metrics are null where a class is missing.
    """
    h = sums_before(histogram(rows, score, positive, by), by, "s", ["pos", "neg"])
    tp, k, t = F.col("all_pos") - F.col("before_pos"), F.col("all_pos") + F.col("all_neg") - F.col("before_pos") - F.col("before_neg"), F.col("pos") + F.col("neg")
    out = h.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("u"),
        F.sum(F.col("pos") * tp / k).alias("ap"), F.sum(t.cast("double") * (t * t - 1)).alias("ties"),
    )
    p, q, n = F.col("n_pos"), F.col("n_neg"), F.col("n_pos") + F.col("n_neg")
    both = (p > 0) & (q > 0)
    sigma = F.sqrt(p * q / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(F.col("u") - p * q / 2.0) - 0.5, F.lit(0.0)) / sigma
    return out.select(*by, "n_pos", "n_neg", F.when(both, F.col("u") / (p * q)).alias("auroc"), F.when(p > 0, F.col("ap") / p).alias("average_precision"), F.when(both, F.col("u")).alias("u"), F.when(both & (sigma > 0), z).alias("z"))


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, off by less than 1e-14: one less a series of positive terms; 0 beyond 6."""
    given, x = x, F.least(F.abs(x), F.lit(6.0))  # which skips nulls
    start = F.struct(x.alias("term"), x.alias("sum"))
    more = lambda a, n: F.struct((a.term * 2 * x * x / (2 * n + 1)).alias("term"), (a.sum + a.term * 2 * x * x / (2 * n + 1)).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(140)), start, more, lambda a: a.sum)
    return F.when(given.isNotNull(), F.when(x < 6.0, 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * total).otherwise(F.lit(0.0)))


def two_sided_p(z: Column) -> Column:
    """The probability that a normal variable is at least as far from 0 as ``z``."""
    return erfc(F.abs(z) / math.sqrt(2))


#: Samples with an exact p: the smaller has at most the first, the larger at most the second number of values.
U_SMALL, U_LARGE = 8, 128


def u_distribution(spark: SparkSession, small: int = U_SMALL, large: int = U_LARGE) -> DataFrame:
    """n1, n2, u, orders and tail: in how many orders of two samples without ties U is ``u``, and the share in which it is at least that.

    For n1 up to ``small`` and n1 <= n2 <= ``large``; by the recurrence on whether the largest value is of the first sample or the second.
    """
    counts = {(0, b): np.ones(1) for b in range(large + 1)}
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    for n1 in range(1, small + 1):
        counts[n1, 0] = np.ones(1)
        for n2 in range(1, large + 1):
            c = np.zeros(n1 * n2 + 1)
            c[n2:] += counts[n1 - 1, n2]
            c[: len(counts[n1, n2 - 1])] += counts[n1, n2 - 1]
            counts[n1, n2] = c
            if n1 <= n2:
                tail = np.cumsum(c[::-1])[::-1] / c.sum()
                for column, x in zip(columns, (np.full(len(c), n1), np.full(len(c), n2), np.arange(len(c)), c, tail), strict=True):
                    column.append(x)
    n1, n2, u, c, tail = (np.concatenate(x) for x in columns)
    whole = lambda x: pa.array(x.astype(np.int64))
    return spark.createDataFrame(pa.table({"n1": whole(n1), "n2": whole(n2), "u": whole(u), "orders": pa.array(c), "tail": pa.array(tail)}))


def mann_whitney(rows: DataFrame, score: str, positive: Column, by: list[str]) -> DataFrame:
    """The columns of ``rank_metrics`` with p, two-sided, and exact (whether it is from the distribution of U).

    It is where a sample has at most U_SMALL values, neither more than U_LARGE, and no scores are tied; else the normal
    approximation with corrections for ties and continuity is taken. p is null where a class is missing.
    """
    h = histogram(rows, score, positive, by)
    tied = h.groupBy(*by).agg(F.bool_or(F.col("pos") + F.col("neg") > 1).alias("tied"))
    ranked = rank_metrics(rows, score, positive, by)
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    ranked = ranked.join(tied.select(*[F.col(c).alias(f"_{c}") for c in by], "tied"), same, "left").drop(*[f"_{c}" for c in by])
    low, high = F.least("n_pos", "n_neg"), F.greatest("n_pos", "n_neg")
    far = F.greatest(F.col("u"), F.col("n_pos") * F.col("n_neg") - F.col("u"))
    wanted = ~F.col("tied") & (low <= U_SMALL) & (high <= U_LARGE)
    table = u_distribution(rows.sparkSession).select(F.col("n1").alias("_n1"), F.col("n2").alias("_n2"), F.col("u").alias("_u"), "tail")
    found = ranked.join(table, wanted & (low == F.col("_n1")) & (high == F.col("_n2")) & (far.cast("long") == F.col("_u")), "left")
    p = F.coalesce(F.when(F.col("tail").isNotNull(), F.least(2 * F.col("tail"), F.lit(1.0))), F.when(F.col("u").isNotNull(), F.coalesce(two_sided_p(F.col("z")), F.lit(1.0))))
    return found.withColumns({"p": p, "exact": F.col("tail").isNotNull()}).drop("_n1", "_n2", "_u", "tail", "tied")


def cohen_d(x: Column, positive: Column, on_zero: float | None = 0.0) -> Column:
    """(mean of positives - mean of others) / pooled deviation; ``on_zero`` where that is 0, null with fewer than two of a class."""
    a, b = F.when(positive, x), F.when(~positive, x)
    n, m = F.count(a), F.count(b)
    pooled = F.sqrt(((n - 1) * F.var_samp(a) + (m - 1) * F.var_samp(b)) / (n + m - 2))
    return F.when((n >= 2) & (m >= 2), F.when(pooled > 0, (F.avg(a) - F.avg(b)) / pooled).otherwise(F.lit(on_zero).cast("double")))


def draw(n: Column, *parts) -> Column:
    """A number below n that depends on the parts alone; the same in any engine that has md5."""
    text = F.concat_ws("-", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n


def bootstrap_difference(rows: DataFrame, x: str, group: str, draws: int, seed: int = 42) -> DataFrame:
    """draw and diff: the mean of x over resampled rows with ``group`` minus that without, for each draw.

    ``rows`` has one row per unit: group, i (0 to n - 1 in its group) and n (units of the group).
    """
    got = resampled_means(rows, x, [group], F.lit(str(seed)), draws)
    mean = lambda where: F.max(F.when(where, F.col("mean")))  # noqa: E731  one row each
    return got.groupBy("draw").agg((mean(F.col(group)) - mean(~F.col(group))).alias("diff"))


def bootstrap_mean(rows: DataFrame, x: str, by: list[str], draws: int, seed: int = 43) -> DataFrame:
    """draw and mean of x over resampled rows of each group, for each draw; ``rows`` as in ``bootstrap_difference``, groups without nulls."""
    return resampled_means(rows, x, by, F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in by]), draws)


def cluster_bootstrap(rows: DataFrame, units: DataFrame, key: str, score: str, label: str, draws: int, seed: int = 7, by: list[str] | None = None) -> DataFrame:
    """Group, draw, auroc and ap over resampled units (one row per ``key``), for each draw that holds both classes.

    Draws give each unit a multiplicity, the same in all groups, and histograms of scores are weighted by it. Tied scores count
    half in auroc and are one threshold in ap; null scores are left out. Ranges of scores and blocks of draws are tiles that go side
    by side, first for the sums of each range, then for the metrics; a tile holds a byte for each unit and draw of it. Multiplicities stay cached.
    """
    by = by or []
    spark = rows.sparkSession
    n = units.count()
    each = histogram(rows, score, F.col(label) == 1, [*by, key]).join(numbered(units, [], key).select(key, "i"), key).select(*by, "s", "i", "pos", "neg").persist()
    ranges = max(1, -(-each.count() // SPAN))
    spans = packed(each.withColumn("_t", F.struct(*by, (_range_of(each, "s", ranges) if ranges > 1 else F.lit(0)).alias("_part"))), "_t").persist()
    times = multiplicities(spark, n, seed, draws, max(1, min(WIDE, TILE // max(n, 1)))).persist()
    keys = F.broadcast(spans.select("_t"))  # a row for each group and range
    none = weighted(spans, times.crossJoin(keys), "_t", False)
    group = Window.partitionBy(*[F.col(f"_t.{c}") for c in by], "draw")
    under = group.orderBy("_t._part").rowsBetween(Window.unboundedPreceding, -1)
    sums = none.select("_t", "draw", *[F.coalesce(F.sum(c).over(under), F.lit(0.0)).alias(f"below_{c}") for c in "pn"], *[F.sum(c).over(group).alias(f"all_{c}") for c in "pn"])
    out = weighted(spans, times.join(sums, "draw"), "_t", True)
    out = out.groupBy(*[F.col(f"_t.{c}").alias(c) for c in by], "draw").agg(*[F.sum(c).alias(c) for c in "pnua"])
    return out.where("p > 0 AND n > 0").select(*by, "draw", (F.col("u") / (F.col("p") * F.col("n"))).alias("auroc"), (F.col("a") / F.col("p")).alias("ap"))


def adjusted_rand(rows: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """The adjusted Rand index of two labellings in each group, from their contingency counts; no row for an empty table."""
    by = by or []
    pairs = lambda n: n * (n - 1) / 2
    cells = rows.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    on = [*by, "one"]
    side = lambda c, name: cells.groupBy(*on, c).agg(F.sum("n").alias("n")).groupBy(*on).agg(F.sum(pairs(F.col("n"))).alias(name))
    both = cells.groupBy(*on).agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    sums = both.join(side(a, "l"), on).join(side(b, "r"), on)  # one row a group each
    expected = F.when(F.col("n") > 1, F.col("l") * F.col("r") / pairs(F.col("n"))).otherwise(0.0)
    best = (F.col("l") + F.col("r")) / 2
    return sums.select(*by, F.when(best == expected, 1.0).otherwise((F.col("s") - expected) / F.nullif(best - expected, F.lit(0.0))).alias("ari"))
