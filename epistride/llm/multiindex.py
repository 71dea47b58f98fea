"""Operator 4: near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, form a grid of cells. A vector lives in the cell of its nearest
codewords and visits the cells nearest to it, in the order of the multi-sequence algorithm, until the target recall for
pairs at the threshold is reached (calibrated on a bounded sample; nearer pairs are found more surely). In each cell the
visitors are compared with those who live there, in blocks, in double precision. A pair counts once, however often it
meets; tasks give numbers of links and as few edges as connect what they have linked, never all pairs.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistride.llm.common import Scratch, prepare, write_table
from epistride.llm.components import components
from epistride.llm.vectors import matrix, unit, usable, width_of

#: Vectors that the codebooks and the visits are fitted on (at least, and for each codeword), codewords of a half at most (a
#: million cells, which 800 million vectors fill), vectors that live in a cell on average.
SAMPLE, PER_WORD = 4096, 16
CODEWORDS = 1024
CELL = 800
#: Vectors of a block in a task: those who live in a cell, and its visitors.
LIVING, VISITING = 1024, 4096


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from an even spread of the points."""
    unique = np.unique(points, axis=0)
    words = unique[np.linspace(0, len(unique) - 1, min(k, len(unique))).astype(int)]
    for _ in range(rounds):
        near = squares(points, words).argmin(axis=1)
        n = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, points)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T, 0)


def multi_sequence(one: np.ndarray, two: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The first n pairs (i, j) in ascending order of one[i] + two[j]."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    queue, seen, out = [(float(one[a[0]] + two[b[0]]), 0, 0)], {(0, 0)}, []
    while queue and len(out) < n:
        _, i, j = heapq.heappop(queue)
        out.append((int(a[i]), int(b[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(queue, (float(one[a[x]] + two[b[y]]), x, y))
    return out


class Grid:
    """Both codebooks and the number of cells that a vector visits."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float, seed: int = 7):
        self.half = max(1, sample.shape[1] // 2)
        self.one, self.two = codebook(sample[:, : self.half], k), codebook(sample[:, self.half :], k)
        self.cells = len(self.one) * len(self.two)
        rng = np.random.default_rng(seed)
        x = sample[rng.integers(0, len(sample), min(1000, 4 * len(sample)))]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        y = threshold * x + np.sqrt(1 - threshold**2) * away
        self.visits = self.cells
        # Neighbours at the threshold itself: a pair meets if either visits the other's cell.
        ranks = np.minimum(self._rank(x, self.cell(y)), self._rank(y, self.cell(x)))
        self.visits = int(min(self.cells, np.quantile(ranks, recall, method="higher") + 1))

    def _parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squares(x[:, : self.half], self.one), squares(x[:, self.half :], self.two)

    def _rank(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells are nearer to each vector than ``cell``."""
        a, b = self._parts(x)
        own = a[np.arange(len(x)), cell // len(self.two)] + b[np.arange(len(x)), cell % len(self.two)]
        return np.array([np.searchsorted(np.sort(b[i]), own[i] - a[i], side="left").sum() for i in range(len(x))])

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self._parts(x)
        return a.argmin(axis=1) * len(self.two) + b.argmin(axis=1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """Cells that each vector visits, nearest first; its own comes first."""
        a, b = self._parts(x)
        out = np.empty((len(x), self.visits), np.int32)
        for i in range(len(x)):
            out[i] = [p * len(self.two) + q for p, q in multi_sequence(a[i], b[i], self.visits)]
        return out


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n positions the smallest one reachable over the links a - b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float, cells: int, width: int):
    """Group function of a block of a cell: number of links and the smallest linked id of each vector that has any."""

    def run(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        x = matrix(table.column("v"), width)
        side, ids, n, home = (table.column(c).to_numpy() for c in ("side", "id", "n", "home"))
        visiting, living = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        visits = table.column("visits").combine_chunks()
        per = np.diff(visits.offsets.to_numpy())
        # Where those who live here go: sorted keys of (row, cell).
        keys = np.sort(np.repeat(np.arange(len(ids)), per) * cells + visits.flatten().to_numpy())
        x = unit(x)
        every, at = np.unique(ids, return_inverse=True)
        links, left, right = np.zeros(len(every), np.int64), [], []
        for i in range(0, len(visiting), 512):
            some = visiting[i : i + 512]
            p, q = np.nonzero(x[some] @ x[living].T >= threshold)
            p, q = some[p], living[q]
            key = q * cells + home[p]
            back = np.searchsorted(keys, key)
            back = (back < len(keys)) & (keys[np.minimum(back, len(keys) - 1)] == key)
            keep = np.where(home[p] == cell, ids[p] < ids[q], ~back | (home[p] > cell))
            p, q = p[keep], q[keep]
            np.add.at(links, at[p], n[q])
            np.add.at(links, at[q], n[p])
            local, inverse = np.unique(np.concatenate([at[p], at[q]]), return_inverse=True)
            roots = local[smallest_reachable(len(local), inverse[: len(p)], inverse[len(p) :])]
            left.append(local[roots != local])
            right.append(roots[roots != local])
        root = smallest_reachable(len(every), np.concatenate([np.zeros(0, int), *left]), np.concatenate([np.zeros(0, int), *right]))
        some = np.flatnonzero(links)
        return pa.table({"id": every[some], "links": links[some], "root": every[root[some]]})

    return run


def link_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.995, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, n_links, component_id and kept of every row: vectors of a cosine from ``threshold`` on are linked.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, as do rows with a null
    id; shorter vectors count as filled up with zeros; equal vectors are one class and are never compared with each other;
    repeated rows count as further vectors, and rows that share an id but not their vector link each by its own; other columns are left out; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    some = F.exists(F.col(vector_column), lambda x: x != 0)
    fits = usable(vector_column) & F.coalesce(some, F.lit(False)) & F.col(id_column).isNotNull()
    v = F.col(vector_column)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"), fits.alias("fits"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"))
    with Scratch(spark, "multiindex") as made:
        # Classes are of equal vectors, not of equal hashes; hashes only name them. Written, so that a class of many copies can be split.
        # Links are between numbers of classes, so that an id with several vectors keeps the links of each.
        classes = rows.where("fits").groupBy("h1", "h2", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
        classes = made.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
        reps = classes.select("id", "n", "v")
        width, count = width_of(reps, "v"), reps.count()
        named = classes.select("id", "h1", "h2", "n", "rep")
        if count:
            k = int(min(CODEWORDS, max(1, round((count / CELL) ** 0.5))))
            sample = classes.orderBy(F.xxhash64("rep", "h1"), "h1", "h2").limit(max(SAMPLE, PER_WORD * k)).select("v").toArrow()  # at most PER_WORD * CODEWORDS rows
            grid = Grid(unit(matrix(sample.column("v"), width)), k, threshold, recall)
            found = made.write(_found(made, reps, grid, threshold, width), "found")
            links = found.groupBy("id").agg(F.sum("links").alias("links"))
            parts = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
            linked = made.write(parts.join(classes.select("id", "rep"), "id"), "parts")
            lowest = linked.groupBy("component").agg(F.min("rep").alias("low"))
            linked = linked.join(lowest, "component").select("id", "low")
            named = named.join(links, "id", "left").join(linked, "id", "left")
        else:
            named = named.withColumn("links", F.lit(0)).withColumn("low", F.col("rep"))
        named = named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("low", "rep").alias("component_id"))
        out = rows.select("id", "fits", "h1", "h2").join(made.write(named, "named"), ["h1", "h2"], "left")
        links = F.when(F.col("fits"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links")
        out = out.select("id", links, F.when(F.col("fits"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
        out = write_table(out, "linked")
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_column)


def _found(made: Scratch, reps: DataFrame, grid: Grid, threshold: float, width: int) -> DataFrame:
    kind = dict(reps.dtypes)["v"]

    def place(batches):
        for batch in batches:
            x = matrix(batch.column("v"), width)
            x = unit(x)
            visits = grid.visited(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * grid.visits), pa.array(visits.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n", "v")), pa.array(grid.cell(x).astype(np.int32)), lists], ["id", "n", "v", "home", "visits"])

    placed = made.write(reps.mapInArrow(place, f"id long, n long, v {kind}, home int, visits array<int>"), "placed")
    living = placed.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / LIVING).alias("lives")).withColumnRenamed("home", "cell")
    visiting = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITING).alias("comes"))
    sizes = F.broadcast(living.join(visiting, "cell"))  # at most CODEWORDS ** 2 rows; a cell where none lives takes no visitors
    block = lambda n: F.expr(f"pmod(xxhash64(id), {n})")
    here = placed.withColumn("cell", F.col("home")).join(sizes, "cell")
    here = here.select("cell", block("lives").alias("i"), F.explode(F.expr("sequence(0L, comes - 1)")).alias("j"), F.lit(0).alias("side"), "id", "n", "v", "home", "visits")
    there = placed.withColumn("cell", F.explode("visits")).join(sizes, "cell")
    none = F.array().cast("array<int>").alias("visits")
    there = there.select("cell", F.explode(F.expr("sequence(0L, lives - 1)")).alias("i"), block("comes").alias("j"), F.lit(1).alias("side"), "id", "n", "v", "home", none)
    return here.union(there).groupBy("cell", "i", "j").applyInArrow(_compare(threshold, grid.cells, width), "id long, links long, root long")
