"""Operator 2: exact top-k by inner product, with best-first search in paged M-trees.

Vectors become integers; one more component makes all of one length, so that the largest inner product is the smallest
distance. Pivots from a bounded sample deal vectors to pages of bounded size, each with its own M-tree: nodes with
covering radii, entries with their distance to the parent. A query is first answered in a page of its nearest pivot; its
k-th distance then rules out all pages whose pivot is too far beyond their covering radius, and inside a page all
subtrees and entries that the triangle inequality rules out from stored distances alone.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from epistride.llm.common import Scratch, prepare, write_table
from epistride.llm.hashing import ranges
from epistride.llm.vectors import matrix, usable

#: Pivots at most (a bounded sample of the vectors; a pivot has several pages beyond), vectors of a page on average, entries
#: of a leaf and children of a node.
PIVOTS = 1024
PAGE = 8192
LEAF = 512
FAN = 32
#: Queries that one task answers in one page.
QUERIES = 512
#: Sums of products whose terms add up to less than this in size are exact in doubles.
EXACT = 1 << 52
#: Squared lengths beyond the first need smaller units, in which components are below the second.
LARGEST, COMPONENT = 2.0**960, 450
#: What a product of doubles can lose by vanishing.
TINY = 2.0**-1070
#: The largest and smallest long: scores beyond are given as these.
MOST, LEAST = (1 << 63) - 1, -(1 << 63)


def rounding(width: int) -> float:
    """Error of a double product of ``width`` components, relative to the product of both lengths."""
    return 2 * width * float(np.finfo(np.float64).eps)


def slack_of(width: int, square: float) -> float:
    """Slack of distances against rounding: squared ones are off by a share of the largest squared length."""
    return (16 * rounding(width + 1)) ** 0.5 * (1 + square**0.5)


class Tree:
    """An M-tree over integer vectors with their lifted component. Integers are held as doubles, which each is exactly.

    With a ``shift`` they are held divided by two to its power, so that squares fit; scores are those of the integers.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, shift: int = 0):
        self.ids, self.vectors, self.top, self.shift = ids, vectors.astype(np.float64), top, shift
        self.points = lifted(self.vectors, top)
        #: Per node: entries (rows of a leaf, or children), their distance to the node's pivot, radii of children, whether a leaf.
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
        self.pivots: list[np.ndarray] = []
        self.root, self.radius = -1, 0.0
        #: Vectors and nodes whose distance a search has computed, to measure what bounds spare.
        self.computed = 0
        if len(ids):
            self.root, _, self.radius = self._build(np.arange(len(ids)), self.points.mean(axis=0))
            # The rows of a leaf lie next to each other, by their distance to its pivot.
            leaves = [k for k, (_, _, radii) in enumerate(self.nodes) if radii is None]
            order = np.concatenate([self.nodes[k][0] for k in leaves])
            begin = 0
            for k in leaves:
                rows, at, _ = self.nodes[k]
                self.nodes[k] = (np.arange(begin, begin + len(rows)), at, None)
                begin += len(rows)
            self.ids, self.vectors, self.points = self.ids[order], self.vectors[order], self.points[order]
        self.lengths = lengths_of(self.vectors)

    def _distances(self, rows: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - pivot) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray, pivot: np.ndarray) -> tuple[int, np.ndarray, float]:
        d = self._distances(rows, pivot)
        if len(rows) <= LEAF:
            order = np.argsort(d)
            self.nodes.append((rows[order], d[order], None))
        else:
            fan = max(2, min(FAN, -(-3 * len(rows) // (2 * LEAF))))
            chosen = self.points[rows[np.linspace(0, len(rows) - 1, fan).astype(int)]]
            own = self.points[rows]
            near = ((own**2).sum(axis=1)[:, None] + (chosen**2).sum(axis=1)[None] - 2 * own @ chosen.T).argmin(axis=1)
            if np.bincount(near, minlength=fan).max() > 0.9 * len(rows):  # copies: any split will do
                near = np.arange(len(rows)) % fan
            parts = [rows[near == k] for k in range(fan)]
            made = [self._build(p, self.points[p].mean(axis=0)) for p in parts if len(p)]
            at = np.array([np.sqrt(((c - pivot) ** 2).sum()) for _, c, _ in made])
            self.nodes.append((np.array([n for n, _, _ in made]), at, np.array([r for _, _, r in made])))
        self.pivots.append(pivot)
        return len(self.nodes) - 1, pivot, float(d.max())

    def search(self, query: np.ndarray, own: int, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (score, -id) among ``best`` and this tree's vectors but those with the id ``own``."""
        if self.root < 0:
            return best
        heapq.heapify(best)
        whole = query.astype(np.float64)
        q = np.append(whole, 0.0)
        length = float(lengths_of(whole[None])[0])
        base = length**2 + self.top
        square = 1 << 2 * self.shift  # integer scores to one of the tree's
        slack = slack_of(len(whole), base)

        def reach() -> float:
            return np.sqrt(max(base - 2 * (best[0][0] / square), 0)) + slack if len(best) >= k else np.inf

        first = float(np.sqrt(((self.pivots[self.root] - q) ** 2).sum()))
        queue = [(max(0.0, first - self.radius), self.root, first)]
        limit = reach()
        while queue:
            bound, node, d = heapq.heappop(queue)
            if bound > limit:
                break
            entries, at, radii = self.nodes[node]
            if radii is None:
                lo, hi = np.searchsorted(at, (d - limit, d + limit)) if limit < np.inf else (0, len(at))
                rows = slice(int(entries[0]) + int(lo), int(entries[0]) + min(int(hi) + 1, len(at)))
                scores = self.vectors[rows] @ whole
                self.computed += len(scores)
                ids = self.ids[rows]
                sizes = self.lengths[rows] * length
                error = sizes * rounding(len(whole))
                # Products of small components may vanish in the units of large ones.
                error = error + len(whole) * TINY if self.shift else np.where(sizes < EXACT, 0.0, error)
                if len(best) >= k:
                    some = np.flatnonzero((scores + error >= best[0][0] / square) & (ids != own))
                else:
                    some = np.flatnonzero(ids != own)
                if error[some].any():
                    exact = exact_scores(self.vectors[int(rows.start) + some], whole, sizes[some], self.shift)
                    offers = heapq.nlargest(k, zip(exact, (-ids[some]).tolist(), strict=True))
                else:
                    if len(some) > k:
                        some = some[np.lexsort((ids[some], -scores[some]))[:k]]
                    offers = [(int(scores[j]), -int(ids[j])) for j in some.tolist()]
                for found in offers:
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
                limit = reach()
            else:
                keep = np.flatnonzero(np.abs(d - at) - radii <= limit)
                self.computed += len(keep)
                for j in keep.tolist():
                    child = int(entries[j])
                    dc = float(np.sqrt(((self.pivots[child] - q) ** 2).sum()))
                    low = max(0.0, dc - radii[j])
                    if low <= limit:
                        heapq.heappush(queue, (low, child, dc))
        return best

    def dump(self) -> bytes:
        """Pages of nodes as one array file."""
        import io

        out = io.BytesIO()
        sizes = np.array([len(e) for e, _, _ in self.nodes])
        radii = [r if r is not None else np.full(len(e), -1.0) for e, _, r in self.nodes]
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
        np.savez_compressed(out, ids=self.ids, vectors=self.vectors.astype(np.int32) if fits_int(self.top) else self.vectors, sizes=sizes, entries=cat([e for e, _, _ in self.nodes]).astype(np.int32), at=cat([a for _, a, _ in self.nodes]), radii=cat(radii), pivots=np.array(self.pivots), head=np.array([self.root, self.radius, self.top, self.shift]))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        import io

        f = np.load(io.BytesIO(data))
        self = cls.__new__(cls)
        self.computed = 0
        self.ids, self.vectors = f["ids"], f["vectors"].astype(np.float64)
        self.lengths = lengths_of(self.vectors)
        self.root, self.radius, self.top, self.shift = int(f["head"][0]), float(f["head"][1]), float(f["head"][2]), int(f["head"][3])
        ends = np.cumsum(f["sizes"])
        entries, at, radii, self.pivots = f["entries"], f["at"], f["radii"], list(f["pivots"])
        self.nodes = []
        for a, b in zip((ends - f["sizes"]).tolist(), ends.tolist(), strict=True):
            r = radii[a:b]
            self.nodes.append((entries[a:b], at[a:b], None if len(r) and r[0] < 0 else r))
        return self


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    """Lengths of rows whose squares may vanish."""
    most = np.abs(vectors).max(axis=1, initial=0.0)
    return most * np.sqrt(((vectors / np.where(most > 0, most, 1.0)[:, None]) ** 2).sum(axis=1))


def exact_scores(vectors: np.ndarray, query: np.ndarray, sizes: np.ndarray, shift: int = 0) -> list[int]:
    """Inner products of integers held as doubles; ``sizes`` bounds the sums of their terms' sizes, by which longs do or Python integers."""
    out = np.empty(len(vectors), object)
    small = (sizes < (1 << 62)) & (shift == 0)
    out[small] = (vectors[small].astype(np.int64) @ query.astype(np.int64)).tolist()
    whole = [_integer(x, shift) for x in query.tolist()]
    out[~small] = [sum(_integer(x, shift) * y for x, y in zip(v, whole, strict=True) if y) for v in vectors[~small].tolist()]
    return out.tolist()


def _integer(x: float, shift: int) -> int:
    """The integer that is held as ``x``, which may be beyond all doubles."""
    over, under = x.as_integer_ratio()
    return (over << shift) // under


def fits_int(top: float) -> bool:
    """Whether all components fit 32 bits, by the largest squared length."""
    return top < 1 << 62


def integers(vector: str, scale: int = 1024, shift: int = 0):
    """floor(scale * x) of each component, as a double, which holds it exactly; divided by two to the power ``shift``."""
    unit = 2.0**-shift
    return F.transform(F.col(vector), lambda x: _floor(x.cast("double"), scale, unit))


def _floor(x, scale, unit):
    y = x * scale
    return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double") * unit).otherwise(x * unit * scale)


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k largest integer inner products of each query row with all other rows.

    Ties go to the smaller id. Vectors that are null or empty, or hold null or non-finite components, take no part; all
    others do, with exact scores. A score beyond a long is given as the nearest long, and such scores are ranked by their
    value as doubles. Shorter vectors count as filled up with zeros; a query's own id is no candidate; rows that repeat a
    query's id and vector ask once, and as candidates count each; null ids take no part; an empty table gives an empty
    result. Where squared lengths are too large for doubles, bounds are taken in smaller units, and scores from whole numbers.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.where(usable(vector_column)).where(F.col(id_column).isNotNull())

    def held(shift: int) -> DataFrame:
        return rows.select(F.col(id_column).cast("long").alias("id"), integers(vector_column, scale, shift).alias("v"), is_query.alias("asks"))

    with Scratch(spark, "mtree") as made:
        whole = made.write(held(0), "integers")
        size, shift = size_of(whole), 0
        if size.top is not None and size.top > LARGEST:
            most = rows.agg(F.max(F.array_max(F.transform(F.col(vector_column), lambda x: F.abs(x.cast("double")))))).first()[0]
            shift = max(1, math.frexp(most)[1] + math.frexp(scale)[1] - COMPONENT)
            whole = made.write(held(shift), "scaled")
            size = size_of(whole)
        return write_table(_top_k(made, whole, size, k, shift), "top")


def size_of(rows: DataFrame) -> Row:
    """width, the largest squared length (top), rows (n) and queries (asked)."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return rows.agg(F.max(F.size("v")).alias("width"), F.max(square).alias("top"), F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked")).first()


def _top_k(made: Scratch, rows: DataFrame, size: Row, k: int, shift: int) -> DataFrame:
    width, top, n, asked = size
    schema = "query_id long, vec_id long, score long, exponent int, mantissa double"
    if not width:
        return made.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kind = "array<int>" if fits_int(top) else "array<double>"
    rows = rows.withColumn("v", F.col("v").cast(kind))
    most = int(max(1, min(PIVOTS, n // PAGE + 1)))
    sample = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(most).toArrow()  # at most PIVOTS rows
    near = np.unique(lifted(matrix(sample.column("v"), width), top), axis=0)

    def nearest(batches):
        for batch in batches:
            x = lifted(matrix(batch.column("v"), width), top)
            d = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (near**2).sum(axis=1)[None] - 2 * x @ near.T, 0))
            p = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "asks")), pa.array(p.astype(np.int32))], ["id", "v", "asks", "pivot"])

    dealt = rows.mapInArrow(nearest, f"id long, v {kind}, asks boolean, pivot int")
    counts = dealt.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PAGE).alias("pages"))
    pages = np.zeros(len(near), np.int64)
    for r in counts.collect():  # at most PIVOTS rows
        pages[r.pivot] = r.pages
    counts = made.spark.createDataFrame([(i, int(x)) for i, x in enumerate(pages)], "pivot int, pages long")
    dealt = made.write(dealt.join(F.broadcast(counts), "pivot").withColumn("part", F.pmod(F.xxhash64("id"), F.col("pages"))).drop("pages"), "dealt")

    def build(table: pa.Table) -> pa.Table:
        tree = Tree(table.column("id").to_numpy(), matrix(table.column("v"), width), top, shift)
        pivot = table.column("pivot")[0].as_py()
        reach = float(np.sqrt(((tree.points - near[pivot]) ** 2).sum(axis=1)).max())
        return pa.table({"pivot": pa.array([pivot], pa.int32()), "part": table.column("part").combine_chunks()[:1].cast(pa.int64()), "reach": [reach], "tree": pa.array([tree.dump()], pa.binary())})

    paged = dealt.select("id", "v", "pivot", "part")
    index = made.write(paged.groupBy("pivot", "part").applyInArrow(build, "pivot int, part long, reach double, tree binary"), "trees")
    reaches = np.full(len(near), -np.inf)
    for r in index.groupBy("pivot").agg(F.max("reach").alias("reach")).collect():  # at most PIVOTS rows
        reaches[r.pivot] = r.reach
    blocks = max(1, -(-asked // QUERIES))
    some = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).alias("block")

    def answer(key, trees: pa.Table, asks: pa.Table) -> pa.Table:
        out = []
        if trees.num_rows and asks.num_rows:
            tree = Tree.load(trees.column("tree")[0].as_py())
            qs = matrix(asks.column("v"), width)
            for q, own, worst in zip(qs, asks.column("id").to_pylist(), asks.column("worst").to_pylist(), strict=True):
                best = [(worst - 1, 0)] * k if worst is not None else []
                out += [(own, -i, s) for s, i in tree.search(q, own, k, best) if worst is None or s >= worst]
        beyond = [(0, 0.0) if LEAST < s < MOST else (s.bit_length() * (1 if s > 0 else -1), s / (1 << s.bit_length())) for _, _, s in out]
        table = np.array([(q, i, min(max(s, LEAST), MOST)) for q, i, s in out], np.int64).reshape(-1, 3)
        return pa.table({"query_id": table[:, 0], "vec_id": table[:, 1], "score": table[:, 2], "exponent": pa.array([e for e, _ in beyond], pa.int32()), "mantissa": pa.array([m for _, m in beyond], pa.float64())})

    def ask(requests: DataFrame) -> DataFrame:
        keys = requests.select(*(F.col(c).alias(c) for c in ("pivot", "part", "block"))).distinct()
        trees = index.join(keys, ["pivot", "part"]).select("pivot", "part", "block", "tree")
        by = ("pivot", "part", "block")
        return trees.groupBy(*by).cogroup(requests.groupBy(*by)).applyInArrow(answer, schema)

    queries = dealt.where("asks").dropDuplicates(["id"])
    home = queries.select("id", "v", "pivot", "part", some, F.lit(None).cast("long").alias("worst"))
    first = made.write(ask(home), "nearest")
    enough = (F.col("n") >= k) & (F.col("low") > LEAST)
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).select(F.col("query_id").alias("id"), F.when(enough, F.col("low")).alias("worst"))

    def routes(batches):
        """Pages whose pivot isn't too far for a query, but for its own page."""
        names = ["id", "v", "block", "worst", "pivot", "part"]
        for batch in batches:
            v = matrix(batch.column("v"), width)
            q = np.column_stack([v, np.zeros(len(v))])
            base = (q**2).sum(axis=1)
            d = np.sqrt(np.maximum(base[:, None] + (near**2).sum(axis=1)[None] - 2 * q @ near.T, 0))
            worst = batch.column("worst").to_numpy(zero_copy_only=False).astype(np.float64)  # null: not a number
            far = np.sqrt(np.maximum(base + top - 2 * np.ldexp(worst, -2 * shift), 0)) + slack_of(width, float((base + top).max()))
            i, p = np.nonzero(d - reaches[None] <= np.where(np.isnan(far), np.inf, far)[:, None])
            i, p, part = np.repeat(i, pages[p]), np.repeat(p, pages[p]), ranges(np.zeros(len(p), np.int64), pages[p])
            away = (p != batch.column("pivot").to_numpy()[i]) | (part != batch.column("part").to_numpy()[i])
            chosen = batch.take(pa.array(i[away]))
            yield pa.RecordBatch.from_arrays([*(chosen.column(c) for c in names[:4]), pa.array(p[away].astype(np.int32)), pa.array(part[away])], names)

    known = home.drop("worst").join(kth, "id", "left").select("id", "v", "block", "worst", "pivot", "part")
    rest = ask(known.mapInArrow(routes, f"id long, v {kind}, block long, worst long, pivot int, part long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("exponent"), F.desc("mantissa"), "vec_id")
    ranked = first.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that gives all of them the squared length ``top``."""
    return np.column_stack([vectors, np.sqrt(np.maximum(top - (vectors**2).sum(axis=1), 0))])
