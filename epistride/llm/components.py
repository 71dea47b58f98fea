"""Connected components of links that are too many for one machine: labels spread and jump until none changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistride.llm.common import Scratch, write_table


class Forest:
    """Union-find over the positions 0 to n - 1; the smallest position of a tree is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of an Arrow batch by as few that connect the same ids: each id and the smallest of its tree."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(ids))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            forest.join(x, y)
        roots = forest.roots()
        own = roots != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[roots[own]])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in ``links`` (long columns a and b).

    Null ends and loops are ignored; repeated links change nothing; ids without links are not in the result. Every round
    is written to the shared folder, and only whether a label changed comes to the driver.
    """
    ends = links.select("a", "b").where("a != b").mapInArrow(contract, "a long, b long")
    both = ends.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
    with Scratch(links.sparkSession, "components") as made:
        both = made.write(both.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), "links")
        labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("p"))
        labels = made.write(labels, "labels")
        while True:
            near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("p").alias("m"))
            seen = labels.join(near, labels.id == near.a).select("id", "p", F.least("p", "m").alias("m"))
            hooked = seen.select(F.explode(F.array(F.struct(F.col("id"), F.col("m")), F.struct(F.col("p").alias("id"), F.col("m")))).alias("x")).select("x.*")
            lower = hooked.groupBy("id").agg(F.min("m").alias("m"))
            above = lower.select(F.col("id").alias("m"), F.col("m").alias("mm"))
            jumped = lower.join(above, "m", "left").select("id", F.coalesce("mm", "m").alias("p"))
            new = jumped.join(labels.withColumnRenamed("p", "old"), "id").select("id", "p", (F.col("p") != F.col("old")).alias("changed"))
            new = made.write(new, "labels")
            labels = new.select("id", "p")
            if not new.where("changed").limit(1).count():
                return write_table(labels.withColumnRenamed("p", "component"), "component")
