"""Operator 3: best-two-fit packing of tokenised documents into sequences of a fixed capacity.

Pieces of one length are interchangeable, so packing is decided on the histogram of lengths (at most ``capacity``
counts, whatever the corpus): bins are filled greedily with the largest piece that fits, then a bin's smallest piece
gives way to two unpacked pieces that fill its expanded gap more tightly. Equal bins are made as one run with a
multiplicity, which gives exactly the bins that filling one after another would give. Each piece then finds its place
from its rank among the pieces of its length; ranks come from counts per block of rows, so no length, however common,
is gathered in a task.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epistride.llm.common import by_bytes, clean, prepare, write_table
from epistride.llm.tokens import default_vocabulary, encoder

#: Ranks stay below this in the placement keys.
RANKS = 1 << 44


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Runs (multiplicity, lengths of one bin in descending order) that use up ``counts`` exactly."""
    left = {n: int(c) for n, c in counts.items() if c > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths must be from 1 to the capacity")
    sizes = sorted(left)
    runs = []
    while sizes:
        used: dict[int, int] = {}
        gap, top = capacity, len(sizes) - 1
        while top >= 0:
            top = min(top, bisect.bisect_right(sizes, gap) - 1)
            if top < 0:
                break
            n = sizes[top]
            take = min(gap // n, left[n])
            used[n] = take
            gap -= take * n
            top -= 1
        if gap and sum(used.values()) > 1:
            smallest = min(used)
            pair = _tighter_pair(sizes, left, used, smallest, gap + smallest)
            if pair:
                used[smallest] -= 1
                if not used[smallest]:
                    del used[smallest]
                for n in pair:
                    used[n] = used.get(n, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                sizes.pop(bisect.bisect_left(sizes, n))
        runs.append((times, [n for n in sorted(used, reverse=True) for _ in range(used[n])]))
    return runs


def _tighter_pair(sizes: list[int], left: dict[int, int], used: dict[int, int], smallest: int, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum over ``smallest`` that fits ``room``."""
    free = [n for n in sizes[: bisect.bisect_right(sizes, room - 1)] if left[n] > used.get(n, 0)]
    best, found = smallest, None
    low, high = 0, len(free) - 1
    while low <= high:
        a, b = free[low], free[high]
        if a + b > room:
            high -= 1
            continue
        if (low < high or left[a] - used.get(a, 0) > 1) and a + b > best:
            best, found = a + b, (b, a)
        elif low == high:
            pass
        low += 1
    return found


class Placement:
    """Where the r-th piece of each length goes."""

    def __init__(self, runs: list[tuple[int, list[int]]]):
        rows, taken, sequences = [], {}, 0
        for times, lengths in runs:
            offset = 0
            for n in dict.fromkeys(lengths):
                uses = lengths.count(n)
                rows.append((n * RANKS + taken.get(n, 0), sequences, uses, offset))
                taken[n] = taken.get(n, 0) + uses * times
                offset += uses * n
            sequences += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.key, self.base, self.uses, self.offset = table.T.copy()
        self.sequences = sequences

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = lengths * RANKS + ranks
        i = np.searchsorted(self.key, key, side="right") - 1
        at = key - self.key[i]
        return self.base[i] + at // self.uses[i], self.offset[i] + at % self.uses[i] * lengths


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and lengths of the pieces of ``n`` ids: all of ``capacity`` but the first, which may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pack_documents(docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None, end_id: int = 2, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if asked for.

    A document is its ids and then ``end_id``; only documents over ``capacity`` are cut. Null texts count as empty
    (they hold ``end_id`` alone); repeated rows are packed each; texts of any length are tokenised whole; other columns
    are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = vocabulary or default_vocabulary()

    def pieces(batches):
        from pyspark import TaskContext

        enc, block, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in by_bytes(batch):
                rows, ids_of, names = [], [], part.column("id")
                for i, own in enumerate(enc.batch(part.column("text").to_pylist())):
                    ids = np.append(own, np.uint32(end_id)).astype("<u4")
                    for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                        own = ids[start : start + length].tobytes()
                        rows.append((i, k, start, length, zlib.crc32(own), seen[length]))
                        seen[length] += 1
                        if with_ids:
                            ids_of.append(own)
                table = np.array(rows, np.int64).reshape(-1, 6)
                columns = [names.take(pa.array(table[:, 0])), *(pa.array(table[:, c].copy()) for c in range(1, 6)), pa.array(np.full(len(table), block))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids_of, pa.binary())] * with_ids, ["id", "piece", "start", "length", "ids_crc32", "nth", "block"] + ["ids"] * with_ids)

    rows = docs.select(F.col(id_column).alias("id"), clean(text_column).alias("text"))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, piece long, start long, length long, ids_crc32 long, nth long, block long" + ", ids binary" * with_ids
    made = write_table(rows.mapInArrow(pieces, schema), "pieces")

    blocks = made.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    place = Placement(best_two_fit(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = made.join(blocks, ["block", "length"]).withColumn("at", placed("length", F.col("base") + F.col("nth")))
    return out.select(F.col("id").alias(id_column), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens and ids (little-endian unsigned 32-bit), from pack_documents(with_ids=True).

    An empty table gives none; a sequence holds at most the capacity, so that each is gathered in bounded memory.
    """
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("parts"))
    return parts.select("sequence_id", "n_tokens", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
