"""Resampling by hashed draws: rows are never copied once a draw, numpy makes the draws of a block of units at a time."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_S = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_K = [int(abs(np.sin(np.float64(i + 1))) * 2**32) & 0xFFFFFFFF for i in range(64)]
_AT = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
#: Numbers that are hashed at once, so that all arrays stay in the cache.
CHUNK = 1 << 15


def _heads(words: list, shape: tuple[int, int]) -> np.ndarray:
    """The first four bytes of MD5, as the big-endian number that its first eight hex digits say, of blocks of 16 words (numbers or arrays)."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, u = np.empty_like(a), np.empty_like(a)
    for i in range(61):  # the last three steps don't reach the first word
        if i < 32:
            x, y, z = (b, c, d) if i < 16 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        w = words[_AT[i]]
        np.add(f, a, out=f)
        if np.ndim(w):
            np.add(f, w, out=f)
        np.add(f, np.uint32(_K[i] if np.ndim(w) else (int(w) + _K[i]) & 0xFFFFFFFF), out=f)
        np.left_shift(f, np.uint32(_S[i]), out=u)
        np.right_shift(f, np.uint32(32 - _S[i]), out=f)
        np.bitwise_or(f, u, out=f)
        np.add(f, b, out=a)  # takes the place of the oldest
        a, b, c, d = d, a, b, c
    return (b + np.uint32(0x67452301)).byteswap()


def heads(prefixes: list[bytes], first: int, last: int) -> Iterator[tuple[list[int], int, np.ndarray]]:
    """(numbers of prefixes, first i, heads): the first eight hex digits of md5(prefix + decimal i), as numbers, a row a prefix, for i from ``first`` below ``last``, in pieces."""
    lengths: dict[int, list[int]] = {}
    for number, prefix in enumerate(prefixes):
        lengths.setdefault(len(prefix), []).append(number)
    with np.errstate(over="ignore"):
        while first < last:
            digits = len(str(first))
            to = min(last, 10**digits, first + CHUNK)
            i = np.arange(first, to)
            text = np.empty((len(i), digits), np.uint8)
            left = i.copy()
            for place in range(digits - 1, -1, -1):
                text[:, place] = left % 10 + 48
                left //= 10
            for length, numbers in lengths.items():
                n, step = length + digits, max(1, CHUNK // len(i))
                shift, at = length % 4, length // 4
                padded = np.zeros((len(i), -(-(shift + digits) // 4) * 4), np.uint8)
                padded[:, shift : shift + digits] = text
                moving = np.ascontiguousarray(padded.view("<u4").T)
                for start in range(0, len(numbers), step):
                    some = numbers[start : start + step]
                    if n > 55:  # more than a block
                        got = [[int.from_bytes(hashlib.md5(prefixes[k] + b"%d" % x, usedforsecurity=False).digest()[:4], "big") for x in range(first, to)] for k in some]
                        yield some, first, np.array(got, np.uint32)
                        continue
                    tail = bytes(digits) + b"\x80" + bytes(55 - n) + struct.pack("<Q", 8 * n)
                    fixed = np.frombuffer(b"".join(prefixes[k] + tail for k in some), "<u4").reshape(len(some), 16)
                    words: list = [int(w[0]) if (w == w[0]).all() else w[:, None] for w in fixed.T]
                    for j, w in enumerate(moving):
                        words[at + j] = w[None] | fixed[:, at + j, None]
                    yield some, first, _heads(words, (len(some), len(i)))
            first = to


def below(heads: np.ndarray, n: int) -> np.ndarray:
    """The heads modulo n, as places in an array."""
    if n >= 1 << 32:
        return heads.astype(np.int64)
    return (heads - heads // np.uint32(n) * np.uint32(n)).astype(np.int64)


#: Draws of units in a task's cell; values in one, of a group with more of which each cell makes all draws again and keeps those of its own values; values in a row.
CELL, HELD, PIECE = 1 << 23, 1 << 22, 1 << 12


def resampled_means(rows: DataFrame, x: str, by: list[str], prefix: Column, draws: int) -> DataFrame:
    """by, draw and mean of x over resampled rows of each group: slot i of draw b takes row md5(prefix-b-i) modulo n; ``rows`` has by, i, n and x.

    Cells of draws go side by side, each over the values of its group as an array: nothing is as large as rows times draws. Nulls in x are left
    out, groups with nulls too.
    """
    spark, types = rows.sparkSession, dict(rows.dtypes)
    known = rows.where(F.forall(F.array(*[F.col(c).isNotNull() for c in by]), lambda c: c)).select(*by, "i", "n", F.col(x).cast("double").alias("_x"), prefix.alias("_prefix"))
    pieces = known.groupBy(*by, "_prefix", "n", F.floor(F.col("i") / HELD).alias("_held"), F.floor(F.col("i") / PIECE).alias("_piece")).agg(F.sort_array(F.collect_list(F.struct("i", "_x"))).alias("_x"))
    cells = F.least(F.ceil(F.col("n") * F.lit(draws) / CELL), F.lit(draws)).cast("int")
    pieces = pieces.select(*by, "_prefix", "n", "_held", "_piece", F.transform("_x", lambda e: e["_x"]).alias("_x"), F.explode(F.sequence(F.lit(0), cells - 1)).alias("_cell"), cells.alias("_cells"))

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("_piece")
        values = pa.chunked_array([c.flatten() for c in table.column("_x").chunks]).combine_chunks()
        there = ~values.is_null().to_numpy(zero_copy_only=False)
        v, full = np.where(there, values.to_numpy(zero_copy_only=False), 0.0), bool(there.all())
        one = lambda c: table.column(c)[0].as_py()
        n, low, cell, many = one("n"), one("_held") * HELD, one("_cell"), one("_cells")
        mine = list(range(1 + cell * draws // many, 1 + (cell + 1) * draws // many))
        sums, counts = np.zeros(len(mine)), np.zeros(len(mine), np.int64)
        for at, _, h in heads([f"{one('_prefix')}-{b}-".encode() for b in mine], 0, n):
            j = below(h, n)
            if n > HELD:
                own = (j >= low) & (j < low + len(v))
                j = np.where(own, j - low, 0)
                sums[at] += np.where(own, v[j], 0.0).sum(axis=1)
                counts[at] += (own & there[j]).sum(axis=1)
            else:
                sums[at] += v[j].sum(axis=1)
                counts[at] += j.shape[1] if full else there[j].sum(axis=1)
        keys = [pa.repeat(table.column(c)[0], len(mine)) for c in by]
        return pa.table([*keys, pa.array(mine, pa.int32()), pa.array(sums), pa.array(counts)], names=[*by, "draw", "s", "c"])

    dealt = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by, "_held", "_cell")  # of which few small ones aren't put together
    got = dealt.groupBy(*by, "_held", "_cell").applyInArrow(mean, ", ".join([f"`{c}` {types[c]}" for c in by] + ["draw int", "s double", "c long"]))
    return got.groupBy(*by, "draw").agg((F.sum("s") / F.nullif(F.sum("c"), F.lit(0))).alias("mean"))


#: Bytes of multiplicities in a tile and draws of one at most; rows of a range of scores, and of a step through it.
TILE, WIDE, SPAN, STRIDE = 1 << 25, 64, 1 << 21, 1 << 14


def multiplicities(spark, n: int, seed: int, draws: int, wide: int) -> DataFrame:
    """tile, draw and times (a byte for each of n units): how often each draw takes each unit; slot i of draw b takes unit md5(seed-b-i) modulo n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                times = np.zeros(n, np.int64)
                for _, _, h in heads([f"{seed}-{b}-".encode()], 0, n):
                    np.add.at(times, below(h[0], n), 1)
                if n and times.max() > 255:
                    raise OverflowError("a unit is drawn more than 255 times")
                yield pa.RecordBatch.from_arrays([pa.array([(b - 1) // wide], pa.int32()), pa.array([b], pa.int32()), pa.array([times.astype(np.uint8).tobytes()], pa.binary())], ["tile", "draw", "times"])

    parts = max(1, min(draws, -(-n * draws // CELL)))
    return spark.range(1, draws + 1, 1, parts).mapInArrow(count, "tile int, draw int, times binary")


def _key(column: pa.ChunkedArray, times: int = 1) -> pa.Array:
    """The first struct of a column, repeated, with fields that may be null."""
    one = column[:1].combine_chunks()
    one = one if isinstance(one, pa.Array) else one.chunk(0)
    return pa.concat_arrays([pa.StructArray.from_arrays(one.flatten(), names=[f.name for f in one.type])] * times)


def packed(rows: DataFrame, key: str) -> DataFrame:
    """A row for each value of the struct ``key``: units, pos and neg by ascending s, and where each s begins, as arrays in binary columns."""
    kind = dict(rows.dtypes)[key]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("s")
        s = table.column("s").to_numpy()
        new = np.r_[True, (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))] if s.dtype.kind == "f" else np.r_[True, s[1:] != s[:-1]]
        arrays = [table.column("i").to_numpy().astype(np.int32), table.column("pos").to_numpy().astype(np.int32), table.column("neg").to_numpy().astype(np.int32), np.flatnonzero(new).astype(np.int32)]
        return pa.table([_key(table.column(key)), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], names=[key, "units", "pos", "neg", "starts"])

    return rows.select(key, "s", "i", "pos", "neg").groupBy(key).applyInArrow(pack, f"`{key}` {kind}, units binary, pos binary, neg binary, starts binary")


def weighted(rows: DataFrame, times: DataFrame, key: str, ranked: bool) -> DataFrame:
    """key, draw, p and n (rows of each class by their multiplicities); ``ranked`` adds u and a, with the sums below and in all in ``times``.

    A tile is a range of scores and a block of draws; it goes through its rows in steps, a column for each draw.
    """
    kind, names = dict(rows.dtypes)[key], ["p", "n", *(["u", "a"] if ranked else [])]

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        units, pos, neg, starts = (np.frombuffer(left.column(c)[0].as_py(), np.int32) for c in ("units", "pos", "neg", "starts"))
        right = right.sort_by("draw")
        c = np.stack([np.frombuffer(t.as_py(), np.uint8) for t in right.column("times")], axis=1)
        below_p, below_n, all_p, all_n = (right.column(x).to_numpy().astype(float) if ranked else np.zeros(c.shape[1]) for x in ("below_p", "below_n", "all_p", "all_n"))
        out = {x: np.zeros(c.shape[1]) for x in names}
        at, ends = 0, np.r_[starts[1:], len(units)]
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + STRIDE, side="right")))
            own = slice(starts[at], ends[to - 1])
            w = c[units[own]].astype(np.float64)
            p, n = w * pos[own, None], w * neg[own, None]
            if ranked:
                if to - at < len(w):
                    p, n = (np.add.reduceat(x, starts[at:to] - starts[at], axis=0) for x in (p, n))
                before_p, before_n = (b + o + np.cumsum(x, axis=0) - x for b, o, x in ((below_p, out["p"], p), (below_n, out["n"], n)))
                out["u"] += (p * (before_n + n / 2)).sum(axis=0)
                tp = all_p - before_p
                k = tp + all_n - before_n
                out["a"] += (p * np.divide(tp, k, out=np.zeros_like(k), where=k > 0)).sum(axis=0)
            out["p"], out["n"] = out["p"] + p.sum(axis=0), out["n"] + n.sum(axis=0)
            at = to
        return pa.table([_key(left.column("_own"), c.shape[1]), right.column("draw").combine_chunks(), *[pa.array(out[x]) for x in names]], names=[key, "draw", *names])

    tiles = times.select(F.col("tile").alias("_at")).distinct()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = rows.withColumnRenamed(key, "_own").crossJoin(F.broadcast(tiles))  # at most one row a draw
    left, right = left.repartition(parts, "_own", "_at"), times.repartition(parts, key, "tile")
    return left.groupBy("_own", "_at").cogroup(right.groupBy(key, "tile")).applyInArrow(tile, f"`{key}` {kind}, draw int, " + ", ".join(f"{x} double" for x in names))
