"""Operator 6: near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: in round i < t each shingle is thrown into one hashed bin of t with the value (i, hash); each bin keeps its
smallest. A document stops after the first round that leaves no bin empty, and rounds t to 2t - 1 throw every shingle
into bin i - t, so that every coordinate fills. Coordinates of two sets agree with a probability of their similarity,
concentrated about it. Bands of coordinates give candidates; links are confirmed on full shingle sets.

Sets hold keyed 64-bit hashes of shingles, whose key is drawn anew for each run: no texts can be made that collide, and
any two sets of n shingles do by chance with a probability below n**2 / 2**64. Equal sets are known by the BLAKE2b digest of
the whole set.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistride.llm.common import Scratch, by_bytes, clean, filter_slot, id_filter, in_filter, maybe_in, prepare, write_table
from epistride.llm.components import Forest, components
from epistride.llm.hashing import U, mix, shingle_hashes, shingle_key, split_words, window_starts, word_digests

#: Shingles and sets of one part of a bucket, about, if no single set is larger: a task compares two parts.
GROUP_SHINGLES = 400_000
GROUP_ROWS = 1024
EMPTY = U(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Near:
    """Links: 100 * intersection >= percent * union of sets of ``words``-word shingles."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5

    @property
    def size(self) -> int:
        return self.bands * self.rows


def shingle_sets(texts: pa.Array, k: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one after another, and where each begins.

    Words are compared with A-Z in lower case; a text with fewer than ``k`` words is one shingle, one without words none.
    """
    words = split_words(texts, lower=True)
    digests, n = word_digests(words), words.per_text
    at, counts = window_starts(words.first, k)
    long = shingle_hashes(digests, k, key)[at]
    short = np.flatnonzero((n > 0) & (n < k))
    counts = counts.copy()
    counts[short] = 1
    first = np.concatenate(([0], np.cumsum(counts)))
    if len(short):
        every = np.empty(first[-1], np.uint64)
        mask = np.zeros(first[-1], bool)
        mask[first[short]] = True
        every[~mask] = long
        every[mask] = [shingle_hashes(digests[words.first[i] : words.first[i + 1]], int(n[i]), key)[0] for i in short]
    else:
        every = long
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        every[a:b].sort()
    keep = np.ones(len(every), bool)
    keep[1:] = every[1:] != every[:-1]
    keep[first[:-1][np.diff(first) > 0]] = True
    ends = np.concatenate(([0], np.cumsum(keep)))
    return every[keep], ends[first]


def sketches(values: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """The sketch of each set as a row of ``t`` numbers; an empty set has no coordinate filled."""
    n = len(first) - 1
    out = np.full(n * t, EMPTY, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(first))
    open_ = np.diff(first) > 0
    for i in range(2 * t):
        mine = open_[owner]
        if not mine.any():
            break
        v, o = (values, owner) if mine.all() else (values[mine], owner[mine])
        h = mix(v + U((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        rank = (U(i) << U(54)) | (mix(h + U(1)) >> U(10))
        slot = ((h >> U(32)) * U(t) >> U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, o * t + slot, rank)
        open_ &= (out.reshape(n, t) == EMPTY).any(axis=1)
    return out.reshape(n, t)


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * U(0xD1B54A32D192ED03)), parts.shape[:2]).copy()
    for r in range(rows):
        h = mix(h + parts[:, :, r])
    return h


def _digests(values: np.ndarray, first: np.ndarray) -> tuple[list[bytes], pa.Array]:
    """Each set as bytes, and its digest."""
    data = values.astype("<u8").tobytes()
    sets = [data[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return sets, pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in sets], pa.binary())


def _profile(near: Near, key: np.ndarray):
    """Arrow function: per document its number of shingles, the digest of its set, and its band hashes."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, most=2 << 20):
                values, first = shingle_sets(part.column("text"), near.words, key)
                n = np.diff(first)
                bands = band_hashes(sketches(values, first, near.size), near.bands, near.rows)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * near.bands), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), _digests(values, first)[1], flat], ["id", "n_shingles", "own", "bands"])

    return run


def _sets_of(docs: DataFrame, reps: DataFrame, words: int, key: np.ndarray) -> DataFrame:
    """id and shingle set (bytes of sorted 64-bit hashes) of the classes in ``reps`` (id, rep, own), one row each."""
    bitmap = id_filter(reps, "rep")

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(bitmap, batch.column("slot").to_numpy())))
            for part in by_bytes(batch, most=2 << 20) if batch.num_rows else ():
                sets, own = _digests(*shingle_sets(part.column("text"), words, key))
                yield pa.RecordBatch.from_arrays([part.column("id"), own, pa.array(sets, pa.binary())], ["rep", "own", "shingles"])

    rows = docs.select("id", "text", filter_slot("id").alias("slot")).mapInArrow(run, "rep long, own binary, shingles binary")
    return rows.join(reps, ["rep", "own"]).select("id", "shingles").dropDuplicates(["id"])


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets in ``a`` with those in ``b``, by a product over the shingles that occur in both."""
    left, right = np.unique(np.concatenate(a)), np.unique(np.concatenate(b))
    both = np.intersect1d(left, right, assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return out

    def held(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
        m = np.zeros((len(sets), len(some)), np.float32)
        for i, s in enumerate(sets):
            at = np.searchsorted(some, s)
            at[at == len(some)] = 0
            m[i, at[some[at] == s]] = 1
        return m

    step = max(1, (8 << 20) // (len(a) + len(b)))
    for i in range(0, len(both), step):
        some = both[i : i + step]
        out += held(a, some) @ held(b, some).T
    return out


def _verify(percent: int):
    """Group function: confirms links between the sets of side 0 and side 1 (or within side 0) that are not yet connected."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        label = table.column("label").to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
        one = np.flatnonzero(side == 0)
        two = np.flatnonzero(side == 1)
        if not len(one):  # no set of this pair's first part: those of the second are compared in its own group
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        two = two if len(two) else one
        sizes = np.array([len(s) for s in sets], np.int64)
        forest = Forest(len(ids))
        by_label = {}
        for i, x in enumerate(label.tolist()):
            forest.join(i, by_label.setdefault(x, i))
        made = []
        shared = intersections([sets[i] for i in one], [sets[i] for i in two])
        for begin in range(0, len(one), 256):  # a few rows at a time, so that a block of copies stays small in memory
            some = one[begin : begin + 256]
            linked = (100 + percent) * shared[begin : begin + 256].astype(np.int64) >= percent * (sizes[some][:, None] + sizes[two][None, :])
            for i, j in zip(*np.nonzero(linked), strict=True):
                x, y = int(some[i]), int(two[j])
                if x != y and forest.join(x, y):
                    made.append((ids[x], ids[y]))
        pairs = np.array(made, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def near_duplicates(docs: DataFrame, near: Near = Near(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links) and kept (id = component_id) of every row.

    Null and empty texts, and texts without words, have no shingles and link with nothing; repeated rows give a row
    each, and rows that share an id but not their text link each by its own text; rows with a null id come back unlinked; ids are longs; other columns are left out; an empty table gives an
    empty result. Texts of any length count whole. Documents with equal sets are one class from the start, so copies
    are never compared with each other.
    """
    spark = docs.sparkSession
    prepare(spark)
    key = shingle_key(near.words)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), clean(text_column).alias("text"))
    with Scratch(spark, "minhash") as made:
        profiles = made.write(rows.mapInArrow(_profile(near, key), "id long, n_shingles long, own binary, bands array<long>"), "profiles")
        full = profiles.where("n_shingles > 0 AND id IS NOT NULL")
        # Written, so that later joins deal rows out by their own keys and a class of many copies can be split, and class numbers stay.
        classes = made.write(full.groupBy("own").agg(F.min("id").alias("rep")).withColumn("class", F.monotonically_increasing_id()), "classes")
        named = classes.withColumnRenamed("rep", "id")
        reps = full.select("id", "own", "n_shingles", "bands").join(named, ["id", "own"]).dropDuplicates(["class"])
        labels = _linked(made, rows, reps.select(F.col("class").alias("id"), F.col("id").alias("rep"), "own", "n_shingles", "bands"), near, key)
        linked = labels.select(F.col("id").alias("class"), "component").join(classes, "class")
        lowest = made.write(linked.groupBy("component").agg(F.min("rep").alias("component_id")), "lowest")
        linked = linked.join(lowest, "component").select("class", "component_id")
        known = made.write(classes.join(linked, "class", "left").select("own", F.coalesce("component_id", "rep").alias("component_id")), "known")
        out = profiles.select("id", "n_shingles", "own").join(known, "own", "left")
        component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
        out = write_table(out.select(F.col("id"), "n_shingles", component.alias("component_id")), "near")
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_column)


def _parts(load: str) -> str:
    return f"greatest(1L, ceil({load} / {GROUP_SHINGLES}), ceil(n / {GROUP_ROWS}))"


def _linked(made: Scratch, rows: DataFrame, reps: DataFrame, near: Near, key: np.ndarray) -> DataFrame:
    """id and component of the classes ``reps`` (id, the number of the class; rep, a document of it; own, the digest of its set) that are linked with others."""
    banded = made.write(reps.select("id", "n_shingles", F.explode("bands").alias("band")), "bands")
    # Buckets with more than one class: every class is compared with the bucket's smallest id first.
    buckets = banded.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("other")).where("hub != other").select("band", "hub")
    members = made.write(banded.join(buckets, "band"), "members")
    made.drop("bands")
    stars = members.where("id != hub").groupBy("id", "hub").agg(F.first("n_shingles").alias("n_shingles"))
    ids = members.select("id").distinct()
    sets = made.write(_sets_of(rows, reps.select("id", "rep", "own").join(ids, "id", "left_semi"), near.words, key), "sets")
    loads = stars.groupBy("hub").agg(F.sum("n_shingles").alias("load"), F.count(F.lit(1)).alias("n")).select("hub", F.expr(_parts("load")).alias("parts"))
    dealt = stars.join(loads, "hub").select("id", "hub", F.expr("pmod(xxhash64(id), parts)").alias("part"))
    keys = dealt.select("hub", "part").distinct()
    sides = dealt.select("hub", "part", "id", F.lit(0).alias("side")).union(keys.select("hub", "part", F.col("hub").alias("id"), F.lit(1).alias("side")))
    compared = sides.join(sets, "id").select("hub", "part", "id", "side", F.col("id").alias("label"), "shingles")
    links = made.write(compared.groupBy("hub", "part").applyInArrow(_verify(near.percent), "a long, b long"), "links")
    labels = components(links)

    # Buckets that still hold several components: all their classes are compared, block against block.
    known = members.select("band", "id", "n_shingles").join(labels, "id", "left").withColumn("label", F.coalesce("component", "id"))
    open_ = known.groupBy("band").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("load"),
        F.bit_xor(F.xxhash64("id")).alias("who"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("too"),
    ).where("low != high")
    once = open_.groupBy("who", "too", "n").agg(F.min("band").alias("band"), F.max("load").alias("load"))
    once = once.select("band", F.expr(_parts("load * 2")).alias("parts"))
    blocks = known.join(once, "band").select("band", "id", "label", "parts", F.expr("pmod(xxhash64(id), parts)").alias("part"))
    paired = blocks.select("band", "id", "label", "part", F.explode(F.expr("sequence(0L, parts - 1)")).alias("with"))
    paired = paired.select("band", "id", "label", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), (F.col("part") > F.col("with")).cast("int").alias("side"))
    more = paired.join(sets, "id").groupBy("band", "i", "j").applyInArrow(_verify(near.percent), "a long, b long")
    more = made.write(more, "more")
    return components(links.union(more)) if more.limit(1).count() else labels


def one_of_each(docs: DataFrame, near: Near = Near(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each group of near-duplicates: that with the smallest id.

    Rows that repeat an id leave one row; rows with a null id, and rows without words, stay. Columns are unchanged.
    """
    found = write_table(near_duplicates(docs, near, id_column, text_column).select(F.col(id_column).alias("gone id"), "n_shingles", "kept"), "near")
    copies = found.where("NOT kept").select("gone id").distinct()
    twice = found.where("`gone id` IS NOT NULL").groupBy("gone id").count().where("count > 1").select("gone id")
    touched, rest = maybe_in(docs, id_column, copies.union(twice), "gone id")
    left = touched.join(copies, F.col(id_column).cast("long") == F.col("gone id"), "left_anti")
    named, unnamed = left.where(F.col(id_column).isNotNull()), left.where(F.col(id_column).isNull())
    return rest.union(named.dropDuplicates([id_column])).union(unnamed)
