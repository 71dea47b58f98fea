"""Operator 9: removal of repeated passages, over a log-structured index of window fingerprints.

A passage of ``k`` words that occurs twice holds an anchor at the same place in both: of the ``ANCHOR``-word windows in
it, the one with the smallest hash. The index keeps anchors only. A batch (documents in ascending order of id) writes
one immutable run, sorted by hash, with the first place of each; before that it is merge-joined with the runs of the
past, and all places of an anchor seen twice are marked. Runs are compacted when there are several. Marked places are
then verified: the full ``k``-word windows about them are compared as cryptographic digests of all their words, made anew
from the texts, and every window but the first of its kind is removed.

Hashes travel in rows per bucket and block of texts, as sorted or position-ordered arrays; a hash that is common inside
a block is sent once, so that no bucket grows with the number of copies.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.llm.common import Scratch, by_bytes, clean, drop_path, maybe_in, new_path, prepare, write_table
from epistride.llm.hashing import mix, runs, split_words, window_digests, window_hashes, window_starts, word_digests, word_hashes

#: Words of an anchor; windows must be longer.
ANCHOR = 8
#: Bytes of text that one block of hashes covers, and that a bucket stands for (about 10 million words, 1.5 million anchors).
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20
SENT = "bucket int, hashes binary, checks binary, docs binary, places binary, sure_docs binary, sure_places binary"
RUN = "bucket int, hashes binary, docs binary, places binary"
MARKS = "part int, docs binary, places binary"
MANIFEST = "version long, k int, buckets int, before long, last long, runs array<string>, levels array<int>, marks array<string>, answer string"
GONE = "id long, places array<int>"


def _pack(values: np.ndarray) -> bytes:
    """Differences, compressed: places of one bucket ascend."""
    return zlib.compress(np.diff(values, prepend=values.dtype.type(0)).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), kind), dtype=kind)


def anchors(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window positions, the position of the anchor of each, and all anchor hashes by position.

    The anchor is the leftmost smallest of the k - ANCHOR + 1 short windows inside, so it depends on the words alone.
    """
    at, _ = window_starts(first, k)
    n = len(hashes) - ANCHOR + 1
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    short = window_hashes(hashes, np.arange(n), ANCHOR)
    best, span, want = np.arange(n), 1, k - ANCHOR + 1
    while span < want:
        step = min(span, want - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(short[a] <= short[b], a, b)
        span += step
    return at, best[at], short


def _blocks(batch: pa.RecordBatch):
    for part in by_bytes(batch, most=BLOCK_BYTES):
        order = np.argsort(part.column("id").to_numpy(), kind="stable")
        yield part if (np.diff(order) == 1).all() else part.take(pa.array(order))


def _send(hashes, checks, docs, places, buckets: int, all_of_repeats: bool):
    """Rows for the buckets: each hash once, and beside it the places that this block alone already settles.

    Places come ordered. ``all_of_repeats``: every place of a repeated hash is settled, else all that differ from the
    first; a repeated row gives the first place again.
    """
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], checks[order] if checks is not None else None
    again = np.zeros(len(h), bool)
    if len(h):
        again[1:] = h[1:] == h[:-1]
        if c is not None:
            again[1:] &= c[1:] == c[:-1]
    settled = again.copy()
    if all_of_repeats:
        settled[:-1] |= again[1:]
    elif again.any():
        later = np.flatnonzero(again)
        lead = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))[later]]
        own = order[later]
        settled[later] = (docs[own] != docs[lead]) | (places[own] != places[lead])
    sure = np.sort(order[settled])
    sent = np.sort(order[~again])
    bucket = (hashes[sent] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
    sent, bucket = sent[by], bucket[by]
    rows = []
    for a, b in runs(bucket):
        own = sent[a:b]
        rows.append((int(bucket[a]), hashes[own].tobytes(), checks[own].tobytes() if checks is not None else b"", _pack(docs[own]), _pack(places[own]), b"", b""))
    if len(sure):
        to = int(mix(docs[:1].view(np.uint64))[0] % np.uint64(buckets))  # by the block's first document, so that a task made again sends the same
        rows.append((to, b"", b"", b"", b"", _pack(docs[sure]), _pack(places[sure])))
    names = [x.split()[0] for x in SENT.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def _anchor_rows(k: int, buckets: int):
    def run(batches):
        for batch in batches:
            for part in _blocks(batch):
                words = split_words(part.column("text"))
                _, best, short = anchors(word_hashes(word_digests(words)), words.first, k)
                at = best[np.diff(best, prepend=-1) != 0]
                owner = np.searchsorted(words.first, at, side="right") - 1
                ids = part.column("id").to_numpy()
                yield _send(short[at], None, ids[owner], (at - words.first[owner]).astype(np.int32), buckets, True)

    return run


def _window_rows(k: int, buckets: int):
    def run(batches):
        for batch in batches:
            for part in _blocks(batch):
                words = split_words(part.column("text"))
                digests = word_digests(words)
                at, best, _ = anchors(word_hashes(digests), words.first, k)
                marked = np.zeros(len(digests) + 1, bool)
                places = part.column("places")
                first = np.repeat(words.first[:-1], np.diff(places.offsets.to_numpy()))
                at_marks = first + places.flatten().to_numpy()
                marked[at_marks[at_marks < len(digests)]] = True
                at = at[marked[best]]
                owner = np.searchsorted(words.first, at, side="right") - 1
                ids = part.column("id").to_numpy()
                one, two = window_digests(digests, at, k).T
                yield _send(one, two, ids[owner], (at - words.first[owner]).astype(np.int32), buckets, False)

    return run


def _gather(table: pa.Table, checks: bool):
    """The arrays of a bucket, ordered by hash and then by place, and the places already settled."""
    live = [r for r in table.to_pylist() if r["hashes"]]
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    hashes = cat([np.frombuffer(r["hashes"], np.uint64) for r in live], np.uint64)
    check = cat([np.frombuffer(r["checks"], np.uint64) for r in live], np.uint64) if checks else None
    docs, places = cat([_unpack(r["docs"], np.int64) for r in live], np.int64), cat([_unpack(r["places"], np.int32) for r in live], np.int32)
    order = np.lexsort((places, docs, check, hashes) if checks else (places, docs, hashes))
    sure = [(_unpack(r["sure_docs"], np.int64), _unpack(r["sure_places"], np.int32)) for r in table.to_pylist() if r["sure_docs"]]
    return hashes[order], check[order] if checks else None, docs[order], places[order], sure


def _marks(found: list[tuple[np.ndarray, np.ndarray]], parts: int) -> pa.Table:
    """Places by hashed parts of the documents: few rows, whatever the number of documents."""
    docs = np.concatenate([np.zeros(0, np.int64), *(d for d, _ in found)])
    places = np.concatenate([np.zeros(0, np.int32), *(p for _, p in found)])
    part = (mix(docs.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((places, docs, part))
    docs, places, part = docs[order], places[order], part[order]
    rows = [(int(part[a]), _pack(docs[a:b]), _pack(places[a:b])) for a, b in runs(part)]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("part", pa.int32()), ("docs", pa.binary()), ("places", pa.binary())))})


def _per_document(table: pa.Table) -> pa.Table:
    """The distinct places of each document of a part."""
    rows = table.to_pylist()
    docs, places = np.concatenate([_unpack(r["docs"], np.int64) for r in rows]), np.concatenate([_unpack(r["places"], np.int32) for r in rows])
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (places[1:] != places[:-1])
    docs, places = docs[new], places[new]
    cuts = runs(docs)
    lists = pa.ListArray.from_arrays(pa.array([0, *(b for _, b in cuts)], pa.int32()), pa.array(places))
    return pa.table({"id": pa.array(docs[[a for a, _ in cuts]]), "places": lists})


def _match(parts: int):
    """Cogroup function of a bucket: merge-joins the new batch with the runs of the past; gives marks and the sorted new run."""

    def run(key, new: pa.Table, old: pa.Table) -> pa.Table:
        hashes, _, docs, places, found = _gather(new, False)
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = hashes[1:] != hashes[:-1]
        shared = ~fresh
        shared[:-1] |= ~fresh[1:]
        added = fresh.copy()
        for r in old.to_pylist():
            past = np.frombuffer(r["hashes"], np.uint64)
            at = np.searchsorted(past, hashes)
            at[at == len(past)] = 0
            hit = past[at] == hashes if len(past) else np.zeros(len(hashes), bool)
            shared |= hit
            added &= ~hit
            seen = np.unique(at[hit])
            found.append((np.frombuffer(r["docs"], np.int64)[seen], np.frombuffer(r["places"], np.int32)[seen]))
        marks = _marks([*found, (docs[shared], places[shared])], parts)
        mine = pa.table({"part": pa.array([None], pa.int32()), "docs": pa.array([docs[added].tobytes()], pa.binary()), "places": pa.array([places[added].tobytes()], pa.binary())})
        both = pa.concat_tables([marks, mine])
        n = marks.num_rows
        return both.append_column("bucket", pa.array([key[0].as_py()] * (n + 1), pa.int32())).append_column("hashes", pa.array([None] * n + [hashes[added].tobytes()], pa.binary()))

    return run


def _later(parts: int):
    """Group function of a bucket: places of all its windows but the first of each kind."""

    def run(table: pa.Table) -> pa.Table:
        hashes, check, docs, places, found = _gather(table, True)
        # A repeated row gives the same place twice: neither is later than the other.
        start = np.ones(len(hashes), bool)
        start[1:] = (hashes[1:] != hashes[:-1]) | (check[1:] != check[:-1])
        lead = np.maximum.accumulate(np.where(start, np.arange(len(hashes)), 0))
        later = (docs != docs[lead]) | (places != places[lead])
        return _marks([*found, (docs[later], places[later])], parts)

    return run


def _merge(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
    order = np.argsort(hashes, kind="stable")
    docs = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in rows])[order]
    places = np.concatenate([np.frombuffer(r["places"], np.int32) for r in rows])[order]
    return pa.table({"bucket": pa.array([rows[0]["bucket"]], pa.int32()), "hashes": [hashes[order].tobytes()], "docs": [docs.tobytes()], "places": [places.tobytes()]})


class FingerprintIndex:
    """A log-structured index in a folder: sorted immutable runs of anchor hashes by bucket, and the places marked so far.

    No hash is in two runs. Runs stand on levels: when a level has more than ``most_runs``, they are merged into one of the
    next level, so that an anchor is rewritten a logarithm of the number of batches times. A manifest lists what is valid;
    it is written after new tables and before superseded ones go, so that an index can be opened again, also after a failure
    half-way.
    """

    def __init__(self, spark: SparkSession, k: int = 20, buckets: int | None = None, most_runs: int = 2, folder: str | None = None):
        if k <= ANCHOR:
            raise ValueError(f"windows must be longer than {ANCHOR} words")
        self.spark, self.k, self.most_runs = spark, k, most_runs
        self.buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder or new_path(spark, "index")
        self.runs: list[str] = []
        self.levels: list[int] = []
        self.marks: list[str] = []
        #: Largest document id indexed; ids of the next batch must be larger. And that before the last batch.
        self.last: int | None = None
        self.before: int | None = None
        #: What was found in the last batch, for a caller that lost it.
        self.answer: str | None = None
        self.version = 0
        self._stale: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str, most_runs: int = 2) -> FingerprintIndex:
        """The index that ``save`` left in a folder."""
        row = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy(F.desc("version")).first()
        self = cls(spark, row.k, row.buckets, most_runs, folder)
        self.runs, self.levels, self.marks = list(row.runs), list(row.levels), list(row.marks)
        self.before, self.last, self.answer, self.version = row.before, row.last, row.answer, row.version
        return self

    def save(self) -> None:
        """Writes a manifest; then tables that it no longer lists go."""
        row = (self.version + 1, self.k, self.buckets, self.before, self.last, self.runs, self.levels, self.marks, self.answer)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        self.version += 1
        for path in self._stale:
            drop_path(self.spark, path)
        self._stale = []

    def _state(self) -> dict:
        return {k: list(v) if isinstance(v, list) else v for k, v in vars(self).items()}

    def _restore(self, state: dict) -> None:
        """Back to an earlier state; tables made since are deleted."""
        for path in {*self.runs, *self.marks, *self._stale} - {*state["runs"], *state["marks"], *state["_stale"]}:
            drop_path(self.spark, path)
        vars(self).update(state)

    def _new(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex}"

    def _past(self) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(*self.runs)

    def append(self, docs: DataFrame) -> None:
        """Adds a batch (id, text) whose ids are larger than all before, and the places that it marks, also in earlier batches."""
        low, high = docs.agg(F.min("id"), F.max("id")).first()
        if low is None:
            return
        if self.last is not None and low <= self.last:
            raise ValueError(f"ids of a batch must be larger than {self.last}")
        sent = docs.select("id", "text").mapInArrow(_anchor_rows(self.k, self.buckets), SENT)
        kind = MARKS + ", bucket int, hashes binary"
        both = sent.groupBy("bucket").cogroup(self._past().groupBy("bucket")).applyInArrow(_match(self.buckets), kind)
        path, run = self._new("match"), self._new("run")
        both.withColumn("is_run", F.col("part").isNull()).write.option("compression", "zstd").partitionBy("is_run").parquet(path)
        matched = self.spark.read.schema(kind + ", is_run boolean").parquet(path)
        matched.where("is_run AND length(hashes) > 0").select("bucket", "hashes", "docs", "places").write.option("compression", "zstd").parquet(run)
        drop_path(self.spark, f"{path}/is_run=true")
        self.runs.append(run)
        self.levels.append(0)
        self.marks.append(path)
        self.before, self.last, self.answer = self.last, high, None
        while self.levels.count(self.levels[-1]) > self.most_runs:
            self._merge_from(self.levels.index(self.levels[-1]))

    def _merge_from(self, at: int) -> None:
        """Merges the runs from place ``at`` on into one of the next level; old ones go with the next manifest, or at once if none lists them."""
        path = self._new("run")
        old = self.spark.read.schema(RUN).parquet(*self.runs[at:])
        old.groupBy("bucket").applyInArrow(_merge, RUN).write.option("compression", "zstd").parquet(path)
        self._stale += self.runs[at:]
        if not self.version:
            for gone in self._stale:
                drop_path(self.spark, gone)
            self._stale = []
        self.runs[at:], self.levels[at:] = [path], [self.levels[-1] + 1]

    def compact(self) -> None:
        """Merges all runs into one."""
        if len(self.runs) > 1:
            self.levels[-1] = max(self.levels)
            self._merge_from(0)

    def marked(self) -> DataFrame:
        """id and the distinct places of each document marked so far."""
        kind = MARKS + ", bucket int, hashes binary, is_run boolean"
        marks = self.spark.createDataFrame([], MARKS)
        for path in self.marks:
            marks = marks.union(self.spark.read.schema(kind).parquet(path).where("NOT is_run").select("part", "docs", "places"))
        return per_document(marks)


def per_document(marks: DataFrame) -> DataFrame:
    """id and the distinct places of each document in ``marks``."""
    return marks.groupBy("part").applyInArrow(_per_document, "id long, places array<int>")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def gone_words(n: int, places, k: int) -> np.ndarray:
    """Which of ``n`` words a removed window covers; ``places`` are the starts of removed windows."""
    edge = np.zeros(n + 1, np.int64)
    starts = np.unique(np.asarray(places, np.int64))
    starts = starts[starts + k <= n]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return np.cumsum(edge)[:-1] > 0


def strip(text: str, places, k: int) -> str:
    """The text without removed words: what stays is unchanged, and gaps become a line break if they held one, else a space."""
    spans = [m.span() for m in _WORD.finditer(text)]
    gone = gone_words(len(spans), places, k)
    if not gone.any():
        return text
    parts, at = [], None
    for a, b in runs(gone):
        if not gone[a]:
            if at is not None:
                parts.append("\n" if "\n" in text[at : spans[a][0]] else " ")
            begin, end = spans[a][0], spans[b - 1][1]
            parts.append(text[begin:end])
            at = end
    return "".join(parts)


def _digests(k: int):
    """Words, removed words and the digest of what is left of each document."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch):
                out = []
                for text, places in zip(part.column("text").to_pylist(), part.column("places").to_pylist(), strict=True):
                    words = text.encode().split()  # bytes split at exactly the six characters that end words
                    gone = gone_words(len(words), places, k) if places else np.zeros(0, bool)
                    removed = int(gone.sum())
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed else words
                    out.append((len(words), removed, hashlib.sha256(b" ".join(left)).hexdigest()))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["id", "n_words", "n_removed", "kept_sha256"])

    return run


def repeated_windows(rows: DataFrame, k: int = 20, batches: int = 3) -> DataFrame:
    """id and the starts (words) of windows that occur earlier: smaller id, or same id and smaller start. ``rows``: id (long), text."""
    spark, known = rows.sparkSession, rows.where("id IS NOT NULL")
    cuts, size = known.agg(F.percentile_approx("id", [i / batches for i in range(1, max(2, batches))], 1000), F.sum(F.octet_length("text"))).first()
    edges = [None, *sorted(set(cuts or [])), None] if batches > 1 else [None, None]
    with Scratch(spark, "substrings") as made:
        index = FingerprintIndex(spark, k, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // BUCKET_BYTES), folder=f"{made.folder}/index")
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            batch = known if low is None else known.where(F.col("id") > low)
            index.append(batch if high is None else batch.where(F.col("id") <= high))
        return write_table(_verified(made, known, index), "gone")


def _verified(made: Scratch, known: DataFrame, index: FingerprintIndex) -> DataFrame:
    """id and starts of windows that occur earlier, by all words of the windows about marked places."""
    marks = made.write(index.marked(), "marks")
    near, _ = maybe_in(known, "id", marks)
    sent = near.join(marks, "id").select("id", "text", "places").mapInArrow(_window_rows(index.k, index.buckets), SENT)
    return per_document(sent.groupBy("bucket").applyInArrow(_later(index.buckets), MARKS))


def repeats_of_batch(index: FingerprintIndex, batch: DataFrame, past: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The result of ``remove_repeats`` for the rows of a new batch alone, which enters the index; the index is saved.

    Ids of the batch must be larger than all indexed (else ValueError); rows with a null id come back whole. ``past`` holds
    the documents of earlier batches: only those with marked places are read again, to verify. What the index was built
    with holds for the window; an empty batch gives an empty result.

    The index is saved once the batch is verified. After a failure before that it stands as it was, and the batch can be
    given again; if it was saved and the caller lost the result, the same batch (the last one) gives it once more.
    """
    prepare(batch.sparkSession)
    rows, old = (d.select(F.col(id_column).cast("long").alias("id"), clean(text_column).alias("text")) for d in (batch, past))
    known = rows.where("id IS NOT NULL")
    low, high = known.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return _told(rows, batch.sparkSession.createDataFrame([], GONE), index.k, id_column)
    if index.answer and high == index.last and (index.before is None or low > index.before):
        return _told(rows, batch.sparkSession.read.schema(GONE).parquet(index.answer), index.k, id_column)
    first, state, answer = index.last, index._state(), index._new("answer")
    try:
        index.append(known)
        with Scratch(batch.sparkSession, "batch") as made:
            every = old.where(F.lit(first).isNotNull() & (F.col("id") <= F.lit(first))).union(known)
            gone = _verified(made, every, index)
            gone = gone.where(F.col("id") > first) if first is not None else gone
            gone.write.option("compression", "zstd").parquet(answer)
        if state["answer"]:
            index._stale.append(state["answer"])
        index.answer = answer
        index.save()
    except BaseException:
        drop_path(batch.sparkSession, answer)
        index._restore(state)
        raise
    return _told(rows, batch.sparkSession.read.schema(GONE).parquet(answer), index.k, id_column)


def remove_repeats(docs: DataFrame, k: int = 20, batches: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_words, n_removed and kept_sha256 (words that stay, joined by one space) of every row; see ``without_repeats`` for texts.

    A word goes if a window of ``k`` words over it occurs earlier (smaller id, or same id and smaller start); windows
    are judged on the input. Null texts have no words; rows with a null id come back whole and are not indexed; repeated
    rows each give a row and don't count as earlier than each other; rows that share an id are taken for repeats. Other
    columns are left out, ids are longs, an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), clean(text_column).alias("text"))
    return _told(rows, repeated_windows(rows, k, batches), k, id_column)


def _told(rows: DataFrame, gone: DataFrame, k: int, id_column: str) -> DataFrame:
    touched, rest = maybe_in(rows, "id", gone)
    schema = "id long, n_words long, n_removed long, kept_sha256 string"
    out = touched.join(gone, "id", "left").select("id", "text", "places").mapInArrow(_digests(k), schema)
    none = F.lit(None).cast("array<int>").alias("places")
    return out.union(rest.select("id", "text", none).mapInArrow(_digests(k), schema)).withColumnRenamed("id", id_column)


def without_repeats(docs: DataFrame, k: int = 20, batches: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with repeated words taken out of the text; see ``remove_repeats``.

    What stays keeps its white space; rows of which nothing stays are left out; untouched rows come back as they are,
    null texts included. A column n_chars is counted anew where words went.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), clean(text_column).alias("text"))
    gone = repeated_windows(rows, k, batches).select(F.col("id").alias("gone id"), F.col("places").alias("gone places"))
    touched, rest = maybe_in(docs, id_column, gone, "gone id")

    @F.pandas_udf("string")
    def stripped(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([t if p is None else strip(t, p, k) for t, p in zip(texts, places, strict=True)], dtype=object)

    joined = touched.join(gone, F.col(id_column).cast("long") == F.col("gone id"), "left")
    hit = joined.where(F.col("gone id").isNotNull()).withColumn(text_column, stripped(F.col(text_column), F.col("gone places"))).where(F.col(text_column) != "")
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.char_length(text_column).cast(docs.schema["n_chars"].dataType))
    missed = joined.where(F.col("gone id").isNull())
    return rest.select(docs.columns).union(hit.select(docs.columns)).union(missed.select(docs.columns))
