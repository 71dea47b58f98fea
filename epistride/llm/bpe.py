"""Operator 8: byte-level BPE by a distinct-word table, and decoding by a join with the table of pieces.

Spark splits texts into words by the vocabulary's pattern. Each block of texts keeps its words as codes into its own list
of distinct words; the lists go to buckets by word, where each distinct word is encoded once; the ids go back to the
blocks and are put in place of the codes. So only lists of distinct words cross the network twice, and the codes once.
For decoding, the distinct ids of each block are joined with the table of ids and pieces (one row an id), and the joined
pieces meet the block's ids: a block knows no piece but those that the join gave it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.llm.common import Scratch, clean, drop_path, prepare, text_bytes, write_table
from epistride.llm.hashing import ranges, runs, span_hashes, text_buffers
from epistride.llm.tokens import default_vocabulary, encoder

# Unicode's white space, and the pattern of the byte-level vocabulary in Java's syntax.
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
SPECIAL = "<|endoftext|>"
#: Pieces of text that begin with their white space: no token reaches across, whatever the other characters are.
SAFE = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"

#: Words (with repeats) and their bytes from which a block is full: its codes and its word list are held by one task.
BLOCK_WORDS = 6_000_000
BLOCK_BYTES = 32 << 20
#: Bytes of text that a bucket of words stands for.
BUCKET_BYTES = 64 << 20
#: Rows of a table of pieces up to which it is broadcast (about 30 MB); a larger one is joined by a shuffle.
PIECES = 1 << 20
BLOCK_ROW = "block long, bucket int, docs array<long>, counts array<int>, codes binary, words binary"


def words_of(text: Column) -> Column:
    """Words of a text, in order; they join to the text again. A special string is a word by itself.

    A text with characters that this Java doesn't know is split before white space alone; the library splits its words further.
    """
    split = lambda x: F.regexp_extract_all(x, F.lit(PATTERN), F.lit(0))
    parts = F.split(text, r"<\|endoftext\|>", -1)
    marked = F.flatten(F.transform(parts, lambda x, i: F.when(i > 0, F.concat(F.array(F.lit(SPECIAL)), split(x))).otherwise(split(x))))
    return F.when(text.rlike(r"\p{Cn}"), F.regexp_extract_all(text, F.lit(SAFE), F.lit(0))).when(F.contains(text, F.lit(SPECIAL)), marked).otherwise(split(text))


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Whole numbers below 2**32 by groups of seven bits: each group that numbers still need is compressed by itself."""
    parts = []
    for a in arrays:
        rest = np.asarray(a, np.uint32)
        parts.append(b"")
        planes = 0
        while planes == 0 or len(rest):
            more = rest >= 128
            packed = zstandard.compress(((rest & 127) | (more * np.uint32(128))).astype(np.uint8).tobytes(), 3)
            parts += [np.array([len(rest), len(packed)], "<u4").tobytes(), packed]
            rest, planes = rest[more] >> 7, planes + 1
        parts[-2 * planes - 1] = np.array([planes], "<u4").tobytes()
    return b"".join(parts)


def _unsqueeze(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        (planes,) = np.frombuffer(data, "<u4", 1, at).tolist()
        at += 4
        for k in range(planes):
            n, size = np.frombuffer(data, "<u4", 2, at).tolist()
            at += 8
            part = np.frombuffer(zstandard.decompress(data[at : at + size]), np.uint8) if n else np.zeros(0, np.uint8)
            at += size
            if k == 0:
                a, where = np.zeros(n, np.uint32), np.arange(n)
            a[where] |= (part & 127).astype(np.uint32) << np.uint32(7 * k)
            where = where[part >= 128]
        out.append(a)
    return out


class _Block:
    """Codes of some documents and their distinct words."""

    def __init__(self):
        self.code: dict[str, int] = {}
        self.ids: list = []
        self.counts: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.words = self.bytes = 0

    def add(self, ids: pa.Array, words: pa.ListArray) -> None:
        flat = words.flatten()
        self.bytes += pc.sum(pc.binary_length(flat)).as_py() or 0
        flat = flat.dictionary_encode()
        code = self.code
        new = np.array([code.setdefault(w, len(code)) for w in flat.dictionary.to_pylist()], np.uint32)
        self.codes.append(new[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint32))
        self.counts.append(np.diff(words.offsets.to_numpy()))
        self.ids += ids.to_pylist()
        self.words += len(flat)

    def rows(self, block: int, buckets: int):
        codes = np.concatenate(self.codes)
        order = np.argsort(-np.bincount(codes, minlength=len(self.code)), kind="stable")  # common words get small codes
        small = np.empty(len(order), np.uint32)
        small[order] = np.arange(len(order))
        yield block, -1, self.ids, np.concatenate(self.counts), _squeeze(small[codes]), None
        words = pa.array(list(self.code), pa.string()).take(pa.array(order))
        data, offsets = text_buffers(words)
        bucket = (span_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for a, b in runs(bucket[order]):
            own = order[a:b]
            some = words.take(pa.array(own))
            text, ends = text_buffers(some)
            yield block, int(bucket[own[0]]), None, None, _squeeze(own, np.diff(ends)), zstandard.compress(text.tobytes(), 3)


def _blocks(buckets: int):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        block = _Block()

        def send(block):
            rows = list(block.rows(number, buckets))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            names = [x.split()[0] for x in BLOCK_ROW.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                block.add(some.column("id"), some.column("words"))
                if block.words >= BLOCK_WORDS or block.bytes >= BLOCK_BYTES:
                    yield send(block)
                    number, block = number + 1, _Block()
        if block.ids:
            yield send(block)

    return run


def _encode(path: str):
    """Group function of a bucket: encodes each distinct word once and gives every block the ids of its words, and which they are."""

    def run(table: pa.Table) -> pa.Table:
        enc = encoder(path).slow
        rows = table.select(["block", "codes", "words"]).to_pylist()
        lists = []
        for r in rows:
            codes, sizes = _unsqueeze(r["codes"])
            text = zstandard.decompress(r["words"])
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))
            lists.append((codes, pa.LargeStringArray.from_buffers(len(codes), pa.py_buffer(ends), pa.py_buffer(text))))
        every = pa.chunked_array([x for _, x in lists]).combine_chunks().dictionary_encode()
        distinct = every.dictionary.to_pylist()
        ids: list[list[int]] = []
        for i in range(0, len(distinct), 1024):
            ids += [e.ids for e in enc.encode_batch_fast(distinct[i : i + 1024], add_special_tokens=False)]
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.array([y for x in ids for y in x], np.uint32)
        first = np.concatenate(([0], np.cumsum(n)))
        at, out = 0, []
        indices = every.indices.to_numpy()
        for r, (codes, _) in zip(rows, lists, strict=True):
            own = indices[at : at + len(codes)]
            at += len(codes)
            its = flat[ranges(first[own], n[own])]
            out.append((r["block"], _squeeze(codes, n[own], its), np.unique(its).astype(np.int32)))
        return pa.table({"block": pa.array([r[0] for r in out], pa.int64()), "ids": pa.array([r[1] for r in out], pa.binary()), "used": pa.array([r[2] for r in out], pa.list_(pa.int32()))})

    return run


def _place(with_ids: bool):
    """Cogroup function of a block: puts the ids of words in place of their codes, document by document, and decodes them by the joined pieces."""

    def run(key, coded: pa.Table, joined: pa.Table) -> pa.Table:
        encoded, pieces = joined.filter(pc.field("ids").is_valid()), joined.filter(pc.field("ids").is_null())
        piece = dict(zip(pieces.column("number").to_pylist(), pieces.column("piece").to_pylist(), strict=True))
        row = coded.to_pylist()[0]
        codes = _unsqueeze(row["codes"])[0] if row["codes"] else np.zeros(0, np.uint32)
        size = int(codes.max()) + 1 if len(codes) else 0
        start, count, parts, at = np.zeros(size, np.int64), np.zeros(size, np.int64), [np.zeros(0, np.uint32)], 0
        for data in encoded.column("ids").to_pylist():
            own, n, ids = _unsqueeze(data)
            start[own], count[own] = at + np.cumsum(n, dtype=np.int64) - n, n
            parts.append(ids)
            at += len(ids)
        table = np.concatenate(parts)
        out, begin = [], 0
        for n in row["counts"]:
            own = codes[begin : begin + n]
            begin += n
            ids = table[ranges(start[own], count[own])].astype("<u4")
            data, text = ids.tobytes(), b"".join(map(piece.__getitem__, ids.tolist()))
            if with_ids:
                out.append((len(ids), data, text.decode("utf-8", "replace")))
            else:
                out.append((len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(text).hexdigest()))
        names = ["id", "n_tokens", "ids", "decoded"] if with_ids else ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        kinds = [pa.int64(), pa.binary() if with_ids else pa.string(), pa.string()]
        return pa.table([pa.array(row["docs"], pa.int64()), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=names)

    return run


def pieces_of(spark: SparkSession, vocabulary: str) -> DataFrame:
    """number and piece (bytes) of every id of a vocabulary."""
    pieces = encoder(vocabulary).pieces
    table = pa.table({"number": pa.array(list(pieces), pa.int32()), "piece": pa.array(list(pieces.values()), pa.binary())})
    rows = spark.createDataFrame(table)
    return F.broadcast(rows) if len(pieces) <= PIECES else rows


def encode_and_decode(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every row; with_ids: ids (little-endian unsigned 32-bit) and decoded text instead.

    Null texts count as empty (no ids); repeated rows each give a row; ids of rows are longs and may be null; other columns
    are left out; an empty table gives an empty result; texts are split and encoded whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = vocabulary or default_vocabulary()
    texts = docs.select(F.col(id_column).cast("long").alias("id"), clean(text_column).alias("text"))
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), text_bytes(texts) // BUCKET_BYTES)
    rows = texts.select("id", words_of(F.col("text")).alias("words"))
    with Scratch(spark, "bpe") as made:
        at = f"{made.folder}/blocks"
        blocks = rows.mapInArrow(_blocks(buckets), BLOCK_ROW).withColumn("listed", F.col("bucket") >= 0)
        blocks.write.option("compression", "zstd").partitionBy("listed").parquet(at)
        blocks = spark.read.schema(blocks.schema).parquet(at)
        words = blocks.where("listed").select("block", "bucket", "codes", "words")
        encoded = made.write(words.groupBy("bucket").applyInArrow(_encode(path), "block long, ids binary, used array<int>"), "encoded")
        drop_path(spark, f"{at}/listed=true")
        used = encoded.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("used"))).alias("used"))  # no more than the block has words
        used = used.select("block", F.explode("used").alias("number"))
        pieces = used.join(pieces_of(spark, path), "number").select("block", F.lit(None).cast("binary").alias("ids"), "number", "piece")
        joined = encoded.select("block", "ids", F.lit(None).cast("int").alias("number"), F.lit(None).cast("binary").alias("piece")).union(pieces)
        schema = "id long, n_tokens long, " + ("ids binary, decoded string" if with_ids else "ids_sha256 string, decoded_sha256 string")
        coded = spark.read.schema(blocks.schema).parquet(at).where("NOT listed").select("block", "docs", "counts", "codes")
        out = write_table(coded.groupBy("block").cogroup(joined.groupBy("block")).applyInArrow(_place(with_ids), schema), "encoded")
    return out.withColumnRenamed("id", id_column)
