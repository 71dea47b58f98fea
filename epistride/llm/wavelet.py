"""Operator 12: token ids in shards that each hold a wavelet matrix, so that one compressed file answers access, counts and lookups.

A shard is one Parquet file of one row: the documents in ascending order with the ends of their tokens, and a bit plane for
each binary digit of the ids, highest first. A plane has the digit of every token in the order that the planes above leave
them in, those with a 0 before those with a 1, and the number of ones before each block of 512 bits. A token is read by
following its position down the planes, the occurrences of an id by narrowing a range of positions, and the places of
these by going up again. Shards are ranges of documents, of about as many tokens each, and no document is cut.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epistride.llm.common import Scratch, by_bytes, clean, drop_path, new_path, prepare, write_table
from epistride.llm.hashing import text_buffers
from epistride.llm.tokens import byte_of_character

#: Tokens of a shard; only a longer document makes a longer one.
SHARD_TOKENS = 1 << 20
#: Bits whose ones are counted together.
BLOCK = 512
#: Bytes of a word that takes the quick way.
WORD_BYTES = 256
#: The id at the end of each document.
END = 2

ENCODED = "tie long, n_tokens long, ids binary"
SHARD = "part int, place int, documents array<struct<id: {kind}, tokens: bigint>>, n_tokens long, zeros array<bigint>, planes array<binary>, ones array<binary>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Stands for the end of a word's part inside the fast encoder; words that hold it go through the library.
MARK = "\x01"
_LETTERS, _PUNCTUATION = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!\"#$%&()*+,\-./:;<=>?@\[\]^_`{|}~\\\\"
_PLAIN = rf"^[{_LETTERS}0-9{_PUNCTUATION}]+$"
_PART = rf"([{_LETTERS}]+|[0-9]|[{_PUNCTUATION}]+)"


@functools.lru_cache(maxsize=4)
def is_proper(path: str) -> bool:
    """Whether merging whatever gives the piece of lowest id is the same as going through the vocabulary's merges.

    It is where pieces of one character come before all merges, ids of merges ascend in their order, and each piece,
    merged from its characters, gives itself: no merge reaches over the borders of two pieces that stand side by side, so
    that they are what they would be alone, which is the pair that the vocabulary lists.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != _SUFFIX or any(model.get(k) for k in ("continuing_subword_prefix", "dropout", "byte_fallback", "unk_token")):
        return False
    ids, made = model["vocab"], {}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    order = {m: i for i, m in enumerate(merges)}
    at = [ids[a + b] for a, b in merges]
    single = [*byte_of_character(), *(c + _SUFFIX for c in byte_of_character())]
    if at != sorted(set(at)) or not all(c in ids for c in single) or max(ids[c] for c in single) > at[0]:
        return False
    for a, b in merges:
        piece, end = (a + b, "") if not b.endswith(_SUFFIX) else ((a + b)[: -len(_SUFFIX)], _SUFFIX)
        parts = [*piece[:-1], piece[-1] + end]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (order.get((parts[i], parts[i + 1]), len(order)), i))
            if (parts[best], parts[best + 1]) not in order:
                return False
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        made[a + b] = True
    return len(made) == len(merges)


_SUFFIX = "</w>"


class WordEncoder:
    """Ids of texts by a tokenizer whose tokens never reach across ASCII white space: each distinct word of a batch is encoded once.

    Normal forms, lower case, special strings and the split into words all stop at white space, which gives no token itself.
    Plain words (Latin letters, digits and ASCII punctuation without the apostrophe) are cut into their parts and merged by a
    quicker encoder of the same pieces if the vocabulary is ``proper``; other words go through the library.
    """

    def __init__(self, path: str, proper: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import tiktoken
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = None
        if proper:
            with open(path, encoding="utf-8") as f:
                file = json.load(f)
            special, table = {t["content"] for t in file["added_tokens"]}, byte_of_character()
            ranks = {}
            for piece, i in file["model"]["vocab"].items():
                if piece not in special:
                    ends = piece.endswith(_SUFFIX)
                    ranks[bytes(table[c] for c in (piece[: -len(_SUFFIX)] if ends else piece)) + (MARK.encode() if ends else b"")] = i
            self.fast = tiktoken.Encoding("own", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})
            self.ends = np.zeros(max(ranks.values()) + 1, bool)
            self.ends[[i for b, i in ranks.items() if len(b) > 1 and b.endswith(MARK.encode())]] = True

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words, one after the other, and the number of each."""
        plain = np.zeros(len(words), bool)
        if self.fast is not None:
            short = pc.less_equal(pc.binary_length(words), WORD_BYTES)
            plain = pc.and_(pc.and_(pc.match_substring_regex(words, _PLAIN), short), pc.invert(pc.match_substring(words, "<|"))).to_numpy(zero_copy_only=False)
        counts = np.zeros(len(words), np.int64)
        some = words.filter(pa.array(plain))
        parts = pc.count_substring_regex(some, _PART).to_numpy(zero_copy_only=False).astype(np.int64)
        marked = pc.replace_substring_regex(pc.utf8_lower(some), _PART, r"\1" + MARK)
        told = text_buffers(marked)[0].tobytes().decode()
        quick = self.fast.encode_to_numpy(told, disallowed_special=()) if told else np.zeros(0, np.uint32)
        # A word ends with the last of its parts.
        ends = (np.flatnonzero(self.ends[quick]) + 1)[np.cumsum(parts) - 1] if len(some) else np.zeros(0, np.int64)
        counts[plain] = np.diff(ends, prepend=0)
        rest = self.library.encode_batch_fast(words.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)
        slow = [np.array(x.ids, np.uint32) for x in rest]
        counts[~plain] = [len(x) for x in slow]
        out = np.empty(int(counts.sum()), np.uint32)
        at = np.repeat(plain, counts)
        out[at] = quick
        out[~at] = np.concatenate([np.zeros(0, np.uint32), *slow])
        return out, counts

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the number of each."""
        words = pc.ascii_split_whitespace(texts)
        lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        at = coded.indices.to_numpy(zero_copy_only=False)
        pool, sizes = self._distinct(coded.dictionary)
        begins = np.cumsum(sizes) - sizes
        per_word = sizes[at]
        upto = np.concatenate(([0], np.cumsum(per_word)))
        out = pool[np.arange(upto[-1]) + np.repeat(begins[at] - upto[:-1], per_word)]
        ends = np.cumsum(lengths)
        return out, upto[ends] - upto[ends - lengths]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, proper: bool) -> WordEncoder:
    return WordEncoder(path, proper)


@dataclass
class Matrix:
    """A wavelet matrix of ``n`` ids: planes from the highest digit down, each with its number of zeros and its counts of ones."""

    n: int
    zeros: list[int]
    planes: list[np.ndarray]  # packed bits, lowest first, with whole blocks
    ones: list[np.ndarray]  # before each block, and at the end

    @classmethod
    def of(cls, ids: np.ndarray) -> Matrix:
        """The matrix of uint32 ids; there are as many planes as the largest id has digits."""
        n, zeros, planes, ones = len(ids), [], [], []
        width = int(ids.max()).bit_length() if n else 0
        if width <= 16:
            ids = ids.astype(np.uint16)
        for digit in range(width - 1, -1, -1):
            bit = (ids >> digit) & 1 == 1
            padded = np.zeros(-(-n // BLOCK) * BLOCK, bool)
            padded[:n] = bit
            zeros.append(int(n - np.count_nonzero(bit)))
            planes.append(np.packbits(padded, bitorder="little"))
            ones.append(np.concatenate(([0], np.cumsum(np.count_nonzero(padded.reshape(-1, BLOCK), axis=1)))).astype(np.int64))
            ids = np.concatenate([ids[~bit], ids[bit]])
        return cls(n, zeros, planes, ones)

    def _rank(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        block, rest = np.divmod(at, BLOCK)
        packed = np.concatenate([self.planes[plane], np.zeros(BLOCK // 8, np.uint8)]).reshape(-1, BLOCK // 8)
        inside = np.zeros(len(at), np.int64)
        for lo in range(0, len(at), 1 << 14):
            some = slice(lo, lo + (1 << 14))
            bits = np.unpackbits(packed[block[some]], axis=1, bitorder="little")
            inside[some] = np.count_nonzero(bits & (np.arange(BLOCK) < rest[some, None]), axis=1)
        return self.ones[plane][block] + inside

    def _select(self, plane: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """The position of the nth (from 0) one or zero of a plane."""
        before = self.ones[plane] if bit else np.arange(len(self.ones[plane])) * BLOCK - self.ones[plane]
        block = np.searchsorted(before, nth, side="right") - 1
        packed = self.planes[plane].reshape(-1, BLOCK // 8)
        out = np.zeros(len(nth), np.int64)
        for lo in range(0, len(nth), 1 << 12):
            some = slice(lo, lo + (1 << 12))
            bits = np.unpackbits(packed[block[some]], axis=1, bitorder="little") == bit
            out[some] = np.argmax(np.cumsum(bits, axis=1) > (nth[some] - before[block[some]])[:, None], axis=1)
        return block * BLOCK + out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at some positions."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.uint32)
        for i, zeros in enumerate(self.zeros):
            bit = (self.planes[i][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out = (out << np.uint32(1)) | bit
            ones = self._rank(i, at)
            at = np.where(bit, zeros + ones, at - ones)
        return out

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id between two positions stand below the last plane."""
        if token >> len(self.zeros):
            return 0, 0
        ends = np.array([begin, end], np.int64)
        for i, zeros in enumerate(self.zeros):
            ones = self._rank(i, ends)
            ends = zeros + ones if token >> (len(self.zeros) - 1 - i) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of an id from ``begin`` to before ``end``."""
        lo, hi = self._range(token, begin, self.n if end is None else end)
        return hi - lo

    def find(self, token: int) -> np.ndarray:
        """The positions of all occurrences of an id, ascending."""
        lo, hi = self._range(token, 0, self.n)
        at = np.arange(lo, hi)
        for i in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - i) & 1
            at = self._select(i, bit, at - self.zeros[i] if bit else at)
        return at

    def all(self) -> np.ndarray:
        """All ids in order, plane by plane from the lowest."""
        width = len(self.zeros)
        out = np.zeros(self.n, np.uint16 if width <= 16 else np.uint32)
        for i in range(width - 1, -1, -1):
            bit = np.unpackbits(self.planes[i], bitorder="little")[: self.n].view(bool)
            up = np.empty_like(out)
            up[~bit], up[bit] = out[: self.zeros[i]], out[self.zeros[i] :]
            up |= bit.astype(out.dtype) << (width - 1 - i)
            out = up
        return out.astype(np.uint32)


def matrix_of(row: dict) -> Matrix:
    """The matrix in a row of a shard's file."""
    return Matrix(row["n_tokens"], row["zeros"], [np.frombuffer(p, np.uint8) for p in row["planes"]], [np.frombuffer(o, "<i8") for o in row["ones"]])


def _pack(ids: np.ndarray) -> bytes:
    """Ids compressed for their way through a shuffle, in 16 bits each where they fit."""
    wide = len(ids) and ids.max() > 0xFFFF
    return (b"\1" if wide else b"\0") + pa.compress(ids.astype("<u4" if wide else "<u2").tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    kind = np.dtype("<u4" if data[0] else "<u2")
    return np.frombuffer(pa.decompress(data[1:], n * kind.itemsize, codec="zstd", asbytes=True), kind)


def encoded(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text", end_id: int = END) -> DataFrame:
    """id, tie (a hash of the text), n_tokens and ids (packed, the end id last) of each row."""
    path = vocabulary or default_vocabulary()
    proper = is_proper(path)

    def run(batches):
        enc = word_encoder(path, proper)
        for batch in batches:
            for part in by_bytes(batch):
                ids, counts = enc.batch(part.column("text"))
                ends = np.cumsum(counts)
                out = [_pack(np.append(ids[b - n : b], np.uint32(end_id))) for n, b in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tie"), pa.array(counts + 1, pa.int64()), pa.array(out, pa.binary())], ["id", "tie", "n_tokens", "ids"])

    rows = docs.select(F.col(id_column).alias("id"), clean(text_column).alias("text")).withColumn("tie", F.xxhash64("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {ENCODED}")


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text", end_id: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the token ids of all documents to ``path``, one file a shard, in ascending order of their ids.

    Null texts count as empty and hold the end id alone; rows with equal ids are ordered by a hash of their text, and null
    ids come first; an empty table gives no shard; other columns are left out; texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    with Scratch(spark, "wavelet") as made:
        tokens = made.write(encoded(docs, vocabulary, id_column, text_column, end_id), "tokens")
        total = tokens.agg(F.sum("n_tokens").alias("n")).first().n or 0
        # About four shards a task; ranges are those of rows, so that a task may hold more where documents are longer.
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * shard_tokens)))
        kind = dict(tokens.dtypes)["id"]

        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, place, held, names, size, schema = TaskContext.get().partitionId(), 0, [], [], 0, None

            def shard():
                matrix = Matrix.of(np.concatenate(held).astype(np.uint32))
                documents = [{"id": i, "tokens": len(x)} for i, x in zip(names, held, strict=True)]
                row = [part, place, documents, matrix.n, matrix.zeros, [p.tobytes() for p in matrix.planes], [o.astype("<i8").tobytes() for o in matrix.ones]]
                return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema.names)

            for batch in batches:
                schema = schema or _shard_schema(batch.schema.field("id").type)
                for i, n, ids in zip(*(batch.column(c).to_pylist() for c in ("id", "n_tokens", "ids")), strict=True):
                    if held and size + n > shard_tokens:
                        yield shard()
                        place, held, names, size = place + 1, [], [], 0
                    held.append(_unpack(ids, n))
                    names.append(i)
                    size += n
            if held:
                yield shard()

        dealt = tokens.repartitionByRange(tasks, "id", "tie").sortWithinPartitions("id", "tie", "ids").select("id", "n_tokens", "ids")
        rows = dealt.mapInArrow(shards, SHARD.format(kind=kind))
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)


def _shard_schema(kind: pa.DataType) -> pa.Schema:
    documents = pa.list_(pa.struct([("id", kind), ("tokens", pa.int64())]))
    kinds = [pa.int32(), pa.int32(), documents, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
    return pa.schema(list(zip(("part", "place", "documents", "n_tokens", "zeros", "planes", "ones"), kinds, strict=True)))


#: Tasks whose shards are summed as one group.
GROUP = 1024
#: Shards whose starts may be broadcast: 24 bytes each.
STARTS = 1 << 20


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, place, start (tokens of all shards before it) and n_tokens of each shard at ``path``; planes are not read.

    Sums go by groups of GROUP tasks: one row a group is ordered by a single task.
    """
    rows = spark.read.parquet(path).select("part", "place", "n_tokens", F.floor(F.col("part") / GROUP).alias("group"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("group").agg(F.sum("n_tokens").alias("total"))
    totals = totals.select("group", F.sum("total").over(before.orderBy("group")).alias("groups_before"))
    inside = F.sum("n_tokens").over(before.partitionBy("group").orderBy("part", "place"))
    start = F.coalesce("groups_before", F.lit(0)) + F.coalesce("inside", F.lit(0))
    return rows.withColumn("inside", inside).join(totals, "group").select("part", "place", start.alias("start"), "n_tokens")


def _matrix(row: dict) -> Matrix:
    return Matrix(row["n_tokens"], row["zeros"], [np.frombuffer(p, np.uint8) for p in row["planes"]], [np.frombuffer(o, "<i8") for o in row["ones"]])


def _kind(shards: DataFrame) -> str:
    """The type of the documents' ids."""
    return shards.schema["documents"].dataType.elementType["id"].dataType.simpleString()


def documents(spark: SparkSession, path: str) -> DataFrame:
    """id, start (tokens of all documents before it), n_tokens and ids (little-endian, 32 bits) of each document, read from the shards at ``path``."""
    shards = spark.read.parquet(path)
    kind = _kind(shards)

    def run(batches):
        for batch in batches:
            for one in range(batch.num_rows):  # a shard at a time
                row = batch.slice(one, 1).to_pylist()[0]
                data = _matrix(row).all().astype("<u4").tobytes()
                counts = np.array([d["tokens"] for d in row["documents"]], np.int64)
                ends = np.cumsum(counts)
                names = pa.array([d["id"] for d in row["documents"]], batch.schema.field("documents").type.value_type.field("id").type)
                ids = [data[4 * (b - n) : 4 * b] for n, b in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names, pa.array(row["start"] + ends - counts), pa.array(counts), pa.array(ids, pa.binary())], ["id", "start", "n_tokens", "ids"])

    where = starts(spark, path).select("part", "place", "start")
    if shards.count() <= STARTS:  # else the planes are shuffled
        where = F.broadcast(where)
    return shards.join(where, ["part", "place"]).mapInArrow(run, f"id {kind}, start long, n_tokens long, ids binary")


def count_of(spark: SparkSession, path: str, tokens: Iterable[int]) -> DataFrame:
    """token and n, its occurrences, for each of some token ids, from ranks alone; ids that don't occur have 0, repeated ones count once."""
    wanted = sorted(set(tokens))

    def run(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                matrix = _matrix(batch.slice(one, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([matrix.count(t) for t in wanted], pa.int64())], ["token", "n"])

    counted = spark.read.parquet(path).select("n_tokens", "zeros", "planes", "ones").mapInArrow(run, "token long, n long")
    none = spark.createDataFrame([(t, 0) for t in wanted], "token long, n long")
    return counted.unionByName(none).groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, tokens: Iterable[int]) -> DataFrame:
    """token, id and place (from 0, in its document) of every occurrence of some token ids, by selects from the planes."""
    shards, wanted = spark.read.parquet(path).select("documents", "n_tokens", "zeros", "planes", "ones"), sorted(set(tokens))

    def run(batches):
        for batch in batches:
            kind = batch.schema.field("documents").type.value_type.field("id").type
            for one in range(batch.num_rows):
                row = batch.slice(one, 1).to_pylist()[0]
                matrix, names = _matrix(row), pa.array([d["id"] for d in row["documents"]], kind)
                begins = np.concatenate(([0], np.cumsum([d["tokens"] for d in row["documents"]])))
                for token in wanted:
                    at = matrix.find(token)
                    which = np.searchsorted(begins, at, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), token, np.int64)), names.take(pa.array(which)), pa.array(at - begins[which])], ["token", "id", "place"])

    return shards.mapInArrow(run, f"token long, id {_kind(shards)}, place long")


#: Positions that are read from a shard at once.
POSITIONS = 1 << 16


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """position and token of each distinct ``position`` in the sequence of all tokens; null ones and those beyond its end are left out."""
    where = starts(spark, path).where("n_tokens > 0").withColumn("end", F.col("start") + F.col("n_tokens"))
    bucket = lambda c: F.floor(c / POSITIONS)  # noqa: E731  a shard lies in few buckets, a position in one
    where = where.withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end") - 1))))
    asked = positions.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct().withColumn("bucket", bucket(F.col("position")))
    found = asked.join(where, "bucket").where("position >= start AND position < end")
    chunks = found.groupBy("part", "place", "start", "bucket").agg(F.collect_list("position").alias("positions"))  # at most POSITIONS

    def run(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                row = batch.slice(one, 1).to_pylist()[0]
                at = np.array(row["positions"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(_matrix(row).access(at - row["start"]).astype(np.int64))], ["position", "token"])

    shards = spark.read.parquet(path).select("part", "place", "n_tokens", "zeros", "planes", "ones")
    return chunks.join(shards, ["part", "place"]).mapInArrow(run, "position long, token long")


def store_and_read(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text", end_id: int = END) -> DataFrame:
    """Writes the shards of ``docs`` and reads the documents back: id, start, n_tokens and ids_crc32 (unsigned) of each; see ``write_shards``."""
    spark = docs.sparkSession
    path = new_path(spark, "shards")
    write_shards(docs, path, vocabulary, id_column, text_column, end_id)
    # CRC-32 of Spark is that of the bytes, unsigned.
    out = write_table(documents(spark, path).select(F.col("id").alias(id_column), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")), "read")
    drop_path(spark, path)
    return out
