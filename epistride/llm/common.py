"""Shared pieces: written tables in the shared folder, batches bounded by bytes, clean inputs."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch; texts may be long, and a batch is held whole by a Python worker.
ARROW_ROWS = 1000
#: Bytes of text that an operator handles at once inside a batch (one longer text is handled alone).
CHUNK_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches for tables with long texts; results are lazy, so the session keeps the bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


@functools.cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='epistride-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; where it is unset, one of our own, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    return (where or _own_folder()).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/epistride/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends here and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written tables of one operator: gone when the block ends, and a name's older table as soon as it is written anew."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, new_path(spark, name), {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        drop_path(self.spark, self.folder)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that no later plan reads."""
        if name in self.paths:
            drop_path(self.spark, self.paths.pop(name))


def text_bytes(rows: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: what buckets are counted by."""
    return rows.agg(F.sum(F.octet_length(column)).alias("n")).first().n or 0


def clean(text) -> F.Column:
    """Null text counts as empty."""
    return F.coalesce(text if not isinstance(text, str) else F.col(text), F.lit(""))


def by_bytes(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes in ``column``, or one row."""
    offsets = batch.column(column)
    ends = pc.cumulative_sum(pc.cast(pc.binary_length(offsets).fill_null(0), pa.int64())).to_numpy(zero_copy_only=False)
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(ends.searchsorted(base + most, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


#: A filter has 2**23 bits, which is 1 MB.
FILTER_BITS = 23


def id_filter(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> bytes:
    """A bitmap of ``2**bits`` bits (1 MB at 23) of hashed ids: rows that miss it are surely not in ``ids``.

    Its size is fixed, whatever the table: with very many ids it fills up and no longer spares work, and the
    exact join after it stays as it is.
    """
    slot = filter_slot(column, bits)
    rows = (
        ids.select(slot.alias("b"))
        .groupBy(F.bitmap_bucket_number("b").alias("k"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
        .collect()
    )
    out = bytearray((1 << bits) // 8)
    for k, chunk in rows:
        at = (k - 1) * 4096
        out[at : at + 4096] = chunk
    return bytes(out)


def filter_slot(column: str, bits: int = FILTER_BITS) -> F.Column:
    """1 to 2**bits: bitmap buckets count from 1."""
    return F.xxhash64(F.col(column)).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(1)


def in_filter(bitmap: bytes, slots):
    """Which of the slots of ``filter_slot`` are set. Bit position of slot s is (s - 1) modulo the bucket."""
    import numpy as np

    at = np.asarray(slots, dtype=np.int64) - 1
    return (np.frombuffer(bitmap, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def maybe_in(rows: DataFrame, column: str, some: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows whose long ``column`` may be in ``some[key]``, and rows where it surely isn't: only the former need a join."""
    bitmap = id_filter(some, key)

    @F.pandas_udf("boolean")
    def maybe(slot: pd.Series) -> pd.Series:
        return pd.Series(in_filter(bitmap, slot.to_numpy()))

    hit = maybe(F.xxhash64(F.col(column).cast("long")).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + F.lit(1))
    return rows.where(hit), rows.where(~hit)
