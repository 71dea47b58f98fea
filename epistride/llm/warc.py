"""Operator 5: WARC archives with segmented, chunked records; reading reassembles segments and decodes the framing.

Records go through Spark's text sink (a record is valid UTF-8 and its terminator is the line separator), so lost tasks
leave no partial archive. Archives are read as binary files; whole records are decoded where they are parsed, and only
segments are grouped by their origin, ordered by number and checked against the stated total.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.llm.common import Scratch, by_bytes, drop_path, maybe_in, new_path, prepare, write_table

#: Payloads from so many bytes are stored once; blocks beyond SEGMENT bytes are split; CHUNK is a transfer chunk.
LEAST_BYTES = 1000
SEGMENT = 16_384
CHUNK = 4_096
#: Records of an archive file: a record holds SEGMENT bytes and its header at most, however long the page, so that an archive
#: holds about 33 MB before compression, and so does the task that reads it.
RECORDS = 2_000
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

_READ = "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, problem string, payload binary"


def chunked(body: bytes) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(x), x) for x in _cuts(body, CHUNK) if x]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """Decodes chunked transfer framing; extensions and trailers are allowed. Raises ValueError where it is broken."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(data[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(data) < at + size + 2 or data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(data[at : at + size])
        at += size + 2


def _cuts(block: bytes, most: int) -> list[bytes]:
    """Pieces of at most ``most`` bytes, cut where a character begins."""
    out, at = [], 0
    while len(block) - at > most:
        end = at + most
        while block[end] & 0xC0 == 0x80 and end > at + most - 3:
            end -= 1
        out.append(block[at:end])
        at = end
    return [*out, block[at:]]


def _record(fields: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in (*fields, ("Content-Length", len(block))))
    return f"WARC/1.1\r\n{head}\r\n{block.decode()}"


def record_id(page, digest: str, source: int, nth: int = 1) -> str:
    """Follows from the row alone: its page, payload and hashed address, and its number among equal rows."""
    return f"<urn:x-page:{'' if page is None else page}:{digest}:{source}:{nth}>"


def records_of(page, url: str | None, digest: str, source: int, nth: int, top: dict | None, payload: bytes) -> Iterator[str]:
    """The records of a page: a revisit, or a response and its continuations. Without their terminators."""
    name = record_id(page, digest, source, nth)
    stated = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    uri = "".join((url or "").split()) or "urn:x-none"
    common = [("WARC-Target-URI", uri), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", stated), ("Content-Type", "application/http; msgtype=response")]
    if top is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        own = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Refers-To", record_id(top["page_id"], digest, top["source"])), ("WARC-Profile", profile)]
        yield _record([*own, *common], f"{HTTP}Content-Length: {len(payload)}\r\n\r\n".encode())
        return
    block = f"{HTTP}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    parts = _cuts(block, SEGMENT)
    for k, part in enumerate(parts, 1):
        if k == 1:
            own = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common]
        else:
            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Segment-Origin-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z")]
        if len(parts) > 1:
            own.append(("WARC-Segment-Number", k))
        if len(parts) > 1 and k == len(parts):
            own.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(own, part)


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes the records of ``pages`` (page_id, url, html) to gzipped archives in a folder.

    Of equal payloads from LEAST_BYTES on, the one with the largest page_id is a response and the others revisit it.
    Null html counts as empty; repeated rows give a record each, and are responses if their page_id is the largest; a null
    page_id is smaller than any other. Names of records don't depend on how rows are dealt to tasks.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("source", F.xxhash64(F.coalesce("url", F.lit(""))))
    with Scratch(pages.sparkSession, "pages") as made:
        long = F.octet_length("html") >= LEAST_BYTES
        known = made.write(rows.groupBy("digest", "page_id", "source").agg(F.count(F.lit(1)).alias("n"), F.max(long).alias("long")), "known")
        largest = known.where("long").groupBy("digest").agg(F.max(F.struct("page_id", "source")).alias("top"))
        revisits = known.where("long").join(largest, "digest").where("NOT page_id <=> top.page_id OR n > 1")
        odd = revisits.select("digest", "page_id", "source", "n", F.when(F.expr("NOT page_id <=> top.page_id"), F.col("top")).alias("top"))
        short = known.where("NOT long AND n > 1").select("digest", "page_id", "source", "n", F.lit(None).cast("struct<page_id: bigint, source: bigint>").alias("top"))
        odd = made.write(odd.union(short).select(*(F.col(c).alias(f"its {c}") for c in ("digest", "page_id", "source")), "n", "top"), "odd")
        touched, rest = maybe_in(rows, "page_id", odd, "its page_id")  # payloads of other pages stay where they are
        same = F.col("page_id").eqNullSafe(F.col("its page_id")) & (F.col("digest") == F.col("its digest")) & (F.col("source") == F.col("its source"))
        names = ("page_id", "url", "html", "digest", "source")
        dealt = touched.join(odd, same, "left").select(*names, F.coalesce("n", F.lit(1)).alias("n"), "top")
        once, several = dealt.where("n = 1"), dealt.where("n > 1").dropDuplicates(["digest", "page_id", "source"])
        rest = rest.select(*names, F.lit(1).cast("long").alias("n"), F.lit(None).cast("struct<page_id: bigint, source: bigint>").alias("top"))

        def records(batches):
            for batch in batches:
                for part in by_bytes(batch, "html"):
                    made = []
                    for r in part.to_pylist():
                        payload = r["html"].encode()
                        for nth in range(1, r["n"] + 1):
                            made += records_of(r["page_id"], r["url"], r["digest"], r["source"], nth, r["top"], payload)
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])

        out = once.union(several).union(rest).mapInArrow(records, "value string")
        out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def _inflate(data: bytes) -> bytes:
    """Gzip with one or several members, or plain bytes."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = end + 4
        size = int(fields["content-length"])
        if at + size > len(data):
            raise ValueError("record is cut off")
        yield fields, data[at : at + size]
        at += size + 4


def _payload(block: bytes) -> tuple[dict[bytes, bytes], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return fields, unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def _digest(stated: str | None) -> str | None:
    return base64.b32decode(stated.partition(":")[2]).hex() if stated and stated.startswith("sha1:") else None


def _finished(name: str, kind: str, refers: str | None, stated: str | None, block: bytes, with_payload: bool) -> tuple:
    """A row of ``_READ`` from a whole record."""
    try:
        fields, payload = _payload(block)
    except ValueError as e:
        return name, kind, refers, None, _digest(stated), str(e), None
    if kind == "revisit":
        return name, kind, refers, int(fields.get(b"content-length", b"0")), _digest(stated), None, None
    digest = hashlib.sha1(payload).hexdigest()
    problem = "payload differs from its digest" if _digest(stated) not in (None, digest) else None
    return name, kind, refers, len(payload), digest, problem, payload if with_payload else None


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """record_id, record_type, refers_to, payload_bytes, payload_digest, problem and payload of every response and revisit.

    ``problem`` tells what is wrong with a record: missing or repeated segments, a total or digest that doesn't hold,
    broken framing. Other record types are left out. An archive file is held by one task.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for f, block in parse_archive(_inflate(content.as_py())):
                    kind, name = f.get("warc-type"), f.get("warc-record-id")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    segment = f.get("warc-segment-number")
                    if segment is None:
                        rows.append((*_finished(name, kind, f.get("warc-refers-to"), f.get("warc-payload-digest"), block, with_payload), None, None, None, None, None))
                    else:
                        total = f.get("warc-segment-total-length")
                        rows.append((name, kind, f.get("warc-refers-to"), None, None, None, None, int(segment), f.get("warc-segment-origin-id", name), int(total) if total else None, f.get("warc-payload-digest"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield _batch(rows, both)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, both)

    both = _READ + ", segment int, origin string, total long, stated string, block binary"
    parsed = write_table(files.mapInArrow(parse, both), "records")
    names = [x.split()[0] for x in _READ.split(", ")]
    segments = parsed.where("segment IS NOT NULL").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("segment", "record_type", "total", "stated", "block"))).alias("parts"))

    def reassemble(batches):
        for batch in batches:
            rows = []
            for name, parts in zip(batch.column("origin").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                block, last = b"".join(p["block"] for p in parts), parts[-1]
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                    rows.append((name, "response", None, None, _digest(parts[0]["stated"]), "segments are missing or repeated", None))
                elif last["total"] != len(block):
                    rows.append((name, "response", None, None, _digest(parts[0]["stated"]), "total length doesn't hold", None))
                else:
                    rows.append(_finished(name, "response", None, parts[0]["stated"], block, with_payload))
            yield _batch(rows, _READ)

    return parsed.where("segment IS NULL").select(*names).union(segments.mapInArrow(reassemble, _READ))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them again: page_id, payload_bytes, payload_digest, record_type, refers_to and problem.

    One row per row of ``pages``; an empty table gives an empty result; columns but page_id, url and html are left out.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    page = lambda c: F.nullif(F.split(F.col(c), ":")[2], F.lit("")).cast("long")
    read = read_archives(pages.sparkSession, path, with_payload=False)
    drop_path(pages.sparkSession, path)  # read whole by now
    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "problem")
