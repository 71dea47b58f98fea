import hashlib

import duckdb
import pytest

from epistride.llm import warc
from epistride.llm.queries import ORACLES


def expected(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or ""), []).append(i)
    for i, _, h in rows:
        data = (h or "").encode()
        top = max(groups[h or ""], key=lambda x: -1 if x is None else x)
        revisit = len(data) >= 1000 and i != top
        yield i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None


@pytest.fixture
def pages(spark):
    big = "héllo \U0001f600\r\n\r\n0\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(1, "http://a", "x"), (2, "http://a", None), (3, None, "x" * 1000), (4, "u\r\nX: y", "x" * 1000), (5, "u", big), (6, "u", big + "!"), (7, "u", big), (8, "u", "y" * 999), (9, "u", "y" * 999), (None, "u", "x" * 1000), (11, "u", "r" * 2000), (11, "u", "r" * 2000)]
    return rows, spark.createDataFrame([(*r, "d", 0) for r in rows], "page_id long, url string, html string, digest string, segment int").repartition(3)


def test_pages_come_back(pages):
    rows, data = pages
    got = warc.archive_pages(data).collect()
    assert all(r.problem is None for r in got)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected(rows), key=key)


def test_payloads_come_back(pages, spark, tmp_path):
    rows, data = pages
    warc.write_archives(data, f"file://{tmp_path}/w")
    read = warc.read_archives(spark, f"file://{tmp_path}/w").where("record_type = 'response'").collect()
    assert sorted(bytes(r.payload).decode() for r in read) == sorted(h or "" for i, _, h in rows if (i, h) not in {(3, "x" * 1000), (None, "x" * 1000), (5, rows[4][2])})


def test_names_follow_from_rows_alone(pages, spark, tmp_path):
    rows, data = pages
    found = []
    for n, dealt in enumerate((data, data.repartition(7, "html").sortWithinPartitions("url"))):
        warc.write_archives(dealt, f"file://{tmp_path}/{n}")
        found.append(sorted((r.record_id, r.refers_to or "") for r in warc.read_archives(spark, f"file://{tmp_path}/{n}").collect()))
    names = {r[0] for r in found[0]}
    assert found[0] == found[1] and len(names) == len(rows) and {r[1] for r in found[0]} - {""} <= names


def test_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_archives_are_told(spark, tmp_path):
    body = b"z" * 50_000
    whole = [x.encode() + b"\r\n\r\n" for x in warc.records_of(1, "u", hashlib.sha1(body).hexdigest(), 1, 1, None, body)]
    assert len(whole) > 2
    wrong = [x.encode() + b"\r\n\r\n" for x in warc.records_of(2, "u", hashlib.sha1(b"other").hexdigest(), 1, 1, None, b"small")]
    short = [x.replace(b"Total-Length: ", b"Total-Length: 1").replace(b":1:", b":3:") for x in whole]
    (tmp_path / "a.warc").write_bytes(b"".join([*reversed(whole[:1] + whole[2:]), *wrong, *reversed(short)]))
    got = {r.record_id.split(":")[2]: r.problem for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert got == {"1": "segments are missing or repeated", "2": "payload differs from its digest", "3": "total length doesn't hold"}


@pytest.mark.parametrize("data", [b"", b"a", b"\r\n" * 5000, b"x" * 4096])
def test_chunks(data):
    assert warc.unchunked(warc.chunked(data)) == data
    with pytest.raises(ValueError):
        warc.unchunked(warc.chunked(data)[:-5])
