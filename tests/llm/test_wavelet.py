"""Operator 12: shards of token ids as wavelet matrices."""

import glob
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import HOSTILE
from pyspark.sql import functions as F

from epistride.llm import common, wavelet


@pytest.fixture(scope="module")
def words():
    import public_tokenizers
    import tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def told(rows, words):
    """start, ids of each document in ascending order."""
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = words(text)
        out.append((i, at, ids))
        at += len(ids)
    return out


def bytes_of(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name", ["hostile", "small"])
def test_documents_come_back(spark, name, words, request):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(i, at, len(ids), zlib.crc32(bytes_of(ids))) for i, at, ids in told(rows, words)]
    assert sorted(tuple(r) for r in wavelet.store_and_read(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_the_word_encoder_is_the_library(words):
    extra = ["a<|startoftext|>b <|endoftext|>", "<|endoftext|> x", "İİ Σσς ẞ", "x ́y é", "a b c\x1cd\x85e", "don't WE'LL 'S", "Å 각 ᄀ ᅡ", "1234 5.6,7"]
    texts = [t or "" for t in [*HOSTILE, *extra]]
    assert wavelet.is_proper(wavelet.default_vocabulary())
    rng = np.random.default_rng(1)
    letters = list("etaoinshrdlucmfwypvbgkjqxzETAOINéèüßñçÀÖ") + list("etaoinshrdlu" * 3) + list(".,!?;:()-_\"\\[]{}|<>@#$%^&*+=~`/'0123456789")
    texts += [" ".join("".join(rng.choice(letters, rng.integers(1, 24))) for _ in range(4000)) for _ in range(5)]
    for proper in (True, False):
        enc = wavelet.WordEncoder(wavelet.default_vocabulary(), proper)
        ids, counts = enc.batch(pa.array(texts))
        ends = np.cumsum(counts)
        assert [ids[b - n : b].tolist() for n, b in zip(counts, ends, strict=True)] == [words(t)[:-1] for t in texts]


@pytest.mark.parametrize("ids", [[], [0], [0, 0, 0], [5], [7, 0, 7, 3, 1, 7, 0], "random", "wide", "skewed"])
def test_matrix(ids):
    rng = np.random.default_rng(4)
    if isinstance(ids, str):
        ids = {"random": rng.integers(0, 49_000, 3000), "wide": rng.integers(0, 1 << 32, 700), "skewed": np.where(rng.random(5000) < 0.9, 11, rng.integers(0, 40, 5000))}[ids]
    ids = np.array(ids, np.uint32)
    m = wavelet.Matrix.of(ids)
    assert m.all().tolist() == ids.tolist()
    assert m.access(np.arange(len(ids))).tolist() == ids.tolist()
    for token in [*{*ids[:40].tolist()}, 0, 6, 1 << 20]:
        at = np.flatnonzero(ids == token)
        assert m.find(token).tolist() == at.tolist() and m.count(token) == len(at)
        lo, hi = len(ids) // 4, 3 * len(ids) // 4
        assert m.count(token, lo, hi) == int(((at >= lo) & (at < hi)).sum())


def test_shards_answer_access_counts_and_lookups(spark, small, words):
    path = common.new_path(spark, "shards")
    wavelet.write_shards(small, path, shard_tokens=3000)
    files = glob.glob(f"{path.removeprefix('file://')}/*.parquet")
    shards = spark.read.parquet(path).collect()
    assert len(files) == len(shards) > 10
    assert all(r.n_tokens <= 3000 or len(r.documents) == 1 for r in shards)
    want = told([(r.doc_id, r.text) for r in small.collect()], words)
    flat = [t for _, _, ids in want for t in ids]
    tokens = [2, flat[0], flat[100], 49407, 2]
    assert {r.token: r.n for r in wavelet.count_of(spark, path, tokens).collect()} == {t: flat.count(t) for t in tokens}
    found = sorted(tuple(r) for r in wavelet.occurrences(spark, path, [2, flat[100]]).select("token", "id", "place").collect())
    assert found == sorted((t, i, p) for i, _, ids in want for p, t in enumerate(ids) if t in (2, flat[100]))
    asked = [0, 1, 1, 2999, 3000, 3001, len(flat) - 1, len(flat), -1, None, *range(0, len(flat), 977)]
    got = {r.position: r.token for r in wavelet.tokens_at(spark, path, spark.createDataFrame([(a,) for a in asked], "position long")).collect()}
    assert got == {a: flat[a] for a in asked if a is not None and 0 <= a < len(flat)}


def test_ties_nulls_and_empty_tables(spark, words):
    rows = [(None, "null id"), (3, "b"), (3, "a"), (3, "a"), (1, None), (2, ""), (2, "c " * 900)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, documents string")
    got = sorted((r.start, r.n_tokens, r.ids_crc32, r.doc_id) for r in wavelet.store_and_read(docs).collect())
    assert [r[3] for r in got] == [None, 1, 2, 2, 3, 3, 3]
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:], strict=False)) and got[0][0] == 0
    assert sorted((r[3] or 0, r[1], r[2]) for r in got) == sorted((i or 0, len(words(t)), zlib.crc32(bytes_of(words(t)))) for i, t in rows)
    assert wavelet.store_and_read(docs.limit(0)).count() == 0
    many = docs.where("doc_id = 3").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("n")
    path = common.new_path(spark, "shards")
    wavelet.write_shards(many, path, shard_tokens=10)
    back = sorted((r.start, r.n_tokens) for r in wavelet.documents(spark, path).collect())
    assert len(back) == 150 and all(a[0] + a[1] == b[0] for a, b in zip(back, back[1:], strict=False))
