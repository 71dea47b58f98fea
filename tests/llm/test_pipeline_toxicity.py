import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from epistride.llm import toxicity
from epistride.llm.hashing import split_words

SF, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet")
    return toxicity.score_held_out(docs, labels).join(labels, "doc_id", "left").collect()


def test_held_out_accuracy(scored):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in scored)
    told = [(r.toxic, r.predicted) for r in scored if r.held_out and r.toxic is not None]
    right = sum(a == b for a, b in told)
    assert len(told) > 500 and right >= 0.98 * len(told)
    assert sum(b for a, b in told if a) >= 0.85 * sum(a for a, _ in told)


def test_spans_name_words(scored, spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGE}/documents.parquet").collect()}
    words = {texts[r.doc_id][s.begin : s.end].lower() for r in scored for s in r.spans if r.predicted}
    assert {"idiot", "moron"} & words and all(w and not any(c.isspace() for c in w) for w in words)


def test_labels_and_held_out_rows_do_not_leak(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.score_held_out(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.score_held_out(docs.withColumn("lang", F.lit("zz")), turned).collect()}
    assert a == pytest.approx(b)


def test_edges(spark, hostile):
    labels = spark.createDataFrame([(0, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(hostile, labels).collect()
    assert len(got) == hostile.count() and {r.score for r in got} == {1.0} and set(hostile.columns) <= set(got[0].asDict())
    none = toxicity.score_documents(hostile, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.0]
    assert toxicity.score_documents(hostile.limit(0), labels).count() == 0


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    scores, move = rng.normal(size=(3, 4)), rng.normal(size=(2, 2))
    lengths = np.array([4, 2, 1])
    p, pairs, z = toxicity.forward_backward(scores, move, lengths)
    total = np.zeros((2, 2))
    for n, t in enumerate(lengths):
        mass, at, moved = 0.0, np.zeros(4), np.zeros((2, 2))
        for path in np.ndindex(*(2,) * t):
            w = np.exp(sum(scores[n, i] for i in range(t) if path[i]) + sum(move[a, b] for a, b in zip(path[:-1], path[1:], strict=True)))
            mass += w
            at[:t] += w * np.array(path)
            for a, b in zip(path[:-1], path[1:], strict=True):
                moved[a, b] += w
        assert np.allclose(p[n], at / mass) and np.isclose(z[n], np.log(mass))
        total += moved / mass
    assert np.allclose(pairs, total)


def plain_score(model, text):
    """Score and spans by plain recursions over the whole text, token by token."""
    data = (text or "").encode()
    odds_of = dict(zip(model.evidence.hashes.tolist()[1:], model.evidence.odds.tolist()[1:], strict=True))
    m = np.exp(model.chain.move)
    spans, e = [], []
    for t in re.finditer(rb"[A-Za-z\x80-\xff]+", data):
        word = t[0].decode(errors="surrogateescape") if t[0].isascii() else t[0].decode()
        own = [odds_of.get(int(h), 0.0) if h else 0.0 for h in toxicity.features_of(pa.array([word]))[0][:, 0]]
        e.append(float(np.exp(np.clip(np.array([*own, max(own)]) @ model.chain.emit[1:] + model.chain.emit[0], -30, 30))))
        spans.append((len(data[: t.start()].decode()), len(data[: t.end()].decode())))
    a, b = [], np.array([0.5, 0.5])
    for i, x in enumerate(e):
        v = (a[-1] @ m if i else np.array([0.5, 0.5])) * [1, x]
        a.append(v / v.sum())
    p = [0.0] * len(e)
    for i in range(len(e) - 1, -1, -1):
        v = a[i] * b
        p[i] = v[1] / v.sum()
        b = m @ (b * [1, e[i]])
        b /= b.sum()
    inputs = np.array([1, sum(-np.log1p(-min(x, 1 - 1e-9)) for x in p), sum(p), np.log1p(len(p))])
    return 1 / (1 + np.exp(-np.clip(inputs @ model.chain.document, -30, 30))), [(*s, x) for s, x in zip(spans, p, strict=True) if x > 0.5]


@pytest.mark.parametrize("piece", [1 << 22, 50])
def test_scores_and_spans_against_plain_recursions(spark, hostile, piece, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs.select(F.col("doc_id").alias("id"), "text"), labels.select(F.col("doc_id").alias("id"), "toxic"))
    monkeypatch.setattr(toxicity, "PIECE", piece)
    texts = [r.text for r in hostile.collect()] + [r.text for r in docs.limit(150).collect()]
    texts += ["\u00e9t\u00e9 you idiot " + "fine words here " * 300 + "moron, idiots! " + "more " * 127, " ".join(["idiot"] * 400), "idiot"]
    scores, spans = model.score(pa.array(texts, pa.string()))
    for text, score, found in zip(texts, scores, spans, strict=True):
        want, told = plain_score(model, text)
        assert np.isclose(score, want, rtol=1e-6) and [(s["begin"], s["end"]) for s in found] == [t[:2] for t in told]
        assert np.allclose([s["marginal"] for s in found], [t[2] for t in told])
    assert sum(map(len, spans)) > 400


def test_words_of_other_scripts():
    w = split_words(pa.array(["Été, X-y", None, ""]), lower=True, inside=toxicity._LETTER)
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)] == ["Été", "x", "y"] and w.first.tolist() == [0, 3, 3, 3]


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "substrings", "best_two_fit"]

    clean = corpus_pipeline.remove_toxic(spark, docs, SF).cache()
    assert clean.columns == COLUMNS
    left = {r.doc_id: r.text for r in clean.collect()}
    told = [(labels[i], i not in left) for i in rows if i in labels]
    assert sum(bool(a) == b for a, b in told) >= 0.95 * len(told)

    unique = corpus_pipeline.remove_near_duplicates(spark, clean, SF).cache()
    assert unique.columns == COLUMNS
    want = {i for i, (_, c) in brute.near_duplicates(left, 5, 80).items() if i == c}
    left = {r.doc_id: r.text for r in unique.collect()}
    assert set(left) == want

    stripped = corpus_pipeline.remove_repeated_passages(spark, unique, SF).cache()
    assert stripped.columns == COLUMNS
    kept = {r.doc_id: (r.text, r.n_chars) for r in stripped.collect()}
    import hashlib

    for i, (n, gone, sha) in brute.substring_dedup(left, 20).items():
        if n and gone == n:
            assert i not in kept
        else:
            text, chars = kept[i]
            assert hashlib.sha256(" ".join(brute.WORD.findall(text)).encode()).hexdigest() == sha and (gone or text == left[i]) and chars == len(text)

    packed = corpus_pipeline.pack(spark, stripped, SF).collect()
    assert {r.doc_id for r in packed} == set(kept) and max(r.offset + r.length for r in packed) <= 1024


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_stage_keeps_columns_named_like_its_results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["Score", "predicted", "spans", "scored"]
    own = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    got = corpus_pipeline.remove_toxic(spark, own, SF)
    assert got.columns == own.columns and got.count() == corpus_pipeline.remove_toxic(spark, docs, SF).count() > 0
    assert got.where(" OR ".join(f"NOT {n} <=> concat('{n} ', doc_id)" for n in names)).count() == 0
