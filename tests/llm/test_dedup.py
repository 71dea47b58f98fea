import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epistride.llm import common, hashing, minhash, substrings
from epistride.llm.components import components
from epistride.llm.minhash import Near


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", ["hostile", "small"])
@pytest.mark.parametrize("near", [Near(3, 85), Near(5, 80)])
def test_near_duplicates(name, near, request):
    docs = request.getfixturevalue(name)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, near).collect()}
    assert got == brute.near_duplicates(texts_of(docs), near.words, near.percent)


def family(rng, n, spread):
    """Copies that drift from one text: some pairs link, others only through third ones."""
    words = [f"v{i}" for i in rng.integers(0, 5000, 120)]
    for _ in range(n):
        own = list(words)
        for at in rng.integers(0, 120, rng.integers(0, spread)):
            own[at] = f"e{rng.integers(0, 9999)}"
        yield " ".join(own)


def test_chains_and_unlinked_members_of_buckets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, t) for i, t in enumerate(x for s in (2, 5, 8, 12) for x in family(rng, 40, s))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, Near(3, 85)).collect()}
    assert got == brute.near_duplicates(dict(rows), 3, 85)


def test_blocks_without_members(spark, monkeypatch):
    """Groups of one or two sets are dealt over more parts than they fill."""
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", 20)
    rng = np.random.default_rng(5)
    rows = [(i, t) for i, t in enumerate(x for _ in range(25) for x in family(rng, 3, 14))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, Near(3, 85)).collect()}
    assert got == brute.near_duplicates(dict(rows), 3, 85)


def test_a_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    values, first = np.concatenate([a, b, a[:1]]), np.array([0, 400, 800, 801, 801])
    s = minhash.sketches(values, first, 256)
    assert (s[:3] != minhash.EMPTY).all() and (s[3] == minhash.EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.1


@pytest.mark.parametrize("name", ["hostile", "small"])
@pytest.mark.parametrize("batches", [1, 4])
def test_repeated_passages(name, batches, request):
    docs = request.getfixturevalue(name)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs, 20, batches).collect()}
    assert got == brute.substring_dedup(texts_of(docs), 20)


def test_repeated_rows_of_one_block_keep_their_text(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "pq")
    rows = [(3, one), (3, one), (4, f"{two} x {two}"), (4, f"{two} x {two}"), (5, f"y {one}"), (5, f"y {one}"), (6, "short"), (6, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(docs, 20).collect())
    assert got == [(3, 30, 0)] * 2 + [(4, 61, 30)] * 2 + [(5, 31, 30)] * 2 + [(6, 1, 0)] * 2
    left = sorted((r.doc_id, r.text) for r in substrings.without_repeats(docs, 20).collect())
    assert left == [(3, one)] * 2 + [(4, f"{two} x")] * 2 + [(5, "y")] * 2 + [(6, "short")] * 2


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_under_sums_of_powers_differ(spark):
    one, two = thue_morse(1024), thue_morse(1024).translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {two} y")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()) == [(1, 1, True), (2, 2, True)]
    tail = " ".join(f"p{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{one} {tail}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.remove_repeats(docs, 20).collect()) == [(1, 0), (2, 0), (3, 20)]


def test_digests_tell_words_apart():
    words = ["a", "aa", "\0", "\0\0", "a\0", "abcdefg", "abcdefgh", "abcdefgh\0", "x" * 14, "x" * 15, "x" * 16, "x" * 17, "\u00e9" * 7, "\u00e9" * 8, thue_morse(1024)]
    split = hashing.split_words(pa.array([" ".join(words), None, " ".join(reversed(words))]))
    digests = hashing.word_digests(split).tolist()
    assert len({tuple(d) for d in digests}) == len(words) and digests == digests[::-1]


def test_a_block_sent_again_is_the_same():
    rng = np.random.default_rng(0)
    docs, places = np.repeat(np.arange(40), 10), np.tile(np.arange(10, dtype=np.int32), 40)
    hashes = rng.integers(0, 60, 400).astype(np.uint64)
    assert substrings._send(hashes, None, docs, places, 7, True) == substrings._send(hashes, None, docs, places, 7, True)


def test_batches_alone_against_a_reopened_index(spark, small):
    texts = {i: t for i, t in texts_of(small).items()}
    ids = sorted(texts)
    folder = common.new_path(spark, "kept-index")
    substrings.FingerprintIndex(spark, 20, folder=folder).save()
    got, cuts = {}, [0, len(ids) // 4, len(ids) // 2, len(ids)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        index = substrings.FingerprintIndex.open(spark, folder, most_runs=1)
        inside = F.col("doc_id").between(ids[a], ids[b - 1])
        out = substrings.repeats_of_batch(index, small.where(inside), small.where(F.col("doc_id") < ids[a]))
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()}
    assert got == brute.substring_dedup(texts, 20)
    with pytest.raises(ValueError):
        substrings.FingerprintIndex.open(spark, folder).append(small.select(F.col("doc_id").alias("id"), "text"))


def test_a_failed_batch_can_be_given_again(spark, small, monkeypatch):
    texts = texts_of(small)
    ids = sorted(texts)
    folder = common.new_path(spark, "failing-index")
    substrings.FingerprintIndex(spark, 20, folder=folder).save()
    index = substrings.FingerprintIndex.open(spark, folder)
    half = len(ids) // 2
    one, two = small.where(F.col("doc_id") < ids[half]), small.where(F.col("doc_id") >= ids[half])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeats_of_batch(index, one, one.limit(0)).collect()}
    verified = substrings._verified

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(substrings, "_verified", fails)
    with pytest.raises(RuntimeError):
        substrings.repeats_of_batch(index, two, one)
    monkeypatch.setattr(substrings, "_verified", verified)
    again = substrings.FingerprintIndex.open(spark, folder)
    for known in (index, again):
        assert known.last == ids[half - 1] and known.runs == again.runs
    got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeats_of_batch(index, two, one).collect()}
    assert got == brute.substring_dedup(texts, 20)
    # Saved, and the result lost: the same batch gives it once more.
    repeated = substrings.repeats_of_batch(substrings.FingerprintIndex.open(spark, folder), two, one).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeated}.items() <= got.items() and len(repeated) == len(ids) - half


def test_ten_batches_rewrite_runs_by_levels(spark):
    rng = np.random.default_rng(11)
    pool = [" ".join(f"p{j}x{i}" for i in range(25)) for j in range(6)]
    rows = [(i, " ".join(rng.permutation([pool[rng.integers(6)], f"a{i} b{i}", " ".join(f"u{i}y{j}" for j in range(22))]))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = common.new_path(spark, "levels")
    substrings.FingerprintIndex(spark, 20, buckets=3, folder=folder).save()
    got, levels = {}, []
    for b in range(10):
        index = substrings.FingerprintIndex.open(spark, folder, most_runs=1)
        out = substrings.repeats_of_batch(index, docs.where(F.col("doc_id").between(6 * b, 6 * b + 5)), docs.where(F.col("doc_id") < 6 * b))
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()}
        levels.append(list(index.levels))
    assert got == brute.substring_dedup(dict(rows), 20)
    assert levels[:4] == [[0], [1], [1, 0], [2]] and levels[9] == [3, 1]
    kept = {p.rsplit("/", 1)[-1] for p in index.runs}
    import os

    assert {x for x in os.listdir(folder.removeprefix("file://")) if x.startswith("run-")} == kept


def test_shingles_that_once_collided_are_not_linked(spark):
    """Under an unkeyed hash these texts had equal sets, though they share no shingle."""
    rows = [(1, "eszyci (!@#@!!! tail"), (2, "fiqfvi @(n@d~t= tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, Near(3, 85)).collect())
    assert got == [(1, 1, 1, True), (2, 1, 2, True)]
    assert minhash.one_of_each(docs, Near(5, 80)).count() == 2


def test_shingle_hashes_depend_on_the_key_and_on_each_word():
    split = hashing.split_words(pa.array(["a b c d", "b a c d", "a b", "a b c"]))
    digests = hashing.word_digests(split)
    one, two = hashing.shingle_key(5), hashing.shingle_key(5)
    whole = [hashing.shingle_hashes(digests[a:b], b - a, key)[0] for key in (one, two) for a, b in zip(split.first[:-1], split.first[1:], strict=True)]
    assert len(set(whole)) == 8
    again = hashing.shingle_key(5, b"0123456789abcdef")
    assert (hashing.shingle_key(5, b"0123456789abcdef") == again).all()


def test_an_id_with_several_texts_keeps_the_links_of_each(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, Near(3, 85)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_kept_texts(spark):
    run = " ".join(f"p{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"x  {run}"), (2, f"y\n{run} z"), (3, "a\n b")], "doc_id long, text string")
    docs = docs.union(spark.createDataFrame([(4, run), (5, None), (6, f"w {run}  v  v")], "doc_id long, text string")).withColumn("places", F.lit(1)).withColumn("n_chars", F.lit(7))
    got = {r.doc_id: (r.text, r.places, r.n_chars) for r in substrings.without_repeats(docs, 20).collect()}
    assert got == {1: (f"x  {run}", 1, 7), 2: ("y\nz", 1, 3), 3: ("a\n b", 1, 7), 5: (None, 1, 7), 6: ("w v  v", 1, 6)}


def test_one_of_each(spark):
    text = " ".join(f"p{i}" for i in range(30))
    rows = [(None, text), (7, text), (7, text), (9, text + " q"), (8, None), (8, None), (10, "other")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string")
    left = minhash.one_of_each(docs).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in left) == [(0, "k"), (7, "k"), (8, "k"), (10, "k")]


def test_empty_null_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0 and substrings.remove_repeats(empty).count() == 0
    text = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (9, text), (8, None)], "doc_id long, text string")
    near = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert near == {(None, None, True), (7, 7, True), (9, 7, False), (8, 8, True)}
    left = sorted((r.doc_id or 0, r.n_removed) for r in substrings.remove_repeats(docs).collect())
    assert left == [(0, 0), (7, 0), (7, 0), (8, 0), (9, 30)]


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [*((i, i + 1) for i in range(100, 160)), *((int(a), int(b)) for a, b in rng.integers(200, 400, (150, 2))), (1, 1), (None, 2)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    ids = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == brute.component_of(ids, [x for x in links if x[0] in ids and x[1] in ids])
