"""Operators 11 and 13: repair of conversations and the trie of their beginnings."""

import itertools
import random

import brute
import pytest
from pyspark.sql import functions as F

from epistride.llm import repair, trie

SCHEMA = "conv_id long, turn long, role string, text string"
HOSTILE = [
    (None, 0, "user", "no id."), (None, 0, "user", "no id."), (1, None, None, None), (1, None, "user", "null turn first."), (1, 3, "", "empty role."), (1, 3, "", "empty role."),
    (2, 5, "system", "a"), (2, 5, "system", "a"), (2, 9, "tool", "Tool says x!"), (2, 9, "Assistant", " \t\n"), (2, 10, "assistant", "fine. \n\x0b"), (3, 0, "user", None),
    (4, 0, "user", "x" * 70000 + "."), (4, 1, "assistant", "y?"), (4, 2, "user", "z "), (4, 2, "assistant", "中文。"), (20, 0, "user", "same. "), (21, 0, "user", "same. "), (40, 0, "s", "s."),
]


def random_rows(seed, convs=60):
    rng = random.Random(seed)
    texts = ["One two.", "three four five!", "six", "", " ", "seven?"]
    roles = ["user", "assistant", "system", "tool", "unknown"]
    return [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(convs) for t in range(rng.randrange(0, 6))]


@pytest.fixture(params=["hostile", "random", "small"])
def rows(request, spark):
    if request.param == "small":
        return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    return HOSTILE if request.param == "hostile" else random_rows(1)


def repaired(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fault", F.lit(1)).withColumn("turns", F.lit("x")).withColumn("signature", F.lit(2)).repartition(3)
    return repair.repair_conversations(repair.damaged(df))


def test_repair_is_that_of_trying_all_edits(spark, rows):
    out = repair.digests(repaired(spark, rows)).collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out}
    assert len(got) == len(out) and got == brute.structure_repair(rows)


def test_every_short_signature():
    turns = {"x": ("user", "blank"), "s": ("system", ""), "u": ("user", ""), "a": ("assistant", ""), "o": ("tool", ""), "U": ("user", "truncated"), "A": ("assistant", "truncated")}
    for n in range(5):
        for signature in itertools.product(turns, repeat=n):
            given = [(turns[c][0], str(i), turns[c][1]) for i, c in enumerate(signature)]
            cost, audit, told = brute.cheapest_repair(given)
            got = repair.solve("".join(signature))
            replayed = [f"{role or given[i][0]}:{'' if i is None else given[i][1]}" for i, role in got[2]]
            assert (got[0], got[1], replayed) == (cost, audit, told), signature


def test_a_long_signature_is_solved_without_deep_recursion():
    cost, audit, plan = repair.solve("s" + "ua" * 40_000 + "u")
    assert (cost, len(audit), len(plan)) == (2, 80_002, 80_001) and audit.count("D") == 1


def test_repaired_turns_and_conversations_without_turns(spark):
    rows = [(7, 0, "user", "Hi."), (7, 1, "user", "Again."), (8, 0, "user", "gone")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("gone", F.col("conv_id") == 8)
    got = {r.conv_id: r for r in repair.repair_conversations(df).collect()}
    assert got[7].audit == "KR" and [(x.role, x.text) for x in got[7].repaired] == [("user", "Hi."), ("assistant", "Again.")]
    assert (got[8].audit, got[8].repaired, got[8].cost, got[8].gaps) == ("", [], 0, 0)
    assert repair.repair_conversations(df.limit(0)).count() == 0


def nodes(df):
    out = df.collect()
    got = {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out}
    assert len(got) == len(out)
    return got


def trie_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("words", F.lit(1)).withColumn("key", F.lit("x")).withColumn("turns", F.lit(3)).repartition(3)
    return trie.prefix_trie(trie.rebuilt(trie.conversations(df)))


def test_trie(spark, rows):
    assert nodes(trie_of(spark, rows)) == brute.prefix_trie(rows)


@pytest.mark.parametrize("seed", range(3))
def test_trie_over_many_blocks(spark, seed, monkeypatch):
    """Few distinct turns, many copies: nodes and runs of equal conversations reach over several blocks."""
    rng = random.Random(seed)
    monkeypatch.setattr(trie, "BLOCK_TURNS", 12)
    rows = [(c, t, "user", rng.choice(["a b", "c"])) for c in range(180) for t in range(rng.choice([1, 2, 3, 3, 3, 5]))]
    rows += [(c, t, "user", "hot") for c in range(180, 260) for t in range(4)]
    assert nodes(trie_of(spark, rows)) == brute.prefix_trie(rows)


def test_turnless_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(trie.rebuilt(trie.conversations(empty))).count() == 0
    # Conversations whose base is absent lose their first turns, perhaps all.
    rows = [(c, 0, "user", "only") for c in range(21, 40)]
    got = nodes(trie_of(spark, rows))
    assert got == brute.prefix_trie(rows) and any(n[1] == 0 and n[7] != trie.NOTHING for n in got)


def test_shared_turns():
    a, b = bytes(16), b"\1" * 16
    for x in itertools.product((a, b), repeat=4):
        for y in itertools.product((a, b), repeat=3):
            same = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), 3)
            assert trie.shared_turns(b"".join(x), b"".join(y)) == same
