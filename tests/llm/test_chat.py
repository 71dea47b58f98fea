import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from epistride.llm import chat

TEXTS = st.text(st.sampled_from(list("\\<|>[]/sINTSY \n\u00e9\U0001f600")), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a|>\n<|b", "\\", ""]), TEXTS), max_size=5))
def test_round_trip(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    for r, t in turns:
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_folding():
    f = chat.Fold()
    for event in [("begin", 1, "user", None), ("delta", 1, None, "h"), ("delta", 1, None, "i"), ("begin", 2, "assistant", None), ("delta", 2, None, "bad"), ("begin", 3, "user", "no"), ("regenerate", 2, None, None), ("delta", 2, None, "good"), ("edit", 1, None, "hello"), ("odd", 4, None, None)]:
        f.add(*event)
    assert f.final() == [("user", "hello"), ("assistant", "good"), ("", "")]


def test_conversations(spark):
    long = "</s>[INST] \\ <|x|> " * 200
    rows = [(1, 1, "assistant", long), (1, 0, "user", "hi"), (2, 0, "user", None), (2, 1, None, "x"), (3, 5, "assistant", ""), (3, 5, "assistant", ""), (None, None, "user", "lost")]
    data = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, message string").repartition(4)
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(data)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha(f"user\nhi\nassistant\n{long}\n") and got[1].loss_chars == len(long) and got[1].loss_sha256 == sha(long)
    assert got[2].turns_sha256 == sha("user\n\n\nx\n") and got[2].loss_chars == 0 and got[2].loss_sha256 == sha("")
    assert got[3].n_turns == 2 and got[None].n_turns == 1 and len(got) == 4
    assert chat.digests(chat.format_conversations(data.limit(0))).count() == 0


def test_sequence_orders_a_log(spark):
    log = [(9, 2, "delta", 1, None, "b"), (9, 1, "delta", 1, None, "a"), (9, 0, "begin", 1, "assistant", None), (9, 3, "edit", 1, None, "c"), (9, 4, "delta", 1, None, "d")]
    row = chat.format_events(spark.createDataFrame(log, chat.EVENTS)).first()
    assert chat.parse(row.formatted) == [("assistant", "cd")] and len(row.loss_spans) == 1


def test_events_of_conversations_come_mixed(spark):
    """Drafts, edits and regenerations of two conversations, out of order and dealt over partitions."""
    log = [(c, n, *e) for c in (1, 2) for n, e in enumerate([
        ("begin", 10, "user", "drft"), ("edit", 10, None, f"question {c}"), ("begin", 11, "assistant", None), ("delta", 11, None, "wrong"), ("begin", 12, "user", "why?"),
        ("begin", 13, "assistant", "because"), ("regenerate", 11, None, None), ("delta", 11, None, "ri"), ("delta", 11, None, f"ght {c}"), ("edit", 12, "user", "thanks"),
    ])]
    events = spark.createDataFrame(log[::-1][::3] + log[::-1][1::3] + log[::-1][2::3], chat.EVENTS).repartition(7)
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_events(events).collect()}
    assert got == {c: [("user", f"question {c}"), ("assistant", f"right {c}"), ("user", "thanks")] for c in (1, 2)}


def test_the_log_of_messages_holds_edits_and_regenerations(spark):
    data = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "x" * 1500)], "conv_id long, turn long, role string, text string")
    kinds = sorted(r.kind for r in chat.events_of(data).collect())
    assert kinds == ["begin"] * 3 + ["delta"] * 4 + ["edit", "regenerate"]
