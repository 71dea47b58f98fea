"""Operator 10: chat formatting by folding an event log per conversation.

Logs are dealt by conversation and sorted by sequence; one pass folds streamed deltas, edits and regenerations into the
final messages and renders them. A task holds one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistride.llm.common import prepare

#: Control strings of common chat formats; none may stand unescaped in a text. None begins with a character that another ends with.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_ROLE = re.compile(r"[\\|<\[]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"<\|((?:\\.|[^\\|])*)\|>\n", re.S)
END = "</s>\n"
#: Characters of a streamed delta made from a finished message.
DELTA = 512

#: Characters of a draft that is thrown away again.
DRAFT = 32

#: An event; ``seq`` may be of any type that has an order, and orders the events of a conversation.
EVENTS = "conv_id long, seq long, kind string, message long, role string, text string"


def escape(text: str) -> str:
    """A backslash goes before every backslash and after the first character of every control string."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Message:
    role: str
    parts: list[str]

    @property
    def text(self) -> str:
        return "".join(self.parts)


class Fold:
    """Folds events in order.

    begin opens a message, delta appends to it, edit replaces its text, regenerate empties it and drops what follows it.
    Events of a message that was never begun, or was dropped, open it where they stand.
    """

    def __init__(self):
        self.messages: dict = {}

    def add(self, kind: str | None, message, role: str | None, text: str | None) -> None:
        known = self.messages.get(message)
        if known is None:
            known = self.messages[message] = Message(role or "", [])
        if kind == "delta":
            known.parts.append(text or "")
        elif kind == "edit":
            known.parts = [text or ""]
        elif kind == "regenerate":
            known.parts = []
            while next(reversed(self.messages)) != message:
                self.messages.popitem()
        elif kind == "begin":
            known.role = role or ""
            known.parts = [text] if text else []

    def final(self) -> list[tuple[str, str]]:
        return [(m.role, m.text) for m in self.messages.values()]


#: Roles whose texts are trained on.
TRAINED = frozenset({"assistant"})


def render(turns: list[tuple[str, str]], trained: frozenset[str] = TRAINED) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans (code points) of texts of trained roles."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head = "<|" + _ROLE.sub(lambda m: "\\" + m[0], role) + "|>\n"
        body = escape(text)
        if role in trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        end = formatted.find(END, head.end()) if head else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(head[1]), unescape(formatted[head.end() : end])))
        at = end + len(END)
    return turns


def events_of(rows: DataFrame) -> DataFrame:
    """An event log that ends in the given messages (conv_id, turn, role, text), as a chat service would have written it.

    A trained message begins, streams a draft, is followed by a message, is regenerated (which drops that one) and
    streams its text in deltas; any other begins with a draft and is edited. ``seq`` is the place in the conversation: turn
    (null first), for equal turns role, a hash of the text and a number of the row, and the event's step. Repeated rows stay.
    """
    pieces = F.expr(f"transform(sequence(0, greatest(0, (char_length(text) - 1) div {DELTA})), i -> substring(text, i * {DELTA} + 1, {DELTA}))")
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("message"),
    )
    message, role = F.col("message"), F.col("role")
    event = lambda kind, of=message, by=role, text=F.lit(""): F.struct(F.lit(kind).alias("kind"), of.alias("message"), by.alias("role"), text.alias("text"))
    draft = F.reverse(F.substring("text", 1, DRAFT))
    streamed = F.concat(
        F.array(event("begin"), event("delta", text=draft), event("begin", -1 - message, F.lit("user"), draft), event("regenerate")),
        F.transform(pieces, lambda x: event("delta", text=x)),
    )
    edited = F.array(event("begin", text=draft), event("edit", text=F.col("text")))
    log = rows.select("conv_id", "turn", "role", "message", F.xxhash64("text").alias("tie"), F.posexplode(F.when(role.isin(*TRAINED), streamed).otherwise(edited)).alias("step", "event"))
    return log.select("conv_id", F.struct("turn", "role", "tie", "message", "step").alias("seq"), "event.*")


def format_events(events: DataFrame) -> DataFrame:
    """conv_id, formatted text and loss_spans of every conversation in a log (conv_id, seq, kind, message, role, text) in any order.

    Events without a conversation (null) form one; null texts count as empty; unknown kinds only open their message; an
    empty log gives an empty result; other columns are left out.
    """
    prepare(events.sparkSession)
    spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        current, fold, done = None, None, []

        def finished():
            formatted, where = render(fold.final())
            done.append((current[0], formatted, [{"begin": a, "end": b} for a, b in where]))

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], spans)], ["conv_id", "formatted", "loss_spans"])
            done.clear()
            return out

        for batch in batches:
            for conv, kind, message, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "kind", "message", "role", "text")), strict=True):
                if current is None or current[0] != conv:
                    if current is not None:
                        finished()
                    current, fold = (conv,), Fold()
                fold.add(kind, message, role, text)
            if done:
                yield batch_of()
        if current is not None:
            finished()
            yield batch_of()

    dealt = events.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "kind", "message", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<begin: bigint, end: bigint>>")


def format_conversations(rows: DataFrame) -> DataFrame:
    """Formats finished messages through their event log; see ``events_of`` and ``format_events``."""
    return format_events(events_of(rows))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, and the text under the loss mask."""

    def run(batches):
        for batch in batches:
            rows = []
            for formatted, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = parse(formatted)
                told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss = "".join(unescape(formatted[s["begin"] : s["end"]]) for s in spans)
                rows.append((len(turns), told, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            kinds = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds))], ["conv_id", *(n for n, _ in kinds)])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
