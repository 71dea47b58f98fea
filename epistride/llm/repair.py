"""Operator 11: repair of conversation structure, one solution for each distinct signature.

A conversation becomes a string with one character a turn that tells the initial of its role and its fault: its signature.
There are far fewer signatures than conversations. Each distinct one is solved once by a memoised recursion over its
suffixes, the audits are joined back by signature, and the edits are replayed on the turns by column functions.

The repaired roles read ``(s?(ua)+)?`` by their initials. An audit is a string of edits in order: K keeps a turn, R gives
it the role user or assistant, whichever must follow, D deletes it, I inserts one without text.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistride.llm.common import Scratch, prepare, write_table

#: Costs of the edits, and what a truncated turn adds that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Adjacent initials that may stand in a conversation.
LEGAL = ("su", "ua", "au")
#: States of the recursion: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the next user or assistant turn, and after keeping a turn with an initial.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_NEVER = 1 << 60
#: Characters of a suffix that the recursion keeps in its memory; longer signatures go on from there turn by turn.
REMEMBERED = 64

SOLVED = "signature string, cost long, audit string, plan array<struct<turn: int, role: string>>"
_EDITS = pa.list_(pa.struct([("turn", pa.int32()), ("role", pa.string())]))

Choice = tuple[int, str]  # cost of a suffix from a state on, and the first edit


def _with_inserts(choices: list[Choice]) -> tuple[Choice, ...]:
    """Allows inserts before the suffix: after two of them a state comes again, so more never pay."""
    user, assistant = choices[USER], choices[ASSISTANT]
    user, assistant = min(user, (INSERT + assistant[0], "I")), min(assistant, (INSERT + user[0], "I"))
    return min(choices[START], (INSERT + user[0], "I")), min(choices[SYSTEM], (INSERT + user[0], "I")), user, assistant


def _before(symbol: str, rest: tuple[Choice, ...]) -> tuple[Choice, ...]:
    """Choices for a suffix that begins with ``symbol``, from those for what follows. Ties go to the edit that is least in ASCII."""
    out = []
    for state in range(4):
        ways = [(DELETE + rest[state][0], "D")]
        if symbol != "x":
            more = TRUNCATED if symbol.isupper() else 0
            kept = _KEPT.get((state, symbol.lower()))
            if kept is not None:
                ways.append((KEEP + more + rest[kept][0], "K"))
            ways.append((REROLE + more + rest[_NEXT[state]][0], "R"))
        out.append(min(ways))
    return _with_inserts(out)


@functools.lru_cache(maxsize=1 << 15)
def _choices(suffix: str) -> tuple[Choice, ...]:
    if not suffix:
        return _with_inserts([(0, ""), (_NEVER, ""), (_NEVER, ""), (0, "")])
    return _before(suffix[0], _choices(suffix[1:]))


def solve(signature: str) -> tuple[int, str, list[tuple[int | None, str | None]]]:
    """Cost, audit and plan of the cheapest repair, with the audit that is least in ASCII among equals.

    The plan names for each turn of the repaired conversation the turn it comes from (none for inserts) and its new role
    (none where the role stays). Within a state an edit leads to one state only, so that comparing first edits compares audits.
    """
    at = max(0, len(signature) - REMEMBERED)
    table = [_choices(signature[at:])]
    for symbol in reversed(signature[:at]):
        table.append(_before(symbol, table[-1]))
    suffixes = [*reversed(table), *(_choices(signature[i:]) for i in range(at + 1, len(signature) + 1))]
    cost, state, i = suffixes[0][START][0], START, 0
    audit, plan = [], []
    while edit := suffixes[i][state][1]:
        audit.append(edit)
        if edit == "K":
            plan.append((i, None))
            state = _KEPT[state, signature[i].lower()]
        elif edit != "D":
            state = _NEXT[state]
            plan.append((i if edit == "R" else None, "user" if state == USER else "assistant"))
        i += edit != "I"
    return cost, "".join(audit), plan


def solve_signatures(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit and plan of each row of a table of distinct signatures."""

    def run(batches):
        for batch in batches:
            texts = batch.column("signature").to_pylist()
            solved = [solve(s) for s in texts]
            plans = [[{"turn": i, "role": r} for i, r in plan] for _, _, plan in solved]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), pa.array([s[0] for s in solved], pa.int64()), pa.array([s[1] for s in solved], pa.string()), pa.array(plans, _EDITS)],
                ["signature", "cost", "audit", "plan"],
            )

    return signatures.select("signature").mapInArrow(run, SOLVED)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of conversations as a faulty log would hold them; a dropped turn stays as a row with ``gone``.

    The CRC-32 of ``conv_id:turn``, modulo 20, decides: 0 drops the turn, 1 empties its text, 2 takes full stops, question
    and exclamation marks out of it, 3 repeats it, 4 gives it the role user. Null counts as one space, in the key too.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fate") == 0).alias("gone"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


_SPACES = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))


def _signed(rows: DataFrame) -> DataFrame:
    """One row a conversation: its turns in order, its signature and the counts of its faults. One exchange, by conversation."""
    bare = F.rtrim(F.col("text"), F.lit(_SPACES))
    # Of equal turns the first in order is no duplicate; the window needs no exchange beside that by conversation.
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy("turn")
    fault = (
        F.when(bare == "", "b").when(F.col("nth") > 1, "d")
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "t").otherwise("")
    )
    initial = F.substring("role", 1, 1)
    shown = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(shown)).otherwise(shown)
    turn = F.struct("turn", "role", "text", "nth", "fault", symbol.alias("symbol"))
    rows = rows.repartition("conv_id").withColumn("nth", F.row_number().over(same)).withColumn("fault", fault)
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(~F.col("gone"), turn))).alias("turns"))
    times = F.array_compact(F.col("turns.turn"))
    count = lambda f: F.size(F.filter("turns", lambda x: x.fault == f)).cast("long")
    initials = F.transform("turns", lambda x: F.substring(x.role, 1, 1))
    pairs = F.zip_with(F.slice("initials", 1, F.greatest(F.size("initials") - 1, F.lit(0))), F.slice("initials", 2, F.size("initials")), lambda a, b: F.concat(a, b))
    convs = convs.select(
        "conv_id", "turns", F.array_join("turns.symbol", "").alias("signature"), initials.alias("initials"),
        F.coalesce(F.array_max(times) - F.array_min(times) + 1 - F.size(F.array_distinct(times)), F.lit(0)).cast("long").alias("gaps"),
        count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"),
    )
    return convs.withColumn("illegal", F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL))).cast("long")).drop("initials")


def _replayed(turns: Column, plan: Column) -> Column:
    def row(edit):
        old = F.get(turns, edit.turn)
        return F.struct(F.coalesce(edit.role, old.role).alias("role"), F.coalesce(old.text, F.lit("")).alias("text"))

    return F.transform(plan, row)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Repairs conversations given as turns (conv_id, turn, role, text, and optionally gone for turns known to be lost).

    Returns one row a conversation: conv_id, gaps (missing numbers of turns), the numbers of blank, duplicate and truncated
    turns (by the first fault of each), illegal (adjacent roles that may not follow each other), cost, audit, and repaired,
    the turns after the edits (role and text).

    Turns are ordered by turn (null first), role and text. Null roles and texts count as one space; a role is known by its
    first character, and a turn whose role begins with none of s, u, a (empty roles too) can't be kept as it is. Repeated rows
    are turns of their own, and all but the first are duplicates. Rows without a conversation (null) form one. A conversation
    whose turns are all gone has zeros, an empty audit and no turns; an empty table gives an empty result; other columns
    are left out. A conversation is one value, as its repaired form is; texts are hashed and compared whole.
    """
    spark = rows.sparkSession
    prepare(spark)
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    told = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], gone.alias("gone"))
    with Scratch(spark, "repair") as made:
        convs = made.write(_signed(told), "convs")
        solved = made.write(solve_signatures(convs.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))), "solved")
        # Catalyst broadcasts the solved table only where its size, known as it is written, is below the session's threshold.
        found = convs.join(solved, "signature")
        counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        return write_table(found.select("conv_id", *counts, "audit", _replayed(F.col("turns"), F.col("plan")).alias("repaired")), "repaired")


def digests(repaired: DataFrame) -> DataFrame:
    """The repaired conversations with repaired_sha256, the digest of their ``role:text`` joined by newlines, instead of their turns."""
    told = F.array_join(F.transform("repaired", lambda x: F.concat(x.role, F.lit(":"), x.text)), "\n")
    return repaired.select(*[c for c in repaired.columns if c != "repaired"], F.sha2(told, 256).alias("repaired_sha256"))
