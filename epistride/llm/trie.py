"""Operator 13: the prefix trie of conversations, from the Cartesian tree over their sorted LCP array.

Turns become 128-bit digests, so that a conversation is a binary key whose order is that of its turns. Keys are sorted into
blocks by ranges, and next to each key stands the number of turns it shares with the key before (LCP). A node of the trie is
an interval of keys: it begins at a key whose LCP is below its depth and ends before the next such key. Inside a block one
stack finds these nearest smaller values, merges nodes of equal LCP and adds the depths between. Across blocks the minima of
the blocks find them: a path that is open where a block begins belongs, at each depth, to the nearest earlier block whose
minimum is below that depth. What the blocks add to such nodes is summed; all other nodes are finished inside their block.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistride.llm.common import Scratch, prepare, write_table

#: Bytes of the digest of a turn.
WIDTH = 16
#: Turns in a block, about; a task holds the nodes of its block.
BLOCK_TURNS = 500_000

CONVERSATION = "key binary, conv_id long, words array<int>"
ENTRY = "block int, at long, lcp int, turns int, key binary, words array<int>, n long, low long, ids binary"
EDGES = "block int, edge int, after int, owners array<int>"
NODE = "low long, depth int, parent_low long, parent_owner int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PIECE = "owner int, owner_depth int, block int, above int, some_low long, n long, children long, leaves long, spoken long, born long, before long, ids binary"
CROSSING = "owner int, depth int, parent_owner int, low long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema.names)


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in text.split(", ")])


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their beginning."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    lo, hi = 0, n - 1  # the first lo turns are equal, and the first hi + 1 are not
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[: mid * WIDTH] == b[: mid * WIDTH]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _entries(batches):
    """Sorted (key, conv_id, words) of one block to its distinct keys with their LCPs; first and last key are kept."""
    schema, block = _schema(ENTRY), TaskContext.get().partitionId()
    key, words, low, ids, lcp, at, out = None, None, None, [], None, 0, []

    def entry(last=False):
        return (block, at, lcp, len(key) // WIDTH, key if last or not at else None, words, len(ids), low, b",".join(ids))

    for batch in batches:
        for k, conv, w in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "words")), strict=True):
            if k != key:
                if key is not None:
                    out.append(entry())
                    at, lcp = at + 1, shared_turns(key, k)
                key, words, low, ids = k, w, conv, []
            ids.append(b"%d" % conv)
        if out:
            yield _frame(out, schema)
            out = []
    if key is not None:
        yield _frame([entry(last=True)], schema)


def _edges(batches):
    """For each block, in order: the LCP with the block before and with that after it, and the owner of each depth that is open where it begins.

    There is one row a block, whatever the number of conversations in it.
    """
    schema = _schema(EDGES)
    stack: list[tuple[int, int]] = []  # (minimum, block): blocks whose minimum is smaller than that of all blocks after them
    before, pending, out = None, None, []
    for batch in batches:
        for block, inner, first, last in zip(*(batch.column(c).to_pylist() for c in ("block", "inner", "first", "last")), strict=True):
            edge = -1 if before is None else shared_turns(before, first)
            if pending is not None:
                out.append((pending[0], pending[1], edge, pending[2]))
            owners, deep = [], len(stack) - 1
            for depth in range(edge, -1, -1):
                while stack[deep][0] >= depth:
                    deep -= 1
                owners.append(stack[deep][1])
            pending, before = (block, edge, owners[::-1]), last
            least = edge if inner is None else min(edge, inner)
            while stack and stack[-1][0] >= least:
                stack.pop()
            stack.append((least, block))
        if out:
            yield _frame(out, schema)
            out = []
    if pending is not None:
        yield _frame([(pending[0], pending[1], -1, pending[2])], schema)


class _Path:
    """Open nodes of depth ``lo`` to ``hi`` that begin at the same key of a block, or in an earlier block (then ``owners`` has the block of each depth)."""

    __slots__ = ("begun", "children", "ends", "hi", "ids", "lo", "low", "owners", "spoken", "waiting")

    def __init__(self, lo: int, hi: int, begun: tuple[int, ...], spoken: list[int] | None = None, owners: list[int] | None = None):
        self.lo, self.hi, self.owners = lo, hi, owners
        self.begun = begun  # the sums when these nodes began
        self.spoken = spoken  # words of the first d turns, for each d
        self.low = None  # smallest member so far
        self.children = 0  # of the node at hi
        self.ends, self.ids = -1, None  # depth of the node at which conversations end, and their ids
        self.waiting: list[int] = []  # finished children of the node at hi


class _Block:
    """Goes through the keys of one block; see the module's first lines."""

    def __init__(self, block: int, edge: int, after: int, owners: list[int]):
        self.block, self.edge, self.after = block, edge, after
        self.sums = (0, 0, 0, 0)  # over the keys so far: conversations, all their words, words of new nodes, leaves
        self.open = [_Path(0, edge, self.sums, owners=owners)] if edge >= 0 else []
        self.nodes = tuple(array("q") for _ in range(8))  # the columns of NODE but the last; -1 stands for no owner
        self.ends: dict[int, str] = {}
        self.pieces: list[tuple] = []
        self.next = None

    def add(self, lcp: int | None, *entry) -> None:
        lcp = self.edge if lcp is None else lcp
        if self.next is not None:
            self._take(*self.next, following=lcp)
        self.next = (lcp, *entry)

    def finish(self) -> None:
        self._take(*self.next, following=self.after)
        self._close(self.after)
        while self.open:
            self._hand_over(self.open[-1], self.open[-1].lo)
            self._pop()

    def _take(self, lcp: int, turns: int, words: list[int], n: int, low: int, ids: bytes, following: int) -> None:
        self._close(lcp)
        spoken = [0, *itertools.accumulate(words)]
        if turns > lcp:
            if self.open:
                self.open[-1].children += 1
            self.open.append(_Path(lcp + 1, turns, self.sums, spoken))
        top = self.open[-1]  # its deepest node is where these conversations end
        top.low = low if top.low is None else min(top.low, low)
        top.ends, top.ids = turns, ids
        convs, all_words, new_words, leaves = self.sums
        self.sums = (convs + n, all_words + n * spoken[-1], new_words + spoken[-1] - spoken[max(lcp, 0)], leaves + (following < turns))

    def _close(self, lcp: int) -> None:
        """Nodes deeper than ``lcp`` end before the key that has it."""
        while self.open and self.open[-1].hi > lcp:
            top = self.open[-1]
            lo = max(top.lo, lcp + 1)
            (self._hand_over if top.owners else self._finish)(top, lo)
            if lo == top.lo:
                self._pop()
            else:
                top.hi, top.children = lcp, 0 if top.owners else 1

    def _pop(self) -> None:
        gone = self.open.pop()
        if self.open:
            below = self.open[-1]
            below.low = min((x for x in (below.low, gone.low) if x is not None), default=None)

    def _since(self, path: _Path) -> list[int]:
        return [a - b for a, b in zip(self.sums, path.begun, strict=True)]

    def _finish(self, top: _Path, lo: int) -> None:
        """Nodes from ``hi`` up to ``lo`` have the same members; all but the first have one child."""
        n, spoken, born, leaves = self._since(top)
        for row in top.waiting:
            self.nodes[2][row] = top.low
        top.waiting, children = [], top.children
        for depth in range(top.hi, lo - 1, -1):
            before = top.spoken[max(depth - 1, 0)]
            saved = spoken - n * before - (born - before + top.spoken[max(top.lo - 1, 0)])
            row = len(self.nodes[0])
            for column, value in zip(self.nodes, (top.low, depth, top.low, -1, n, children, leaves, saved), strict=True):
                column.append(value)
            if top.ends == depth:
                self.ends[row] = hashlib.sha256(top.ids).hexdigest()
            children = 1
        if lo > top.lo:
            top.waiting.append(row)
        elif len(self.open) > 1:
            self.open[-2].waiting.append(row)

    def _hand_over(self, top: _Path, lo: int) -> None:
        """What this block adds to nodes that reach beyond it: a piece for each."""
        n, spoken, born, leaves = self._since(top)
        children = top.children
        for depth in range(top.hi, lo - 1, -1):
            ids = top.ids if top.ends == depth else None
            if top.owners:
                owner, above, before, own = top.owners[depth], None, None, born
            else:
                owner, before = self.block, top.spoken[max(depth - 1, 0)]
                below = self.open[-2] if len(self.open) > 1 else None
                above = self.block if depth > top.lo or below is None else below.owners[depth - 1] if below.owners else self.block
                own = born - before + top.spoken[max(top.lo - 1, 0)]
            self.pieces.append((owner, depth, self.block, above, top.low, n, children, leaves, spoken, own, before, ids))
            if depth == top.hi:
                for row in top.waiting:
                    self.nodes[3][row] = owner
                top.waiting = []
            children = 0 if top.owners else 1

    def batches(self, most: int = 10_000) -> Iterator[pa.RecordBatch]:
        """Finished nodes and pieces, as rows of the same schema."""
        node, piece = _schema(NODE), _schema(PIECE)
        both = pa.schema([*node, *piece])
        for at in range(0, len(self.nodes[0]), most):
            columns = [pa.array(c[at : at + most], pa.int64()).cast(t) for c, t in zip(self.nodes, node.types, strict=False)]
            owners = columns[3].to_pylist()
            columns[3] = pa.array([x if x >= 0 else None for x in owners], pa.int32())
            n = len(owners)
            columns.append(pa.array([self.ends.get(i, NOTHING) for i in range(at, at + n)], pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, t) for t in piece.types)], schema=both)
        for at in range(0, len(self.pieces), most):
            some = _frame(self.pieces[at : at + most], piece)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(some.num_rows, t) for t in node.types), *some.columns], schema=both)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by block and place (the first of a block with its edges) to nodes and pieces."""
    current = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("block", "edge", "after", "owners", "lcp", "turns", "words", "n", "low", "ids")), strict=True):
            if current is None or current.block != row[0]:
                if current is not None:
                    current.finish()
                    yield from current.batches()
                current = _Block(*row[:4])
            current.add(*row[4:])
    if current is not None:
        current.finish()
        yield from current.batches()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and block to nodes; ids are hashed as they come."""
    schema, key, out = _schema(CROSSING), None, []

    def node():
        return (*key, above, low, n, children, leaves, spoken - n * before - born, digest.hexdigest())

    for batch in batches:
        for owner, depth, up, some_low, *more, some_before, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "owner_depth", "above", "some_low", "n", "children", "leaves", "spoken", "born", "before", "ids")), strict=True):
            if (owner, depth) != key:
                if key is not None:
                    out.append(node())
                key, above, low, n, children, leaves, spoken, born, before, digest, told = (owner, depth), None, some_low, 0, 0, 0, 0, 0, 0, hashlib.sha256(), False
            above, before, low = up if up is not None else above, before if some_before is None else some_before, min(low, some_low)
            n, children, leaves, spoken, born = (a + b for a, b in zip((n, children, leaves, spoken, born), more, strict=True))
            if ids is not None:
                if told:
                    digest.update(b",")
                digest.update(ids)
                told = True
        if out:
            yield _frame(out, schema)
            out = []
    if key is not None:
        yield _frame([node()], schema)


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and turns (digest in hex, words) of each conversation in ``rows`` (conv_id, turn, role, text).

    Turns are ordered by turn (null first), equal ones by digest; null roles and texts count as empty; rows without a
    conversation (null) are left out; repeated rows are turns of their own; other columns are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    turns = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), words.alias("words")).alias("x"))
    return turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x.digest.alias("digest"), x.words.alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Conversations that share beginnings: the first h turns of conversation c - c % ``every``, then its own after its first h.

    h is the CRC-32 of c in decimal, modulo ``most`` + 1. Where that conversation is absent, only its own turns after the
    first h are left, perhaps none.
    """
    base = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    joined = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    shared = F.when(F.col("first").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("first", F.lit(1), h))
    return joined.select("conv_id", F.concat(shared, own).alias("turns"))


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turns with digest and words): a row for each distinct sequence of first turns.

    Returns conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves
    (childless nodes in the subtree, the node itself included), saved_tokens (over the subtree, words of each node's last turn
    times the members but one) and ends_sha256 (the digest of the ascending ids, comma between, of the members that end at
    the node). Conversations without turns are members of the root. ``conv_id`` is distinct; an empty table gives an empty
    result; many equal conversations are spread over blocks, and one of any length is one key.
    """
    spark = convs.sparkSession
    prepare(spark)
    key = F.unhex(F.array_join("turns.digest", ""))
    with Scratch(spark, "trie") as made:
        keys = made.write(convs.select(key.alias("key"), "conv_id", F.col("turns.words").alias("words")), "keys")
        turns = keys.agg(F.sum(F.size("words")).alias("n")).first().n or 0
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // BLOCK_TURNS))
        dealt = keys.repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
        entries = made.write(dealt.mapInArrow(_entries, ENTRY), "entries")
        ends = entries.groupBy("block").agg(F.min("lcp").alias("inner"), F.min_by("key", F.when(F.col("key").isNotNull(), F.col("at"))).alias("first"), F.max_by("key", F.when(F.col("key").isNotNull(), F.col("at"))).alias("last"))
        edges = made.write(ends.repartition(1).sortWithinPartitions("block").mapInArrow(_edges, EDGES), "edges").withColumn("at", F.lit(0).cast("long"))
        told = entries.drop("key").join(edges, ["block", "at"], "left").repartition("block").sortWithinPartitions("block", "at")
        found = made.write(told.mapInArrow(_nodes, f"{NODE}, {PIECE}"), "found")
        pieces = found.where("owner IS NOT NULL").repartition("owner", "owner_depth").sortWithinPartitions("owner", "owner_depth", "block")
        crossing = made.write(pieces.mapInArrow(_summed, CROSSING), "crossing")
        columns = ["low", "depth", "parent_low", "parent_owner", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        nodes = found.where("depth IS NOT NULL").select(columns)
        # Only nodes whose parent reaches beyond their block need a join for its smallest member.
        open_ended = nodes.where("parent_owner IS NOT NULL").unionByName(crossing.withColumn("parent_low", F.lit(None).cast("long")).select(columns).where("depth > 0"))
        parents = crossing.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), F.col("low").alias("joined_low"))
        joined = open_ended.join(parents, ["parent_owner", "depth"], "left").withColumn("parent_low", F.col("joined_low")).select(columns)
        root = crossing.where("depth = 0").withColumn("parent_low", F.lit(None).cast("long")).select(columns)
        every = nodes.where("parent_owner IS NULL").unionByName(joined).unionByName(root)
        parent = F.when(F.col("depth") > 0, F.col("parent_low"))
        return write_table(every.select(F.col("low").alias("conv_id"), F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), *columns[4:]), "trie")
