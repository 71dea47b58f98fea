"""Operator 7: toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of whole documents. Evidence of words and of their first letters (log odds of occurring in toxic against clean
labelled documents) labels the tokens of toxic documents; tokens of clean ones are clean. A chain over two states is
fitted to these token labels by gradient ascent on their conditional likelihood. Forward-backward marginals over the whole
document give spans, and their aggregate, through a logistic fit, the score of a document. The recursions go through
segments of a document side by side: products of their transfer matrices give the messages that enter each segment from
both sides, so that a chain is never cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistride.llm.common import Scratch, by_bytes, clean, prepare
from epistride.llm.hashing import U, mix, runs, span_totals, split_words, text_buffers, totals_hash

#: Bounds of what is fitted, all documented: labelled rows for evidence (toxic, clean), labelled rows for the chain (of each
#: class), and segments of these with and without evidence that its weights are fitted on, those with the smallest hashes.
#: Scoring covers every document whole.
EVIDENCE_ROWS = 10_000
CLEAN_ROWS = 30_000
CHAIN_ROWS = 300
CHAIN_SEGMENTS, PLAIN_SEGMENTS = 2048, 512
#: Tokens of a segment.
SEGMENT = 128
#: Bytes of a long text whose features are made at once.
PIECE = 4 << 20
#: Besides the whole word: its first 4, 5 and 6 bytes.
PREFIXES = (4, 5, 6)
LEAST_DOCUMENTS = 5
#: Likelihood ratio of a feature's counts from which it tells something, with so many features looked at.
LEAST_RATIO = 22.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features_of(texts: pa.Array) -> tuple[np.ndarray, object]:
    """Feature hashes of each token (runs of ASCII letters and other scripts, lower case): a row per kind of feature."""
    words = split_words(texts, lower=True, inside=_LETTER)
    spans = [words.ends, *(np.minimum(words.starts + k, words.ends) for k in PREFIXES)]
    out = np.zeros((len(spans), len(words.starts)), np.uint64)
    for lo, hi, at, total, inverse in span_totals(words.data, words.starts, words.ends):
        for row, ends in enumerate(spans):
            out[row, at] = mix(totals_hash(total, inverse, words.starts[at] - lo, ends[at] - lo) + U(row))
    for row, k in enumerate(PREFIXES, 1):
        out[row, words.ends - words.starts < k] = 0
    return out, words


class Evidence:
    """Log odds of the features that tell toxic from clean documents."""

    BITS = 20

    def __init__(self, hashes: np.ndarray, odds: np.ndarray):
        self.hashes = np.concatenate((np.zeros(1, np.uint64), hashes))
        self.odds = np.concatenate(([0], odds)).astype(np.float32)
        self.slot = np.zeros(1 << self.BITS, np.int32)
        self.rest: dict[int, int] = {}
        for i in range(1, len(self.hashes)):
            s = int(self.hashes[i]) & ((1 << self.BITS) - 1)
            if self.slot[s]:
                self.rest[int(self.hashes[i])] = i
            else:
                self.slot[s] = i
        self.more = np.array(sorted(self.rest), np.uint64)

    def __call__(self, features: np.ndarray) -> np.ndarray:
        at = self.slot[(features & U((1 << self.BITS) - 1)).astype(np.int64)]
        found = np.flatnonzero(at)
        out = np.zeros(features.shape, np.float32)
        h = features.reshape(-1)[found]
        i = at.reshape(-1)[found]
        odds = np.where(self.hashes[i] == h, self.odds[i], 0)
        if len(self.more):
            near = np.searchsorted(self.more, h)
            near[near == len(self.more)] = 0
            for j in np.flatnonzero(self.more[near] == h):
                odds[j] = self.odds[self.rest[int(h[j])]]
        out.reshape(-1)[found] = odds
        return out


@dataclass
class Chain:
    """Weights: of a token's features for the toxic state, of the four transitions, and of a document's aggregate."""

    emit: np.ndarray
    move: np.ndarray
    document: np.ndarray


def marginals(scores: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Marginals of state 1 for the tokens of some texts, given their scores for it; text i has the tokens first[i] to first[i + 1]."""
    begin, length, owner = segments(first)
    out = np.zeros(len(scores))
    if not len(begin):
        return out
    m = np.exp(move)
    e = np.exp(np.clip(scores, -30, 30))
    order = np.argsort(-length, kind="stable")
    begin, length, owner = begin[order], length[order], owner[order]
    steps = [int(np.searchsorted(-length, -i, side="left")) for i in range(int(length[0]))]  # segments longer than i

    # What a segment does to a message that enters it from the left: emission, then move and emission for each further token.
    q = np.zeros((2, 2, len(begin)))
    q[0, 0], q[1, 1] = 1, e[begin]
    for i, n in enumerate(steps[1:], 1):
        now, x = q[:, :, :n], e[begin[:n] + i]
        new = np.stack([now[:, 0] * m[0, 0] + now[:, 1] * m[1, 0], (now[:, 0] * m[0, 1] + now[:, 1] * m[1, 1]) * x], axis=1)
        q[:, :, :n] = new / new.sum(axis=(0, 1))
    q /= q.sum(axis=(0, 1))

    # Messages at the ends of segments, one segment of every text after another.
    left, right = np.full((2, len(begin)), 0.5), np.full((2, len(begin)), 0.5)
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))  # segments in the order of the texts
    parts = np.bincount(owner, minlength=len(first) - 1)
    start = np.cumsum(parts) - parts
    texts = np.argsort(-parts, kind="stable")
    for s in range(1, int(parts.max())):
        n = int(np.searchsorted(-parts[texts], -s, side="left"))
        own = start[texts[:n]] + s
        a, b = at[own - 1], at[own]
        new = m.T @ (left[0, a] * q[0][:, a] + left[1, a] * q[1][:, a])
        left[:, b] = new / new.sum(axis=0)
        own = start[texts[:n]] + parts[texts[:n]] - s
        a, b = at[own - 1], at[own]
        new = m @ (q[:, 0, b] * right[0, b] + q[:, 1, b] * right[1, b])
        right[:, a] = new / new.sum(axis=0)

    for i, n in enumerate(steps):
        here = begin[:n] + i
        one = left[1, :n] * e[here]
        share = one / (left[0, :n] + one)
        out[here] = share  # forward: what the tokens so far say
        new = m.T @ np.stack([1 - share, share])
        left[:, :n] = new / new.sum(axis=0)
    for i in range(len(steps) - 1, -1, -1):
        n = steps[i]
        here = begin[:n] + i
        one = out[here] * right[1, :n]
        zero = (1 - out[here]) * right[0, :n]
        out[here] = one / (zero + one)
        new = m @ np.stack([right[0, :n], right[1, :n] * e[here]])
        right[:, :n] = new / new.sum(axis=0)
    return out


def forward_backward(scores: np.ndarray, move: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1, expected transition counts [2, 2] and log partition values, by scaled recursions."""
    n, t = scores.shape
    m = np.exp(move)
    e = np.stack([np.ones_like(scores), np.exp(np.clip(scores, -30, 30))], axis=2)
    live = np.arange(t)[None, :] < lengths[:, None]
    a, c = np.zeros((n, t, 2)), np.ones((n, t))
    for i in range(t):
        a[:, i] = e[:, i] if i == 0 else (a[:, i - 1] @ m) * e[:, i]
        c[:, i] = a[:, i].sum(axis=1)
        a[:, i] /= c[:, i, None]
        stop = ~live[:, i]
        if stop.any():
            a[stop, i], c[stop, i] = (a[stop, i - 1] if i else 0.5), 1
    b = np.ones((n, t, 2))
    pairs = np.zeros((2, 2))
    for i in range(t - 2, -1, -1):
        right = e[:, i + 1] * b[:, i + 1] / c[:, i + 1, None]
        on = live[:, i + 1]
        b[on, i] = (right @ m.T)[on]
        pairs += m * (a[on, i].T @ right[on])
    post = a * b
    return np.where(live, post[:, :, 1] / post.sum(axis=2), 0), pairs, np.log(c).sum(axis=1)


def segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and text of the segments of each text, in order."""
    n = np.diff(first)
    parts = -(-n // SEGMENT)
    owner = np.repeat(np.arange(len(n)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[owner] + nth * SEGMENT
    return begin, np.minimum(SEGMENT, first[owner + 1] - begin), owner


def with_best(odds: np.ndarray) -> np.ndarray:
    """Inputs of a token: the odds of each kind of feature, and the largest of them."""
    return np.concatenate([odds, odds.max(axis=0, keepdims=True)]).T.astype(np.float64)


def aggregate(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: -sum log(1 - p) over its tokens, expected toxic tokens and log tokens."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    sums = [np.bincount(owner, v, len(first) - 1) for v in (-np.log1p(-np.minimum(p, 1 - 1e-9)), p)]
    return np.stack([*sums, np.log1p(np.diff(first))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a ridge; the first weight is of the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_chain(x: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, steps: int = 100, rate: float = 0.1) -> Chain:
    """Fits the chain to segments [n, t, k] of toxic and clean documents, whose tokens are labelled by their evidence."""
    y = ((x[:, :, -1] >= 2.5) & (toxic == 1)[:, None]).astype(np.float64)
    emit, move = np.zeros(x.shape[2] + 1), np.zeros((2, 2))
    emit[0] = -2
    live = np.arange(x.shape[1]) < lengths[:, None]
    both = live[:, 1:]
    seen_pairs = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)], float)
    size = live.sum()
    state = [np.zeros(emit.size + 4), np.zeros(emit.size + 4)]
    for k in range(1, steps + 1):  # Adam on the mean log likelihood
        p, pairs, _ = forward_backward(x @ emit[1:] + emit[0], move, lengths)
        d = np.where(live, y - p, 0)
        grad = np.concatenate([[d.sum()], np.einsum("nt,ntk->k", d, x), (seen_pairs - pairs).reshape(-1)]) / size * 20 - 1e-3 * np.concatenate([emit, move.reshape(-1)])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        step = rate * (state[0] / (1 - 0.9**k)) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-6)
        emit, move = emit + step[: emit.size], move + step[emit.size :].reshape(2, 2)
        move -= move[0, 0]
    return Chain(emit, move, np.zeros(4))


@dataclass
class Model:
    evidence: Evidence | None
    chain: Chain | None
    share: float

    def tokens(self, texts: pa.Array):
        """Inputs of all tokens, their begin and end in the texts' bytes, and the tokens of each text; long texts in pieces."""
        data, offsets = text_buffers(texts)
        x, starts, ends = [np.zeros((0, len(PREFIXES) + 2))], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(*_pieces(data), strict=True):
            inner = offsets[(offsets > lo) & (offsets < hi)] - lo
            cuts = np.concatenate(([0], inner, [hi - lo])).astype(np.int64)
            piece = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data[lo:hi]))])
            features, words = features_of(piece)
            x.append(with_best(self.evidence(features)))
            starts.append(words.starts + lo)
            ends.append(words.ends + lo)
        starts = np.concatenate(starts)
        return np.concatenate(x), starts, np.concatenate(ends), np.searchsorted(starts, offsets), data, offsets

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores and toxic spans (code points) of whole texts."""
        spans: list[list[dict]] = [[] for _ in range(len(texts))]
        if self.chain is None:
            return np.full(len(texts), self.share), spans
        x, starts, ends, first, data, offsets = self.tokens(texts)
        p = marginals(x @ self.chain.emit[1:] + self.chain.emit[0], first, self.chain.move)
        inputs = np.column_stack([np.ones(len(texts)), aggregate(p, first)])
        score = 1 / (1 + np.exp(-np.clip(inputs @ self.chain.document, -30, 30)))
        found = np.flatnonzero(p > 0.5)
        owner = np.searchsorted(first, found, side="right") - 1
        for a, b in runs(owner):
            doc, own = int(owner[a]), found[a:b]
            lo, hi = int(offsets[doc]), int(offsets[doc + 1])
            points = np.concatenate(([0], np.cumsum((data[lo:hi] & 0xC0) != 0x80)))  # code points before each byte
            for k in own.tolist():
                spans[doc].append({"begin": int(points[starts[k] - lo]), "end": int(points[ends[k] - lo]), "marginal": float(p[k])})
        return score, spans


def _pieces(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Begins and ends of pieces of about PIECE bytes that end where no token goes on."""
    cuts = [0]
    while len(data) - cuts[-1] > PIECE:
        at = cuts[-1] + PIECE
        while at < len(data) and _LETTER[data[at]]:
            other = np.flatnonzero(~_LETTER[data[at : at + PIECE]])
            at += int(other[0]) if len(other) else min(PIECE, len(data) - at)
        cuts.append(at)
    if cuts[-1] < len(data):
        cuts.append(len(data))
    return cuts[:-1], cuts[1:]


def _counted(batches):
    """Documents that hold each feature, by class; one row per feature and batch of texts."""
    for batch in batches:
        for part in by_bytes(batch):
            features, words = features_of(part.column("text"))
            toxic = np.repeat(part.column("toxic").to_numpy() == 1, words.per_text)
            doc = np.repeat(np.arange(part.num_rows), words.per_text)
            h, d, t = features.reshape(-1), np.tile(doc, len(features)), np.tile(toxic, len(features))
            order = np.lexsort((d, h))
            h, d, t = h[order], d[order], t[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            new &= h != 0
            h, t = h[new], t[new]
            values, at = np.unique(h, return_inverse=True)
            n = np.bincount(at, minlength=len(values))
            bad = np.bincount(at, t, minlength=len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(bad), pa.array(n - bad)], ["h", "toxic", "clean"])


def _segment_rows(model: Model):
    """Arrow function: inputs of the tokens of each segment of labelled texts, one after another, and whether any has evidence."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch):
                x, _, _, first, _, _ = model.tokens(part.column("text"))
                begin, length, owner = segments(first)
                lists = [x[a : a + n].astype(np.float32).reshape(-1) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [part.column(c).take(pa.array(owner)) for c in ("id", "toxic")]
                seen = pa.array([bool(v.any()) for v in lists], pa.bool_())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(len(owner))), seen, pa.array(lists, pa.list_(pa.float32()))], ["id", "toxic", "nth", "seen", "x"])

    return run


def _document_rows(model: Model):
    """Arrow function: the label and the aggregate of the marginals of labelled texts."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch):
                x, _, _, first, _, _ = model.tokens(part.column("text"))
                told = aggregate(marginals(x @ model.chain.emit[1:] + model.chain.emit[0], first, model.chain.move), first)
                yield pa.RecordBatch.from_arrays([part.column("toxic"), *(pa.array(told[:, k].copy()) for k in range(3))], ["toxic", "a", "b", "c"])

    return run


def fit(docs: DataFrame, labels: DataFrame, train=None) -> Model:
    """Fits the model on labelled rows for which the column ``train`` (of ``id``) holds.

    Evidence comes from at most EVIDENCE_ROWS toxic and CLEAN_ROWS clean labelled documents, those with the smallest hash of their id;
    texts that occur several times count once. Weights of the chain come from CHAIN_SEGMENTS segments with and
    PLAIN_SEGMENTS without evidence out of CHAIN_ROWS documents of each class, whatever their length, and the weights of
    documents from all of these documents. ``docs`` has id and text, ``labels`` id and toxic.
    """
    known = labels.where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    if train is not None:
        known = known.where(train)
    order = F.xxhash64("id", F.lit(17))
    ids = known.where("toxic = 1").orderBy(order).limit(EVIDENCE_ROWS).union(known.where("toxic = 0").orderBy(order).limit(CLEAN_ROWS))
    found = docs.join(F.broadcast(ids), "id").withColumn("key", F.xxhash64("text"))  # ids: at most EVIDENCE_ROWS + CLEAN_ROWS rows
    first = found.groupBy("key").agg(F.min("id").alias("id"))
    with Scratch(docs.sparkSession, "toxicity") as made:
        sample = made.write(found.join(first, ["key", "id"]).dropDuplicates(["key"]).select("id", "text", "toxic"), "labelled")
        sizes = dict(sample.groupBy("toxic").count().collect())
        bad, good = sizes.get(1, 0), sizes.get(0, 0)
        if not bad or not good:
            return Model(None, None, bad / max(1, bad + good))
        model = Model(_evidence(sample, bad, good), None, known.agg(F.avg("toxic")).first()[0])
        part = [sample.where(F.col("toxic") == y).orderBy(order).limit(CHAIN_ROWS) for y in (1, 0)]
        part = made.write(part[0].union(part[1]).repartition(8), "chain")
        cut = made.write(part.mapInArrow(_segment_rows(model), f"id {dict(part.dtypes)['id']}, toxic int, nth long, seen boolean, x array<float>"), "segments")
        order = F.xxhash64("id", "nth"), F.col("id"), F.col("nth")
        some = cut.where("seen").orderBy(*order).limit(CHAIN_SEGMENTS).union(cut.where("NOT seen").orderBy(*order).limit(PLAIN_SEGMENTS)).toArrow()  # bounded by both
        width = len(PREFIXES) + 2
        lengths = np.diff(some.column("x").combine_chunks().offsets.to_numpy()) // width if some.num_rows else np.zeros(0, int)
        if not len(lengths):
            return Model(None, None, model.share)
        x = np.zeros((len(lengths), int(lengths.max()), width))
        x[np.arange(x.shape[1]) < lengths[:, None]] = some.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width)
        model.chain = fit_chain(x, lengths, some.column("toxic").to_numpy())
        rows = part.mapInArrow(_document_rows(model), "toxic int, a double, b double, c double").collect()  # at most 2 * CHAIN_ROWS
    toxic = np.array([r.toxic for r in rows], float)
    model.chain.document = _logistic(np.array([r[1:] for r in sorted(rows)]), np.sort(toxic))
    # The sample holds the classes about evenly; the constant goes back to the labelled share.
    model.chain.document[0] += np.log(model.share / (1 - model.share)) - np.log(toxic.mean() / (1 - toxic.mean()))
    return model


def _evidence(sample: DataFrame, bad: int, good: int) -> Evidence:
    """The features of a bounded sample whose counts tell toxic from clean documents beyond chance."""
    counted = sample.select("text", "toxic").mapInArrow(_counted, "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    part = lambda n, share: F.when(n > 0, n * F.log(n / ((F.col("toxic") + F.col("clean")) * share))).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), bad / (bad + good)) + part(F.col("clean"), good / (bad + good)))
    telling = counted.where(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("odds", odds).where("odds >= 1.5").where(ratio >= LEAST_RATIO)
    rows = sorted(telling.select("h", "odds").collect())
    return Evidence(np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.odds for r in rows]))


def score_documents(docs: DataFrame, labels: DataFrame, train=None, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row of ``docs`` with its columns and score, predicted (score >= threshold) and spans (begin, end, marginal).

    Only the text enters a score. Null texts count as empty; empty texts get the score of no evidence; repeated rows each
    give a row; columns of ``docs`` named score, predicted or spans are replaced; without labels of both classes every
    score is the labelled share of toxic rows (0 without labels); an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_column).alias("id"), clean(text_column).alias("text"))
    model = fit(rows, labels.select(F.col("doc_id").alias("id"), F.col("toxic")), train)

    @F.pandas_udf("score double, spans array<struct<begin: bigint, end: bigint, marginal: double>>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        scores, spans = [], []
        for part in by_bytes(batch):
            s, v = model.score(part.column("text"))
            scores.append(s)
            spans += v
        return pd.DataFrame({"score": np.concatenate(scores) if scores else np.zeros(0), "spans": spans})

    out = docs.drop("score", "predicted", "spans").withColumn("scored", scored(clean(text_column)))
    return out.select("*", "scored.score", "scored.spans").drop("scored").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_column: str):
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_held_out(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every row; labels of held-out rows are not learned from."""
    out = score_documents(docs.select("doc_id", "text"), labels, ~held_out("id"), threshold)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "spans")
