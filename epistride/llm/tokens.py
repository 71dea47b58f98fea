"""Operator 1: token counts, by batch encoding inside Arrow functions that return lengths only.

Texts go through an encoder of the same vocabulary, merges and pattern as the tokenizer file; the two agree on every
text (tests compare them on hostile inputs), and the fast one is several times quicker. A batch is encoded by one call:
its texts are joined by the special string, across which no token reaches, and cut apart at its id. Long texts are split
where no token can reach across either: before white space that follows something else, and where a letter is followed by
a digit or a punctuation mark, or a digit by a letter. The special string inside texts keeps its own id, as in the
library's defaults.
"""

from __future__ import annotations

import base64
import functools
import json
import logging
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistride.llm.common import by_bytes, clean, prepare

#: Characters from which a text is split, and at most about so long a piece if it has a safe boundary; characters of one call.
PIECE_CHARS = 1 << 16
CALL_CHARS = 1 << 20
#: Letters whose class no version of Unicode changes; "|" is left out on the right, as special strings hold a letter before it.
_LETTERS = "A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_SAFE = re.compile(rf"(?<=\S)(?=[ \n\t\r])|(?<=[{_LETTERS}])(?=[0-9!\"#$%&'()*+,./:;<=>?@\[\]^`{{}}~\u3001\u3002\uff01\uff0c\uff1f-])|(?<=[0-9])(?=[{_LETTERS}])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_character() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts by the vocabulary file at ``path``."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        import tokenizers

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        table = byte_of_character()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.pieces = {i: bytes(table[c] for c in s) for s, i in file["model"]["vocab"].items() if s not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in self.pieces.items()}, special_tokens=self.special)
        self.pieces |= {i: s.encode() for s, i in self.special.items()}
        self.slow = tokenizers.Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text as uint32."""
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """All ids of each text as uint32; calls take about CALL_CHARS characters each, whatever the lengths of texts."""
        pieces, owner = [], []
        for i, text in enumerate(texts):
            for piece in safe_pieces(text):
                pieces.append(piece)
                owner.append(i)
        made: list[list[np.ndarray]] = [[] for _ in texts]
        begin, size = 0, 0
        for end, piece in enumerate(pieces, 1):
            size += len(piece)
            if size >= CALL_CHARS or end == len(pieces):
                for i, ids in zip(owner[begin:end], self._call(pieces[begin:end]), strict=True):
                    made[i].append(ids)
                begin, size = end, 0
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in made]

    def _call(self, pieces: list[str]) -> list[np.ndarray]:
        if not self.special:
            return [self._ids(x) for x in pieces]
        mark, number = next(iter(self.special.items()))
        ids = self._ids(mark.join(pieces))
        # Marks inside pieces stand before the one that ends them.
        nth = np.cumsum([x.count(mark) + 1 for x in pieces])[:-1] - 1
        cuts = np.flatnonzero(ids == number)[nth]
        begins, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
        return [ids[a:b] for a, b in zip(begins, ends, strict=True)]

    def _ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # the fast library gives up on huge unbroken runs with a panic, which isn't an Exception
            if type(e).__name__ != "PanicException":
                raise
            logging.getLogger(__name__).warning("%d characters go through the slower library", len(text))
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def safe_pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of about ``most`` characters, split only where no token reaches across; none of these places is inside a special string."""
    start = 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text", limit: int = 1024) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row.

    Null texts count as empty (0 bytes, 0 tokens); repeated rows each give a row; other columns are left out, whatever
    their names; an empty table gives an empty result; texts of any length are counted whole.
    """
    prepare(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def lengths(batches):
        enc = encoder(path)
        for batch in batches:
            for part in by_bytes(batch):
                texts = part.column("text")
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array([len(x) for x in enc.batch(texts.to_pylist())], pa.int64())],
                    ["id", "n_bytes", "n_tokens"],
                )

    rows = docs.select(F.col(id_column).alias("id"), clean(text_column).alias("text"))
    kind = dict(rows.dtypes)["id"]
    counted = rows.mapInArrow(lengths, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
