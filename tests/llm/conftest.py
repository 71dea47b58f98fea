import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"w{i * i % 977}" for i in range(9000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
HOSTILE = [
    None, "", " ", "\t\n\x0b\x0c\r", "a", "One two", "ONE  two", "It's we'll I'd x's 'S", "<|endoftext|>", "a  <|endoftext|>  b <|endoftext|>", "<|endoftext", "!!<|endoftext|>?",
    "caf\u00e9 na\u00efve \u00df \u4e2d\u6587\u5b57 \U0001f600\U0001f468\u200d\U0001f469 \u0e2a\u0e27\u0e31 \u0645\u0631\u062d\u0628\u0627", "a\u0085b\u00a0c\u2028d\u3000e\u180ef\u200bg\x1ch\x1fi", "x" * 3000, "1" * 500 + "\u00bd\u2167", " " * 700 + "z" + "\n" * 300,
    "e\u0301\u0301 \u0378 \U0001fae9 \U000323b0 \ufffd\x00\x01 b\x00c", LONG, LONG + " tail", PASSAGE, "before " + PASSAGE + " after", PASSAGE + " " + PASSAGE, "q " * 400, "r s " * 200,
]


@pytest.fixture(scope="session")
def hostile(spark):
    """Hostile texts with repeats; clashing extra columns."""
    rows = [(i, t, "x", i, f"n{i}", 0) for i, t in enumerate([*HOSTILE, LONG, LONG + " tail", PASSAGE])]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, block long, words string, n_tokens int").repartition(3)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def library():
    import public_tokenizers
    import tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t
