import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bookwright.llm import encoding
from bookwright.llm.queries import TOKENIZERS, VOCABULARY


@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = [
    "", " ", "\x1c\x1d a\x1e b", "a\x85b    c", " \n\n x", "aaa" * 200, "ab" * 500, "。" * 300, "<|endoftext|>", "don't we'll I'M", "9½²³ Ⅷ", "x" * 777 + "é" * 300, "👩‍🔧" * 50, "__init__ _a",
    "".join(random.Random(1).choice("abAB12 \n\t\x1c\x85_-é漢½") for _ in range(5000)),
]


def test_hard_texts(reference):
    found = encoding.Encoder(VOCABULARY).encode([*HARD, None]).to_pylist()
    assert found == [*map(reference.encode_ordinary, HARD), []]


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(reference, text):
    assert encoding.encoder(VOCABULARY).encode([text]).to_pylist() == [reference.encode_ordinary(text)]


def test_another_vocabulary():
    path = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert encoding.Encoder(path).encode(["Größe и мера"]).to_pylist() == [own.encode_ordinary("Größe и мера")]


def test_forgetting_pieces_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED", 3)
    e = encoding.Encoder(VOCABULARY)
    for text in ("one two three four five", "six seven", "one two"):
        assert e.encode([text]).to_pylist() == [reference.encode_ordinary(text)]


def test_rows(spark, reference):
    long = "word and another " * 20000
    rows = [(1, "a b", 9), (1, "a b", 9), (2, None, 9), (3, "", 9), (None, "x", 9), (4, long, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumn("tokens", F.lit(1))
    found = sorted(((r["doc_id"] or 0, r["ids"]) for r in encoding.encode(df, VOCABULARY).collect()), key=repr)
    expected = sorted([(i or 0, reference.encode_ordinary(t or "")) for i, t, _ in rows], key=repr)
    assert found == expected
    assert encoding.encode(df.limit(0), VOCABULARY).count() == 0
    counts = encoding.count_tokens(df, VOCABULARY)
    assert {r["doc_id"]: r["n_tokens"] for r in counts.collect()}[4] == len(reference.encode_ordinary(long))
    assert "text" not in counts.columns
