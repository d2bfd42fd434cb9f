import unicodedata

import pytest
from pyspark.sql import functions as F

from bookwright.llm import lookalikes
from bookwright.llm.lookalikes import canonical_text

SAME = [
    ("Ｗｉｔｈ", "With"), ("é", "é"), ("й", "й"), ("сух", "cyx"), ("ﬁx", "fix"), ("a​b­c﻿", "abc"), ("a b c", "a b c"), ("a‐b‑c", "a-b-c"),
    ("Å", "Å"), ("µ", "μ"), ("ё", "ë"), ("e‍́", "é"), ("한", "한"), ("が", "が"), ("Ω", "Ω"), ("ｶﾞ", "ガ"), ("q̣̇", "q̣̇"),
]
OTHER = [("a", "A"), ("e", "é"), ("a b", "a  b"), ("a\nb", "a b"), ("a\nb", "a\r\nb"), ("\U0001f469‍\U0001f527", "\U0001f469\U0001f527"), ("क्‍ष", "क्ष"), ("½", "1/2"), ("x", "×")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert canonical_text(a) == canonical_text(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_look(a, b):
    assert canonical_text(a) != canonical_text(b)


def test_one_pass_is_enough():
    text = "".join(map(chr, range(0x20, 0x3000))) + "".join(a + b for a, b in SAME)
    once = canonical_text(text)
    assert canonical_text(once) == once
    assert lookalikes.mapping()


def test_scripts_keep_their_marks():
    for text in ("हिन्दी", "ไทย", "مثال", "한국어", "日本語が"):
        assert canonical_text(text) == text
    for text in ("Größe naïve", "ёлка йод"):
        assert unicodedata.is_normalized("NFC", canonical_text(text))


def test_rows(spark):
    rows = [(1, "With", 0), (2, "Ｗｉｔｈ", 0), (2, "Ｗｉｔｈ", 0), (3, "With", 0), (4, None, 0), (5, "", 0), (6, " ", 0), (7, " ", 0), (8, "with", 0), (None, "Wi​th", 0), (9, "Wіth", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, look int")
    assert sorted(map(tuple, lookalikes.same_look(df).collect())) == [(1, 2), (1, 9), (2, 3), (2, 9), (3, 9)]
    assert lookalikes.same_look(df.limit(0)).count() == 0
    found = lookalikes.canonical(df)
    assert found.columns == ["doc_id", "text"]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in found.collect()) == sorted((i or 0, canonical_text(t) or "") for i, t, _ in rows)


def test_pairs_against_every_pair(spark):
    texts = ["abc", "abс", "ａbc", "abd", "ab d", "ab d", "abc", None, "x" * 50000 + "​", "x" * 50000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if texts[a] and texts[b] and texts[a] != texts[b] and canonical_text(texts[a]) == canonical_text(texts[b])]
    assert sorted(map(tuple, lookalikes.same_look(df).collect())) == expected


def test_looks_are_rows_and_not_pairs(spark):
    rows = [(1, "With"), (2, "Ｗｉｔｈ"), (3, "With"), (9, "Wіth"), (4, None), (5, " "), (8, "with"), (8, "with"), (None, "With")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, lookalikes.looks(df).collect())) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (8, 8, 1), (9, 1, 3)]
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Same text").when(F.col("id") == 1, "Ｓame text").otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    assert lookalikes.looks(many).where("texts = 2").count() == 1001
    found = lookalikes.same_look(many)
    assert found.count() == 1000 and found.where("doc_a <> 1 and doc_b <> 1").count() == 0
