import random

import pytest
from pyspark.sql import functions as F

from bookwright.llm import copies, neardup


@pytest.fixture(autouse=True)
def few_tasks(monkeypatch):
    monkeypatch.setattr(neardup, "TASKS", 4)


def library(n=120, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    texts = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            own = list(base)
            for _ in range(rng.randint(1, 7)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 2)] = [rng.choice(words)] * rng.randint(0, 2)
            texts.append(" ".join(own))
    return texts


def brute(texts):
    sets = [neardup.runs(t or "") for t in texts]
    key = ["".join(neardup.words(t or "")) for t in texts]
    return {(a, b): s for a in range(len(texts)) for b in range(a + 1, len(texts)) if key[a] != key[b] and (s := neardup.similarity(sets[a], sets[b])) >= 0.5}


def test_pairs_against_brute_force(spark):
    texts = library()
    expected = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {tuple(r) for r in neardup.similar_pairs(df).collect()}
    assert len(expected) > 80
    assert found <= set(expected)
    assert len(found) >= 0.97 * len(expected)


def test_edges(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [(1, base), (2, base.upper() + "!"), (3, base + " eleven"), (4, None), (5, ""), (6, "one two"), (7, "one two three"), (None, base), (8, base + " eleven"), (3, base + " eleven"), (9, " ".join(f"w{n}" for n in range(30000)))]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("a", F.lit(1)).withColumn("similarity", F.lit(1)).withColumn("rep", F.lit(1))
    assert sorted(map(tuple, neardup.similar_pairs(df).collect())) == [(1, 3), (1, 8), (2, 3), (2, 8)]
    groups = {r["id"]: (r["group_id"], r["links"]) for r in neardup.groups(df).collect()}
    assert groups == {1: (1, 1), 2: (1, 1), 3: (1, 1), 8: (1, 1), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0), 9: (9, 0)}
    assert neardup.similar_pairs(df.limit(0)).count() == 0
    assert neardup.groups(df.limit(0)).count() == 0


def test_copies_are_no_pairs(spark):
    rows = [(1, "name: alpha beta gamma\nsize: ten by twelve feet\nstate: open and ready now"), (2, "size: ten by twelve feet\nname: alpha beta gamma\nstate: open and ready now"), (3, "well-known words stand in this text here"), (4, "wellknown words stand in this text here")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert copies.text_copies(df).count() == 4
    assert neardup.similar_pairs(df).count() == 0


def test_chains_are_one_group(spark):
    words = [f"w{n}" for n in range(120)]
    texts = [" ".join(words[n * 4 : n * 4 + 60]) for n in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = neardup.groups(df).collect()
    assert {r["group_id"] for r in found} == {0}


def test_chains_of_short_texts_are_one_group(spark):
    words = [f"w{n}" for n in range(60)]
    texts = [" ".join(words[n * 3 : n * 3 + 20]) for n in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {r["group_id"] for r in neardup.groups(df).collect()} == {0}


def test_pairs_at_the_threshold(spark):
    texts = [" ".join(f"v{n}x{w}" for w in range(32)) for n in range(300)]
    texts += [" ".join([*text.split()[:22], *(f"u{n}x{w}" for w in range(10))]) for n, text in enumerate(texts)]
    assert all(neardup.similarity(neardup.runs(texts[n]), neardup.runs(texts[n + 300])) == 0.5 for n in range(300))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert neardup.similar_pairs(df).count() >= 297


def test_a_key_that_many_share_is_compared_in_blocks(spark, monkeypatch):
    texts = library(60, 9)
    base = " ".join(f"z{n}" for n in range(40))
    texts += [f"{base} own{n}" for n in range(60)]
    expected = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    monkeypatch.setattr(neardup, "CROWD", 7)
    monkeypatch.setattr(neardup, "PROBE", 2)
    monkeypatch.setattr(neardup, "TASK", 500)
    crowded = {tuple(r) for r in neardup.similar_pairs(df).collect()}
    assert len(expected) > 60 * 59 // 2
    assert crowded <= set(expected)
    assert len(crowded) >= 0.99 * len(expected)
    monkeypatch.setattr(neardup, "FEW", 0)
    monkeypatch.setattr(neardup, "small", lambda rows, number=None: rows)
    assert {tuple(r) for r in neardup.similar_pairs(df).collect()} == crowded


def test_a_third_of_all_rows_alike(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "the same words in every one of these texts").otherwise(F.concat_ws(" ", *[F.concat(F.lit(w), "id") for w in "abcdef"])).alias("text"))
    assert neardup.similar_pairs(df).count() == 0
