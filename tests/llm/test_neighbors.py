import numpy as np
import pytest
from pyspark.sql import functions as F

from bookwright.llm import neighbors


@pytest.fixture(autouse=True)
def few_tasks(monkeypatch):
    monkeypatch.setattr(neighbors, "TASKS", 4)


def exact(ids, x, k, least):
    """Pairs by brute force; of equal similarities the lower id first."""
    pairs = set()
    for n, i in enumerate(ids):
        score = np.round((x @ x[n]).astype(float), 6)
        order = sorted((m for m in range(len(ids)) if m != n and score[m] >= least), key=lambda m: (-score[m], ids[m]))[:k]
        pairs |= {(min(i, ids[m]), max(i, ids[m])) for m in order}
    return pairs


def clusters(rng, groups, size, dim, noise):
    centre = rng.standard_normal((groups, 1, dim))
    x = (centre / np.linalg.norm(centre, axis=2, keepdims=True) + noise * rng.standard_normal((groups, size, dim)) / np.sqrt(dim)).reshape(-1, dim)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, ids, x, space=1):
    return spark.createDataFrame([(int(i), space, v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, space long, vector array<float>")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([clusters(rng, 150, 6, 64, 0.3), clusters(rng, 600, 1, 64, 0)])
    ids = rng.permutation(len(x))
    expected = exact(ids, x, 10, 0.9)
    found = {tuple(r) for r in neighbors.similar_pairs(frame(spark, ids, x)).collect()}
    assert len(expected) > 1000
    assert found <= expected
    assert len(found) >= 0.94 * len(expected)


def test_copies_keep_k_neighbours(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.repeat(clusters(rng, 1, 1, 32, 0), 40, axis=0), clusters(rng, 3, 2, 32, 0.1)])
    df = frame(spark, range(len(x)), x)
    found = neighbors.neighbours(df, k=3).collect()
    own = {}
    for r in found:
        own.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    assert sorted(own[0]) == [(1, 1), (2, 2), (3, 3)]
    assert sorted(own[2]) == [(1, 0), (2, 1), (3, 3)]
    assert sorted(own[39]) == [(1, 0), (2, 1), (3, 2)]
    assert {tuple(r) for r in neighbors.similar_pairs(df, k=3).collect()} == exact(list(range(len(x))), x, 3, 0.9)
    assert neighbors.similar_pairs(df.unionByName(df), k=3).count() == neighbors.similar_pairs(df, k=3).count()


def test_crowded_buckets_keep_their_recall(spark):
    rng = np.random.default_rng(3)
    x = clusters(rng, 2, 150, 32, 0.25)
    ids = list(range(len(x)))
    expected = exact(ids, x, 5, 0.9)
    crowded = neighbors.neighbours(frame(spark, ids, x), k=5, crowd=20)
    found = {(min(r["id"], r["neighbour"]), max(r["id"], r["neighbour"])) for r in crowded.collect()}
    assert len(found & expected) > 0.95 * len(expected)
    whole = {(min(r["id"], r["neighbour"]), max(r["id"], r["neighbour"])) for r in neighbors.neighbours(frame(spark, ids, x), k=5).collect()}
    assert len(whole & expected) > 0.95 * len(expected)


def test_crowded_buckets_lose_nothing(spark):
    rng = np.random.default_rng(3)
    x = clusters(rng, 2, 150, 32, 0.25)
    ids = list(range(len(x)))
    expected = exact(ids, x, 5, 0.9)
    df = frame(spark, ids, x)
    crowded, whole = ({(min(r["id"], r["neighbour"]), max(r["id"], r["neighbour"])) for r in neighbors.neighbours(df, k=5, min_similarity=0.9, crowd=crowd).collect()} for crowd in (20, neighbors.CROWD))
    assert crowded == whole
    assert len(crowded & expected) > 0.95 * len(expected)


def test_every_vector_has_its_k(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([clusters(rng, 1, 30, 32, 0.2), clusters(rng, 200, 1, 32, 0), np.repeat(clusters(rng, 1, 1, 32, 0), 4, axis=0)])
    ids = rng.permutation(len(x))
    df = frame(spark, ids, x).unionByName(frame(spark, [1000, 1001], x[:2], 2))
    for block in (neighbors.ASKING, 50):
        monkeypatch.setattr(neighbors, "ASKING", block)
        monkeypatch.setattr(neighbors, "ASKED", block)
        monkeypatch.setattr(neighbors, "SLAB", 2)
        own = {}
        for r in neighbors.neighbours(df, k=5).orderBy("id", "rank").collect():
            own.setdefault(r["id"], []).append(r["neighbour"])
        assert (own.pop(1000), own.pop(1001)) == ([1001], [1000])
        assert set(own) == set(ids.tolist()) and {len(v) for v in own.values()} == {5}
        score = np.round((x.astype(float) @ x.T.astype(float)), 9)
        true = {int(ids[n]): [int(ids[m]) for m in sorted((m for m in range(len(ids)) if m != n), key=lambda m: (-score[n, m], ids[m]))[:5]] for n in range(len(ids))}
        assert sum(len(set(own[i]) & set(true[i])) for i in true) >= 0.99 * 5 * len(true)
        assert all(own[int(i)] == true[int(i)] for i in ids[30:])


def test_spaces_are_apart(spark):
    x = clusters(np.random.default_rng(4), 1, 1, 16, 0)
    df = frame(spark, [1], x, 1).unionByName(frame(spark, [2], x, 2)).unionByName(frame(spark, [3], x, 1))
    assert [tuple(r) for r in neighbors.similar_pairs(df).collect()] == [(1, 3)]
    assert neighbors.similar_pairs(df.limit(0)).count() == 0


@pytest.mark.filterwarnings("ignore")
def test_usable_vectors(spark):
    chunks = spark.createDataFrame(
        [(1, 1, [3.0, 4.0]), (2, 1, None), (3, 1, [0.0, 0.0]), (4, 1, [1.0, 2.0, 3.0]), (5, 2, [1.0, 0.0]), (6, 9, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (7, 1, [float("nan"), 1.0]), (8, 1, [None, 1.0]), (9, 3, [1.0, 0.0])],
        "id long, document_id long, embedding array<float>",
    ).withColumn("vector", F.lit(1)).withColumn("collection", F.lit("x"))
    documents = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, collection string")
    collections = spark.createDataFrame([("a", "e", 2), ("b", "f", 2), (None, "e", 2)], "name string, embedder string, dim int")
    found = {r["id"]: r for r in neighbors.vectors(chunks, documents, collections).collect()}
    assert set(found) == {1, 5}
    assert np.allclose(found[1]["vector"], [0.6, 0.8])
    assert found[1]["space"] != found[5]["space"]
