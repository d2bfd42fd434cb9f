import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookwright.operators import listing, search
from bookwright.errors import EmbedderMismatch

ROWS = [
    (1, 10, 0, "c1", "The quick brown foxes are jumping", "Foxes", [1.0, 0.0]),
    (2, 10, 1, "c2", "A quick reply about foo_bar and cafés", "", [0.8, 0.6]),
    (3, 10, 2, "c3", "bar foo, then foo bar again: foo bar", "Notes on foxes", [0.0, 1.0]),
    (4, 11, 0, "c4", "", None, None),
    (5, 11, 1, "c5", None, "quick", [1.0, 0.0]),
    (6, 11, 2, "c6", "nothing in common here", "", [0.6, 0.8]),
]
CHUNKS = "id long, document_id long, seq int, chunk_id string, text string, section_title string, embedding array<float>"


@pytest.fixture(scope="module")
def library(spark):
    chunks = spark.createDataFrame(ROWS, CHUNKS).withColumn("page_start", F.lit(None).cast("int")).withColumn("page_end", F.lit(None).cast("int")).withColumn("heading_path", F.array().cast("array<string>"))
    docs = spark.createDataFrame([(10, "a", "/p", "p", ["t"]), (11, "b", "/q", "q", [])], "doc_id long, collection string, source_path string, source_name string, tags array<string>")
    return chunks, docs


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(text, section_title, tokenize='porter unicode61')")
    db.executemany("insert into f(rowid, text, section_title) values (?, ?, ?)", [(r[0], r[4], r[5]) for r in ROWS])
    return db


@pytest.mark.parametrize("query", ["fox", "quick foxes", "cafe", "foo_bar", "jumped quick nothing", "absent", "the QUICK \"fox\" OR (common"])
def test_bm25_is_that_of_sqlite(library, fts, query):
    index = search.word_index(library[0])
    match = " OR ".join(f'"{t}"' for t in dict.fromkeys(w for w in __import__("re").findall(r"\w+", query.lower()) if len(w) > 1))
    expected = {r: -s for r, s in fts.execute("select rowid, bm25(f) from f where f match ?", (match,))}
    scores = search.keyword_scores(index, query)
    found = {r["id"]: r["bm25"] for r in scores.collect()}
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in found)


def test_no_terms_no_hits(library):
    chunks, docs = library
    assert search.keyword_scores(search.word_index(chunks), "! ?") is None
    assert search.search(chunks, docs, search.word_index(chunks), " ", None).count() == 0
    assert search.search(chunks, docs, search.word_index(chunks), "", [1.0, 0.0]).count() == 0


def test_vector_ranking_breaks_ties_by_id(library):
    found = search.vector_top(library[0], [1.0, 0.0], 3).orderBy("vector_rank").collect()
    assert [(r["id"], round(r["vector_score"], 4)) for r in found] == [(1, 1.0), (5, 1.0), (2, 0.8)]


def test_many_queries_agree_with_one(spark, library):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (None, [1.0, 0.0]), (4, None)], "query_id long, vector array<float>")
    found = search.vector_top_each(library[0], queries, 2).collect()
    assert sorted((r["query_id"], r["vector_rank"], r["id"]) for r in found) == [(1, 1, 1), (1, 2, 5), (2, 1, 3), (2, 2, 6)]


def test_modes(library):
    chunks, docs = library
    index = search.word_index(chunks)
    both = search.search(chunks, docs, index, "quick", [0.0, 1.0], k=3).collect()
    assert [r["rank"] for r in both] == [1, 2, 3]
    assert both[0]["score"] == round(1 / 61, 6) or both[0]["score"] > 1 / 61
    words = search.search(chunks, docs, index, "foo bar", None, k=2, mode="keyword").collect()
    assert words[0]["chunk_id"] == "c3"
    assert words[0]["score"] == round(1 / 61, 6)
    assert words[0]["vector_score"] is None
    own = search.search(chunks, docs, index, "quick", [1.0, 0.0], k=5, mode="vector", collections=["b"]).collect()
    assert {r["collection"] for r in own} == {"b"}
    with pytest.raises(ValueError, match="mode"):
        search.search(chunks, docs, index, "x", None, mode="other")
    with pytest.raises(ValueError, match="k is"):
        search.search(chunks, docs, index, "x", None, k=0)


def test_statistics_are_over_all_collections(library):
    chunks, docs = library
    index = search.word_index(chunks)
    everywhere = {r["id"]: r["bm25"] for r in search.keyword_scores(index, "quick").collect()}
    own = search.keyword_top(index, "quick", 5, chunks.where("document_id = 11")).collect()
    assert [(r["id"], r["bm25"]) for r in own] == [(5, everywhere[5])]


def test_read_window(library):
    chunks, docs = library
    assert [r["chunk_id"] for r in search.read_window(chunks, docs, "c2", 1).collect()] == ["c1", "c2", "c3"]
    assert [r["chunk_id"] for r in search.read_window(chunks, docs, "c2", 0).collect()] == ["c2"]
    assert search.read_window(chunks, docs, "c2", 1, "b").count() == 0
    assert search.read_window(chunks, docs, "none").count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0],), ([0.0, 0.0, 0.0],)], "v array<float>")
    found = [r[0] for r in df.select(search.normalised(F.col("v"))).collect()]
    assert np.allclose(found, [[0.6, 0.8, 0], [0, 0, 0]])
    assert np.allclose([r[0] for r in df.select(search.truncated(F.col("v"), 1)).collect()], [[1.0], [0.0]])
    with pytest.raises(Exception, match="at least 4"):
        df.select(search.truncated(F.col("v"), 4)).collect()


def test_empty_library(spark):
    chunks = spark.createDataFrame([], CHUNKS)
    index = search.word_index(chunks)
    assert search.keyword_scores(index, "word").count() == 0
    assert search.vector_top(chunks, [1.0], 3).count() == 0


def test_searchable(spark):
    some = spark.createDataFrame([("a", "e1"), ("b", "e2")], "name string, embedder string")
    assert listing.searchable(some, "e1") == ["a"]
    assert listing.searchable(some.limit(0), "e1") == []
    with pytest.raises(KeyError):
        listing.searchable(some, "e1", "c")
    with pytest.raises(EmbedderMismatch):
        listing.searchable(some, "e1", "b")
    with pytest.raises(EmbedderMismatch, match="e1, e2"):
        listing.searchable(some, "e3")


@pytest.mark.parametrize("most", [1 << 23, 40])
def test_more_query_values_than_are_broadcast(spark, monkeypatch, most):
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((300, 4)).astype(np.float32), rng.standard_normal((90, 4)).astype(np.float32)
    monkeypatch.setattr(search, "QUERY_VALUES", most)
    monkeypatch.setattr(search, "QUERY_BLOCK", 50)
    chunks = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)] + [(900, [1.0]), (901, None)], "id long, embedding array<float>")
    queries = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(q)], "query_id long, vector array<float>")
    found = search.vector_top_each(chunks, queries, 3)
    rows = {(r["query_id"], r["vector_rank"]): r["id"] for r in found.collect()}
    score = q.astype(np.float64) @ x.T.astype(np.float64)
    assert rows == {(n, k + 1): int(i) for n in range(len(q)) for k, i in enumerate(np.argsort(-score[n], kind="stable")[:3])}


def test_windows_and_previous_of_a_hot_document(spark):
    rows = [(n, 1, n if n < 50 else n + 7, f"v{n}") for n in range(100)] + [(200, 2, 0, None), (201, None, 3, "x"), (202, 2, None, "y"), (203, 2, 5, "z")]
    df = spark.createDataFrame(rows, "id long, document_id long, seq int, v string")
    around = {r["id"]: (r["n_around"], r["first_seq"], r["last_seq"]) for r in search.windows(df, 2).collect()}
    seqs = [s for _, d, s, _ in rows if d == 1]
    for i, d, s, _ in rows:
        near = [t for t in seqs if abs(t - s) <= 2] if d == 1 else []
        assert around[i] == ((len(near), near[0], near[-1]) if d == 1 else around[i])
    assert around[201] == around[202] == (0, None, None)
    for block in (7, 4096):
        before = {r["id"]: r["before"] for r in search.previous(df, "v", block).collect()}
        assert [before[n] for n in range(100)] == [None, *(f"v{n}" for n in range(99))]
        assert before[203] is None and before[200] == "y"  # a null place comes first


def test_too_many_hits_are_refused(library):
    chunks, docs = library
    for k in (0, search.MOST_HITS + 1):
        with pytest.raises(ValueError, match="at most"):
            search.search(chunks, docs, None, "x", [1.0, 0.0], k, "vector")
