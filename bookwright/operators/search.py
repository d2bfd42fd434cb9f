"""Ranked search over chunks: by vector, by words (BM25), and by both.

The word index is two tables made once for a snapshot: postings (a term, a chunk
and the places of the term in it) and lengths. Counts for BM25 are over all
chunks, whatever collections a query is limited to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookwright.functions.stemming import stem_column, tokens
from bookwright.functions.stemming import term as index_term
from bookwright.functions.text import citation, snippet

#: BM25's constants, the least inverse document frequency, and the constant of rank fusion.
K1, B, LEAST_IDF, FUSION = 1.2, 0.75, 1e-6, 60
MODES = ("hybrid", "vector", "keyword")
#: Hits that one search may ask for; their rows are broadcast to fetch what is shown of them.
MOST_HITS = 1 << 12
#: Values of query vectors that may be broadcast to all chunks (64 MB), and of a block of them.
QUERY_VALUES, QUERY_BLOCK = 1 << 23, 1 << 18
#: Places of a document that one task orders.
BLOCK = 1 << 12


def pool_size(k: int) -> int:
    """Candidates that each ranking hands to fusion."""
    return max(4 * k, 20)


# Vectors


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(vector: Column) -> Column:
    """The vector at length 1; an all-zero vector stays."""
    length = norm(vector)
    return F.transform(vector, lambda x: (x / F.when(length == 0, 1.0).otherwise(length)).cast("float"))


def truncated(vector: Column, dim: int) -> Column:
    """The first ``dim`` values at length 1; fails for shorter vectors."""
    short = F.raise_error(F.concat(F.lit(f"a vector of at least {dim} values is needed, got "), F.size(vector).cast("string")))
    return F.when(F.size(vector) < dim, short.cast("array<float>")).otherwise(normalised(F.slice(vector, 1, dim)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_scores(chunks: DataFrame, query: Sequence[float], vector: str = "embedding") -> DataFrame:
    """``chunks`` with ``vector_score``; rows without a vector of the query's length are left out."""
    values = F.array(*[F.lit(float(x)) for x in query])
    return chunks.where(F.size(vector) == len(query)).withColumn("vector_score", dot(F.col(vector), values))


def vector_top(chunks: DataFrame, query: Sequence[float], k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """``key``, ``vector_score`` and ``vector_rank`` of the ``k`` best; of equal ones the lower key first."""
    best = vector_scores(chunks.select(key, vector), query, vector).select(key, "vector_score").orderBy(F.desc("vector_score"), key).limit(k)
    return best.withColumn("vector_rank", F.row_number().over(Window.orderBy(F.desc("vector_score"), key)))


def _query_blocks(queries: DataFrame, values: int) -> DataFrame:
    """``dim``, ``ids`` and ``vectors`` (bytes) of blocks of about QUERY_BLOCK values of query vectors, of which there are ``values``."""
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("vectors", T.BinaryType())])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        vectors = np.array(table.column("vector").to_pylist(), np.float64)
        ids = table.column("query_id").to_numpy().astype(np.int64)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([ids.tobytes()]), pa.array([vectors.tobytes()])], names=[f.name for f in schema])

    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-values // QUERY_BLOCK))))
    rows = queries.select(F.size("vector").alias("dim"), block.alias("block"), F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.groupBy("dim", "block").applyInArrow(pack, schema)


def _chunk_blocks(chunks: DataFrame, key: str, vector: str) -> DataFrame:
    """``of`` (the length), ``keys`` and ``given`` (bytes) of blocks of chunks, as their tasks read them."""
    schema = T.StructType([T.StructField("of", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("given", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1)
            at, flat = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False)
            size = np.diff(at)
            for dim in np.unique(size[size > 0]):
                own = np.flatnonzero(size == dim)
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[own].tobytes()]), pa.array([flat[at[own][:, None] + np.arange(dim)].astype(np.float32).tobytes()])], names=[f.name for f in schema])

    given = chunks.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    return given.select(F.col(key).cast("bigint").alias(key), F.col(vector).cast("array<float>").alias(vector)).mapInArrow(pack, schema)


def vector_top_each(chunks: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``key``, ``vector_score``, ``vector_rank`` of the ``k`` best of every query vector.

    ``queries`` has ``query_id`` and ``vector``. Blocks of queries are held
    against blocks of chunks: a task keeps the best of its own rows and only
    those are shuffled. Up to QUERY_VALUES values of queries, counted first, are
    broadcast; of more, every block of queries is sent to every part of the chunks.
    Null ids and vectors take no part, and vectors of other lengths don't meet.
    """
    asked = queries.where("query_id is not null and vector is not null").select("query_id", "vector")
    values = asked.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).collect()[0][0]
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField(key, T.LongType()), T.StructField("vector_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                names, ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["keys"], np.int64)
                q, x = np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dim"]), np.frombuffer(r["given"], np.float32).reshape(-1, r["dim"]).astype(np.float64)
                for at in range(0, len(names), 256):
                    score = q[at : at + 256] @ x.T
                    order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[at : at + 256], order.shape[1])), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(score, order, 1).ravel())], names=[f.name for f in schema])

    blocks = _query_blocks(asked, values)
    blocks = F.broadcast(blocks) if values <= QUERY_VALUES else blocks.hint("shuffle_replicate_nl")
    met = _chunk_blocks(chunks, key, vector).join(blocks, F.col("dim") == F.col("of"))
    best = Window.partitionBy("query_id").orderBy(F.desc("vector_score"), key)
    return met.mapInArrow(run, schema).withColumn("vector_rank", F.row_number().over(best)).where(F.col("vector_rank") <= k)


# Words


@dataclass
class WordIndex:
    """``postings`` (term, key, places), ``lengths`` (key, n) of every chunk."""

    postings: DataFrame
    lengths: DataFrame
    key: str = "id"
    stemmed: bool = True

    def stats(self) -> DataFrame:
        """One row: ``chunks`` and ``mean_length``."""
        return self.lengths.agg(F.count("*").alias("chunks"), F.avg("n").alias("mean_length"))

    def frequencies(self) -> DataFrame:
        """``term``, ``df``: in how many chunks a term is."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))


def document_frequencies(chunks: DataFrame, text: str = "text", title: str | None = "section_title", key: str = "id") -> DataFrame:
    """``term``, ``df`` of unstemmed terms, from the distinct terms of every chunk: what an index would give, without its places. Keys are unique."""
    found = tokens(F.col(text))
    found = F.concat(found, tokens(F.col(title))) if title else found
    return chunks.where(F.col(key).isNotNull()).select(F.explode(F.array_distinct(found)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def word_index(chunks: DataFrame, key: str = "id", text: str = "text", title: str | None = "section_title", stemmed: bool = True, carried: tuple[str, ...] = ()) -> WordIndex:
    """The index of text and title; null counts as empty, and a place between the two keeps phrases apart.

    ``carried`` are columns of a chunk that both tables keep. Stems are worked out
    once for each distinct word and joined to the words of chunks.
    """
    found = tokens(F.col(text))
    if title:
        found = F.concat(found, F.array(F.lit(None).cast("string")), tokens(F.col(title)))
    rows = chunks.where(F.col(key).isNotNull()).select(key, *carried, found.alias("words"))
    lengths = rows.select(key, *carried, F.size(F.array_compact("words")).alias("n"))
    placed = rows.select(key, *carried, F.posexplode("words").alias("place", "term")).where("term is not null")
    postings = placed.groupBy("term", key, *carried).agg(F.sort_array(F.collect_list("place")).alias("places"))
    if stemmed:
        distinct = placed.select("term").distinct()
        vocabulary = distinct.select(F.col("term"), stem_column(F.col("term")).alias("stem"))
        meant = postings.join(vocabulary, "term").select(F.col("stem").alias("term"), key, *carried, "places")
        postings = meant.groupBy("term", key, *carried).agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    return WordIndex(postings, lengths, key, stemmed)


def phrases(query: str, stemmed: bool = True) -> list[tuple[str, ...]]:
    """Terms of a query, distinct and in order; one joined by ``_`` is a phrase."""
    found = dict.fromkeys(t for t in re.findall(r"\w+", query.lower()) if len(t) > 1)
    split = (tuple(index_term(p) if stemmed else p for p in re.findall(r"[^\W_]+", t)) for t in found)
    return list(dict.fromkeys(p for p in split if p))


def phrase_hits(index: WordIndex, phrase: tuple[str, ...]) -> DataFrame:
    """``key``, ``tf``: chunks with the phrase, and how often."""
    hits = index.postings.where(F.col("term") == phrase[0]).select(index.key, "places")
    for n, part in enumerate(phrase[1:], 1):
        other = index.postings.where(F.col("term") == part).select(index.key, F.expr(f"transform(places, p -> p - {n})").alias("at"))
        hits = hits.join(other, index.key).select(index.key, F.array_intersect("places", "at").alias("places")).where(F.size("places") > 0)
    return hits.select(index.key, F.size("places").alias("tf"))


def bm25(tf: Column, df: Column, n: Column, chunks: Column, mean_length: Column) -> Column:
    idf = F.greatest(F.log((chunks - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean_length))


def keyword_scores(index: WordIndex, query: str) -> DataFrame | None:
    """``key``, ``bm25`` of every chunk that has a term of the query; None for a query without terms."""
    wanted = phrases(query, index.stemmed)
    if not wanted:
        return None
    # Single words in one scan of the postings, phrases by joins of theirs.
    single = {p[0]: n for n, p in enumerate(wanted) if len(p) == 1}
    number = F.create_map(*[F.lit(x) for pair in single.items() for x in pair]) if single else None
    parts = [index.postings.where(F.col("term").isin(*single)).select(index.key, F.size("places").alias("tf"), number[F.col("term")].alias("phrase"))] if single else []
    parts += [phrase_hits(index, p).withColumn("phrase", F.lit(n)) for n, p in enumerate(wanted) if len(p) > 1]
    hits = reduce(DataFrame.unionByName, parts)
    # Of a few terms: one row each, broadcast with the one row of counts.
    df = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "phrase").join(index.lengths, index.key).crossJoin(F.broadcast(index.stats()))
    return scored.groupBy(index.key).agg(F.sum(bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("chunks"), F.col("mean_length"))).alias("bm25"))


def keyword_top(index: WordIndex, query: str, k: int, among: DataFrame | None = None) -> DataFrame | None:
    """``key``, ``bm25``, ``keyword_rank`` of the ``k`` best chunks, of those in ``among`` if given."""
    scores = keyword_scores(index, query)
    if scores is None:
        return None
    if among is not None:
        scores = scores.join(among.select(index.key), index.key, "left_semi")
    best = scores.orderBy(F.desc("bm25"), index.key).limit(k)
    return best.withColumn("keyword_rank", F.row_number().over(Window.orderBy(F.desc("bm25"), index.key)))


# Both


def fused(vectors: DataFrame | None, keywords: DataFrame | None, key: str = "id") -> DataFrame:
    """Rankings joined: ``fused`` is the sum of 1 / (60 + rank) over the rankings a chunk is in."""
    if vectors is None or keywords is None:
        one = vectors if vectors is not None else keywords
        missing = [F.lit(None).cast(kind).alias(name) for name, kind in (("vector_score", "double"), ("vector_rank", "int"), ("keyword_rank", "int")) if name not in one.columns]
        both = one.select("*", *missing)
    else:
        both = vectors.join(keywords, key, "full")
    part = lambda c: F.coalesce(1 / (FUSION + F.col(c)), F.lit(0.0))
    return both.select(key, "vector_score", "vector_rank", "keyword_rank", (part("vector_rank") + part("keyword_rank")).alias("fused"))


def fused_top(rankings: DataFrame, k: int, mode: str = "hybrid", key: str = "id") -> DataFrame:
    """The ``k`` best with ``score`` (the cosine by vector, the fused value otherwise) and ``rank``.

    Equal values keep the order of the vector ranking, then of the keyword ranking.
    """
    order = [F.desc("fused"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank")]
    score = F.col("vector_score") if mode == "vector" else F.col("fused")
    return rankings.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("score", score)


def hits(top: DataFrame, chunks: DataFrame, documents: DataFrame, key: str = "id") -> DataFrame:
    """Search hits: what is shown of the best chunks, in their order. ``top`` has at most MOST_HITS rows."""
    found = chunks.join(F.broadcast(top), key)
    docs = documents.select(F.col("doc_id").alias("document_id"), "collection", "source_path", "source_name", "tags")
    return (
        docs.join(F.broadcast(found.drop(*[c for c in ("collection", "source_path", "source_name", "tags") if c in found.columns])), "document_id")
        .select("rank", "chunk_id", "collection", "source_path", "source_name", "seq", "text", "page_start", "page_end", "section_title", "heading_path", F.round("score", 6).alias("score"), F.round("vector_score", 4).alias("vector_score"), "keyword_rank", "tags")
        .orderBy("rank")
    )


def rendered(found: DataFrame) -> DataFrame:
    """``rank``, ``chunk_id`` and ``shown``: a hit's citation, id and the beginning of its text."""
    cited = citation(F.col("source_name"), F.col("page_start"), F.col("page_end"), F.col("heading_path"))
    body = F.regexp_replace(snippet(F.coalesce("text", F.lit(""))), "\n", "\n    ")
    return found.select("rank", "chunk_id", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), cited, F.lit(" ("), F.col("chunk_id"), F.lit(")\n    "), body).alias("shown"))


def search(chunks: DataFrame, documents: DataFrame, index: WordIndex | None, query: str, vector: Sequence[float] | None, k: int = 5, mode: str = "hybrid", collections: Sequence[str] | None = None, limited: bool = False) -> DataFrame:
    """The ``k`` best hits of a query in a mode. Blank queries, and unknown words by keyword, have none.

    ``limited`` says that ``chunks`` and ``documents`` are fewer than those of the index.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if not 1 <= k <= MOST_HITS:
        raise ValueError(f"k is at least 1 and at most {MOST_HITS}")
    docs = documents if collections is None else documents.where(F.col("collection").isin(list(collections)))
    among = chunks if collections is None else chunks.join(docs.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    vectors = vector_top(among, vector, pool_size(k)) if mode != "keyword" and vector is not None and query.strip() else None
    keywords = keyword_top(index, query, pool_size(k), among if limited or collections is not None else None) if mode != "vector" and index is not None else None
    if vectors is None and keywords is None:
        vectors = vector_top(among.limit(0), [0.0], 1)
    return hits(fused_top(fused(vectors, keywords), k, mode), chunks, docs)


def read_window(chunks: DataFrame, documents: DataFrame, chunk_id: str, neighbours: int = 1, collection: str | None = None) -> DataFrame:
    """A chunk and those up to ``neighbours`` before and after it in its document, in order; of several so named the one of least id."""
    docs = documents if collection is None else documents.where(F.col("collection") == collection)
    named = chunks.where(F.col("chunk_id") == chunk_id).select("id", F.col("document_id").alias("doc_id"), F.col("seq").alias("at"))
    one = named.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy("id").limit(1).select(F.col("doc_id").alias("document_id"), "at")
    near = chunks.join(F.broadcast(one), "document_id").where(F.abs(F.col("seq") - F.col("at")) <= neighbours)
    shown = docs.select(F.col("doc_id").alias("document_id"), "collection", "source_path", "source_name", "tags")
    return near.join(shown, "document_id").select("chunk_id", "collection", "source_path", "source_name", "seq", "text", "page_start", "page_end", "section_title", "heading_path", F.lit(0.0).alias("score"), "tags").orderBy("seq")


def windows(chunks: DataFrame, n: int = 1) -> DataFrame:
    """Every chunk with ``n_around``, ``first_seq`` and ``last_seq`` of the chunks up to ``n`` places before and after it, itself among them.

    Every chunk tells the places it is near to, and these are counted by document
    and place, so a document of any size is spread. A chunk without a place or a
    document is around none.
    """
    told = chunks.where("document_id is not null and seq is not null").select("document_id", "seq", F.explode(F.sequence(F.col("seq") - n, F.col("seq") + n)).alias("at"))
    counted = told.groupBy("document_id", F.col("at").alias("seq")).agg(F.count("*").cast("int").alias("n_around"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return chunks.select("id", "document_id", "seq").join(counted, ["document_id", "seq"], "left").select("id", "document_id", "seq", F.coalesce("n_around", F.lit(0)).alias("n_around"), "first_seq", "last_seq")


def previous(chunks: DataFrame, value: str, block: int = BLOCK) -> DataFrame:
    """``id``, ``value`` and ``before``, the value of the chunk before it in its document; null for the first.

    A document is ordered in blocks of places, each by itself; the last value of
    a block goes on to the next that holds any. Equal places are ordered by id.
    """
    placed = chunks.select("id", "document_id", "seq", value, F.floor(F.col("seq") / block).alias("block"))
    own = Window.partitionBy("document_id", "block").orderBy("seq", "id")
    rows = placed.withColumn("held", F.lag(F.struct(F.col(value).alias("v"))).over(own))
    last = placed.groupBy("document_id", "block").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct("seq", "id")).alias("end"))
    ends = last.select("document_id", "block", F.lag("end").over(Window.partitionBy("document_id").orderBy("block")).alias("end"))
    joined = rows.join(ends, rows["document_id"].eqNullSafe(ends["document_id"]) & rows["block"].eqNullSafe(ends["block"]), "left")
    return joined.select("id", value, F.coalesce("held", "end")["v"].alias("before"))
