"""A library on disk: plain Parquet tables to which Spark appends.

Every change is an append with a number that grows. The newest row of a document
says how it stands: its tags, that it is gone, or which version of its chunks
counts. Chunks and their word index are written before the row that makes them
visible, so a reader finds a document as it was or as it is, never half, and a
change costs what it brings, not what is there. ``compact`` rewrites a collection
without what is no longer visible. One writer at a time.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookwright.errors import EmbedderMismatch
from bookwright.operators import listing, search
from bookwright.plans.lineage import cut


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_LONG, _INT, _TEXT, _LIST, _TIME, _BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.ArrayType(T.StringType()), T.TimestampType(), T.BooleanType()
DOCUMENTS = _schema(doc_id=_LONG, collection=_TEXT, source_path=_TEXT, source_name=_TEXT, source_hash=_TEXT, total_pages=_INT, total_chunks=_INT, ocr_used=_INT, ocr_pages_skipped=_INT, tags=_LIST, added_at=_TIME)
CHUNKS = _schema(id=_LONG, document_id=_LONG, seq=_INT, chunk_id=_TEXT, text=_TEXT, token_count=_INT, page_start=_INT, page_end=_INT, section_title=_TEXT, heading_path=_LIST, embedding=T.ArrayType(T.FloatType()))
POSTINGS = _schema(term=_TEXT, id=_LONG, document_id=_LONG, places=T.ArrayType(_INT))
LENGTHS = _schema(id=_LONG, document_id=_LONG, n=_INT)
EXPORTS = _schema(target=_TEXT, collection=_TEXT, item=_TEXT)
COLLECTIONS = _schema(name=_TEXT, embedder=_TEXT, dim=_INT, created_at=_TIME)
#: The tables: what they hold, and what they are ordered by within a file.
TABLES = {"documents": (DOCUMENTS, "doc_id"), "chunks": (CHUNKS, "document_id"), "postings": (POSTINGS, "term"), "lengths": (LENGTHS, "id"), "exports": (EXPORTS, "item"), "collections": (COLLECTIONS, "name")}
#: Tables whose rows belong to a version of a document.
VERSIONED = ("chunks", "postings", "lengths")


def document_id(collection: Column, source_path: Column) -> Column:
    return F.xxhash64(collection, source_path)


class Store:
    """Collections, documents, chunks and the ledger of exports under ``root``, any path that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Tables

    def _there(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _table(self, name: str, names: Iterable[str] | None = None) -> DataFrame:
        """All rows ever written to a table, of some collections; ``names`` prunes partitions."""
        own, _ = TABLES[name]
        schema = T.StructType([f for f in own if f.name != "collection"])
        for extra, kind in (("version", _LONG), ("number", _LONG), ("gone", _BOOL), ("collection", _TEXT)):
            schema = schema.add(extra, kind)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if self._there(name) else self.spark.createDataFrame([], schema)
        return rows if names is None else rows.where(F.col("collection").isin(list(names)))

    def _append(self, name: str, rows: DataFrame, collection: str, number: int, gone: bool = False, mode: str = "append") -> None:
        own, order = TABLES[name]
        kept = [F.col(c) if c in rows.columns else F.lit(None).cast(own[c].dataType).alias(c) for c in own.names if c != "collection"]
        version = F.col("version") if "version" in rows.columns else F.lit(number)
        told = rows.select(*kept, version.cast("bigint").alias("version"), F.lit(number).cast("bigint").alias("number"), F.lit(gone).alias("gone"), F.lit(collection).alias("collection"))
        told.sortWithinPartitions(order).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(f"{self.root}/{name}")

    def _newest(self, name: str, key: str, names: Iterable[str] | None = None) -> DataFrame:
        """The newest row of each key, of those that are not gone, with its version."""
        own, _ = TABLES[name]
        rows = self._table(name, names)
        last = rows.groupBy("collection", key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("collection", key)]), "number").alias("last"))
        return last.where("not last.gone").select(*[F.col(c) if c in ("collection", key) else F.col(f"last.{c}") for c in own.names], *([] if "collection" in own.names else ["collection"]), F.col("last.version").alias("version"))

    def _visible(self, name: str, names: Iterable[str] | None = None) -> DataFrame:
        current = self._newest("documents", "doc_id", names).select("collection", F.col("doc_id").alias("document_id"), "version")
        return self._table(name, names).join(current, ["collection", "document_id", "version"], "left_semi").select(*TABLES[name][0].names)

    # Reading

    def collections(self) -> DataFrame:
        return self._newest("collections", "name").select(*COLLECTIONS.names)

    def pinned(self, name: str) -> dict | None:
        """Embedder, vector length and time of a collection, None if there is none."""
        found = self.collections().where(F.col("name") == name).limit(1).collect()
        return found[0].asDict() if found else None

    def documents(self, names: Iterable[str] | None = None) -> DataFrame:
        return self._newest("documents", "doc_id", names).select(*DOCUMENTS.names)

    def chunks(self, names: Iterable[str] | None = None) -> DataFrame:
        return self._visible("chunks", names)

    def index(self) -> search.WordIndex:
        """The word index of all chunks, as kept with them; a term is looked up by pushing it to the scan."""
        return search.WordIndex(self._visible("postings"), self._visible("lengths"))

    def exports(self) -> DataFrame:
        rows = self._table("exports")
        last = rows.groupBy("target", "collection").agg(F.max("number").alias("number"))
        return rows.join(last, ["target", "collection", "number"], "left_semi").where("item is not null").select(*EXPORTS.names)

    # Writing

    def _number(self) -> int:
        """The number of a change: microseconds, more than any before of this writer."""
        self.last = max(getattr(self, "last", 0) + 1, time.time_ns() // 1000)
        return self.last

    def ensure(self, name: str, embedder: str, dim: int | None = None) -> None:
        """Checks that a collection, if there is one, is of this embedder and length."""
        own = self.pinned(name)
        if own and (own["embedder"] != embedder or (dim is not None and own["dim"] not in (None, dim))):
            raise EmbedderMismatch(f"collection {name!r} was built with {own['embedder']} ({own['dim']} values), not {embedder} ({dim})")

    def add(self, name: str, embedder: str, dim: int, documents: DataFrame, chunks: DataFrame) -> None:
        """Documents with their chunks in place of those with their ids, if any; no document occurs twice."""
        self.ensure(name, embedder, dim)
        number = self._number()
        if not self.pinned(name):
            self._append("collections", self.spark.createDataFrame([(name, embedder, dim, datetime.now(UTC))], COLLECTIONS), name, number)
        kept = cut(chunks)
        self._append("chunks", kept, name, number)
        index = search.word_index(kept, carried=("document_id",))
        self._append("postings", index.postings, name, number)
        self._append("lengths", index.lengths, name, number)
        self._append("documents", documents, name, number)

    def retag(self, name: str, tags: DataFrame) -> None:
        """New tags (``doc_id``, ``tags``) of documents; their chunks stay as they are."""
        stored = self._newest("documents", "doc_id", [name]).drop("tags")
        self._append("documents", cut(stored.join(tags.select("doc_id", "tags"), "doc_id")), name, self._number())

    def remove(self, name: str, gone: DataFrame) -> None:
        """Takes out documents (``doc_id``), with their chunks."""
        self._append("documents", gone.select("doc_id"), name, self._number(), gone=True)

    def delete(self, name: str, source: str) -> int:
        """Takes out the documents with this path or name; how many there were."""
        gone = cut(self.documents([name]).where(listing.matches(source, F.col("source_path"), F.col("source_name"))).select("doc_id"))
        n = gone.count()
        if n:
            self.remove(name, gone)
        return n

    def drop(self, name: str) -> None:
        """Takes out a collection with all it holds."""
        if self.pinned(name):
            self.remove(name, cut(self.documents([name]).select("doc_id")))
            self._append("collections", self.spark.createDataFrame([(name,)], "name string"), name, self._number(), gone=True)

    def compact(self, name: str) -> None:
        """Rewrites a collection's tables without rows that are no longer visible."""
        number, current = self._number(), self._newest("documents", "doc_id", [name])
        for kind in VERSIONED:
            rows = cut(self._table(kind, [name]).join(current.select(F.col("doc_id").alias("document_id"), "version"), ["document_id", "version"], "left_semi"))
            self._append(kind, rows, name, number, mode="overwrite")
        self._append("documents", cut(current), name, number, mode="overwrite")

    def record_exports(self, target: str, collection: str, items: DataFrame) -> None:
        """Puts ``items`` (``item``) in place of what the ledger has for a target and collection."""
        new = items.select(F.lit(target).alias("target"), "item").where("item is not null").distinct()
        marker = self.spark.createDataFrame([(target, None)], "target string, item string")  # so that no item is known, too
        self._append("exports", new.unionByName(marker), collection, self._number())
