"""Chunks for other stores: what is written, what is skipped, what is taken out again."""

from __future__ import annotations

import http.client
import json
import re
import urllib.parse
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookwright.errors import ExportError
from bookwright.functions.text import book_name, category, section_title
from bookwright.plans.lineage import cut
from bookwright.sources.databases import redacted

# Names that a target keeps for itself, and the longest vector it indexes.
RESERVED = r"(?i)^(homebrew|srd(\s*5(\.[12])?(\.1)?)?)$"
INDEXED_DIM = 2000
TABLE_NAME = re.compile(r"[a-z_][a-z0-9_]{0,62}")
UUID = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")


def vector_literal(vector: Column) -> Column:
    """A vector as text, ``[0.1,-2]``, seven digits each."""

    @F.pandas_udf("string")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: "[" + ",".join(f"{x:.7g}" for x in v) + "]", na_action="ignore")

    return run(vector)


def scan(chunks: DataFrame, documents: DataFrame, collection: str | None = None, ordered: bool = True) -> DataFrame:
    """All chunks with their documents, by path and place unless their order doesn't matter, which saves a sort of all vectors."""
    docs = documents if collection is None else documents.where(F.col("collection") == collection)
    docs = docs.select(F.col("doc_id").alias("document_id"), "collection", "source_path", "source_name")
    found = chunks.join(docs, "document_id").select("collection", "source_path", "source_name", "seq", "chunk_id", "text", "token_count", "section_title", "heading_path", "embedding")
    return found.orderBy("source_path", "seq", "chunk_id") if ordered else found


def books(documents: DataFrame) -> DataFrame:
    """``collection``, ``source_path``, ``source_name``, ``book``, ``category``, ``skipped``.

    Of documents of a collection whose names give one book the first by path is
    exported; the others, and reserved names, say why not.
    """
    named = documents.select("collection", "source_path", "source_name", book_name(F.coalesce("source_name", F.lit(""))).alias("book"))
    reserved = F.col("book").rlike(RESERVED)
    first = F.row_number().over(Window.partitionBy("collection", "book").orderBy("source_path"))
    return named.withColumn("n", first).select("collection", "source_path", "source_name", "book", category(F.col("book")).alias("category"), F.when(reserved, "reserved").when(F.col("n") > 1, "duplicate").alias("skipped"))


def gone(exported: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("target", "collection", "item")) -> DataFrame:
    """Items exported before that are no longer current and that no other collection exported to the target.

    ``exported`` has ``keys``; ``current`` has ``collection`` and ``item``.
    """
    target, collection, item = keys
    before = exported.select(*keys).distinct()
    owners = before.groupBy(target, item).agg(F.countDistinct(collection).alias("owners")).where("owners > 1").select(target, item)
    return before.join(current.select(collection, item).distinct(), [collection, item], "left_anti").join(owners, [target, item], "left_anti").select(*keys)


@dataclass
class Report:
    """What an export did; ``skipped`` has ``source_name`` and ``reason``, ``removed`` has ``item``."""

    target: str
    collection: str
    documents: int
    chunks: int
    skipped: DataFrame
    removed: DataFrame


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object for each row."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def manifest(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each document: what was written, and how large it is."""
    made = chunks.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"))
    shown = documents.select("doc_id", "collection", "source_path", "source_name", "source_hash", "total_pages", F.col("ocr_used").cast("boolean").alias("ocr_used"), "ocr_pages_skipped", "tags", "added_at")
    return shown.join(made, "doc_id", "left").na.fill(0, ["chunks", "tokens"]).drop("doc_id")


def with_metadata(chunks: DataFrame, tags: Sequence[str] = (), *carried: str) -> DataFrame:
    """``carried``, ``source_name``, ``chunk_id``, ``text``, ``token_count`` and ``metadata`` of rows with the columns of a chunk, its ``source_name`` and ``total_chunks``.

    The id is that of the folder: the name of the document and the number of the
    chunk, as wide as the last one's and three digits at least.
    """
    number, stem = (F.col("seq") + 1).cast("string"), F.regexp_replace("source_name", r"\.[^.]+$", "")
    width = F.greatest(F.lit(3), F.length(F.col("total_chunks").cast("string")))
    metadata = F.struct(
        F.col("source_name").alias("source_file"), "page_start", "page_end", section_title(F.col("heading_path")).alias("section_title"), "heading_path", F.array(F.lit("paragraph")).alias("element_types"),
        (F.col("seq") + 1).alias("chunk_index"), "total_chunks", F.array(*map(F.lit, tags)).cast("array<string>").alias("custom_tags"), F.current_timestamp().alias("created_at"),
    )
    return chunks.select(*carried, "source_name", F.concat(stem, F.lit("_chunk_"), F.lpad(number, F.greatest(width, F.length(number)), F.lit("0"))).alias("chunk_id"), "text", "token_count", metadata.alias("metadata"))


def library_rows(chunks: DataFrame, owner: str, book: Column, kind: Column) -> DataFrame:
    """Rows of a library table from a scan of chunks."""
    if not UUID.fullmatch(owner):
        raise ExportError(f"the owner must be a UUID, got {owner!r}")
    return chunks.select(
        F.lit(owner).alias("user_id"), "chunk_id", F.col("text").alias("content"), "token_count", book.alias("source_book"), F.nullif("section_title", F.lit("")).alias("section_title"),
        "heading_path", vector_literal(F.col("embedding")).alias("embedding"), kind.alias("category"), F.lit("pending").alias("extraction_status"),
    )


# A Postgres table with vectors

# The columns of the target's table, as it declares them; and what the staging table's column of the name becomes.
_COLUMNS = {
    "collection": ("text NOT NULL", "{}"), "chunk_id": ("text NOT NULL", "{}"), "source_name": ("text NOT NULL", "{}"), "source_path": ("text NOT NULL", "{}"), "content": ("text NOT NULL", "{}"),
    "token_count": ("integer NOT NULL DEFAULT 0", "{}"), "page_start": ("integer", "{}"), "page_end": ("integer", "{}"), "section_title": ("text NOT NULL DEFAULT ''", "{}"),
    "heading_path": ("text[] NOT NULL DEFAULT '{}'", "ARRAY(SELECT json_array_elements_text({}::json))"), "tags": ("text[] NOT NULL DEFAULT '{}'", "ARRAY(SELECT json_array_elements_text({}::json))"),
    "embedder": ("text NOT NULL", "{}"), "embedding": ("vector({dim}) NOT NULL", "{}::vector"),
}


def table_rows(chunks: DataFrame, documents: DataFrame, collection: str, embedder: str) -> DataFrame:
    """Rows of the staging table: arrays as JSON, vectors as text. Chunks without a vector are left out."""
    docs = documents.where(F.col("collection") == collection).select(F.col("doc_id").alias("document_id"), "source_name", "source_path", "tags")
    json_of = lambda c: F.to_json(F.coalesce(c, F.array().cast("array<string>"))).alias(c)
    return chunks.join(docs, "document_id").where("embedding is not null").select(
        F.lit(collection).alias("collection"), "chunk_id", "source_name", "source_path", F.coalesce("text", F.lit("")).alias("content"), F.coalesce("token_count", F.lit(0)).alias("token_count"), "page_start", "page_end",
        F.coalesce("section_title", F.lit("")).alias("section_title"), json_of("heading_path"), json_of("tags"), F.lit(embedder).alias("embedder"), vector_literal(F.col("embedding")).alias("embedding"),
    )


def table_statements(table: str, dim: int) -> list[str]:
    """What makes the table with its indexes, if it isn't there; vectors longer than INDEXED_DIM are searched without an index."""
    if not TABLE_NAME.fullmatch(table):
        raise ExportError("a table name is lower-case letters, digits and underscores")
    columns = ", ".join(f"{name} {kind.replace('{dim}', str(dim))}" for name, (kind, _) in _COLUMNS.items())
    made = [
        "CREATE EXTENSION IF NOT EXISTS vector",
        f"CREATE TABLE IF NOT EXISTS {table} (id bigserial PRIMARY KEY, {columns}, exported_at timestamptz NOT NULL DEFAULT now(), UNIQUE (collection, chunk_id))",
        f"CREATE INDEX IF NOT EXISTS {table}_collection ON {table} (collection)",
    ]
    return made + [f"CREATE INDEX IF NOT EXISTS {table}_embedding_hnsw ON {table} USING hnsw (embedding vector_cosine_ops)"] * (dim <= INDEXED_DIM)


def replace_statements(table: str, staging: str) -> list[str]:
    """What puts the rows of the staging table in place of all rows of the collection; ``?`` is its name."""
    moved = ", ".join(cast.replace("{}", name) for name, (_, cast) in _COLUMNS.items())
    return [f"DELETE FROM {table} WHERE collection = ?", f"INSERT INTO {table} ({', '.join(_COLUMNS)}) SELECT {moved} FROM {staging} WHERE collection = ?"]


class Transaction:
    """Statements over one JDBC connection of the driver, all or none of which take effect."""

    def __init__(self, spark: SparkSession, url: str, **options: str):
        self.jvm, self.url, self.options = spark._jvm, url, options

    def __enter__(self) -> Transaction:
        if driver := self.options.get("driver"):
            self.jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
        known = self.jvm.java.util.Properties()
        for name in ("user", "password"):
            if name in self.options:
                known.setProperty(name, self.options[name])
        try:
            self.line = self.jvm.java.sql.DriverManager.getConnection(self.url, known)
            self.line.setAutoCommit(False)
        except Py4JJavaError as e:
            raise ExportError(f"{redacted(self.url)} can't be reached: {e.java_exception.getMessage()}") from e
        return self

    def run(self, statement: str, *values: str) -> list[str]:
        """Does a statement; the first column of what it returns, as text."""
        try:
            prepared = self.line.prepareStatement(statement)
            for n, value in enumerate(values, 1):
                prepared.setString(n, value)
            found = []
            if prepared.execute():
                rows = prepared.getResultSet()
                while rows.next():
                    found.append(rows.getString(1))
            prepared.close()
            return found
        except Py4JJavaError as e:
            raise ExportError(f"the export to {redacted(self.url)} failed: {e.java_exception.getMessage()}") from e

    def __exit__(self, kind: type | None, *_: object) -> None:
        (self.line.rollback if kind else self.line.commit)()
        self.line.close()


def table_export(rows: DataFrame, url: str, table: str, collection: str, dim: int, batch: int = 500, **options: str) -> None:
    """``rows``, as of ``table_rows``, in place of a collection's rows of a Postgres table with vectors.

    Executors write a staging table of this export; one transaction of the
    database then checks the length of the table's vectors, deletes the
    collection and inserts its rows, so readers see it whole, before or after.
    """
    spark, staging = rows.sparkSession, f"{table[:48]}_new_{uuid.uuid4().hex[:8]}"
    with Transaction(spark, url, **options) as first:
        for statement in table_statements(table, dim):
            first.run(statement)
        kind = first.run("SELECT format_type(atttypid, atttypmod) FROM pg_attribute WHERE attrelid = ?::regclass AND attname = 'embedding'", table)
        if kind != [f"vector({dim})"]:
            raise ExportError(f"{table} holds {', '.join(kind)}, the collection {collection!r} vectors of {dim} values: export to another table")
    staged(rows, url, staging, batch, **options)
    try:
        with Transaction(spark, url, **options) as swap:
            for statement in replace_statements(table, staging):
                swap.run(statement, collection)
    finally:
        with Transaction(spark, url, **options) as last:
            last.run(f"DROP TABLE IF EXISTS {staging}")


def staged(rows: DataFrame, url: str, table: str, batch: int = 500, **options: str) -> None:
    """``rows`` written to a table by the executors, over JDBC; the driver's jar must be there."""
    try:
        rows.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode("overwrite").save()
    except Exception as e:  # the JVM's exceptions have no common type here
        raise ExportError(f"the export to {redacted(url)} failed: {type(e).__name__}") from e


# A library behind REST


class Library:
    """The books and chunks of one owner in a REST library; one line, used by one task."""

    # Fixed values in what follows: names of tables, columns and operators of the interface.

    def __init__(self, url: str, key: str, timeout: float = 60.0):
        at = urllib.parse.urlsplit(url)
        kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
        self.shown, self.root, self.key = f"{at.scheme}://{at.netloc}", at.path.rstrip("/"), key
        self.line = kind(at.netloc, timeout=timeout)

    def _do(self, verb: str, table: str, where: dict[str, str], rows: object = None, how: str = "return=minimal") -> None:
        # The names of headers and the path of the interface.
        said = {"apikey": self.key, "Authorization": f"Bearer {self.key}", "Prefer": how, "Content-Type": "application/json"}
        try:
            self.line.request(verb, f"{self.root}/rest/v1/{table}?{urllib.parse.urlencode(where)}".rstrip("?"), None if rows is None else json.dumps(rows), said)
            reply = self.line.getresponse()
            told = reply.read()
        except (OSError, http.client.HTTPException) as e:
            self.line.close()
            raise ExportError(f"{self.shown} can't be reached: {e}") from e
        if reply.status >= 300:
            raise ExportError(f"{self.shown} refused to {verb} {table} ({reply.status}): {told[:300].decode(errors='replace')}")

    def clear(self, owner: str, book: str) -> None:
        self._do("DELETE", "user_library_chunks", {"user_id": f"eq.{owner}", "source_book": f"eq.{book}"})

    def clear_chunks(self, owner: str, ids: list[str]) -> None:
        quoted = ",".join('"' + i.replace("\\", "\\\\").replace('"', '\\"') + '"' for i in ids)
        self._do("DELETE", "user_library_chunks", {"user_id": f"eq.{owner}", "chunk_id": f"in.({quoted})"})

    def add(self, rows: list[dict]) -> None:
        self._do("POST", "user_library_chunks", {}, rows)

    def register(self, owner: str, book: str) -> None:
        row = {"user_id": owner, "name": book, "title": book, "updated_at": datetime.now(UTC).isoformat()}
        self._do("POST", "user_library_books", {"on_conflict": "user_id,name"}, row, "resolution=merge-duplicates,return=minimal")

    def forget(self, owner: str, book: str) -> None:
        self.clear(owner, book)
        self._do("DELETE", "user_library_books", {"user_id": f"eq.{owner}", "name": f"eq.{book}"})


def each_book(books: DataFrame, url: str, key: str, what: str) -> DataFrame:
    """Does ``what`` (clear, register or forget) for each ``user_id`` and ``source_book``, by the tasks that hold them; gives the books back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = Library(url, key)
        for frame in frames:
            for owner, book in zip(frame["user_id"], frame["source_book"], strict=True):
                getattr(library, what)(owner, book)
            yield frame[["source_book"]]

    return books.select("user_id", "source_book").mapInPandas(run, "source_book string")


def rest_export(rows: DataFrame, url: str, key: str, batch: int = 200) -> DataFrame:
    """``rows``, as of ``library_rows``, in place of the books they are of: ``source_book`` and ``chunks``.

    Books are cleared, then their chunks are posted by as many tasks as there
    are parts, then the books are registered. A task that is repeated after a
    failure takes out what its batches may have left before it posts them again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library, again = Library(url, key), TaskContext.get().attemptNumber() > 0
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = json.loads(frame.iloc[at : at + batch].to_json(orient="records", force_ascii=False))
                if again:
                    library.clear_chunks(part[0]["user_id"], [r["chunk_id"] for r in part])
                library.add(part)
            yield frame.groupby("source_book", as_index=False).agg(chunks=("chunk_id", "size"))

    kept = cut(rows)
    named = kept.select("user_id", "source_book").distinct()
    cut(each_book(named, url, key, "clear"))
    posted = cut(kept.repartition("source_book", F.pmod(F.xxhash64("chunk_id"), F.lit(64))).mapInPandas(run, "source_book string, chunks long"))
    cut(each_book(named, url, key, "register"))
    return posted.groupBy("source_book").agg(F.sum("chunks").alias("chunks"))
