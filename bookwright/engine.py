"""The library as one object: ingest, search, read, list, remove, export."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookwright.config import Config
from bookwright.errors import ExportError
from bookwright.functions import text as fn
from bookwright.functions.embedding import Embedder, embed, resolve
from bookwright.operators import changes, chunking, cleaning, exporting, listing, rows, search
from bookwright.operators.store import Store, document_id
from bookwright.plans.lineage import cut
from bookwright.plans.session import ship
from bookwright.sources import files
from bookwright.sources.databases import read_query, redacted

#: The collection that is used where none is named.
DEFAULT = "default"


def _outcome(rows: DataFrame, status: Column, chunks: Column | None = None, pages: Column | None = None, skipped: Column | None = None, error: Column | None = None) -> DataFrame:
    """Rows as outcomes of an ingest; counts that aren't given are 0."""
    zero = F.lit(0)
    counts = [(zero if c is None else c).alias(n) for n, c in (("chunks", chunks), ("pages", pages), ("pages_skipped", skipped))]
    return rows.select("source_path", status.alias("status"), *counts, (F.lit(None).cast("string") if error is None else error).alias("error"))


class Engine:
    """A library under ``root`` with one embedder for what it ingests and searches."""

    def __init__(self, spark: SparkSession, root: str | None = None, embedder: Embedder | None = None, config: Config | None = None, ocr: files.Ocr | None = None):
        ship(spark)
        self.spark = spark
        self.store = Store(spark, root or os.environ.get("BOOKWRIGHT_HOME") or os.path.expanduser("~/.bookwright"))
        self.embedder, self.config, self.ocr = embedder or resolve(), config or Config(), ocr

    # Ingest

    def ingest(self, paths: Iterable[str], collection: str = DEFAULT, tags: Sequence[str] = (), recursive: bool = False, force: bool = False) -> DataFrame:
        """Adds or refreshes files; a row for each with its path, status, counts and error. A file that can't be read is ``failed``, the others go on."""
        self.store.ensure(collection, self.embedder.name)
        return self._put(self._read(paths, recursive, collection), collection, tags, force, None)

    def _read(self, paths: Iterable[str], recursive: bool, collection: str) -> DataFrame:
        """Files as documents with ``pages``; those of paged formats are cleaned."""
        found = files.weak_pages(files.read_files(self.spark, paths, recursive, self.ocr))
        read = cut(found.withColumn("collection", F.lit(collection)))
        paged = read.where("paged").select("source_path", F.posexplode("pages").alias("p", "page"))
        clean = cleaning.clean_pages(paged.select("source_path", "p", F.col("page.text").alias("text")), ["source_path", "p"])
        pages = clean.groupBy("source_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda x: x["text"]).alias("clean"))
        whole = read.join(pages, "source_path", "left").withColumn("texts", F.coalesce("clean", F.transform("pages", lambda p: p["text"])))
        return whole.select(
            "collection", "source_path", "source_name", "source_hash", F.col("texts").alias("pages"), "paged", F.when(F.col("paged"), F.size("pages")).otherwise(0).alias("total_pages"),
            (F.col("ocr_pages") > 0).cast("int").alias("ocr_used"), F.col("skipped").alias("ocr_pages_skipped"), "error",
        )

    def ingest_texts(self, items: DataFrame, collection: str = DEFAULT, tags: Sequence[str] = (), force: bool = False, sync_prefix: str | None = None) -> DataFrame:
        """Adds or refreshes rows of ``source_path``, ``source_name``, ``text``.

        With ``sync_prefix``, documents under it that no row names are removed,
        and rows outside it are refused. Paths are unique; null texts are empty.
        """
        self.store.ensure(collection, self.embedder.name)
        items = cut(rows.checked(items.select("source_path", "source_name", F.coalesce("text", F.lit("")).alias("text"))).withColumn("collection", F.lit(collection)))
        if sync_prefix is not None and (wrong := changes.outside(items, sync_prefix).take(1)):
            raise ValueError(f"{wrong[0]['source_path']!r} is outside the prefix {sync_prefix!r}")
        zero = F.lit(0)
        given = items.select(
            "collection", "source_path", "source_name", fn.content_hash(F.col("text")).alias("source_hash"), F.array("text").alias("pages"), F.lit(False).alias("paged"),
            zero.alias("total_pages"), zero.alias("ocr_used"), zero.alias("ocr_pages_skipped"), F.lit(None).cast("string").alias("error"),
        )
        return self._put(given, collection, tags, force, sync_prefix)

    def ingest_query(self, dsn: str, query: str, mapping: rows.RowMapping, collection: str = DEFAULT, tags: Sequence[str] = (), sync: bool = True, force: bool = False) -> DataFrame:
        """Adds or refreshes the rows of a query as documents; with ``sync`` those that left it are removed."""
        found = rows.documents(read_query(self.spark, dsn, query), mapping)
        return self.ingest_texts(found, collection, tags, force, mapping.prefix if sync else None)

    def _put(self, given: DataFrame, collection: str, tags: Sequence[str], force: bool, prefix: str | None) -> DataFrame:
        """Compares, chunks and embeds what is new, and swaps the snapshot."""
        stored = self.store.documents([collection])
        tag_column = F.array(*map(F.lit, tags)).cast("array<string>")
        decided = cut(changes.decide(given.withColumn("tags", tag_column), stored, force))
        failed = decided.where("error is not null")
        fresh = decided.where("error is null and status in ('added', 'updated')").withColumn("doc_id", document_id(F.col("collection"), F.col("source_path")))
        c = self.config
        made = chunking.chunk_documents(fresh, ["doc_id", "collection", "source_path", "source_name"], c.max_tokens, c.overlap_tokens, c.strategy)
        title = F.when(F.col("source_path").startswith("sql:"), F.col("source_name")).otherwise(F.regexp_replace("source_name", r"\.[^.]+$", ""))
        key = fn.document_key(F.col("collection"), F.col("source_path"), fn.stem_slug(title))
        named = made.select(
            F.xxhash64("doc_id", "seq").alias("id"), F.col("doc_id").alias("document_id"), "seq", fn.chunk_id(key, F.col("seq") + 1).alias("chunk_id"), "text", "token_count", "page_start", "page_end",
            fn.section_title(F.col("heading_path")).alias("section_title"), "heading_path", fn.embedding_text(F.col("source_name"), F.col("heading_path"), F.col("text")).alias("__embedded"),
        )
        chunks = cut(embed(named, self.embedder, "__embedded").drop("__embedded"))
        counts = chunks.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").cast("int").alias("n"))
        new = fresh.join(counts, "doc_id", "left").select(
            "doc_id", "collection", "source_path", "source_name", "source_hash", "total_pages", F.coalesce("n", F.lit(0)).alias("total_chunks"),
            "ocr_used", F.col("ocr_pages_skipped").cast("int").alias("ocr_pages_skipped"), "tags", F.current_timestamp().alias("added_at"),
        )
        retagged = decided.where("error is null and status = 'retagged'").select("source_path", F.col("tags").alias("new_tags"))
        old = stored.join(retagged, "source_path").select("doc_id", F.col("new_tags").alias("tags"))
        gone = None if prefix is None else cut(changes.removed(decided.select("collection", "source_path"), stored, prefix))
        fine = decided.where("error is null").join(new.select("source_path", "total_chunks"), "source_path", "left")
        out = _outcome(fine, F.col("status"), F.coalesce("total_chunks", "old_chunks"), F.col("total_pages"), F.col("ocr_pages_skipped"))
        out = out.unionByName(_outcome(failed, F.lit("failed"), error=F.col("error")))
        if gone is not None:
            out = out.unionByName(_outcome(gone, F.lit("removed"), F.col("total_chunks")))
        out = cut(out)
        done = {r["status"] for r in out.select("status").distinct().collect()}
        if gone is not None and "removed" in done:
            self.store.remove(collection, gone)
        if "retagged" in done:
            self.store.retag(collection, old)
        if done & {"added", "updated"}:
            dim = int(self.embedder.query("dimension").shape[-1])
            self.store.add(collection, self.embedder.name, dim, new, chunks)
        return out

    # Search

    def search(self, query: str, collection: str | None = None, k: int = 5, mode: str = "hybrid") -> DataFrame:
        """The best hits in the collections that this embedder can search, or in one of them."""
        known = cut(self.store.collections())
        names = listing.searchable(known, self.embedder.name, collection)
        every = self.store.chunks(names)
        vector = self.embedder.query(query).tolist() if mode != "keyword" and query.strip() else None
        index = self.store.index() if mode != "vector" else None
        return search.search(every, self.store.documents(names), index, query, vector, k, mode, limited=known.count() > len(names))

    def read(self, chunk_id: str, neighbours: int = 1, collection: str | None = None) -> DataFrame:
        """A chunk with those around it."""
        return search.read_window(self.store.chunks(), self.store.documents(), chunk_id, neighbours, collection)

    def collections(self) -> DataFrame:
        """Collections, and whether this embedder can search them."""
        summary = listing.collections_summary(self.store.collections(), self.store.documents())
        return summary.withColumn("searchable", F.col("embedder") == self.embedder.name)

    def documents(self, collection: str | None = None) -> DataFrame:
        return listing.documents_listing(self.store.documents(), collection)

    def remove(self, source: str, collection: str = DEFAULT) -> int:
        """Takes out documents by path, row path (``sql:…``) or name."""
        n = self.store.delete(collection, source)
        return n or (self.store.delete(collection, os.path.realpath(os.path.expanduser(source))) if not source.startswith("sql:") else 0)

    # Export

    def _pinned(self, collection: str) -> dict:
        if not (own := self.store.pinned(collection)):
            raise ExportError(f"no collection named {collection!r}")
        return own

    def _scan(self, collection: str) -> DataFrame:
        self._pinned(collection)
        return exporting.scan(self.store.chunks([collection]), self.store.documents([collection]), ordered=False)

    def export_folder(self, collection: str, path: str) -> None:
        """Chunks as JSON lines, one folder for each document; beside them a manifest of documents and the settings."""
        totals = self.store.documents([collection]).select(F.col("doc_id").alias("document_id"), "source_name", "total_chunks")
        self._pinned(collection)
        chunks = self.store.chunks([collection]).join(totals, "document_id")
        self._folder(chunks, exporting.manifest(self.store.chunks([collection]), self.store.documents([collection])), path)

    def _folder(self, chunks: DataFrame, manifest: DataFrame, path: str) -> None:
        c = self.config
        exporting.with_metadata(chunks, c.custom_tags).write.partitionBy("source_name").mode("overwrite").json(f"{path}/chunks")
        settings = [F.lit(c.strategy).alias("chunking_strategy"), F.lit(c.max_tokens).alias("max_tokens"), F.lit(c.overlap_tokens).alias("overlap_tokens"), F.current_timestamp().alias("created_at")]
        manifest.select("*", *settings).write.mode("overwrite").json(f"{path}/manifest")
        self.spark.createDataFrame([(c.to_toml(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    def process(self, paths: Iterable[str], path: str, recursive: bool = False) -> DataFrame:
        """Files as folders of chunks, without a library: ``chunks`` and ``markdown`` by document, a manifest, and the settings.

        Returns the manifest's rows; a file that can't be read has its ``error`` there.
        """
        given = self._read(paths, recursive, "")
        c = self.config
        made = cut(chunking.chunk_documents(given.where("error is null"), ["source_path", "source_name"], c.max_tokens, c.overlap_tokens, c.strategy))
        totals = made.groupBy("source_path").agg(F.count("*").cast("int").alias("total_chunks"), F.sum("token_count").alias("tokens"))
        manifest = cut(given.drop("pages", "collection").join(totals, "source_path", "left").na.fill(0, ["total_chunks", "tokens"]))
        self._folder(made.join(totals.select("source_path", "total_chunks"), "source_path"), manifest, path)
        text = chunking.markdown_documents(given.where("error is null"), "source_path").join(given.select("source_path", "source_name"), "source_path")
        text.select("source_name", "markdown").where("markdown <> ''").write.partitionBy("source_name").mode("overwrite").text(f"{path}/markdown")
        return manifest

    def export_table(self, collection: str, url: str, table: str = "bookwright_chunks", **options: str) -> exporting.Report:
        """Chunks to a Postgres table with vectors, in place of the collection's rows there."""
        own = self._pinned(collection)
        rows = exporting.table_rows(self.store.chunks([collection]), self.store.documents([collection]), collection, own["embedder"])
        exporting.table_export(rows, url, table, collection, own["dim"], **options)
        total = rows.agg(F.countDistinct("source_path").alias("d"), F.count("*").alias("c")).collect()[0]
        none = self.spark.createDataFrame([], "source_name string, reason string"), self.spark.createDataFrame([], "item string")
        return exporting.Report(f"{redacted(url)} ({table})", collection, total["d"], total["c"], *none)

    def export_library(self, collection: str, url: str, key: str, owner: str, searched_with: str | None = None) -> exporting.Report:
        """Documents as books of a REST library; books exported before and gone since are taken out.

        ``searched_with`` is the embedder that the library searches with: a collection of another is refused.
        """
        built = self._pinned(collection)["embedder"]
        if searched_with and built != searched_with:
            raise ExportError(f"the collection {collection!r} was built with {built}, the library searches with {searched_with}")
        target = f"rest:{url.rstrip('/')}#{owner}"
        scanned = self._scan(collection)
        named = cut(exporting.books(self.store.documents([collection])))
        kept = scanned.join(named.where("skipped is null").select("source_path", "book", "category"), "source_path")
        sent = cut(exporting.rest_export(exporting.library_rows(kept, owner, F.col("book"), F.col("category")), url, key))
        current = named.where("skipped is null").select("collection", F.col("book").alias("item"))
        gone = cut(exporting.gone(self.store.exports().where(F.col("target") == target), current).where(F.col("collection") == collection).select("item"))
        cut(exporting.each_book(gone.select(F.lit(owner).alias("user_id"), F.col("item").alias("source_book")), url, key, "forget"))
        self.store.record_exports(target, collection, current.select("item"))
        total = sent.agg(F.count("*").alias("d"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("c")).collect()[0]
        return exporting.Report(target, collection, total["d"], total["c"], named.where("skipped is not null").select("source_name", F.col("skipped").alias("reason")), gone)
