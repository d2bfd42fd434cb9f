"""What a library holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwright.errors import EmbedderMismatch


def collections_summary(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """Each collection with ``documents`` and ``chunks``, empty ones too, by name."""
    counts = documents.groupBy(F.col("collection").alias("name")).agg(F.countDistinct("doc_id").alias("documents"), F.sum("total_chunks").alias("chunks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return collections.join(counts, "name", "left").select("name", "embedder", "dim", zero("documents"), zero("chunks")).orderBy("name")


def documents_listing(documents: DataFrame, collection: str | None = None) -> DataFrame:
    """Documents of a collection, or of all, by collection and name."""
    kept = documents if collection is None else documents.where(F.col("collection") == collection)
    return kept.select("collection", "source_name", "source_path", "total_pages", "total_chunks", "ocr_used", "ocr_pages_skipped", "tags").orderBy("collection", "source_name", "source_path")


def embedders(collections: DataFrame) -> DataFrame:
    """One row with the names of all embedders."""
    return collections.agg(F.array_sort(F.collect_set("embedder")).alias("embedders"))


def searchable(collections: DataFrame, embedder: str, name: str | None = None) -> list[str]:
    """Names of collections that ``embedder`` can search, one of them if ``name`` is given.

    Fails for a named collection that is missing or of another embedder, and if
    there are collections and none can be searched. Collections are few: their
    rows are read on the driver.
    """
    rows = collections.select("name", "embedder").collect()
    if name is not None:
        own = [r for r in rows if r["name"] == name]
        if not own:
            raise KeyError(f"no collection named {name!r}")
        if own[0]["embedder"] != embedder:
            raise EmbedderMismatch(f"collection {name!r} was built with {own[0]['embedder']}, not {embedder}")
        return [name]
    usable = sorted(r["name"] for r in rows if r["embedder"] == embedder)
    if rows and not usable:
        raise EmbedderMismatch(f"no collection was built with {embedder}; there are {', '.join(sorted({str(r['embedder']) for r in rows}))}")
    return usable


def matches(source: str, by_path: Column, by_name: Column) -> Column:
    """Documents that a path or a name means."""
    return (by_path == source) | (by_name == source)
