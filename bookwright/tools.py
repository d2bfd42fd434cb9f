"""The library's six verbs for agents: plain arguments in, text out, within bounds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from bookwright.engine import DEFAULT, Engine
from bookwright.operators.search import rendered

#: Hits and neighbours that one call may ask for, and lines that a listing shows.
MOST_HITS, MOST_NEIGHBOURS, MOST_LINES = 20, 5, 200


def _shown(rows: DataFrame, *order: Column) -> tuple[list[Row], str]:
    """The first rows in an order, and a line that says how many more there are."""
    first = rows.orderBy(*order).limit(MOST_LINES + 1).collect()
    more = f"\n… and {rows.count() - MOST_LINES} more" if len(first) > MOST_LINES else ""
    return first[:MOST_LINES], more


class Tools:
    """Verbs over an engine; files are taken from under ``roots`` only, links resolved."""

    def __init__(self, engine: Engine, roots: Iterable[str] = ()):
        self.engine, self.roots = engine, [Path(r).expanduser().resolve() for r in roots]

    def _allowed(self, path: str) -> str:
        real = Path(path).expanduser().resolve()
        if not any(real == r or r in real.parents for r in self.roots):
            raise PermissionError(f"{path} is outside the allowed folders")
        return str(real)

    def search_knowledge(self, query: str, collection: str | None = None, k: int = 5, mode: str = "hybrid") -> str:
        hits = rendered(self.engine.search(query, collection, min(max(k, 1), MOST_HITS), mode)).orderBy("rank").collect()
        return "\n\n".join(r["shown"] for r in hits) or "No results."

    def read_chunk(self, chunk_id: str, neighbours: int = 1, collection: str | None = None) -> str:
        rows = self.engine.read(chunk_id, min(max(neighbours, 0), MOST_NEIGHBOURS), collection).collect()
        return "\n\n".join(r["text"] for r in rows) or f"No chunk {chunk_id}."

    def list_collections(self) -> str:
        rows, more = _shown(self.engine.collections(), F.col("name"))
        return "\n".join(f"{r['name']}: {r['documents']} documents, {r['chunks']} chunks ({r['embedder']}{'' if r['searchable'] else ', built with another embedder'})" for r in rows) + more or "No collections."

    def list_documents(self, collection: str | None = None) -> str:
        rows, more = _shown(self.engine.documents(collection).withColumn("labels", F.array_join("tags", ", ")), F.col("collection"), F.col("source_name"), F.col("source_path"))
        return "\n".join(f"{r['source_name']} ({r['total_chunks']} chunks{', ' + r['labels'] if r['labels'] else ''})" for r in rows) + more or "No documents."

    def ingest_documents(self, paths: Sequence[str], collection: str = DEFAULT, tags: Sequence[str] = (), recursive: bool = False) -> str:
        # Failures first, so that none of them is among those not shown.
        rows, more = _shown(self.engine.ingest([self._allowed(p) for p in paths], collection, tags, recursive), F.col("status") != "failed", F.col("source_path"))
        return "\n".join(f"{r['status']}: {r['source_path']}" + (f" ({r['error']})" if r["error"] else "") for r in rows) + more or "No files."

    def remove_document(self, source: str, collection: str = DEFAULT) -> str:
        return f"Removed {self.engine.remove(source, collection)}."
