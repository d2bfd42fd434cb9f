"""A thin command line over the engine: ``python -m bookwright.cli --library DIR COMMAND …``."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookwright.config import Config
from bookwright.engine import DEFAULT, Engine
from bookwright.errors import EmbedderMismatch, EmbeddingUnavailable, ExportError, RowSourceError
from bookwright.functions.embedding import resolve
from bookwright.functions.text import snippet
from bookwright.operators.chunking import STRATEGIES
from bookwright.operators.exporting import Report, as_json
from bookwright.operators.rows import RowMapping
from bookwright.sources import files
from bookwright.sources.databases import resolved


def listed(text: str) -> tuple[str, ...]:
    """Parts of an option with commas, without blanks and empty ones."""
    return tuple(p.strip() for p in text.split(",") if p.strip())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="bookwright")
    top.add_argument("--library", help="folder of the library")
    top.add_argument("--embedder", help="hash[:dim] or http:model[@dim]")
    top.add_argument("--master", help="Spark master")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, **options: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name, **options)
        one.add_argument("--collection", default=None)
        return one

    process = command("process", help="write files as folders of chunks, without a library")
    process.add_argument("paths", nargs="+")
    process.add_argument("--output", default="./output")
    process.add_argument("--recursive", action="store_true")
    process.add_argument("--strategy", choices=STRATEGIES, default="hybrid")
    process.add_argument("--max-tokens", type=int, default=512)
    command("info", help="show what files are").add_argument("paths", nargs="+")
    index = command("index", help="add files")
    index.add_argument("paths", nargs="+")
    index.add_argument("--recursive", action="store_true")
    index.add_argument("--force", action="store_true")
    index.add_argument("--tags", type=listed, default=())
    index.add_argument("--max-tokens", type=int, default=512)
    rows = command("index-sql", help="add the rows of a query")
    rows.add_argument("query")
    rows.add_argument("--dsn")
    rows.add_argument("--label", required=True)
    rows.add_argument("--id-column", required=True)
    rows.add_argument("--text-columns", type=listed, required=True)
    rows.add_argument("--title-column")
    rows.add_argument("--meta-columns", type=listed, default=())
    rows.add_argument("--sync", action="store_true")
    rows.add_argument("--force", action="store_true")
    rows.add_argument("--tags", type=listed, default=())
    search = command("search", help="find chunks")
    search.add_argument("query")
    search.add_argument("-k", type=int, default=5)
    search.add_argument("--mode", default="hybrid")
    search.add_argument("--full", action="store_true", help="whole chunks")
    read = command("read", help="show a chunk and those around it")
    read.add_argument("chunk_id")
    read.add_argument("--neighbours", type=int, default=1)
    command("collections", help="list collections")
    command("docs", help="list documents")
    command("rm", help="remove a document").add_argument("source")
    export = command("export", help="write chunks to a folder, a Postgres table or a REST library")
    export.add_argument("path", nargs="?", help="folder for JSON lines")
    export.add_argument("--to", help="jdbc:…, http(s)://… or env:NAME")
    export.add_argument("--table", default="bookwright_chunks")
    export.add_argument("--owner", default=os.environ.get("BOOKWRIGHT_OWNER"), help="UUID of the owner in a REST library")
    export.add_argument("--searched-with", help="embedder of a REST library")
    return top


def exported(engine: Engine, collection: str, given: argparse.Namespace) -> Report:
    """Does an export to a database or a REST library."""
    to = resolved(given.to)
    if to.startswith("jdbc:"):
        login = {k: v for k, v in (("user", os.environ.get("BOOKWRIGHT_DB_USER")), ("password", os.environ.get("BOOKWRIGHT_DB_PASSWORD"))) if v}
        return engine.export_table(collection, to, given.table, driver="org.postgresql.Driver", **login)
    if not (key := os.environ.get("BOOKWRIGHT_LIBRARY_KEY")):
        raise ExportError("set BOOKWRIGHT_LIBRARY_KEY to the key of the library")
    return engine.export_library(collection, to, key, given.owner or "", given.searched_with)


def run(arguments: Sequence[str], spark: SparkSession | None = None) -> int:
    """Does one command; rows go to standard output as JSON. 1: something failed or nothing was removed; 2: a wrong call."""
    given = parser().parse_args(arguments)
    spark = spark or (SparkSession.builder.master(given.master) if given.master else SparkSession.builder).getOrCreate()
    size = getattr(given, "max_tokens", 512)
    config = replace(Config() if size == 512 else Config().for_size(size), strategy=getattr(given, "strategy", "hybrid"))
    try:
        engine = Engine(spark, given.library, resolve(given.embedder), config)
        name = given.collection or DEFAULT
        shown: DataFrame | None = None
        if given.command == "process":
            shown = engine.process(given.paths, given.output, given.recursive)
        elif given.command == "info":
            shown = files.info(files.read_files(spark, given.paths))
        elif given.command == "index":
            shown = engine.ingest(given.paths, name, given.tags, given.recursive, given.force)
        elif given.command == "index-sql":
            mapping = RowMapping(given.label, given.id_column, given.text_columns, given.title_column, given.meta_columns)
            shown = engine.ingest_query(resolved(given.dsn), given.query, mapping, name, given.tags, given.sync, given.force)
        elif given.command == "search":
            shown = engine.search(given.query, given.collection, given.k, given.mode)
            shown = shown if given.full else shown.withColumn("text", snippet(F.col("text")))
        elif given.command == "read":
            shown = engine.read(given.chunk_id, given.neighbours, given.collection)
        elif given.command in ("collections", "docs"):
            shown = engine.collections() if given.command == "collections" else engine.documents(given.collection)
        elif given.command == "rm":
            return 0 if engine.remove(given.source, name) else 1
        elif given.to:
            report = exported(engine, name, given)
            rows = [report.skipped.select(F.lit("skipped").alias("what"), F.concat_ws(": ", "source_name", "reason").alias("name")), report.removed.select(F.lit("removed").alias("what"), F.col("item").alias("name"))]
            shown = rows[0].unionByName(rows[1])
            print(f"{report.collection} to {report.target}: {report.documents} documents, {report.chunks} chunks", file=sys.stderr)
        else:
            if not given.path:
                raise ValueError("name a folder, or a target by --to")
            engine.export_folder(name, given.path)
    except (EmbedderMismatch, EmbeddingUnavailable, ExportError, RowSourceError, KeyError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    failed, sign = False, {"index": '"status":"failed"', "index-sql": '"status":"failed"', "process": '"error":"'}.get(given.command)
    for row in as_json(shown).toLocalIterator() if shown is not None else ():
        print(row["value"])
        failed |= bool(sign) and sign in row["value"]
    return int(failed)


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
