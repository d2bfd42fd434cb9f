import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookwright.config import Config
from bookwright.engine import Engine
from bookwright.errors import EmbedderMismatch, EmbeddingUnavailable, ExportError
from bookwright.functions.embedding import HashingEmbedder, HttpEmbedder, embed, resolve, shortened
from bookwright.operators import exporting
from bookwright.operators.rows import RowMapping
from bookwright.sources import databases
from bookwright.operators.search import word_index
from bookwright.tools import Tools
from bookwright.streaming.ingest import ITEMS, arrivals, ingest_stream

OWNER = "00000000-0000-4000-8000-000000000001"


class Handler(BaseHTTPRequestHandler):
    def _any(self):
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        self.server.seen.append((self.command, self.path, json.loads(body) if body else None, dict(self.headers)))
        status, answer = self.server.answer(self)
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    do_POST = do_DELETE = _any

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    http = HTTPServer(("127.0.0.1", 0), Handler)
    http.seen, http.answer = [], lambda request: (200, [])
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield http
    http.shutdown()


def url(http):
    return f"http://127.0.0.1:{http.server_port}"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("files")
    (base / "routers.md").write_text("# Routers\n\nThe router keeps a table of addresses.\n\n## Reset\n\n" + "Hold the small button to reset the router at once. " * 20)
    (base / "baking.txt").write_text("Bread needs flour and water.\n\nKnead the dough slowly.\n")
    (base / "broken.epub").write_text("not a zip")
    return base


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory, folder):
    made = Engine(spark, str(tmp_path_factory.mktemp("library")), HashingEmbedder(128), Config(max_tokens=64, overlap_tokens=16))
    statuses = {r["source_path"].rsplit("/", 1)[1]: r["status"] for r in made.ingest([str(folder)], tags=["home"]).collect()}
    assert statuses == {"routers.md": "added", "baking.txt": "added", "broken.epub": "failed"}
    return made


def test_search_finds_and_cites(engine):
    best = engine.search("reset the router", k=2).collect()
    assert best[0]["source_name"] == "routers.md"
    assert best[0]["tags"] == ["home"]
    assert engine.search("dough", mode="keyword").collect()[0]["source_name"] == "baking.txt"
    assert engine.search("   ").count() == 0


def test_words_are_indexed_with_the_chunks(engine):
    kept, made = engine.store.index(), word_index(engine.store.chunks())
    assert sorted(map(tuple, kept.postings.select("term", "id", "places").collect())) == sorted(map(tuple, made.postings.select("term", "id", "places").collect()))
    assert sorted(map(tuple, kept.lengths.select("id", "n").collect())) == sorted(map(tuple, made.lengths.collect()))
    plan = kept.postings.where("term = 'router'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,router)" in plan


def test_reading_around(engine):
    middle = engine.store.chunks().where("seq = 1").orderBy("id").collect()[0]["chunk_id"]
    assert [r["seq"] for r in engine.read(middle, 1).collect()] == [0, 1, 2]


def test_listings(engine):
    own = engine.collections().collect()[0]
    assert (own["name"], own["documents"], own["searchable"]) == ("default", 2, True)
    assert [r["source_name"] for r in engine.documents("default").collect()] == ["baking.txt", "routers.md"]


def test_refresh_and_tags(spark, tmp_path, folder):
    engine = Engine(spark, str(tmp_path / "lib"), HashingEmbedder(16))
    path = tmp_path / "a.md"
    path.write_text("one")
    status = lambda **k: engine.ingest([str(path)], **k).collect()[0]["status"]
    assert [status(), status(), status(tags=["x"]), status(tags=["x"]), status(force=True)] == ["added", "unchanged", "retagged", "unchanged", "updated"]
    assert engine.documents().collect()[0]["tags"] == ["x"]
    path.write_text("")
    assert status() == "updated"
    assert engine.documents().collect()[0]["total_chunks"] == 0
    assert engine.store.chunks().count() == 0


def test_synchronised_rows_and_removal(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lib"), HashingEmbedder(16))
    rows = lambda *ids: spark.createDataFrame([(f"sql:t/{n}", f"n{n}", f"text {n}") for n in ids], "source_path string, source_name string, text string")
    engine.ingest_texts(rows(1, 2, 3), "c", sync_prefix="sql:t/")
    engine.ingest_texts(spark.createDataFrame([("other", "o", "kept")], "source_path string, source_name string, text string"), "c")
    found = {r["source_path"]: r["status"] for r in engine.ingest_texts(rows(2, 4), "c", sync_prefix="sql:t/").collect()}
    assert found == {"sql:t/1": "removed", "sql:t/2": "unchanged", "sql:t/3": "removed", "sql:t/4": "added"}
    assert engine.remove("sql:t/2", "c") == 1
    assert engine.remove("n4", "c") == 1
    assert engine.remove("none", "c") == 0
    assert [r["source_path"] for r in engine.documents("c").collect()] == ["other"]
    with pytest.raises(ValueError, match="outside"):
        engine.ingest_texts(rows(1), "c", sync_prefix="sql:u/")
    engine.store.drop("c")
    assert engine.collections().count() == 0


def test_query_rows(spark, tmp_path):
    import sqlite3

    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("create table notes(id integer, title text, body text)")
    db.executemany("insert into notes values (?, ?, ?)", [(1, "One", "alpha"), (2, None, "beta"), (3, "x", None)])
    db.commit()
    engine = Engine(spark, str(tmp_path / "lib"), HashingEmbedder(16))
    found = engine.ingest_query(str(tmp_path / "x.db"), "select * from notes", RowMapping("n", "id", ("body",), "title")).collect()
    assert sorted(r["source_path"] for r in found) == ["sql:n/1", "sql:n/2"]


def test_embedders_are_not_mixed(spark, engine):
    other = Engine(spark, engine.store.root, HashingEmbedder(8))
    with pytest.raises(EmbedderMismatch):
        other.ingest_texts(spark.createDataFrame([("a", "a", "a")], "source_path string, source_name string, text string"))
    with pytest.raises(EmbedderMismatch):
        other.search("x")


def test_library_export(spark, tmp_path, server):
    engine = Engine(spark, str(tmp_path / "lib"), HashingEmbedder(8))
    rows = lambda *names: spark.createDataFrame([(f"/{n}", n, f"text of {n}") for n in names], "source_path string, source_name string, text string")
    engine.ingest_texts(rows("tomb_one.pdf", "two.md", "srd.txt", "two.txt"), "c")
    report = engine.export_library("c", url(server), "key", OWNER)
    assert (report.documents, report.chunks, report.removed.count()) == (2, 2, 0)
    assert sorted(map(tuple, report.skipped.collect())) == [("srd.txt", "reserved"), ("two.txt", "duplicate")]
    assert {b["name"] for m, p, b, _ in server.seen if m == "POST" and "books" in p and b["updated_at"]} == {"Tomb One", "Two"}
    posted = [r for m, p, b, _ in server.seen if m == "POST" and p.endswith("chunks") for r in b]
    assert sorted((r["source_book"], r["category"]) for r in posted) == [("Tomb One", "adventure"), ("Two", "sourcebook")]
    assert server.seen[0][3]["Authorization"] == "Bearer key"
    engine.remove("/tomb_one.pdf", "c")
    server.seen.clear()
    assert [r["item"] for r in engine.export_library("c", url(server), "key", OWNER).removed.collect()] == ["Tomb One"]
    assert sum(m == "DELETE" and "user_library_books" in p for m, p, _, _ in server.seen) == 1
    server.answer = lambda request: (500, "no")
    with pytest.raises(Exception, match="refused"):
        engine.export_library("c", url(server), "key", OWNER)
    with pytest.raises(ExportError, match="no collection"):
        engine.export_library("d", url(server), "key", OWNER)
    with pytest.raises(ExportError, match="searches with"):
        engine.export_library("c", url(server), "key", OWNER, "other")


def test_batches_are_posted_whole(spark, server):
    rows = spark.range(450).select(F.lit(OWNER).alias("user_id"), F.concat(F.lit('c"'), "id").alias("chunk_id"), F.when(F.col("id") < 400, "Big").otherwise("Small").alias("source_book"))
    assert sorted(map(tuple, exporting.rest_export(rows, url(server), "key", batch=50).collect())) == [("Big", 400), ("Small", 50)]
    posted = [r["chunk_id"] for m, p, b, _ in server.seen if m == "POST" and p.endswith("chunks") for r in b]
    assert len(posted) == len(set(posted)) == 450
    assert all(len(b) <= 50 for m, p, b, _ in server.seen if m == "POST" and p.endswith("chunks"))
    library = exporting.Library(url(server), "key")
    library.clear_chunks(OWNER, ['a"b', "c\\d"])
    assert "in.%28%22a%5C%22b%22%2C%22c%5C%5Cd%22%29" in server.seen[-1][1]
    with pytest.raises(ExportError, match="reached"):
        exporting.Library("http://127.0.0.1:9", "key", timeout=1).clear(OWNER, "x")


DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_table_statements():
    made = exporting.table_statements("chunks", 384)
    assert any("embedding vector(384) NOT NULL" in s and "UNIQUE (collection, chunk_id)" in s for s in made)
    assert any("USING hnsw" in s for s in made) and not any("hnsw" in s for s in exporting.table_statements("chunks", 3000))
    swap = exporting.replace_statements("chunks", "new")
    assert swap[0] == "DELETE FROM chunks WHERE collection = ?" and "embedding::vector FROM new WHERE collection = ?" in swap[1]
    with pytest.raises(ExportError):
        exporting.table_statements("Bad Name", 3)


def test_transactions_are_all_or_none(spark, tmp_path):
    at = f"jdbc:derby:{tmp_path / 'db'};create=true"
    exporting.staged(spark.createDataFrame([("a", 1)], "name string, n int"), at, "T1", **DERBY)
    with exporting.Transaction(spark, at, **DERBY) as t:
        t.run('INSERT INTO T1 ("name", "n") VALUES (?, 2)', "b")
    with pytest.raises(ExportError, match="failed"), exporting.Transaction(spark, at, **DERBY) as t:
        t.run("DELETE FROM T1")
        t.run("DELETE FROM missing")
    with exporting.Transaction(spark, at, **DERBY) as t:
        assert sorted(t.run('SELECT "name" FROM T1')) == ["a", "b"]
    read = databases.read_jdbc(spark, at, "select * from T1", "n", 2, **DERBY)
    assert sorted(map(tuple, read.collect())) == [("a", 1), ("b", 2)]


def test_rows_for_a_table(engine):
    rows = exporting.table_rows(engine.store.chunks(), engine.store.documents(), "default", "e").collect()
    assert len(rows) == engine.store.chunks().count()
    assert json.loads(rows[0]["tags"]) == ["home"] and rows[0]["embedding"].startswith("[")


def test_process_writes_folders(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "lib"), HashingEmbedder(8), Config(max_tokens=64, overlap_tokens=16, custom_tags=("x",)))
    found = {r["source_name"]: r for r in engine.process([str(folder)], str(tmp_path / "out")).collect()}
    assert found["broken.epub"]["error"] and found["baking.txt"]["total_chunks"] == 1
    chunks = spark.read.json(str(tmp_path / "out" / "chunks")).where("source_name = 'routers.md'").collect()
    assert sorted(r["chunk_id"] for r in chunks)[0] == "routers_chunk_001"
    first = min(chunks, key=lambda r: r["chunk_id"])["metadata"]
    assert (first["source_file"], first["chunk_index"], first["custom_tags"], first["total_chunks"]) == ("routers.md", 1, ["x"], len(chunks))
    text = spark.read.text(str(tmp_path / "out" / "markdown"), wholetext=True).where("source_name = 'routers.md'").collect()[0]["value"]
    assert text.startswith("# Routers\n\nThe router")
    assert spark.read.json(str(tmp_path / "out" / "manifest")).where("max_tokens = 64").count() == 3


def test_compacting_changes_nothing_that_is_seen(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lib"), HashingEmbedder(8))
    rows = lambda text, *ids: spark.createDataFrame([(f"p{n}", f"n{n}", f"{text} {n}") for n in ids], "source_path string, source_name string, text string")
    engine.ingest_texts(rows("old", 1, 2, 3), "c")
    engine.ingest_texts(rows("new", 1, 2), "c", tags=["t"])
    engine.ingest_texts(rows("kept", 9), "d")
    engine.remove("p3", "c")
    shown = lambda: [sorted(map(str, f.collect())) for f in (engine.store.documents(), engine.store.chunks(), engine.store.index().postings, engine.store.index().lengths)]
    before = shown()
    assert len(before[0]) == 3 and engine.store._table("chunks", ["c"]).count() == 5
    engine.store.compact("c")
    assert shown() == before
    assert engine.store._table("chunks", ["c"]).count() == 2 and engine.store._table("chunks", ["d"]).count() == 1
    assert engine.search("new", "c", mode="keyword").count() == 2


def test_folder_export(spark, engine, tmp_path):
    engine.export_folder("default", str(tmp_path / "out"))
    out = str(tmp_path / "out")
    assert spark.read.json(f"{out}/chunks").count() == engine.store.chunks().count()
    written = {r["source_name"]: r["chunks"] for r in spark.read.json(f"{out}/manifest").collect()}
    assert written == {r["source_name"]: r["total_chunks"] for r in engine.documents("default").collect()}
    assert Config.from_toml("\n".join(r["value"] for r in spark.read.text(f"{out}/config").collect())) == engine.config


def test_literals_and_json(spark):
    df = spark.createDataFrame([(1, [0.1, -2.0, 1e-7]), (2, None)], "id int, v array<float>")
    assert [r[0] for r in df.select(exporting.vector_literal(F.col("v"))).collect()] == ["[0.1,-2,1e-07]", None]
    assert json.loads(exporting.as_json(df).collect()[1][0]) == {"id": 2, "v": None}
    with pytest.raises(ExportError):
        exporting.library_rows(df, "me", F.lit("b"), F.lit("c"))


def test_gone_items(spark):
    ledger = spark.createDataFrame([("t", "a", "x"), ("t", "a", "x"), ("t", "a", "y"), ("t", "b", "y"), ("t", "a", "z")], "target string, collection string, item string")
    current = spark.createDataFrame([("a", "z")], "collection string, item string")
    assert [tuple(r) for r in exporting.gone(ledger, current).collect()] == [("t", "a", "x")]


def test_hashing_embedder(spark):
    e = HashingEmbedder(32)
    assert np.isclose(np.linalg.norm(e.query("a b a")), 1)
    assert not e.query("").any()
    df = embed(spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, t string"), e, "t").collect()
    assert np.allclose(df[0]["embedding"], e.query("a b"))
    assert df[1]["embedding"] is None


def test_http_embedder(server):
    server.answer = lambda request: (200, {"embeddings": [[3.0, 4.0, 12.0]] * len(server.seen[-1][2]["input"])})
    e = HttpEmbedder("m", url(server), dim=2, batch=2, document_prefix="doc: ")
    assert np.allclose(e.documents(["a", "b", "c"]), [[0.6, 0.8]] * 3)
    assert [s[2]["input"] for s in server.seen] == [["doc: a", "doc: b"], ["doc: c"]]
    with pytest.raises(EmbeddingUnavailable):
        HttpEmbedder("m", url(server), dim=9).query("x")
    server.answer = lambda request: (200, {"embeddings": []})
    with pytest.raises(EmbeddingUnavailable, match="came back"):
        e.query("x")
    with pytest.raises(EmbeddingUnavailable):
        HttpEmbedder("m", "http://127.0.0.1:9", timeout=1).query("x")


def test_embedders_by_name(monkeypatch):
    assert resolve("hash:16").name == "hash-words:16"
    assert resolve("http:m@64").dim == 64
    monkeypatch.setenv("BOOKWRIGHT_EMBEDDER", "hash:8")
    assert resolve().dim == 8
    with pytest.raises(EmbeddingUnavailable):
        resolve("other:x")
    assert shortened(np.array([[3.0, 4.0]]), 1).tolist() == [[1.0]]


def test_settings():
    own = Config(strategy="hierarchical", custom_tags=("a", 'b"c'))
    assert Config.from_toml(own.to_toml()) == own
    assert Config.from_toml("[other]\nx = 1\n[chunking]\nmax_tokens = 99\n").max_tokens == 99
    assert Config().for_size(256).overlap_tokens == 32


def test_stream(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lib"), HashingEmbedder(8))
    source = tmp_path / "in"
    rows = [("a", "n", "old", "2024-01-01 00:00:00"), ("a", "n", "new", "2024-01-01 00:00:09"), ("b", "m", "text", "2024-01-01 02:00:00"), (None, "m", "text", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "source_path string, source_name string, text string, at string").select("source_path", "source_name", "text", F.to_timestamp("at").alias("arrived_at")).write.parquet(str(source))
    stream = spark.readStream.schema(ITEMS).parquet(str(source))
    ingest_stream(engine, stream, str(tmp_path / "check"), "s", once=True).awaitTermination(120)
    assert {r["source_path"] for r in engine.documents("s").collect()} == {"a", "b"}
    assert {r["text"] for r in engine.store.chunks(["s"]).collect()} == {"new", "text"}
    query = arrivals(stream).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check2")).start()
    query.awaitTermination(120)
    assert sorted(r["documents"] for r in spark.table("arrivals").collect()) == [2, 2]


def test_tools(engine, folder, tmp_path):
    tools = Tools(engine, [str(folder)])
    assert "routers.md" in tools.search_knowledge("reset the router", k=99).split("\n")[0]
    assert tools.search_knowledge(" ") == "No results."
    first = engine.store.chunks().where("seq = 0").orderBy("id").collect()[0]["chunk_id"]
    assert tools.read_chunk(first, 99)
    assert "2 documents" in tools.list_collections()
    assert "baking.txt (1 chunks, home)" in tools.list_documents()
    assert "unchanged" in tools.ingest_documents([str(folder / "baking.txt")])
    (tmp_path / "link.md").symlink_to("/etc/hostname")
    with pytest.raises(PermissionError):
        tools.ingest_documents([str(tmp_path / "link.md")])
    assert tools.remove_document("none") == "Removed 0."
