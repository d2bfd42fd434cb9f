import json

from bookwright.cli import listed, run


def test_round_trip(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("# Routers\n\nReset the router with the small button.")
    base = ["--library", str(tmp_path / "lib"), "--embedder", "hash:32"]
    rows = lambda: [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert run([*base, "index", str(tmp_path / "a.md"), "--tags", "x, y"], spark) == 0
    assert rows()[0]["status"] == "added"
    assert run([*base, "search", "router", "-k", "1"], spark) == 0
    hit = rows()[0]
    assert hit["tags"] == ["x", "y"]
    assert run([*base, "read", hit["chunk_id"]], spark) == 0
    assert rows()[0]["chunk_id"] == hit["chunk_id"]
    assert run([*base, "collections"], spark) == 0
    assert rows()[0]["documents"] == 1
    assert run([*base, "search", "router", "--collection", "none"], spark) == 2
    assert run([*base, "rm", "none.md"], spark) == 1
    assert run([*base, "export", str(tmp_path / "out")], spark) == 0
    assert run([*base, "export"], spark) == 2
    assert run([*base, "export", "--to", "http://127.0.0.1:9"], spark) == 2
    assert run([*base, "info", str(tmp_path / "a.md")], spark) == 0
    capsys.readouterr()
    assert run([*base, "process", str(tmp_path / "a.md"), "--output", str(tmp_path / "made"), "--max-tokens", "128"], spark) == 0
    assert rows()[0]["total_chunks"] == 1
    assert run([*base, "rm", "a.md"], spark) == 0
    capsys.readouterr()
    assert run([*base, "docs"], spark) == 0
    assert rows() == []
    (tmp_path / "b.epub").write_text("broken")
    assert run([*base, "index", str(tmp_path / "b.epub")], spark) == 1


def test_lists():
    assert listed(" a, ,b,") == ("a", "b")
