"""Cleaning, blocks, chunks, rows, changes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bookwright.errors import RowSourceError
from bookwright.operators import blocks, changes, chunking, cleaning, rows
from bookwright.operators.chunking import tokens

DOCUMENT = "id long, pages array<string>, paged boolean"


def chunked(spark, pages, paged=False, **sizes):
    """The chunks of one document as dictionaries."""
    found = chunking.chunk_documents(spark.createDataFrame([(1, pages, paged)], DOCUMENT), ["id"], **sizes).orderBy("seq").collect()
    assert [r["seq"] for r in found] == list(range(len(found)))
    return [{k: v for k, v in r.asDict().items() if k not in ("id", "seq")} for r in found]


PROSE = "The lens holds the light. The shutter keeps it out! Does the aperture help? "


def test_clean_pages(spark):
    page = "Title line here\nTitle line here\n42\n\n\nme@shop.example bought this copy\nok\nOur real line about words kept, x y z q\n​Real &amp; kept text\n12 34 56\n#### %%%% !!!!"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "1\n2")], "id int, text string")
    found = dict(cleaning.clean_pages(df, ["id"]).collect())
    assert found == {1: "Title line here\n\nOur real line about words kept\nReal & kept text", 2: "", 3: "", 4: ""}


def test_clean_empty_table(spark):
    assert cleaning.clean_pages(spark.createDataFrame([], "id int, text string"), ["id"]).count() == 0


def test_heading_paths_skip_fences(spark):
    text = "# A\n```\n# not a heading\n```\n## B ##\ntext\n### C\n## D\n# E"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    found = blocks.heading_paths(blocks.headings(blocks.lines(df))).orderBy("pos").collect()
    assert [r["path"] for r in found] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"], ["E"]]


def test_paragraphs_keep_fences_whole(spark):
    df = spark.createDataFrame([(1, "one\ntwo  \n\n```\ncode\n\nmore\n```\nend\n# H\nlast")], "doc_id int, text string")
    found = [r["text"] for r in blocks.paragraphs(blocks.lines(df)).orderBy("pos").collect()]
    assert found == ["one\ntwo", "```\ncode\n\nmore\n```\nend", "last"]


def test_chunks_know_their_headings(spark):
    found = chunked(spark, ["# Camera\n\n" + PROSE * 8 + "\n\n## Lens\n\n" + PROSE * 8], limit=64, overlap=0)
    assert {tuple(c["heading_path"]) for c in found} == {("Camera",), ("Camera", "Lens")}
    assert all(c["page_start"] is None for c in found)


def test_small_sections_are_merged_and_named(spark):
    found = chunked(spark, ["# A\n\n## B\n\nshort\n\n## C\n\nalso short"], limit=128)
    assert found == [{"text": "B\n\nshort\n\nC\n\nalso short", "token_count": tokens("B\n\nshort\n\nC\n\nalso short"), "heading_path": ["A"], "page_start": None, "page_end": None}]
    assert len(chunked(spark, ["# A\n\n## B\n\nshort\n\n## C\n\nalso short"], limit=128, strategy="hierarchical")) == 2


def test_overlap_carries_the_end(spark):
    found = chunked(spark, ["\n\n".join(PROSE * 2 for _ in range(10))], limit=64, overlap=16)
    assert len(found) > 2
    for before, after in zip(found, found[1:], strict=False):
        assert after["text"].split("\n\n")[0].split()[-1] == before["text"].split()[-1]


def blocked(spark, pages, paged):
    found = blocks.blocks(spark.createDataFrame([(1, pages, paged)], DOCUMENT), "id").orderBy("place").collect()
    return [(r["level"], r["text"], r["page"], r["path"]) for r in found]


def test_pages_and_wrapped_lines(spark):
    pages = ["INTRODUCTION\nsome wrap-\nped text, well-\nKnown people said so.", "and on the next page.", None]
    assert blocked(spark, pages, True) == [(1, "INTRODUCTION", 1, ["INTRODUCTION"]), (0, "some wrapped text, well- Known people said so.", 1, ["INTRODUCTION"]), (0, "and on the next page.", 2, ["INTRODUCTION"])]


def test_headings_without_markup(spark):
    lines = ["Part One of it.", "A Title In Capitals", "1.2.3 numbered line", "1.2.3.4.5.6 deep", "chapter one of many", "SHOUTED LINE", "A sentence like this", "It's Not One", "x" * 130, "12", "Over The Top."]
    found = blocked(spark, ["\n\n".join(lines)], False)
    assert [(level, text) for level, text, _, _ in found] == [(0, lines[0]), (1, lines[1]), (3, lines[2]), (4, lines[3]), (1, lines[4]), (1, lines[5]), (0, lines[6]), (0, lines[7]), (0, lines[8]), (0, "12"), (0, lines[10])]
    assert found[3][3] == [lines[1], lines[2], lines[3]]
    marked = blocked(spark, ["\n\n".join([*lines, "## Marked"])], False)
    assert [level for level, *_ in marked] == [0] * len(lines) + [2]


def test_fences_are_text(spark):
    text = "# A\n\nbefore\n```\n# no heading\n\n  code-\nmore\n```\n\nafter  \nend"
    assert [(level, t) for level, t, _, _ in blocked(spark, [text], False)] == [(1, "A"), (0, "before\n```\n# no heading\n\n  code-\nmore\n```"), (0, "after\nend")]
    assert [t for _, t, _, _ in blocked(spark, [text], True)] == ["A", "before ``` # no heading    code-more ```".replace("code-more", "codemore"), "after end"]


def test_markdown_of_blocks(spark):
    df = spark.createDataFrame([(1, ["# A\ntext\n\n\n## B ##", "last"], False), (2, [], False), (3, None, False), (4, [None, " "], True)], DOCUMENT)
    assert dict(chunking.markdown_documents(df, "id").collect()) == {1: "# A\n\ntext\n\n## B\n\nlast\n", 2: "", 3: None, 4: ""}


def test_bad_sizes_are_refused():
    with pytest.raises(ValueError, match="at least 16"):
        chunking.Packer(8)
    with pytest.raises(ValueError, match="strategy"):
        chunking.Packer(64, strategy="other")


def filled(text, limit):
    """Pieces of a paragraph, one unit after the other."""
    units = []
    for sentence in re.split(r"(?<=[.!?…])\s+", text):
        units += [(w, n == 0) for n, w in enumerate(sentence.split())] if tokens(sentence) > limit else [(sentence, False)]
    done = [""]
    for unit, fresh in units:
        longer = f"{done[-1]} {unit}".strip() if done[-1] else unit
        if done[-1] and (fresh or tokens(longer) > limit):
            done.append(unit)
        else:
            done[-1] = longer
    return [p for p in done if p]


def test_pieces_of_random_paragraphs(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aaab  .!?\n…") for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["", "x" * 500 + " y. z", "one. two.  three"]
    for limit in (16, 40):
        df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
        found = dict(df.select("n", chunking.split_long(F.col("t"), limit)).collect())
        for n, text in enumerate(texts):
            assert found[n] == filled(text, limit)
            assert " ".join(found[n]).split() == text.split()
            assert all(tokens(p) <= limit or len(p.split()) == 1 for p in found[n])


def test_chunks_of_many_documents(spark):
    df = spark.createDataFrame([(1, None, False), (2, [], False), (3, ["", None, "x"], True), (4, ["a\n\nb"], False)], DOCUMENT).withColumn("text", F.lit("kept"))
    found = {r["id"]: r for r in chunking.chunk_documents(df.withColumn("name", F.concat(F.lit("n"), "id")), ["id", "name"]).collect()}
    assert found.keys() == {3, 4}
    assert (found[3]["page_start"], found[3]["name"]) == (3, "n3")
    assert (found[4]["text"], found[4]["seq"]) == ("a\n\nb", 0)
    assert chunking.chunk_documents(df.limit(0), ["id"]).count() == 0


MAPPING = rows.RowMapping("notes", "id", ("body",), "title", ("status",))


def test_rows_become_documents(spark):
    df = spark.createDataFrame([(1, " T ", "text ", "live", 9), (2, "", "b", None, 9), (3, "x", "  ", "s", 9), (4, "y", None, "s", 9)], "id int, title string, body string, status string, text int")
    found = {r["source_path"]: (r["source_name"], r["text"]) for r in rows.documents(df, MAPPING).collect()}
    assert found == {"sql:notes/1": ("T", "# T\n\nstatus: live\n\ntext"), "sql:notes/2": ("notes #2", "b")}


def test_rows_are_checked(spark):
    df = spark.createDataFrame([(1, "a", "x", "s"), (1, "b", "y", "s")], "id int, title string, body string, status string")
    with pytest.raises(RowSourceError, match="sql:notes/1"):
        rows.checked(rows.documents(df, MAPPING))
    with pytest.raises(RowSourceError, match="status"):
        rows.documents(df.drop("status"), MAPPING)
    with pytest.raises(RowSourceError):
        rows.RowMapping("a b", "id", ("x",))
    nulls = spark.createDataFrame([(None, "b", "y", "s")], df.schema)
    with pytest.raises(Exception, match="has no id"):
        rows.documents(nulls, MAPPING).collect()
    assert rows.documents(nulls, MAPPING, strict=False).count() == 0


def test_decisions(spark):
    stored = spark.createDataFrame([("c", "a", "h1", ["x"], 3), ("c", "b", "h2", ["x"], 1), ("c", "d", None, None, 1)], "collection string, source_path string, source_hash string, tags array<string>, total_chunks int")
    incoming = spark.createDataFrame([("c", "a", "h1", ["x"]), ("c", "b", "h2", ["y"]), ("c", "d", "h", []), ("c", "e", "h", None), (None, "a", "h1", [])], "collection string, source_path string, source_hash string, tags array<string>")
    found = {(r["collection"], r["source_path"]): (r["status"], r["tags"]) for r in changes.decide(incoming, stored).collect()}
    assert found == {("c", "a"): ("unchanged", ["x"]), ("c", "b"): ("retagged", ["y"]), ("c", "d"): ("updated", []), ("c", "e"): ("added", []), (None, "a"): ("added", [])}
    assert {r["status"] for r in changes.decide(incoming.where("source_path in ('a', 'b') and collection = 'c'"), stored, force=True).collect()} == {"updated"}
    assert [r["source_path"] for r in changes.removed(incoming.where("source_path <> 'd'"), stored, "").collect()] == ["d"]
