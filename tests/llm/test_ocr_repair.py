import pytest
from pyspark.sql import functions as F

from bookwright.llm import ocr_repair as ocr

COLUMNS = "id long, document_id long, text string, section_title string, heading_path array<string>, page_start int, page_end int"


@pytest.mark.parametrize("line", ["3", "Page 3", "page 3 of 9", "p. 3", "- 3 -", "[3]", "(3)", "3 / 9", "iii", "III", "Pa9e 3", "Page 3 of l2"])
def test_page_numbers(line):
    assert ocr.is_page_number(line, 2, 4)


@pytest.mark.parametrize("line", ["818", "5", "Room 3", "3 apples", "wait 3 hours.", "", "vi", "Page 7", "it", "3.5 metres"])
def test_no_page_numbers(line):
    assert not ocr.is_page_number(line, 2, 4)


def test_misread_digits():
    assert ocr.is_page_number("- l -", 1, 1)
    assert ocr.is_page_number("p. lO", 10, 10)
    assert ocr.is_page_number("Page 7", None, None)


@pytest.mark.parametrize("line", ["Plane morning 32", "PLANE MORNING 32", "P L A N E   M O R N I N G   3 2", "P1ane morning 32 | 3", "3   Plane morning 32", "Plane rnorning 32", "Plane morning 32 - Page 3"])
def test_headers(line):
    assert ocr.is_header(line, ["Plane morning 32"], 3, 4)


@pytest.mark.parametrize("line", ["Plane morning 33", "the plane morning 32", "Plane morning", "3", "", "Plane morning 32 | 9"])
def test_no_headers(line):
    assert not ocr.is_header(line, ["Plane morning 32"], 3, 4)


def library(spark):
    clean = "The small clover covers the corner of the garden. A read-only list is long-lasting and adjustable. " * 30
    rows = [
        (1, 1, "The srnall clover cov-\ners the\n\n2\nGarden notes\n\ncorner 0f the garden.\n\nA read-\nonly list is adjusta-\nble.", "Beds", ["Garden notes", "Beds"], 1, 2),
        (2, 1, "The small list\nis long.", None, None, None, None),
        (3, 1, "", "", [], 1, 1), (4, 1, None, "", [], 1, 1), (5, 2, clean, "", [], None, None), (6, 2, clean, "", [], None, None), (None, 1, "srnall", "", [], 1, 1),
        (7, 1, "Readings:\n818\n827", "", ["Garden notes"], 1, 2), (1, 1, "The srnall clover cov-\ners the\n\n2\nGarden notes\n\ncorner 0f the garden.\n\nA read-\nonly list is adjusta-\nble.", "Beds", ["Garden notes", "Beds"], 1, 2),
    ]
    docs = spark.createDataFrame([(1, 1, "garden-notes.pdf"), (2, 0, "clean.md"), (3, None, None)], "doc_id long, ocr_used int, source_name string")
    return spark.createDataFrame(rows, COLUMNS).withColumn("kind", F.lit(1)).withColumn("word", F.lit("x")), docs


def test_noise(spark):
    found = sorted(map(tuple, ocr.noise(*library(spark)).collect()))
    assert found == [(1, "chars"), (1, "header"), (1, "hyphen"), (1, "page_number")]


def test_repair(spark):
    found = dict(map(tuple, ocr.repaired(*library(spark)).collect()))
    assert found == {
        1: "The small clover covers the corner of the garden.\n\nA read-only list is adjustable.",
        2: "The small list is long.", 3: "", 7: "Readings: 818 827",
    }


def test_nothing_scanned(spark):
    chunks, docs = library(spark)
    assert ocr.noise(chunks.limit(0), docs).count() == 0
    assert ocr.repaired(chunks, docs.limit(0)).count() == 0


def test_anagram_hash_ignores_order(spark):
    df = spark.createDataFrame([("listen",), ("silent",), ("tinsel",), ("enlists",)], "w string")
    found = [r[0] for r in df.select(ocr.anagram(F.col("w"))).collect()]
    assert found[0] == found[1] == found[2] != found[3]


def test_corrections_need_evidence(spark):
    words = spark.createDataFrame([("rnay", 1), ("cat", 5), ("c1ock", 1), ("dock", 1)], "word string, scanned long")
    counts = spark.createDataFrame([("rnay", 1), ("may", 50), ("cat", 30), ("eat", 200), ("clock", 5), ("c1ock", 1), ("dock", 40)], "word string, n long")
    assert dict(map(tuple, ocr.corrections(words, counts).collect())) == {"rnay": "may", "c1ock": "clock"}


def test_long_headers_are_headers():
    title = "Notes on the winter storage of garden tools " * 8
    assert ocr.is_header(title + " 12", [title], 10, 14)
    assert ocr.is_header(title.replace("m", "rn"), [title], 1, 2)
    assert not ocr.is_header(title + title + title, [title], 1, 2)
    assert not ocr.is_header("any line", [], 1, 2)
