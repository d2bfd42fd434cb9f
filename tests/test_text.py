import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bookwright.functions import text as fn
from bookwright.functions.markup import html_text
from bookwright.functions.stemming import stem, stem_column, term, tokens as index_tokens
from bookwright.operators.chunking import tokens


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r["x"] for r in df.select("n", expression(F.col("v")).alias("x")).orderBy("n").collect()]


TEXTS = [None, "", "   ", "a", "one two three", "x" * 400, "a\x1cb c d e", "word " * 300, "\n\tq\n"]


def test_estimate_agrees_with_the_packer(spark):
    assert column(spark, TEXTS, fn.estimate_tokens) == [None if t is None else tokens(t) for t in TEXTS]


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(), min_size=1, max_size=20))
def test_estimate_of_any_text(spark, values):
    assert column(spark, values, fn.estimate_tokens) == [tokens(v) for v in values]


def test_keys_and_hashes(spark):
    assert column(spark, ["Café au lait!.md", "***", "a" * 60], fn.stem_slug) == ["Café-au-lait-md", "item", "a" * 40]
    assert column(spark, ["x"], fn.content_hash) == ["sha256:" + hashlib.sha256(b"x").hexdigest()]
    digest = hashlib.sha1(b"c\0/p").hexdigest()[:8]
    assert column(spark, ["/p"], lambda p: fn.document_key(F.lit("c"), p, F.lit("stem"))) == [f"stem-{digest}"]
    assert column(spark, [1, 1234], lambda n: fn.chunk_id(F.lit("k"), n), "int") == ["k_chunk_001", "k_chunk_1234"]


@pytest.mark.parametrize(
    ("start", "end", "path", "expected"),
    [(2, 3, ["A", "B"], "n, p.2–3 › A › B"), (2, 2, [], "n, p.2"), (None, 4, ["A"], "n › A"), (0, 4, [], "n"), (5, None, [], "n, p.5")],
)
def test_citation(spark, start, end, path, expected):
    df = spark.createDataFrame([("n", start, end, path)], "name string, s int, e int, path array<string>")
    assert df.select(fn.citation(F.col("name"), F.col("s"), F.col("e"), F.col("path"))).collect()[0][0] == expected


def test_query_terms(spark):
    assert column(spark, ["Über the über_x a-b AB", '"', None], fn.match_expression) == ['"über" OR "the" OR "über_x" OR "ab"', "", None]


def test_book_names(spark):
    given_ = ["some_book-v1.2.pdf", "über guide.md", "a.pdf.txt", "v2.0.1", "notes.xyz", "x  y"]
    assert column(spark, given_, fn.book_name) == ["Some Book", "üBer Guide", "A", "Untitled", "Notes.Xyz", "X Y"]


def test_shared_path_and_tail(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c"]), ([], ["a"]), (["a"], ["a", "b"]), (["x"], ["y"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(fn.common_prefix(F.col("a"), F.col("b"))).collect()] == [["a"], [], ["a"], []]
    assert column(spark, ["a b c d", "", "one"], lambda t: fn.overlap_tail(t, 3)) == ["c d", "", "one"]
    assert column(spark, ["a b"], lambda t: fn.overlap_tail(t, 0)) == [""]


PAGES = {
    "<html><head><title>T</title></head><body><h2>Head</h2><p>one&nbsp; two<script>x()</script></p><div>three<br>four</div><img src='a.png'></body>": "## Head\n\none two\n\nthree\nfour",
    "<p>x</p>": "x",
    "": "",
    "plain text\n with  blanks": "plain text\nwith blanks",
    "a &lt;b&gt; &amp; c &#8212; d": "a <b> & c — d",
    "<ul><li>one<li>two</ul><table><tr><td>a</td><td>b</td></tr></table>": "one\ntwo\n\nab",
    "x<!-- <p>hidden</p> -->y": "xy",
    "<STYLE type='a>b'>p{}</STYLE>shown <noscript><p>no</p></noscript>": "shown",
    "<script>never closed <p>gone</p>": "",
    "<h1 class=\"a>b\">Top</h1>text<h6>deep</h6>": "# Top\ntext\n\n###### deep",
    "<header>kept</header> <titles>kept too</titles>": "kept kept too",
    "1 < 2 and <a href='x'>link</a>s": "1 < 2 and links",
    "unfinished <a hre": "unfinished",
    "<p>a</p>\n\n\n\n<p>b</p>": "a\n\nb",
}


def test_html_column(spark):
    assert column(spark, [*PAGES, None], html_text) == [*PAGES.values(), None]


def test_terms_fold_case_and_accents(spark):
    assert column(spark, ["Café CAFES running", None], index_tokens) == [["café", "cafes", "running"], []]
    assert column(spark, ["café", "cafes", "running", None], stem_column) == ["cafe", "cafe", "run", None]
    assert term("été") == term("été")


def test_stems_are_those_of_sqlite():
    import sqlite3

    words = re.findall(r"[a-z]+", """caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky
        relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness
        formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement
        adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll by yes a be dying saying archaeologies generalizations oscillators""")
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(f, 'instance')")
    db.executemany("insert into f(rowid, t) values (?, ?)", enumerate(words, 1))
    expected = dict(db.execute("select doc, term from v"))
    assert {w: stem(w) for w in words} == {w: expected[n] for n, w in enumerate(words, 1)}
