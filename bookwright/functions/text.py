"""Column builders over text; all of them run inside Spark's generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str methods see it, for the inside of a class of a Java pattern.
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Everything else, likely characters first.
SOLID = r"!-~\x{a1}-\x{167f}\x{0}-\x{8}\x{e}-\x{1b}\x{7f}-\x{84}\x{86}-\x{9f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}"
PATH_MARK = " › "
#: Runs of letters below which a page with images counts as a scan.
WEAK_PAGE_WORDS = 10


def words(text: Column) -> Column:
    """Parts between white space; none for blank text."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def estimate_tokens(text: Column) -> Column:
    """The larger of a quarter of the characters and 1.3 times the words, rounded down; 0 for blank, null for null."""
    n = F.regexp_count(text, F.lit(f"[{SOLID}]++"))
    # Without a branch, so that the words are counted once.
    return ((n > 0).cast("int") * F.greatest(F.lit(1), F.floor(F.length(text) / 4), F.floor(n * 13 / 10))).cast("int")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def stem_slug(name: Column) -> Column:
    """A name as part of a chunk id: words joined by ``-``, at most 40 characters."""
    slug = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}\p{M}_-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(slug, 1, 40), F.lit("")), F.lit("item"))


def document_key(collection: Column, source_path: Column, stem: Column) -> Column:
    return F.concat(stem, F.lit("-"), F.substring(F.sha1(F.concat(collection, F.lit("\0"), source_path)), 1, 8))


def chunk_id(key: Column, number: Column) -> Column:
    """Id of the ``number``-th chunk, counted from 1, of a document."""
    return F.concat(key, F.lit("_chunk_"), F.lpad(number.cast("string"), F.greatest(F.lit(3), F.length(number.cast("string"))), F.lit("0")))


def embedding_text(name: Column, path: Column, text: Column) -> Column:
    """What is embedded for a chunk: name and headings, then the text."""
    return F.concat(F.concat_ws(PATH_MARK, F.array(name), path), F.lit("\n\n"), text)


def section_title(path: Column) -> Column:
    return F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit(""))


def citation(name: Column, page_start: Column, page_end: Column, path: Column) -> Column:
    """``name, p.2–3 › heading``; pages only where known, a range only where it is one."""
    first = F.when(F.coalesce(page_start, F.lit(0)) != 0, F.concat(F.lit(", p."), page_start.cast("string"))).otherwise("")
    last = F.when((first != "") & (F.coalesce(page_end, F.lit(0)) != 0) & (page_end != page_start), F.concat(F.lit("–"), page_end.cast("string"))).otherwise("")
    headings = F.when(F.size(path) > 0, F.concat(F.lit(PATH_MARK), F.array_join(path, PATH_MARK))).otherwise("")
    return F.concat(name, first, last, headings)


def snippet(text: Column, most: int = 400) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def query_terms(query: Column) -> Column:
    """Distinct terms of a query in their order: runs of letters, digits and ``_`` of two characters or more."""
    found = F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 1))


def match_expression(query: Column) -> Column:
    """The terms as a full-text match expression: quoted and joined by OR."""
    return F.array_join(F.transform(query_terms(query), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def is_weak_page(text: Column, images: Column) -> Column:
    """Whether a page with images holds too few words to have been read."""
    return (F.size(F.regexp_extract_all(text, F.lit("[a-zA-Z]{3,}"), F.lit(0))) < WEAK_PAGE_WORDS) & (images > 0)


def common_prefix(a: Column, b: Column) -> Column:
    """The longest path that both paths begin with."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.array_position(F.transform(F.sequence(F.lit(1), shorter), lambda i: F.get(a, i - 1) == F.get(b, i - 1)), False)
    return F.when(shorter == 0, F.slice(a, 1, 0)).otherwise(F.slice(a, F.lit(1), F.when(same == 0, shorter).otherwise((same - 1).cast("int"))))


def overlap_tail(text: Column, tokens: int) -> Column:
    """The last words of a text, about ``tokens`` tokens of them."""
    if tokens <= 0:
        return F.lit("")
    n = max(1, tokens * 10 // 13)
    w = words(text)
    return F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), F.lit(n)), " ")


def sentences(text: Column) -> Column:
    """Parts of a text that end a sentence, in order."""
    return F.split(text, f"(?<=[.!?…])[{SPACE}]+")


# Endings that an export's book name drops, and words that tell an adventure.
BOOK_ENDINGS = r"(?i)(?<=.)\.(pdf|epub|fb2|o?xps|docx|html?|txt|text|md|markdown|rst)$"
ADVENTURE_WORDS = ("adventure", "module", "campaign", "curse", "descent", "tomb", "lost mine", "dragon of")


def book_name(source_name: Column) -> Column:
    """A readable title of a file name: no ending, no version, words with a capital."""
    name = F.regexp_replace(F.regexp_replace(source_name, BOOK_ENDINGS, ""), r"(?i)\.(pdf|txt|epub)$", "")
    name = F.regexp_replace(name, "[_-]+", " ")
    name = F.regexp_replace(name, r"(?i)(?<![A-Za-z0-9_])v?[0-9]+(?:\.[0-9]+)+(?![A-Za-z0-9_])", "")
    name = stripped(F.regexp_replace(name, f"[{SPACE}]+", " "))
    letters = F.split(name, "")
    capital = F.transform(letters, lambda c, i: F.when(c.rlike("[a-z]") & ((i == 0) | ~F.coalesce(F.get(letters, i - 1), F.lit("")).rlike("[A-Za-z0-9_]")), F.upper(c)).otherwise(c))
    return F.coalesce(F.nullif(F.array_join(capital, ""), F.lit("")), F.lit("Untitled"))


def category(book: Column, hints: Sequence[str] = ADVENTURE_WORDS) -> Column:
    return F.when(F.lower(book).rlike("|".join(hints)), "adventure").otherwise("sourcebook")


def markdown_heading(line: Column) -> tuple[Column, Column]:
    """Level and title of a line with a markdown heading; level 0 without one."""
    pattern = rf"^(#{{1,6}})[{SPACE}]+(.+?)[{SPACE}]*#*[{SPACE}]*$"
    line = stripped(line)
    return F.length(F.regexp_extract(line, pattern, 1)), F.regexp_extract(line, pattern, 2)
