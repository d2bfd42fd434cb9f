"""Text of HTML and of other markup, by expressions: every step rewrites the column.

Elements that show nothing go first, then tags become line breaks, heading marks
or nothing, and the character references of what is left are resolved.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bookwright.functions.text import SPACE

# Elements that show nothing, and elements that stand on lines of their own.
HIDDEN = ("script", "style", "head", "title", "noscript")
BLOCKS = ("p", "div", "br", "li", "tr", "section", "article", "blockquote", "pre", "table")

#: What may stand between the name of a tag and its end.
_REST = r"(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
_LINE_SPACE = SPACE.replace(r"\x{9}-\x{d}", r"\x{9}\x{b}-\x{d}")


def unescaped(text: Column) -> Column:
    """Text with its character references resolved; Python sees only texts that have any."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(html.unescape, na_action="ignore")

    return F.when(F.contains(text, F.lit("&")), run(F.when(F.contains(text, F.lit("&")), text))).otherwise(text)


def utf8(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 is replaced."""
    return F.make_valid_utf8(content.cast("string"))


def html_text(source: Column) -> Column:
    """Text of a column of pages, headings as markdown and blocks on lines of their own; null stays null.

    A hidden element without an end hides the rest; an unfinished tag is left out.
    """
    shown = F.regexp_replace(source, r"(?s)<!--.*?(?:-->|\z)|<!\[CDATA\[|\]\]>", "")
    shown = F.regexp_replace(shown, rf"(?is)<({'|'.join(HIDDEN)}){_REST[:-1]}(?<!/)>.*?(?:</\1\s*>|\z)", "")
    for level in range(1, 7):
        shown = F.regexp_replace(shown, rf"(?i)<h{level}{_REST}", "\n\n" + "#" * level + " ")
    shown = F.regexp_replace(shown, rf"(?i)</?(?:{'|'.join(BLOCKS)}){_REST}|</h[1-6]{_REST}", "\n")
    shown = F.regexp_replace(shown, rf"(?i)</?[a-z][^\s/>]*{_REST}|<[!?/][^>]*>|<[a-z/!?][^>]*\z", "")
    lines = F.regexp_replace(unescaped(shown), r"[ \t\x{a0}]+", " ")
    lines = F.regexp_replace(lines, rf"(?dm)^[{_LINE_SPACE}]+|[{_LINE_SPACE}]+$", "")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, null without it."""
    quoted = F.regexp_extract(tag, rf"\s(?:\w+:)?{name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    return F.when(quoted != "", F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def elements(xml: Column, name: str) -> Column:
    """The tags, as they are written, that open elements of a name, in order."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:\w+:)?{name}{_REST}"), F.lit(0))


def strings(xml: Column) -> Column:
    """The stretches of text between tags, without blank ones, in order; references are not resolved."""
    bare = F.regexp_replace(xml, r"(?s)<!--.*?-->|<!\[CDATA\[|\]\]>", "")
    return F.filter(F.transform(F.split(bare, r"(?s)<[^>]*>"), lambda t: F.regexp_replace(t, rf"^[{SPACE}]+|[{SPACE}]+\z", "")), lambda t: t != "")


def has_doctype(xml: Column) -> Column:
    """Whether XML declares a document type or entities, which can grow without bound."""
    return F.contains(xml, F.lit("<!DOCTYPE")) | F.contains(xml, F.lit("<!ENTITY"))
