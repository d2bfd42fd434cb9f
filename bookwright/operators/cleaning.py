"""Removing what page-oriented sources add to a text, line by line.

Every rule is an expression over one line; only dropping a line that equals the
last kept one needs a neighbour, which is a window over the lines of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookwright.functions.markup import unescaped
from bookwright.functions.text import stripped, words

#: Zero-width and soft characters that are removed from pages.
SILENT = "\u200b\u200c\u200d\u200e\u200f\ufeff\u00ad"


def _bare(word: Column, signs: str) -> Column:
    return F.regexp_replace(word, f"^[{signs}]+|[{signs}]+$", "")


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def _share_short(parts: Column, signs: str) -> Column:
    return F.size(F.filter(parts, lambda w: F.length(_bare(w, signs)) <= 2)) / F.size(parts)


def is_junk(line: Column) -> Column:
    """Whether a stripped, non-empty line is a number, a fragment, a watermark or gibberish."""
    parts, n = words(line), F.length(line)
    return (
        line.rlike(r"^\p{Nd}{1,4}$")
        | ((n > 2) & line.rlike(r"^[\p{Nd}\s\x{1c}-\x{1f}\x{85}\p{Z}]+$"))
        | ((n <= 4) & (_letters(line) <= 2))
        | (F.contains(line, F.lit("@")) & (F.size(parts) > 2))
        | ((F.size(parts) >= 3) & (_share_short(parts, ".,;:!?") > 0.5))
        | ((n > 8) & (_letters(line) / n < 0.5))
    )


def without_tail(line: Column) -> Column:
    """A line without the short pieces that follow its last real word, if most of them are junk."""
    parts = words(line)
    flags = F.transform(parts, lambda w: (F.length(_bare(w, r".,;:!?@()\[\]")) >= 3) & (_letters(_bare(w, r".,;:!?@()\[\]")) >= 3))
    real = F.size(parts) - F.array_position(F.reverse(flags), True)  # place of the last real word, from 0; its size if none
    tail = F.slice(parts, (real + 2).cast("int"), F.greatest(F.lit(0), (F.size(parts) - real - 1).cast("int")))
    kept = F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), (real + 1).cast("int")), " "), "[ ,;:]+$", "")
    cuts = (F.size(parts) >= 5) & (real >= 2) & (real < F.size(parts) - 2)
    return F.when(cuts & (F.when(cuts, _share_short(tail, ".,;:!?@")) > 0.5) & (kept != ""), kept).otherwise(line)


def clean_lines(lines: DataFrame, keys: list[str], position: str = "pos", text: str = "line") -> DataFrame:
    """Kept lines of each page: ``keys``, ``position``, ``line``, and ``gap``, whether a blank line precedes it.

    Null lines count as blank. A line is dropped if it is junk or equals the
    kept line before it; blank lines between don't matter for that.
    """
    page = Window.partitionBy(*keys).orderBy(position)
    given = lines.select(*keys, position, stripped(F.coalesce(F.col(text), F.lit(""))).alias("raw"))
    marked = given.withColumn("blank", F.col("raw") == "").withColumn("blanks", F.sum(F.col("blank").cast("int")).over(page))
    kept = marked.where(~F.col("blank")).where(~is_junk(F.col("raw"))).withColumn("line", without_tail(F.col("raw")))
    fresh = kept.withColumn("last", F.lag("line").over(page)).where(F.col("last").isNull() | (F.col("raw") != F.col("last")))
    return fresh.withColumn("before", F.lag("blanks").over(page)).select(*keys, position, "line", (F.col("before").isNotNull() & (F.col("blanks") > F.col("before"))).alias("gap"))


def clean_pages(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``text`` of every page, cleaned; a page of which nothing is left is empty."""
    plain = F.regexp_replace(unescaped(F.coalesce(F.col(text), F.lit(""))), f"[{SILENT}]", "")
    lines = pages.select(*keys, F.posexplode(F.split(plain, "\n")).alias("pos", "line"))
    kept = clean_lines(lines, keys)
    joined = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "gap", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.when(x["gap"], "\n").otherwise(""), x["line"])), "\n")
    return pages.select(*keys).join(joined, keys, "left").select(*keys, F.coalesce(body, F.lit("")).alias("text"))
