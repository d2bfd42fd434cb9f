"""Lines of documents as headings and paragraphs, set-oriented.

Every document is rows of lines; fences, headings and paragraphs are window
functions over them, and the path of a heading is worked out from levels, so a
document of any length is never held whole in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookwright.functions.text import SPACE, markdown_heading, stripped

#: Letters with case, for the inside of a class.
CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def numbered_heading(line: Column) -> tuple[Column, Column]:
    """Whether an unmarked line reads as a numbered or named heading, and its level."""
    line = stripped(line)
    number = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)", 1)
    named = line.rlike(r"(?i)^(chapter|part|section|appendix)\s")
    numbered = line.rlike(r"^\d+(\.\d+)*\s+\S")
    level = F.when(number == "", 1).otherwise(F.least(F.lit(4), F.size(F.split(number, r"\."))))
    return (F.length(line) < 120) & ~F.endswith(line, F.lit(".")) & (named | numbered), level


def is_title(line: Column) -> Column:
    """Whether capitals stand only at the beginning of words, small letters only after another letter, and there is one."""
    return line.rlike(f"[{CASED}]") & ~line.rlike(rf"(?:^|[^{CASED}])\p{{Ll}}|[{CASED}][\p{{Lu}}\p{{Lt}}]")


def is_upper(line: Column) -> Column:
    """Whether there are capitals and no small letters."""
    return line.rlike(r"\p{Lu}") & ~line.rlike(r"[\p{Ll}\p{Lt}]")


def guessed_level(line: Column) -> Column:
    """Level of a stripped line that reads as a heading without markup, 0 if it doesn't."""
    is_numbered, level = numbered_heading(line)
    shown = (F.length(line) < 120) & ~F.endswith(line, F.lit(".")) & (is_title(line) | is_upper(line))
    return F.when(is_numbered | shown, level).otherwise(0)


def lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``pos``, ``line`` of every line, with whether it is ``fenced``; null texts have none."""
    rows = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    mark = stripped(F.col("line")).rlike("^(```|~~~)").cast("int")
    seen = F.sum(mark).over(Window.partitionBy(key).orderBy("pos"))
    return rows.withColumn("mark", mark).withColumn("seen", seen).select(key, "pos", "line", ((F.col("mark") == 1) | (F.col("seen") % 2 == 1)).alias("fenced"))


def headings(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``pos``, ``level``, ``title`` of markdown headings outside fences."""
    level, title = markdown_heading(F.col("line"))
    return rows.where(~F.col("fenced")).select(key, "pos", level.alias("level"), title.alias("title")).where("level > 0")


def heading_paths(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Headings with their ``path``: for each level above, the last heading that no later one of its level or above closed.

    The last heading of each of the six levels is a running maximum; it is open
    as long as none of a lower level came after it.
    """
    upto = Window.partitionBy(key).orderBy("pos")
    last = [F.max(F.when(F.col("level") == n, F.struct("pos", "title"))).over(upto).alias(f"l{n}") for n in range(1, 7)]
    rows = found.select(key, "pos", "level", "title", *last)

    def is_open(n: int) -> Column:
        above = [F.coalesce(F.col(f"l{m}.pos"), F.lit(-1)) for m in range(1, n)]
        return F.col(f"l{n}").isNotNull() & (F.lit(n) <= F.col("level")) & (F.greatest(F.lit(-1), F.lit(-1), *above) < F.col(f"l{n}.pos"))

    path = F.array_compact(F.array(*[F.when(is_open(n), F.col(f"l{n}.title")) for n in range(1, 7)]))
    return rows.select(key, "pos", "level", "title", path.alias("path"))


def paragraphs(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``pos`` (of its first line) and ``text`` of paragraphs: lines between blank lines and headings; fences stay whole."""
    page = Window.partitionBy(key).orderBy("pos")
    level, _ = markdown_heading(F.col("line"))
    ends = ~F.col("fenced") & ((stripped(F.col("line")) == "") | (level > 0))
    marked = rows.withColumn("ends", ends).withColumn("n", F.sum(F.col("ends").cast("int")).over(page)).where(~F.col("ends"))
    body = F.array_sort(F.collect_list(F.struct("pos", F.regexp_replace("line", f"[{SPACE}]+$", "").alias("line"))))
    return marked.groupBy(key, "n").agg(F.min("pos").alias("pos"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("text")).drop("n")


def blocks(documents: DataFrame, key: str = "doc_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """Headings and paragraphs of documents with ``pages`` and ``paged``: ``key``, ``carried``, ``place``, ``level``, ``text``, ``page``, ``path``.

    ``place`` orders the blocks of a document; ``level`` is 0 for a paragraph;
    ``page`` counts from 1 and is null for formats without pages; ``path`` is the
    headings open there, a heading's own among them. Marked headings count if a
    document has any, guessed ones otherwise. Lines of paged sources are joined,
    at a hyphen without a space before a small letter; others keep their line
    breaks. Blank lines and headings within fences are text. No paragraph crosses a page.
    Null pages are empty; documents without pages have no block; keys are unique.
    """
    pages = documents.select(key, *carried, "paged", F.posexplode("pages").alias("p", "text"))
    rows = pages.select(key, *carried, "paged", "p", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).repartition(key)
    # Windows of a page come with those of its document, which is already in one place.
    page, whole, upto = Window.partitionBy(key, "p").orderBy("pos"), Window.partitionBy(key), Window.partitionBy(key).orderBy("place")
    bare = rows.withColumn("bare", stripped(F.col("line"))).withColumn("place", F.shiftleft(F.col("p").cast("bigint"), 32) + F.col("pos"))
    mark = F.col("bare").rlike("^(```|~~~)").cast("int")
    fenced = bare.withColumn("mark", mark).withColumn("fenced", (F.col("mark") == 1) | (F.sum("mark").over(page) % 2 == 1))
    level, title = markdown_heading(F.col("bare"))
    told = fenced.withColumn("level", F.when(F.col("fenced"), 0).otherwise(level)).withColumn("title", title).withColumn("marked", F.max(F.col("level") > 0).over(whole))
    guess = F.when(F.col("fenced") | (F.col("bare") == ""), 0).otherwise(guessed_level(F.col("bare")))
    told = told.withColumn("title", F.when(F.col("marked"), F.col("title")).otherwise(F.col("bare"))).withColumn("level", F.when(F.col("marked"), F.col("level")).otherwise(guess))
    last = [F.max(F.when(F.col("level") == n, F.struct("place", "title"))).over(upto).alias(f"l{n}") for n in range(1, 7)]
    ends = ~F.col("fenced") & ((F.col("bare") == "") | (F.col("level") > 0))
    rows = told.withColumn("ends", ends).select("*", *last, F.sum(F.col("ends").cast("int")).over(upto).alias("n"))

    def is_open(n: int) -> Column:
        above = [F.coalesce(F.col(f"l{m}.place"), F.lit(-1)) for m in range(1, n)]
        return F.col(f"l{n}").isNotNull() & (F.greatest(F.lit(-1), F.lit(-1), *above) < F.col(f"l{n}.place"))

    path = F.array_compact(F.array(*[F.when(is_open(n), F.col(f"l{n}.title")) for n in range(1, 7)])).alias("path")
    rows = rows.where((F.col("level") > 0) | ~F.col("ends"))
    number = F.when(F.col("paged"), F.col("p") + 1).alias("page")
    shown = F.when(F.col("level") > 0, F.col("title")).when(F.col("paged") & ~F.col("fenced"), F.col("bare")).otherwise(F.regexp_replace("line", f"[{SPACE}]+$", ""))
    # A heading is a block of its own: its count of ends is its own, and shared by the paragraph after it.
    kept = rows.select(key, *carried, "paged", "p", "n", "place", "level", path, number, shown.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    made = kept.groupBy(key, "p", "n", "level").agg(*[F.first(c).alias(c) for c in (*carried, "paged", "page", "path")], F.min("place").alias("place"), body.alias("text"))
    wrapped = F.translate(F.regexp_replace("text", r"-\n(?=\p{Ll})", ""), "\n", " ")
    return made.select(key, *carried, "place", "level", F.when(F.col("paged") & (F.col("level") == 0), wrapped).otherwise(F.col("text")).alias("text"), "page", "path")


def markdown(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and ``markdown``: the blocks of each document as a markdown document."""
    shown = F.concat(F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "))).otherwise(""), F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", shown.alias("shown")))), lambda x: x["shown"])
    return found.groupBy(key).agg(F.concat(F.array_join(parts, "\n\n"), F.lit("\n")).alias("markdown"))
