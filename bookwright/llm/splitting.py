"""Oversized texts cut into overlapping pieces at natural boundaries.

A text longer than a range is work for many tasks: it is sliced into ranges with
halos, the ranges are spread, and each task detects the boundaries and headings
of its own. What is then joined are tables: lengths become offsets by prefix sums,
headings that are open at the start of a range come from the ranges before it,
and the boundary tables of neighbouring ranges are stitched into spans, which
decide where pieces begin and end. Pieces are last cut out of the ranges by
offset. Files are read range by range, too, so that no task holds a whole one.

Fixed cuts part a giant text into spans: the best boundary near every multiple of
``SPAN`` characters. They depend on the text alone, so the pieces are the same
whatever the width of a range.

A boundary is, in falling order: before a heading, between paragraphs, between
lines, after a sentence, between words, anywhere. The size of a text is the
larger of a quarter of its characters and 1.3 times its words, rounded down, and
0 for blank text. Null, empty and blank texts have size 0 and one piece.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookwright.plans.lineage import cut

#: Characters of a range, of the halo on either side, and between the fixed cuts of a giant text; ranges of a slice of a prefix sum.
RANGE, HALO, SPAN, SLICE = 1 << 12, 1 << 11, 1 << 16, 1 << 10
#: Ids up to which they are broadcast (8 MB) to part repeated rows from the others; more are joined by a shuffle.
FEW = 1 << 20
#: White space as Python's str.split sees it, for patterns of Java.
BLANK = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
HEADING, PARAGRAPH, LINE, SENTENCE, WORD = 5, 4, 3, 2, 1
_BREAKS = re.compile(r"(?P<h>[^\S\n]*\n\s*(?=#{1,6}\s))|(?P<p>[^\S\n]*\n[^\S\n]*\n\s*)|(?P<l>[^\S\n]*\n[^\S\n]*)|(?P<s>(?<=[.!?…])[\"'”’)\]]*[^\S\n]+(?=\S)|(?<=[。！？])[^\S\n]*)|(?P<w>\s+)")
_HEAD = re.compile(r"(?m)^(#{1,6})[^\S\n]+(\S.*?)[^\S\n]*#*[^\S\n]*$")
_RANK = {"h": HEADING, "p": PARAGRAPH, "l": LINE, "s": SENTENCE, "w": WORD}

_KEY = ["id", "h"]
_PATH = T.ArrayType(T.StringType())
_HEADS = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType())]))


def size_of(chars: int, words: int) -> int:
    """Estimated tokens of a text."""
    return max(1, chars // 4, words * 13 // 10) if words else 0


@dataclass
class Table:
    """Boundaries (places and ranks), starts of words, and headings (place, level, title), all in order."""

    places: list[int] = field(default_factory=list)
    ranks: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    heads: list[tuple[int, int, str]] = field(default_factory=list)


def detect(before: str, body: str, after: str, offset: int = 0) -> Table:
    """What stands in ``body``, which begins at ``offset`` of its text; the halos on either side are read and not reported."""
    whole, low, high = before + body + after, len(before), len(before) + len(body)
    shift, found = offset - low, Table()
    if not low and body[:1].strip():
        found.words.append(offset)
    for m in _BREAKS.finditer(whole):
        at = m.end()
        if at >= high:
            break
        if low <= at and 0 < at and (not found.places or found.places[-1] != at + shift):
            found.places.append(at + shift)
            found.ranks.append(_RANK[m.lastgroup or "w"])
            if whole[at - 1].isspace():
                found.words.append(at + shift)
    found.heads = [(m.start() + shift, len(m[1]), m[2]) for m in _HEAD.finditer(whole) if low <= m.start() < high]
    return found


def most_words(limit: int) -> int:
    """The most words whose size is within ``limit``."""
    return (10 * limit + 9) // 13


def anchor(table: Table, grid: int) -> int:
    """The fixed cut near ``grid``: its best boundary, the nearest of those, the first of two."""
    low, high = bisect_left(table.places, grid - HALO), bisect_right(table.places, grid + HALO)
    best = max(range(low, high), key=lambda n: (table.ranks[n], -abs(table.places[n] - grid), -table.places[n]), default=None)
    return grid if best is None else table.places[best]


def lead(table: Table, end: int, least: int, overlap: int) -> int:
    """Where a piece begins that shares the text before ``end``, up to ``overlap`` tokens of it and nothing before ``least``."""
    if overlap <= 0:
        return end
    first = bisect_left(table.words, end) - most_words(overlap)
    low = max(least, end - 4 * overlap - 3, table.words[first] if first > 0 else 0)
    n = bisect_left(table.places, low)
    if n < len(table.places) and table.places[n] < end:
        return table.places[n]
    # No boundary so near: inside a word, which counts as one more.
    return min(end, low)


def cut_span(table: Table, start: int, stop: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of the pieces of the span of a text from ``start`` to ``stop``.

    Each piece is the longest that fits, drawn back to the best boundary of its
    second half; the next starts at a boundary about ``overlap`` tokens before
    its end, and always after its start. The first shares text with the span before.
    """
    most, found = most_words(limit), []
    a = start if start == 0 else lead(table, start, max(1, start - 4 * overlap - 3), overlap)
    while True:
        n = bisect_left(table.words, a)
        inside = a > 0 and not (n < len(table.words) and table.words[n] == a)
        last = n + most - inside
        b = min(stop, a + 4 * limit + 3, table.words[last] if last < len(table.words) else stop)
        if b < stop:
            low, high = bisect_right(table.places, a + (b - a) // 2), bisect_right(table.places, b)
            best = max(range(low, high), key=lambda k: (table.ranks[k], table.places[k]), default=None)
            b = b if best is None else table.places[best]
        found.append((a, b))
        if b >= stop:
            return found
        a = max(a + 1, lead(table, b, a + 1, overlap))


def opened(stack: list[tuple[int, str]], level: int, title: str) -> list[tuple[int, str]]:
    """The open headings after one more: those of its level and below are closed."""
    return [*(h for h in stack if h[0] < level), (level, title)]


def path_of(given: list[str], stack: list[tuple[int, str]]) -> list[str]:
    """The path of a text and the headings open in it, which may begin by repeating the end of that path."""
    own = [t for _, t in stack]
    same = next((n for n in range(min(len(given), len(own)), 0, -1) if given[-n:] == own[:n]), 0)
    return [*given, *own[same:]]


def _pathed(table: Table, pieces: list[tuple[int, int]], given: list[str], stack: list[tuple[int, str]]) -> Iterator[tuple[int, int, list[str]]]:
    """Pieces with their paths: ``stack`` is open before the first heading of the table."""
    n = 0
    for a, b in pieces:
        while n < len(table.heads) and table.heads[n][0] <= a:
            stack = opened(stack, *table.heads[n][1:])
            n += 1
        yield a, b, path_of(given, stack)


# Ranges


def _given(df: DataFrame, id_column: str, text_column: str, path_column: str) -> DataFrame:
    """``id``, ``text``, ``path`` and ``h``, a digest of the text; nulls are empty, null ids are left out."""
    path = F.col(path_column).cast("array<string>") if path_column in df.columns else F.array().cast("array<string>")
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), F.coalesce(path, F.array()).alias("path")).where("id is not null")
    return rows.withColumn("h", F.xxhash64("text"))


def _once(rows: DataFrame) -> DataFrame:
    """Rows without repetitions of an id with the same text. Texts are shuffled only of ids that occur more than once."""
    twice = cut(rows.select("id").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    number = twice.count()
    if not number:
        return rows
    again = F.broadcast(twice) if number <= FEW else twice
    least = rows.join(again, "id", "left_semi").groupBy("id", "h").agg(F.min("text").alias("text"), F.min("path").alias("path"))
    return rows.join(again, "id", "left_anti").unionByName(least)


def _ranges(rows: DataFrame, width: int, halo: int) -> DataFrame:
    """``id``, ``h``, ``path``, ``part``, ``parts``, ``offset``, ``before``, ``body``, ``after`` of rows longer than a range.

    A text is sliced in one walk, and its ranges leave the task that holds it.
    """
    sliced = rows.select("id", "h", "path", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{width}}}"), F.lit(0)).alias("slices"))
    one = sliced.select("id", "h", "path", F.size("slices").alias("parts"), "slices", F.posexplode("slices").alias("part", "body"))
    around = one.select(
        "id", "h", "path", "part", "parts", (F.col("part").cast("bigint") * width).alias("offset"), F.substring(F.coalesce(F.get("slices", F.col("part") - 1), F.lit("")), -halo, halo).alias("before"), "body",
        F.substring(F.coalesce(F.get("slices", F.col("part") + 1), F.lit("")), 1, halo).alias("after"),
    )
    return around.repartition("id", "h", "part")


def file_ranges(spark: SparkSession, paths: list[str], width: int = 1 << 20, halo: int = 4 * HALO) -> DataFrame:
    """The ranges of text files, read by byte offset: as those of columns, with ``source_path``; ``id`` is a hash of it.

    A range holds the characters whose first byte lies in it, so neighbours part
    between characters; bytes that are no UTF-8 are replaced. Sizes are listed
    without reading; offsets in characters are prefix sums of what was read.
    """
    listed = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("source_path"), "length")
    parts = F.greatest(F.lit(1), F.ceil(F.col("length") / width)).cast("int")
    places = listed.select("source_path", F.col("length"), parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).repartition("source_path", "part")
    schema = T.StructType([T.StructField("source_path", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("parts", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("before", "body", "after"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for r in batch.to_pylist():
                at, low = r["part"] * width, max(0, r["part"] * width - halo)
                system, inside = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", r["source_path"]))
                with system.open_input_file(inside) as source:
                    data = source.read_at(min(r["length"], at + width + halo) - low, low)
                marks = [0, at - low, min(at + width, r["length"]) - low, len(data)]
                edges = [next((n for n in range(m, min(len(data), m + 4)) if data[n] & 0xC0 != 0x80), min(len(data), m)) for m in marks]
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([r["source_path"]]), pa.array([r["part"]], pa.int32()), pa.array([r["parts"]], pa.int32()), *(pa.array([t]) for t in texts)], names=[f.name for f in schema])

    read = places.mapInArrow(run, schema).select(F.xxhash64("source_path").alias("id"), F.lit(0).cast("bigint").alias("h"), F.array().cast("array<string>").alias("path"), "source_path", "part", "parts", "before", "body", "after")
    offsets = _before(cut(read.select(*_KEY, "part", F.length("body").cast("bigint").alias("offset"))), sums=("offset",))
    return read.join(offsets, [*_KEY, "part"])


def _before(rows: DataFrame, sums: tuple[str, ...] = (), maxima: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with each of ``sums`` and ``maxima`` taken over all parts of its text before the own one, in place of the own value.

    In two steps, so that no task sees all parts of a giant text: within slices
    of parts, and over slices.
    """
    sliced = rows.withColumn("slice", F.floor(F.col("part") / SLICE))
    kinds = [(F.sum, c) for c in sums] + [(F.max, c) for c in maxima]
    earlier = Window.partitionBy(*_KEY).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy(*_KEY, "slice").agg(*[f(c).alias(f"s_{c}") for f, c in kinds]).select(*_KEY, "slice", *[f(f"s_{c}").over(earlier).alias(f"s_{c}") for f, c in kinds])
    within = Window.partitionBy(*_KEY, "slice").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    both = sliced.select(*_KEY, "slice", "part", *[f(c).over(within).alias(c) for f, c in kinds]).join(slices, [*_KEY, "slice"])
    zero = F.lit(0).cast("bigint")
    added = [(F.coalesce(f"s_{c}", zero) + F.coalesce(c, zero)).alias(c) for c in sums]
    return both.select(*_KEY, "part", *added, *[F.greatest(f"s_{c}", c).alias(c) for c in maxima])


def sizes(df: DataFrame, id_column: str = "id", text_column: str = "text", width: int = RANGE) -> DataFrame:
    """``id`` and ``size``, the estimated tokens of each text, added up from its ranges.

    A word counts in the range where it starts, which its halo tells. Null ids
    take no part; of rows repeated under one id the largest size counts.
    """

    def starts(column: str) -> Column:
        return F.regexp_count(column, F.lit(rf"(?<![^{BLANK}])[^{BLANK}]")).cast("bigint")

    rows = _given(df, id_column, text_column, "")
    short = rows.where(F.length("text") <= width).select("id", F.length("text").cast("bigint").alias("chars"), starts("text").alias("words"))
    inside = F.when((F.length("before") > 0) & F.col("before").rlike(rf"[^{BLANK}]$") & F.col("body").rlike(rf"^[^{BLANK}]"), -1).otherwise(0)
    counted = _ranges(rows.where(F.length("text") > width), width, 1).select(*_KEY, "part", F.length("body").cast("bigint").alias("c"), (starts("body") + inside).alias("w"))
    long = counted.dropDuplicates([*_KEY, "part"]).groupBy(*_KEY).agg(F.sum("c").alias("chars"), F.sum("w").alias("words"))
    both = short.unionByName(long.select("id", "chars", "words"))
    size = F.when(F.col("words") == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("chars") / 4), F.floor(F.col("words") * 13 / 10)))
    return both.groupBy("id").agg(F.max(size).cast("bigint").alias("size"))


# Pieces

_PLACED = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("span", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("heading_path", _PATH), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])
_PIECES = T.StructType([T.StructField("id", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType()), T.StructField("token_count", T.IntegerType()), T.StructField("heading_path", _PATH)])


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)
    columns = zip(*rows, strict=True) if rows else [()] * len(shape)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, shape, strict=True)], schema=shape)


def cut_text(text: str, limit: int, overlap: int) -> tuple[Table, list[tuple[int, int]]]:
    """The table of a whole text, and its pieces; a blank one is one piece."""
    table = detect("", text, "")
    if not table.words:
        return table, [(0, len(text))]
    spans = max(1, len(text) // SPAN)
    cuts = [0, *(anchor(table, k * SPAN) for k in range(1, spans)), len(text)]
    return table, [p for k in range(spans) for p in cut_span(table, cuts[k], cuts[k + 1], limit, overlap)]


def _short_pieces(rows: DataFrame, limit: int, overlap: int) -> DataFrame:
    """The pieces of texts that are one range, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text = r["text"]
                table, found = cut_text(text, limit, overlap)
                for n, (a, b, path) in enumerate(_pathed(table, found, r["path"], [])):
                    out.append((r["id"], n, a, b, text[a:b], size_of(b - a, len(text[a:b].split())), path))
            yield _batch(out, _PIECES)

    return rows.select("id", "text", "path").mapInArrow(run, _PIECES)


def _tables(ranges: DataFrame) -> DataFrame:
    """The boundary table of every range: places, ranks and starts of words as packed numbers relative to ``offset``, and headings."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("path", _PATH), T.StructField("part", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("chars", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("ranks", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("heads", _HEADS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                t = detect(r["before"], r["body"], r["after"])
                packed = [np.array(t.places, np.int32).tobytes(), np.array(t.ranks, np.int8).tobytes(), np.array(t.words, np.int32).tobytes()]
                heads = [{"at": r["offset"] + at, "level": level, "title": title} for at, level, title in t.heads]
                out.append((r["id"], r["h"], r["path"], r["part"], r["offset"], len(r["body"]), *packed, heads))
            yield _batch(out, schema)

    return ranges.select("id", "h", "path", "part", "offset", "before", "body", "after").mapInArrow(run, schema)


def _open_headings(tables: DataFrame) -> DataFrame:
    """``id``, ``h``, ``part`` and ``carried``: the headings open where each range begins.

    The last heading of each level before a range is a maximum over the ranges
    before it; it is open if none of a level above came after it.
    """

    def last(n: int) -> Column:
        own = F.filter("heads", lambda x: x["level"] == n)
        return F.array_max(F.transform(own, lambda x: F.struct(x["at"].alias("at"), x["title"].alias("title")))).alias(f"l{n}")

    rows = _before(tables.select(*_KEY, "part", *map(last, range(1, 7))), maxima=tuple(f"l{n}" for n in range(1, 7)))

    def is_open(n: int) -> Column:
        above = [F.coalesce(F.col(f"l{m}.at"), F.lit(-1)) for m in range(1, n)]
        return F.col(f"l{n}").isNotNull() & (F.greatest(F.lit(-1), F.lit(-1), *above) < F.col(f"l{n}.at"))

    found = F.array(*[F.when(is_open(n), F.struct(F.lit(n).alias("level"), F.col(f"l{n}.title").alias("title"))) for n in range(1, 7)])
    return rows.select(*_KEY, "part", F.filter(found, lambda x: x.isNotNull()).alias("carried"))


def _placed(tables: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Where the pieces of texts of several ranges are: the boundary tables of a span, stitched, and cut.

    A group is the ranges of one span and of a margin around it, whatever the
    length of the text: less than three spans of boundaries.
    """
    margin = HALO + 4 * overlap + 4
    total = tables.groupBy(*_KEY).agg(F.sum("chars").alias("whole"))
    carried = _open_headings(tables)
    spans = F.greatest(F.lit(1), F.floor(F.col("whole") / SPAN))
    first = F.greatest(F.lit(0), F.floor((F.col("offset") - margin) / SPAN)).cast("int")
    upto = F.greatest(F.lit(0), F.least(spans - 1, F.floor((F.col("offset") + F.col("chars") + margin) / SPAN))).cast("int")
    rows = tables.join(carried, [*_KEY, "part"]).join(total, _KEY)
    spread = rows.withColumn("span", F.explode(F.sequence(F.least(first, upto), upto))).withColumn("spans", spans.cast("int"))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        span, spans, whole = rows[0]["span"], rows[0]["spans"], rows[0]["whole"]
        table, begins = Table(), [r["offset"] for r in rows]
        for r in rows:
            table.places += (np.frombuffer(r["places"], np.int32).astype(np.int64) + r["offset"]).tolist()
            table.ranks += np.frombuffer(r["ranks"], np.int8).tolist()
            table.words += (np.frombuffer(r["words"], np.int32).astype(np.int64) + r["offset"]).tolist()
            table.heads += [(x["at"], x["level"], x["title"]) for x in r["heads"]]
        start = anchor(table, span * SPAN) if span else 0
        stop = whole if span == spans - 1 else anchor(table, (span + 1) * SPAN)
        stack = [(x["level"], x["title"]) for x in rows[0]["carried"]]
        out = []
        for n, (a, b, path) in enumerate(_pathed(table, cut_span(table, start, stop, limit, overlap), rows[0]["path"], stack)):
            r = rows[bisect_right(begins, a) - 1]
            out.append((r["id"], r["h"], span, n, a, b, path, r["part"], a - r["offset"]))
        return pa.Table.from_batches([_batch(out, _PLACED)])

    return spread.groupBy(*_KEY, "span").applyInArrow(run, _PLACED)


def pieces_of_ranges(ranges: DataFrame, limit: int, overlap: int) -> DataFrame:
    """The pieces of texts given as ranges: ``id``, ``seq``, ``start``, ``end``, ``text``, ``token_count``, ``heading_path``."""
    placed = cut(_placed(cut(_tables(ranges)), limit, overlap))
    over = Window.partitionBy(*_KEY).orderBy("span")
    bases = placed.groupBy(*_KEY, "span").agg(F.count("*").alias("k")).withColumn("base", F.sum("k").over(over) - F.col("k")).drop("k")
    numbered = placed.join(bases, [*_KEY, "span"]).withColumn("seq", (F.col("base") + F.col("n")).cast("int"))
    text = F.substring(F.concat("body", "after"), (F.col("at") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    told = ranges.select(*_KEY, "part", "body", "after").join(numbered, [*_KEY, "part"]).select("id", "seq", "start", "end", text.alias("text"), "heading_path")
    words = F.regexp_count("text", F.lit(rf"(?<![^{BLANK}])[^{BLANK}]"))
    size = F.when(words == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length("text") / 4), F.floor(words * 13 / 10)))
    return told.select("id", "seq", "start", "end", "text", size.cast("int").alias("token_count"), "heading_path")


def _checked(limit: int, overlap: int) -> int:
    """The halo that a range needs: a piece that begins in it ends in it."""
    if limit < 16 or not 0 <= overlap <= limit // 2:
        raise ValueError("limit is at least 16 and overlap at most half of it")
    return max(HALO, 4 * limit + 4)


def pieces(df: DataFrame, limit: int = 512, overlap: int = 64, id_column: str = "id", text_column: str = "text", path_column: str = "heading_path", width: int = RANGE) -> DataFrame:
    """The pieces of every text: ``id``, ``seq``, ``start``, ``end``, ``text``, ``token_count``, ``heading_path``.

    ``start`` and ``end`` are offsets in characters of the whole text. Pieces
    are at most ``limit`` large and share up to ``overlap`` tokens with the one
    before. The heading path of the text goes on with the headings, all levels,
    that are open where a piece begins, in whatever range they stand. A text that
    needs no cut is its own piece. Null ids take no part; a row repeated under
    its id counts once, and of several texts under one id each has its pieces.
    """
    halo = _checked(limit, overlap)
    width = max(width, halo)
    rows = _once(_given(df, id_column, text_column, path_column))
    long = (F.length("text") > width) & F.col("text").rlike(f"[^{BLANK}]")
    return _short_pieces(rows.where(~long), limit, overlap).unionByName(pieces_of_ranges(_ranges(rows.where(long), width, halo), limit, overlap))


def oversized(df: DataFrame, limit: int = 512, overlap: int = 64, id_column: str = "id", text_column: str = "text", width: int = RANGE) -> DataFrame:
    """``id`` of every text larger than ``limit``: one that is cut into several pieces and isn't blank.

    A text has several pieces just if its size is over the limit. Texts with too
    few characters for that many words are not looked at. Null ids take no part;
    of rows repeated under one id the largest text counts.
    """
    halo = _checked(limit, overlap)
    width = max(width, halo)
    rows = _given(df, id_column, text_column, "").where((F.length("text") >= 2 * most_words(limit)) & F.col("text").rlike(f"[^{BLANK}]"))
    schema = T.StructType([T.StructField("id", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = (i for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if len(cut_text(text, limit, overlap)[1]) > 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(cuts), pa.int64())], names=["id"])

    short = rows.where(F.length("text") <= width).select("id", "text").mapInArrow(run, schema)
    tables = cut(_tables(_ranges(rows.where(F.length("text") > width), width, halo)).dropDuplicates([*_KEY, "part"]))
    several = _placed(tables, limit, overlap).groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1").select("id")
    return short.unionByName(several).distinct()


def file_pieces(spark: SparkSession, paths: list[str], limit: int = 512, overlap: int = 64, width: int = 1 << 20) -> DataFrame:
    """The pieces of text files, which are read by byte ranges: ``source_path`` and what ``pieces`` has; an empty file has no piece."""
    ranges = file_ranges(spark, paths, width, 4 * _checked(limit, overlap))
    named = ranges.select("id", "source_path").distinct()
    return pieces_of_ranges(ranges, limit, overlap).join(named, "id").drop("id")
