"""Scan noise in text read from pages: found by kind, and repaired into paragraphs.

Lines of a page that are no text (running headers, page numbers) are told from
the titles and page range of their chunk. Everything else is decided by counts
of words over the whole collection, in SQL: a hyphen at a line end belongs to its
word if the hyphenated word is seen more often within lines than the joined one;
a word is misread if a frequent word differs from it by a known confusion, is far
more frequent, and the word itself is hardly seen outside scanned text.

Words and confusions meet by anagram hash: the hash of a word is the sum of the
fifth powers of its characters, so replacing "rn" by "m" changes it by the same
amount in every word, and a join on the changed hash finds all words that can be
meant. Each match is then checked letter by letter and the most frequent stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookwright.plans.lineage import cut

# What a scanner reads, and what was printed.
CONFUSIONS = (
    "0 o", "1 l", "1 i", "5 s", "9 g", "8 b", "6 b", "2 z", "3 e", "4 a", "7 t",
    "l i", "i l", "c e", "e c", "o a", "a o", "b h", "h b", "f t", "t f", "n u", "u n", "y v", "v y", "q g", "g q",
    "rn m", "m rn", "cl d", "d cl", "ii u", "u ii", "vv w", "w vv", "ri n", "n ri", "li h", "h li", "in m", "m in", "ni m", "lc k", "k lc", "fi h", "tl d",
)
#: How much more often the meant word occurs, by whether the misread one has a digit among its letters.
RATIO, RATIO_DIGIT = 10, 1
#: Part of a misread word's occurrences that may stand outside scanned text.
CLEAN = 0.1
_MODULUS = 1 << 60

_WORD = re.compile(r"[^\W_]+")
_LAST = re.compile(r"([^\W_]+)[-‐‑¬\u00ad]\s*$")
_FIRST = re.compile(r"\s*([^\W_]+)")
_ENDS = re.compile(r"[.!?…:。！？][\"'”’)\]]*\s*$")
_ROMAN = re.compile(r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_MISREAD = str.maketrans("lIi|!OoQSsBZzgqb", "1111100055822996")
_PAGE = re.compile(r"(?:(\w{1,6})[.:]?\s+)?[\[({<\-–—~·•|*.]*\s*([\w|!]{1,5})(?:\s*(?:/|\||[a-z0-9]{1,3})\s*([\w|!]{1,5}))?\s*[\])}>\-–—~·•|*.]*", re.IGNORECASE)
_MANY = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("li", "h"))
_ONE = str.maketrans("0a1ifc8bn95", "oolltehhugs")


def _fold(text: str, many: bool) -> str:
    """Letters and digits of a line, those that a scanner confuses written alike."""
    plain = "".join(c for c in text.casefold() if c.isalnum())
    for wrong, right in _MANY if many else ():
        plain = plain.replace(wrong, right)
    return plain.translate(_ONE)


def _numbers(token: str) -> set[int]:
    """The numbers a token may give: digits, misread digits, a Roman numeral."""
    found = set()
    if token.isdecimal() and token.isascii():
        return {int(token)}
    if any(c.isdigit() for c in token) or not token.strip("lI|!Oo"):
        digits = token.translate(_MISREAD)
        if digits.isdecimal() and digits.isascii():
            found.add(int(digits))
    low = token.lower()
    if _ROMAN.fullmatch(low):
        values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in low]
        found.add(sum(-v if v < max(values[n:]) else v for n, v in enumerate(values)))
    return found


def _in_range(token: str, first: int | None, last: int | None) -> bool:
    numbers = _numbers(token)
    if first is None and last is None:
        return bool(numbers)
    low, high = (first or last or 0), (last or first or 0)
    return any(low <= n <= high for n in numbers)


def is_page_number(line: str, first: int | None, last: int | None) -> bool:
    """Whether a line gives nothing but a page number of the range, in any form, possibly misread."""
    match = _PAGE.fullmatch(line.strip())
    if not match or not _in_range(match[2], first, last):
        return False
    return not match[1] or _fold(match[1], False) in _PAGE_WORDS


_PAGE_WORDS = {_fold(w, False) for w in ("page", "p", "pg", "pag", "pp", "no", "seite", "s")}


def is_header(line: str, titles: list[str], first: int | None, last: int | None) -> bool:
    """Whether a line repeats a title, alone or with a page number before or after it."""
    tokens = line.split()
    # A misread form has at most two letters for one, and a number stands beside the title: what is longer is no title.
    if not tokens or sum(map(str.isalnum, line)) > 2 * max((sum(map(str.isalnum, t)) for t in titles), default=0) + 24:
        return False
    variants, number = [tokens], re.compile(r"[^\w|!]+")
    bare = [t for t in tokens if number.sub("", t)]
    if len(bare) > 1:
        if _in_range(number.sub("", bare[-1]), first, last):
            variants.append(bare[:-1])
            variants.append(bare[:-2] if _fold(bare[-2], False) in _PAGE_WORDS else bare[:-1])
        if _in_range(number.sub("", bare[0]), first, last):
            variants.append(bare[1:])
        if len(bare) > 2 and _fold(bare[0], False) in _PAGE_WORDS and _in_range(number.sub("", bare[1]), first, last):
            variants.append(bare[2:])
    folded = {_fold("".join(v), many) for v in variants for many in (False, True)} - {""}
    return any(_fold(t, many) in folded for t in titles for many in (False, True))


def titles_of(section: str | None, path: list[str] | None, name: str | None) -> list[str]:
    """Titles of a chunk's section and document."""
    stem = re.sub(r"\.\w{1,5}$", "", name or "")
    stem = re.sub(r"\s*\(\d+\)$|^copy of ", "", stem)
    return [t for t in dict.fromkeys([*(path or []), section or "", stem.replace("-", " ")]) if t and t.strip()]


def running_lines(text: str, titles: list[str], first: int | None, last: int | None) -> tuple[list[tuple[str, bool]], bool, bool]:
    """Lines of the running text, each with whether a paragraph begins there; whether a header and a page number were left out."""
    kept: list[tuple[str, bool]] = []
    header = number = blank = left_out = False
    for line in text.replace("\r\n", "\n").replace("\r", "\n").replace("\f", "\n").split("\n"):
        if not line.strip():
            blank = True
        elif is_page_number(line, first, last):
            number = left_out = True
        elif is_header(line, titles, first, last):
            header = left_out = True
        else:
            # What a page break parts goes on as one paragraph unless a sentence ended there.
            begins = not kept or (blank and not (left_out and not _ENDS.search(kept[-1][0])))
            if kept and blank and _LAST.search(kept[-1][0]):
                begins = False
            kept.append((line.strip(), begins))
            blank = left_out = False
    return kept, header, number


def evidence(lines: list[tuple[str, bool]]) -> tuple[list[str], list[tuple[str, str]]]:
    """Distinct words of running lines, and the two parts of each word split at a line end by a hyphen; lower case."""
    words: dict[str, None] = {}
    splits: dict[tuple[str, str], None] = {}
    cut_first = False
    for n, (line, _) in enumerate(lines):
        found = [w.lower() for w in _WORD.findall(line)]
        end = _LAST.search(line)
        after = _FIRST.match(lines[n + 1][0]) if n + 1 < len(lines) else None
        if cut_first:
            found = found[1:]
        cut_first = bool(end and after)
        if end and after:
            splits[end[1].lower(), after[1].lower()] = None
            found = found[:-1]
        words |= dict.fromkeys(found)
    return list(words), list(splits)


def scanned(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with text of documents with ``ocr_used`` = 1, with ``source_name``."""
    docs = documents.where("ocr_used = 1 and doc_id is not null").select(F.col("doc_id").alias("document_id"), "source_name").dropDuplicates(["document_id"])
    given = chunks.select(F.col("id").cast("bigint").alias("id"), "document_id", F.col("text").cast("string").alias("text"), "section_title", "heading_path", "page_start", "page_end")
    return given.where("id is not null and text is not null").join(docs, "document_id").drop("document_id")


def _evidence(ocr: DataFrame) -> DataFrame:
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("header", T.BooleanType()), T.StructField("page_number", T.BooleanType()), T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("splits", T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))),
    ])
    split = pa.struct([("left", pa.string()), ("right", pa.string())])
    kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(split)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lines, header, number = running_lines(r["text"], titles_of(r["section_title"], r["heading_path"], r["source_name"]), r["page_start"], r["page_end"])
                words, splits = evidence(lines)
                rows.append((r["id"], header, number, words, [{"left": a, "right": b} for a, b in splits]))
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[f.name for f in schema])

    return ocr.mapInArrow(run, schema)


def vocabulary(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of words (``word``, ``n``) and of words joined by a hyphen within a line (``left``, ``right``, ``n``)."""
    token = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
    tokens = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(token), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    parts = cut(tokens.select(F.split("token", "-").alias("parts"), "n"))
    words = parts.select(F.explode("parts").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    several = parts.where(F.size("parts") > 1)
    neighbours = F.arrays_zip(F.slice("parts", F.lit(1), F.size("parts") - 1).alias("left"), F.slice("parts", F.lit(2), F.size("parts") - 1).alias("right"))
    pairs = several.select(F.explode(neighbours).alias("p"), "n").groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("n").alias("n"))
    return words, pairs


def anagram(word: Column) -> Column:
    """Sum of the fifth powers of a word's characters, so that equal letters in any order are equal."""
    def power(c: Column) -> Column:
        x = (F.ascii(c) % 1009).cast("bigint")
        return x * x * x * x * x

    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda s, c: (s + power(c)) % F.lit(_MODULUS))


def corrections(words: DataFrame, counts: DataFrame) -> DataFrame:
    """``word`` and ``meant``: the most frequent word that ``word`` can be a misreading of.

    ``words`` has ``word`` and ``scanned``, its count in scanned text; ``counts``
    has ``word`` and ``n``, counts over everything.
    """
    pairs = [c.split() for c in CONFUSIONS]
    value = lambda s: sum((ord(c) % 1009) ** 5 for c in s)
    table = F.array(*[F.struct(F.lit(w).alias("wrong"), F.lit(r).alias("right"), F.lit(value(r) - value(w)).cast("bigint").alias("change")) for w, r in pairs])
    known = words.join(counts, "word", "left").na.fill(0, ["n"]).withColumn("n", F.greatest(F.lit(1), "n", "scanned"))
    rare = known.where(((F.length("word") > 2) | F.col("word").rlike(r"^(\p{N}\p{L}|\p{L}\p{N})$")) & F.col("word").rlike(r"\p{L}") & (F.col("n") - F.col("scanned") <= CLEAN * F.col("n")))
    spread = rare.withColumn("c", F.explode(table)).where(F.contains("word", F.col("c.wrong"))).select("word", "n", "c.wrong", "c.right", F.pmod(anagram(F.col("word")) + F.col("c.change"), F.lit(_MODULUS)).alias("hash"))
    meant = counts.where(F.length("word") > 1).select(F.col("word").alias("meant"), F.col("n").alias("times"), anagram(F.col("word")).alias("hash"))
    places = F.sequence(F.lit(1), F.length("word") - F.length("wrong") + 1)
    fits = F.exists(places, lambda i: (F.substring("word", i, F.length("wrong")) == F.col("wrong")) & (F.concat(F.substring("word", F.lit(1), i - 1), F.col("right"), F.substring("word", i + F.length("wrong"), F.length("word"))) == F.col("meant")))
    ratio = F.when(F.col("word").rlike(r"\p{N}") & (F.length("word") > 2), RATIO_DIGIT).otherwise(RATIO)
    plain = ~F.col("meant").rlike(r"\p{N}")
    matched = spread.join(meant, "hash").where(plain & (F.col("times") >= ratio * F.col("n")) & (F.col("times") > 1) & fits)
    best = Window.partitionBy("word").orderBy(F.desc("times"), "meant")
    return matched.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("word", "meant")


def _decisions(chunks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Scanned chunks, their evidence, what each split word is (``left``, ``right``, ``word``, ``joined``), and corrections."""
    every = cut(scanned(chunks, documents))
    ocr = every.dropDuplicates(["id"])
    seen = cut(_evidence(ocr))
    words, pairs = vocabulary(chunks.select("id", F.col("text").cast("string").alias("text")).where("id is not null and text is not null"))
    words = cut(words)
    single = seen.select(F.explode("words").alias("word"))
    split = seen.select(F.explode("splits").alias("s")).groupBy("s.left", "s.right").agg(F.count("*").alias("times")).withColumn("word", F.concat("left", "right"))
    found = words.select("word", F.col("n").alias("joined_n"))
    left = words.select(F.col("word").alias("left"), F.col("n").alias("left_n"))
    right = words.select(F.col("word").alias("right"), F.col("n").alias("right_n"))
    weighed = split.join(found, "word", "left").join(pairs.withColumnRenamed("n", "pair_n"), ["left", "right"], "left").join(left, "left", "left").join(right, "right", "left").na.fill(0, ["joined_n", "pair_n", "left_n", "right_n"])
    # Counted as the vocabulary is: a word misread twice in a chunk, or in a repeated row, counts twice in both.
    in_scans = vocabulary(every)[0].withColumnRenamed("n", "scanned")
    scanned_counts = single.unionByName(split.select("word")).distinct().join(in_scans, "word", "left").na.fill(0, ["scanned"])
    fixed = cut(corrections(scanned_counts, words))
    # A pair is one word if joined it is seen more, or seen neither way: then unless its parts are common words, or figures.
    unseen = (F.col("pair_n") == 0) & (F.col("joined_n") == 0) & F.col("meant").isNull()
    parts = (F.col("left_n") > 10 * F.col("times")) & (F.col("right_n") > 10 * F.col("times"))
    figures = F.col("left").rlike(r"^\p{N}+$") | F.col("right").rlike(r"^\p{N}+$")
    joined = F.when(figures, False).when(unseen, ~parts).otherwise((F.col("joined_n") > F.col("pair_n")) | (F.col("meant").isNotNull() & (F.col("pair_n") == 0)))
    decided = weighed.join(fixed, "word", "left").select("left", "right", "word", joined.alias("joined"))
    return ocr, seen, cut(decided), fixed


def _used(seen: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split words of each chunk with their decision, and the words that its running text then has."""
    splits = cut(seen.select("id", F.explode("splits").alias("s")).select("id", "s.left", "s.right").join(decided, ["left", "right"]))
    parts = splits.select("id", F.explode(F.when(F.col("joined"), F.array("word")).otherwise(F.array("left", "right"))).alias("word"))
    return splits, seen.select("id", F.explode("words").alias("word")).unionByName(parts).distinct()


def noise(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``id`` and ``kind`` (hyphen, chars, header, page_number) of scan noise, each once.

    Only chunks of documents with ``ocr_used`` = 1. Null ids and texts take no
    part; empty texts have no noise; null titles and page numbers are unknown: a
    number line then counts whatever its number.
    """
    _, seen, decided, fixed = _decisions(chunks, documents)
    splits, words = _used(seen, decided)
    lines = seen.select("id", F.explode(F.array(F.when(F.col("header"), "header"), F.when(F.col("page_number"), "page_number"))).alias("kind")).where("kind is not null")
    hyphens = splits.where("joined").select("id", F.lit("hyphen").alias("kind"))
    chars = words.join(fixed, "word").select("id", F.lit("chars").alias("kind"))
    return lines.unionByName(hyphens).unionByName(chars).distinct()


def _paragraphs(lines: list[tuple[str, bool]], joined: set[tuple[str, str]], meant: dict[str, str]) -> str:
    """Lines as paragraphs: words put together, misread ones replaced in their case."""
    def fix(match: re.Match) -> str:
        word = match[0]
        better = meant.get(word.lower())
        if better is None:
            return word
        letters = [c for c in word if c.isalpha()]
        return better.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else better.capitalize() if word[0].isupper() or (word[0] == "8" and match.start() == 0) else better

    paragraphs: list[str] = []
    for line, begins in lines:
        if begins or not paragraphs:
            paragraphs.append(line)
            continue
        end, after = _LAST.search(paragraphs[-1]), _FIRST.match(line)
        if end and after:
            together = (end[1].lower(), after[1].lower()) in joined
            paragraphs[-1] = (paragraphs[-1][: end.end(1)] if together else paragraphs[-1].rstrip()) + line.lstrip()
        else:
            paragraphs[-1] += " " + line
    return "\n\n".join(_WORD.sub(fix, p) for p in paragraphs)


def repaired(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``id`` and ``text`` of every scanned chunk as continuous paragraphs.

    Rows are those of ``scanned``; a chunk without noise only has its wrapped
    lines put together. An empty text stays empty.
    """
    ocr, seen, decided, fixed = _decisions(chunks, documents)
    splits, words = _used(seen, decided)
    joins = splits.where("joined").groupBy("id").agg(F.collect_set(F.concat_ws("-", "left", "right")).alias("joins"))
    fixes = words.join(fixed, "word").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "meant"))).alias("fixes"))
    rows = ocr.join(joins, "id", "left").join(fixes, "id", "left")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lines, _, _ = running_lines(r["text"], titles_of(r["section_title"], r["heading_path"], r["source_name"]), r["page_start"], r["page_end"])
                out.append(_paragraphs(lines, {tuple(j.split("-", 1)) for j in r["joins"] or []}, dict(r["fixes"] or [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])

    return rows.select("id", "text", "section_title", "heading_path", "page_start", "page_end", "source_name", "joins", "fixes").mapInArrow(run, schema)
