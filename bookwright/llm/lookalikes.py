"""One form for texts that look the same and differ in their characters.

A table of characters is worked out once, checked, and compiled to one pattern
whose longest match wins; a text is rewritten in a single pass over its grapheme
clusters. The form is meant for comparing: it writes look-alike letters of other
scripts as the Latin letter they look like, also in words of that script.

What becomes equal: wide forms, composed and decomposed accents, characters that
show nothing, blanks of other kinds (one for one), joined letters, hyphens and
signs of the same look, look-alike letters. What stays different: letter case,
accents, line breaks, the number of blanks. A joiner between two pictographs or
after a virama shows in what it joins, and is kept. Null stays null; empty and
blank texts keep their blanks, in one form.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookwright.plans.lineage import cut

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = "асеорхуіјѕһԁԛԝѵАВЕКМНОРСТУХІЈЅԌԚԜѴ", "aceopxyijshdqwvABEKMHOPCTYXIJSGQWV"
GREEK = "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳͿϹ", "ovABEZHIKMNOPTYXcjJC"
# Signs of the same look.
SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", "⁃": "-", "µ": "μ", "’": "'", "‘": "'", "ʼ": "'", "′": "'", "∕": "/", "⁄": "/", "∶": ":", "․": ".", "‚": ",", "ı": "i", "ɡ": "g", "ɑ": "a"}
#: Joiners and marks that show nothing by themselves.
JOINERS = "\u200c\u200d"
BREAKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\u2028\u2029"


def _single(char: str, letters: dict[str, str]) -> str:
    """What one character becomes, by rule: wide and joined forms, blanks, nothing, letters."""
    if char in BREAKS:
        return char
    kind = unicodedata.category(char)
    if kind == "Zs":
        return " "
    if kind == "Cf" or char in "\u034f\u115f\u1160\u3164\uffa0" or "\ufe00" <= char <= "\ufe0f":
        return ""
    if unicodedata.decomposition(char).startswith(("<wide>", "<narrow>")) or "ﬀ" <= char <= "ﬆ":
        char = unicodedata.normalize("NFKC", char)
    parts = (letters.get(c, c) for c in unicodedata.normalize("NFD", char))
    return unicodedata.normalize("NFC", "".join(parts))


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Every character that changes and what it becomes.

    Raises ValueError if a result would change again, so that one pass is enough
    and the order of rewriting can't matter.
    """
    letters = dict(zip(*CYRILLIC, strict=True)) | dict(zip(*GREEK, strict=True)) | SIGNS
    planes = (*range(0x20, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0080))
    table = {c: m for c in map(chr, planes) if (m := _single(c, letters)) != c}
    if conflicts := [c for c, m in table.items() if any(x in table for x in m)]:
        raise ValueError(f"mapped twice: {conflicts[:10]}")
    return table


@lru_cache(maxsize=1)
def _marks() -> str:
    """Characters that join the one before, as they are or by what they become."""
    table = mapping()
    own = (c for c in map(chr, range(0x300, 0x10000)) if unicodedata.combining(table.get(c, c)[:1] or " "))
    return _ranges(own)


def _ranges(chars) -> str:
    """The characters as the inside of a class of a pattern."""
    spans: list[list[int]] = []
    for n in sorted(map(ord, chars)):
        if spans and n == spans[-1][1] + 1:
            spans[-1][1] = n
        else:
            spans.append([n, n])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


@lru_cache(maxsize=1)
def _transducer():
    table = mapping()
    changing, silent = _ranges(table), _ranges(c for c, m in table.items() if not m and c not in JOINERS and not 0xFE00 <= ord(c) <= 0xFE0F)
    viramas = "\u094d\u09cd\u0a4d\u0acd\u0b4d\u0c4d\u0ccd\u0d4d"
    pictures = "©®‼-㊙\U0001f000-\U0001faff"
    # Longest first: joined pictographs, then a letter with its marks, then one character.
    pattern = re.compile(
        rf"[{pictures}][\ufe0f\U0001f3fb-\U0001f3ff]*(?:\u200d[{pictures}][\ufe0f\U0001f3fb-\U0001f3ff]*)+"
        rf"|[{viramas}][{JOINERS}]"
        rf"|[^\s](?:[{silent}{JOINERS}]*[{_marks()}])+(?:(?<=[{viramas}])[{JOINERS}])?"
        rf"|[\u1100-\u115f\ua960-\ua97c][\u1160-\u11a7][\u11a8-\u11ff]?"
        rf"|[{changing}]"
    )
    kept = set(viramas)

    @lru_cache(maxsize=1 << 16)
    def cluster(found: str) -> str:
        if len(found) == 1:
            return table.get(found, found)
        if found[-1] in JOINERS and found[-2] in kept and len(found) > 2:
            return cluster(found[:-1]) + found[-1]
        if found[0] in kept or ("\u200d" in found and not any(unicodedata.combining(c) for c in found)):
            return found.replace("\ufe0f", "")
        decomposed = unicodedata.normalize("NFD", "".join(table.get(c, c) for c in found))
        return unicodedata.normalize("NFC", "".join(table.get(c, c) for c in decomposed))

    def rewrite(text: str) -> str:
        return text if text.isascii() else pattern.sub(lambda m: cluster(m[0]), text)

    return rewrite


def canonical_text(text: str | None) -> str | None:
    """The one form of a text; null stays null."""
    return None if text is None else _transducer()(text)


def canonical(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``text``, the one form of ``text_column``, for every row, repeated ones too."""
    given = df.select(F.col(id_column), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = _transducer()
        for batch in batches:
            texts = pa.array([None if t is None else rewrite(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_column, "text"])

    return given.mapInArrow(run, given.schema)


def _digests(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id``, ``look`` (digest of the one form) and ``exact`` (digest of the text) of texts that aren't blank."""
    given = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("look", T.BinaryType()), T.StructField("exact", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite, digest = _transducer(), lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                look = rewrite(text)
                if look.strip():
                    exact = digest(text)
                    rows.append((i, exact if look is text else digest(look), exact))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["id", "look", "exact"])

    return given.mapInArrow(run, schema)


def _kept(digests: DataFrame) -> DataFrame:
    """Digests of looks that have two different texts at least, each id and text once."""
    several = digests.groupBy("look").agg(F.min("exact").alias("low"), F.max("exact").alias("high")).where("low <> high").select("look")
    return digests.join(several, "look", "left_semi").dropDuplicates(["id", "exact"])


def same_look(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pairs ``doc_a`` < ``doc_b`` of texts that look the same and are not the same characters.

    Digests of 128 bits stand for the texts. Copies are counted before anything
    is joined: only looks with two different texts go on, so a look that a third
    of all rows share, all with one text, costs a partial count and no join. Of a
    look the different texts are paired, and each pair is then given the documents
    of either side, so copies of one text never meet each other. A row repeated
    under its id counts once; rows without id, null and blank texts make no pair.
    """
    kept = cut(_kept(_digests(df, id_column, text_column)))
    texts = kept.select("look", "exact").distinct()
    pairs = texts.select("look", F.col("exact").alias("left")).join(texts.select("look", F.col("exact").alias("right")), "look").where(F.col("left") < F.col("right")).select("left", "right")
    x, y = kept.select(F.col("exact").alias("left"), F.col("id").alias("x")), kept.select(F.col("exact").alias("right"), F.col("id").alias("y"))
    both = pairs.join(x, "left").join(y, "right").where("x <> y")
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def looks(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document with a text that isn't blank: ``doc_id``, ``group_id`` (least id of its look), ``texts`` (how many different ones look so).

    The pairs of ``same_look`` by representatives: as many rows as documents,
    however many share a look. Of several texts under one id the one of the least digest counts.
    """
    own = cut(_digests(df, id_column, text_column).groupBy("id").agg(F.min(F.struct("look", "exact")).alias("d")).select("id", "d.look", "d.exact"))
    # Counted by text first, so that a look of a third of all rows is a few rows.
    texts = own.groupBy("look", "exact").agg(F.min("id").alias("low"))
    groups = texts.groupBy("look").agg(F.min("low").alias("group_id"), F.count("*").alias("texts"))
    return own.join(groups, "look").select(F.col("id").alias("doc_id"), "group_id", "texts")
