"""Terms of a full-text index: words without case and diacritics, stemmed by Porter's rules."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*"
_MEASURE = re.compile(r"[aeiouy]+[^aeiouy]+")

# Porter's endings of steps 2, 3 and 4.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def _shape(word: str) -> str:
    """The word with ``y`` told apart: a vowel after a consonant, else a consonant."""
    return "".join("Y" if c == "y" and (n == 0 or word[n - 1] in "aeiou") else c for n, c in enumerate(word))


def _measure(stem: str) -> int:
    return len(_MEASURE.findall(_shape(stem)))


def _vowel(stem: str) -> bool:
    return bool(re.search("[aeiouy]", _shape(stem)))


def _short(stem: str) -> bool:
    return bool(re.search("[^aeiouyY][aeiouy][^aeiouywxY]$", _shape(stem)))


def _first(word: str, table) -> tuple[str, str] | None:
    """The stem before the longest ending of ``table``, and that ending."""
    for ending in sorted(table, key=len, reverse=True):
        if word.endswith(ending):
            return word[: -len(ending)], ending
    return None


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for ending in ("ed", "ing"):
        stem = w.removesuffix(ending)
        if stem != w and _vowel(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if re.search(r"([^aeiouylsz])\1$", stem):
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short(stem) else stem
    return w


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other scripts, and very short or long ones, stay as they are."""
    if not 3 <= len(word.encode()) < 64 or not re.fullmatch("[a-z]+", word):
        return word
    w = _past(_plural(word))
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (found := _first(w, table)) and _measure(found[0]) > 0:
            w = found[0] + table[found[1]]
    if (found := _first(w, _STEP4)) and _measure(found[0]) > 1 and (found[1] != "ion" or found[0].endswith(("s", "t"))):
        w = found[0]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@lru_cache(maxsize=1 << 18)
def term(token: str) -> str:
    """The index term of a token."""
    plain = "".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c))
    return stem(unicodedata.normalize("NFC", plain).lower())


def tokens(text: Column) -> Column:
    """Words of a text in order, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def stem_column(token: Column) -> Column:
    """The index terms of a column of distinct tokens."""

    @F.pandas_udf("string")
    def run(token: pd.Series) -> pd.Series:
        return token.map(term, na_action="ignore")

    return run(token)
