"""Text normalisation and segmentation as column expressions."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Letters with marks and their bases, from the Unicode decompositions of Latin letters.
_PAIRS = [(chr(c), d[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])]
MARKED, BARE = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)


def once(c: Column) -> Column:
    """c as a column that a filter on it, or on one beside it, does not work out again: the optimizer writes a filter's columns
    out and moves it below them, but not below what it takes for varying."""
    return F.when(F.spark_partition_id() >= 0, c)


def normalize_basic(c: Column) -> Column:
    """Lower case, only letters and digits, without marks, one space between words."""
    words = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(words, MARKED, BARE), r"\p{Mn}", ""), " +", " "))


def normalize_dedup(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", " "))


def normalize_strong(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "_", " "), r"[\s\p{Z}]+", " "))


def words_of(c: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(F.trim(c), r"[\s\p{Z}]+"), lambda w: w != "")


def sentences_of(c: Column) -> Column:
    """Lines, cut after full stops, exclamation and question marks that white space follows; without empty ones."""
    marked = F.regexp_replace(F.coalesce(c, F.lit("")), r"([.!?])[ \t]+", "$1\n")
    return F.filter(F.transform(F.split(marked, r"[\r\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def matched(a: str, b: str) -> int:
    """Characters in the matching blocks of difflib's SequenceMatcher(None, a, b), for b of under 200 characters, where none is
    popular: the longest common part, the earliest in a and then in b, and the same on both sides of it. Parts are searched as
    strings, which takes a fraction of the time."""
    total, todo, find = 0, [(0, len(a), 0, len(b))], b.find
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        size, i, at = 0, alo, alo
        while i + size < ahi and size < bhi - blo:
            j = find(a[i : i + size + 1], blo, bhi)
            if j < 0:
                i += 1
                continue
            at, size = i, size + 1
            while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                size += 1
        if size:
            j = find(a[at : at + size], blo, bhi)
            total += size
            todo += [(alo, at, blo, j), (at + size, ahi, j + size, bhi)]
    return total


def matching_ratio(a: str, b: str) -> float:
    """difflib.SequenceMatcher(None, a, b).ratio()."""
    if len(b) >= 200:
        return difflib.SequenceMatcher(None, a, b).ratio()
    n = len(a) + len(b)
    return 2.0 * matched(a, b) / n if n else 1.0


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two trimmed lower-case texts, in that order; once for equal rows that follow each other."""
    out, before = [], None
    for pair in zip(a, b, strict=True):
        if pair != before:
            ratio, before = matching_ratio(*((x or "").lower().strip() for x in pair)), pair
        out.append(ratio)
    return pd.Series(out, dtype=float)
