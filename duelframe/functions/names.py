"""Person and event names: cleaning, comparison keys, similarity."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StringType

# Name suffixes ignored in comparison, and surname particles.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")
PARTICLES = ("da", "de", "del", "do", "dos", "la", "le", "van", "von")


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, F.length(word))))


def clean_person(c: Column) -> Column:
    """Collapse spaces, capitalise every word, keep the inner capital of Mc-, Mac- and O'."""
    def word(w: Column) -> Column:
        out = _capital(w)
        for prefix in ("O'", "Mac", "Mc"):
            n = len(prefix)
            kept = F.concat(F.lit(prefix), _capital(F.substring(w, n + 1, F.length(w))))
            out = F.when(w.startswith(prefix) & (F.length(w) > n), kept).otherwise(out)
        return out
    return F.array_join(F.transform(F.split(F.trim(c), r"\s+"), word), " ")


def _without(c: Column, marks: str, space: str, new: str) -> Column:
    """``space`` becomes ``new`` and ``marks`` go. As replacements, which cost a fraction of a translation of every letter."""
    out = F.replace(c, F.lit(space), F.lit(new))
    for mark in marks:
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


def basic_key(c: Column) -> Column:
    plain = _without(F.lower(c), "'.", "-", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


@F.pandas_udf(StringType())
def _fold_accents(s: pd.Series) -> pd.Series:
    def fold(text):
        if text is None or text.isascii():
            return text
        return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
    return s.map(fold, na_action="ignore")


def unicode_key(c: Column) -> Column:
    """Accent-free comparison key. Call it on distinct names: the fold runs in a Python worker."""
    text = F.translate(F.lower(_fold_accents(c)), "-.'`‘’", "  ")
    text = F.regexp_replace(text, r"\b(" + "|".join(SUFFIXES) + r")\b", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def last_token(c: Column) -> Column:
    return F.element_at(F.split(F.trim(c), r"\s+"), -1)


def surname(c: Column) -> Column:
    """All words after the first, or from the first inner particle on; a single word is its own surname."""
    words = F.split(F.trim(c), r"\s+")
    n = F.size(words)
    marks = F.filter(
        F.transform(words, lambda w, i: F.when((i > 0) & (i < n - 1) & F.lower(w).isin(*PARTICLES), i + 1)),
        lambda i: i.isNotNull())
    start = F.when(n <= 1, F.lit(1)).otherwise(F.coalesce(F.array_min(marks), F.lit(2)))
    return F.array_join(F.slice(words, start, n), " ")


def initials(c: Column) -> Column:
    words = F.split(F.trim(c), r"\s+")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    return (F.when(F.size(words) >= 2, F.upper(F.concat(F.substring(first, 1, 1), F.substring(last, 1, 1))))
            .when(F.length(first) >= 2, F.upper(F.substring(first, 1, 2)))
            .otherwise(F.lit("??")))


def slug(c: Column) -> Column:
    return _without(F.lower(c), ":.", " ", "-")


def strict_slug(c: Column) -> Column:
    """Marks dropped, runs of spaces and hyphens become one hyphen, none at the ends."""
    text = F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w\s-]", "")
    return F.trim(F.regexp_replace(text, r"[\s-]+", "-"), F.lit("-"))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.sort_array(F.array(a, b)))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.coalesce(F.lit(1.0) - F.try_divide(F.levenshtein(a, b).cast("double"), longest.cast("double")), F.lit(1.0))


@F.pandas_udf(DoubleType())
def _gestalt(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def gestalt_similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio, scored on candidate pairs only."""
    return _gestalt(a, b)
