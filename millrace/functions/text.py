"""Text normalisation, word and n-gram columns. 

All stay inside the JVM but the character n-gram count, which is linear only in Python.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import ColumnOrName, col, let, ratio

# What counts as white space (Unicode separators plus the ASCII control spaces), ASCII
# punctuation, English articles, and the shape of an English-looking word.
SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = r"\b(a|an|the)\b"
ENGLISH_WORD = r"[A-Za-z]+(?:['-][A-Za-z]+)*"


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # any odd number with mixed bits


def strip(c: ColumnOrName) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: ColumnOrName) -> Column:
    """Trim, and make each run of white space one blank."""
    return F.trim(F.regexp_replace(col(c), f"{SPACE}+", " "))


def normalize_text(c: ColumnOrName) -> Column:
    return collapse(F.lower(col(c)))


def normalize_answer(c: ColumnOrName, punctuation_to: str = "") -> Column:
    """Lower case, no punctuation, no articles, single blanks."""
    bare = F.regexp_replace(F.lower(col(c)), PUNCTUATION, punctuation_to)
    # (?U) gives the word boundary its Unicode meaning.
    return collapse(F.regexp_replace(bare, f"(?U){ARTICLES}", " "))


def words(c: ColumnOrName) -> Column:
    """White-space tokens; an empty text has none."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def word_count(c: ColumnOrName) -> Column:
    return F.regexp_count(col(c), F.lit(ENGLISH_WORD))


def ngrams(items: Column, n: int, separator: str = " ") -> Column:
    """Adjacent n-grams of an array of strings, each joined to one string."""

    def grams(bound):
        count = F.size(bound) - n + 1
        # Element access is constant time inside a lambda; ``slice`` walks from the array start.
        return F.when(
            count > 0,
            F.transform(
                F.sequence(F.lit(0), count - 1),
                lambda i: F.concat_ws(separator, *[F.get(bound, i + k) for k in range(n)]),
            ),
        ).otherwise(F.array().cast("array<string>"))

    return let(items, grams)


def distinct_ratio(grams: Column) -> Column:
    return let(grams, lambda g: ratio(F.size(F.array_distinct(g)), F.size(g)))


def is_repetitive(c: ColumnOrName, n: int = 30, threshold: float = 0.5) -> Column:
    """True where few of the character n-grams are distinct; short and null texts are not repetitive."""
    return F.coalesce(character_ngram_ratio(n)(col(c)) < threshold, F.lit(False))


def character_ngram_ratio(n: int):
    """Column function: distinct / total character n-grams of a text, null under n characters."""

    @F.pandas_udf(T.DoubleType())
    def share(texts: pd.Series) -> pd.Series:
        def of(text):
            if text is None or len(text) < n:
                return None
            # A window's hash is a difference of prefix sums over powers of an odd number, shifted to the window's start.
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
            powers = np.full(len(points), MULTIPLIER, dtype=np.uint64)
            powers[0] = 1
            sums = np.append(np.uint64(0), np.cumsum(points * np.cumprod(powers)))
            back = np.full(len(points) - n + 1, pow(int(MULTIPLIER), -1, 1 << 64), dtype=np.uint64)
            back[0] = 1
            hashes = (sums[n:] - sums[:-n]) * np.cumprod(back)
            return len(np.unique(hashes)) / len(hashes)

        return pd.Series([of(t) for t in texts], dtype="float64")

    return share


def repetition_penalty(c: ColumnOrName, n: int = 3, max_penalty: float = -1.0) -> Column:
    """(1 - distinct/total word n-grams) * max_penalty; 0 for texts under n words."""
    share = distinct_ratio(ngrams(words(F.lower(col(c))), n))
    return F.coalesce((1.0 - share) * F.lit(float(max_penalty)), F.lit(0.0))


def distinct_captures(c: ColumnOrName, pattern: str, group: int = 1) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))))


def any_message_contains(messages: ColumnOrName, markers: Sequence[str]) -> Column:
    """True where the content of any message holds any marker, ignoring case."""

    def hit(message):
        content = F.lower(message["content"])
        found = F.lit(False)
        for marker in markers:
            found = found | content.contains(marker.lower())
        return found

    return F.coalesce(F.exists(col(messages), hit), F.lit(False))


def split_keeping_delimiters(c: ColumnOrName, delimiters: Sequence[str]) -> Column:
    """Array of (key, content): the text before the first delimiter has an empty key.

    A leading part without text is left out, as is an input that is empty.
    """
    alternatives = "|".join(re.escape(d) for d in delimiters)
    keys = F.regexp_extract_all(col(c), F.lit(f"({alternatives})"), F.lit(1))
    contents = F.split(col(c), alternatives, -1)
    parts = let(
        keys,
        lambda k: F.transform(
            contents,
            lambda c, i: F.struct(F.coalesce(F.get(k, i - 1), F.lit("")).alias("key"), c.alias("content")),
        ),
    )
    return F.filter(parts, lambda p: (p["key"] != "") | (p["content"] != ""))


def sublist_positions(items: ColumnOrName, pattern: ColumnOrName) -> Column:
    """0-based starts of every occurrence of the array ``pattern`` in ``items``."""

    def positions(bound):
        array, wanted = bound["items"], bound["pattern"]
        n = F.size(wanted)
        last = F.size(array) - n + 1

        def starts_here(i):
            rest = F.transform(wanted, lambda w, k: F.get(array, i + k) == w)
            return (F.get(array, i) == F.get(wanted, F.lit(0))) & F.forall(rest, lambda same: same)

        return F.when(
            (last > 0) & (n > 0),
            F.filter(F.sequence(F.lit(0), last - 1), starts_here),
        ).otherwise(F.array().cast("array<int>"))

    return let(F.struct(col(items).alias("items"), col(pattern).alias("pattern")), positions)
