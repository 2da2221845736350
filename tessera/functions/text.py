"""Text functions as column expressions: folding, views, analyzers, token sets."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD, NUMBER, ASCII_WORD = r"[\p{L}\p{N}_]+", r"\p{Nd}+", "[a-z0-9]+"


@lru_cache
def combining_class() -> str:
    """A regex class of all code points whose canonical combining class is not 0."""
    ranges, start = [], None
    for cp in range(sys.maxunicode + 2):
        mark = cp <= sys.maxunicode and unicodedata.combining(chr(cp)) != 0
        if mark and start is None:
            start = cp
        elif not mark and start is not None:
            ranges.append(rf"\x{{{start:x}}}-\x{{{cp - 1:x}}}")
            start = None
    return "[" + "".join(ranges) + "]"


def fold(col: Column | str) -> Column:
    """NFKD, without combining marks, case-folded; null stays null, white space stays. In the JVM, by the
    Unicode library that Spark carries."""
    text = F.col(col) if isinstance(col, str) else col
    split = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True))
    bare = F.regexp_replace(split, combining_class(), "")
    return F.when(text.isNotNull(), F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), bare, F.lit(True)))


@F.pandas_udf(T.StringType())
def fold_python(text: pd.Series) -> pd.Series:
    """The same as fold(), for sessions without that library."""
    import unicodedata as u

    return text.map(lambda v: None if v is None else "".join(c for c in u.normalize("NFKD", v) if not u.combining(c)).casefold())


def windows(text: Column, n: int = 3) -> Column:
    """All substrings of n characters; none if the text is shorter."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def word_windows(text: Column) -> Column:
    """Trigrams inside words, each word with a space on both sides."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(3)))))


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s\s+", " ")


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def token_set(text: Column, pattern: str = WORD) -> Column:
    return F.array_distinct(tokens(text, pattern))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 where whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Jaccard, and the shares of each set that the other covers, of two arrays of distinct values."""
    hit = F.size(F.array_intersect(a, b))
    return share(hit, F.size(F.array_union(a, b))), share(hit, F.size(a)), share(hit, F.size(b))


#: Executors get these functions by value; they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
