"""Scripts and transliteration."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def script_of(text: str) -> str:
    """First word of the Unicode names of most letters; the first seen wins ties; UNKNOWN without letters."""
    counts: dict[str, int] = {}
    for c in text:
        if c.isalpha() and (name := unicodedata.name(c, "").split()):
            counts[name[0]] = counts.get(name[0], 0) + 1
    return max(counts, key=counts.get) if counts else "UNKNOWN"


@F.pandas_udf(T.StringType())
def script_column(text: pd.Series) -> pd.Series:
    return text.map(lambda v: script_of(v or ""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def families_column(text: pd.Series) -> pd.Series:
    """The distinct families of a text's letters."""
    return text.map(lambda v: sorted({unicodedata.name(c, "UNKNOWN").split()[0] for c in v or "" if c.isalpha()}))


def latin_table(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """character -> Latin spelling for all characters beyond ASCII in `columns`; bounded by Unicode's size."""
    chars = None
    for c in columns:
        some = df.select(F.explode(F.array_distinct(F.split(F.regexp_replace(F.col(c), r"[\x00-\x7F]", ""), ""))).alias("c"))
        chars = some if chars is None else chars.unionByName(some)
    found = sorted(r["c"] for r in chars.filter("c <> ''").distinct().collect())
    spell = df.sparkSession._jvm.com.ibm.icu.text.Transliterator.getInstance("Any-Latin; Latin-ASCII")
    return {c: spell.transliterate(c) for c in found}


def transliterated(col: Column, table: dict[str, str]) -> Column:
    """`col` with every character of `table` spelled in Latin."""
    if not table:
        return col
    singles = {k: v for k, v in table.items() if len(k) == 1 and len(v) == 1 and ord(k) < 0x10000}
    out = F.translate(col, "".join(singles), "".join(singles.values())) if singles else col
    rest = {k: v for k, v in table.items() if k not in singles}
    if rest:
        spelled = F.create_map(*[F.lit(x) for kv in rest.items() for x in kv])
        out = F.array_join(F.transform(F.split(out, ""), lambda c: F.coalesce(F.element_at(spelled, c), c)), "")
    return out


#: Executors get these functions by value; they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
