"""Quality rules with adaptive thresholds.

Each rule is a number of a document: mean word length, symbols a word, share of repeated lines, of repeated
words. For each language and source the rule's distribution is held in a mergeable quantile sketch: counts
of logarithmic buckets (relative error at most `accuracy`), which are merged by adding. A group's fence lies
`reach` times the distance of its quartiles beyond them, both on a logarithmic scale and among values that
are not zero, so that it follows the group where most documents have none of what a rule counts. Fences of
groups are drawn towards those of their language, and these towards those of all, by `prior` documents'
weight: a group of few documents mostly takes its parent's, one of many its own. Documents are joined with
the fences of their language and source and filtered. There are no fixed cutoffs beside the contract's base.

The sketch is one row for each language, source, rule and bucket, made by an aggregation with map-side
combination, so a hot source is no single task; all documents count.

Defined results: null and empty texts have no words and fail; null language or source are groups of their
own; equal values share a bucket, so ties get one verdict; repeated rows count each; an empty table gives
an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import few, ship, small_batches, staged, text_or_empty

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
LEAST_WORDS = 50
#: rule -> sides of the fence that fail
RULES = {"word_length": "both", "symbol_ratio": "high", "dup_line_ratio": "high", "repeat_ratio": "high"}
ZERO = -(1 << 40)


def measure(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode().split()  # bytes split at ASCII white space alone
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeated = 0
    if len(words) > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
        n = len(number)
        if n < 2_000_000:
            windows = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
        else:  # three ids don't fit 63 bits: number the pairs first
            windows = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1] * n + ids[2:]
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(windows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(words), bool)
        cover[:-2] |= twice
        cover[1:-1] |= twice
        cover[2:] |= twice
        repeated = int(cover.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five counts."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "source", text_or_empty().alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_lines bigint, n_repeat_words bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, chars, symbols, dups, repeats = zip(*map(measure, batch["text"]), strict=True) if len(batch) else ((),) * 5
            lines = [1 + t.count("\n") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "source": batch["source"], "n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_lines": lines, "n_repeat_words": repeats})

    return rows.mapInPandas(run, schema)


def with_rules(rows: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1))
    return rows.withColumns({
        "word_length": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
    })


def sketch(rows: DataFrame, accuracy: float = 0.01) -> DataFrame:
    """lang, source, rule, bucket, n: the mergeable sketch. Bucket i holds values in (g**(i-1), g**i], g =
    (1 + accuracy) / (1 - accuracy); zeros have a bucket below all."""
    base = math.log((1 + accuracy) / (1 - accuracy))
    long = rows.select("lang", "source", F.explode(F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*RULES))).alias("rule", "value"))
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / base)).otherwise(ZERO).cast("long")
    return long.groupBy("lang", "source", "rule", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fences(sketches: DataFrame, keys: list[str], reach: float, least_spread: float, accuracy: float = 0.01) -> DataFrame:
    """keys, rule, n (values that are not zero), and the logarithms low and high of merged sketches' fences."""
    base = math.log((1 + accuracy) / (1 - accuracy))
    merged = sketches.filter(F.col("bucket") != ZERO).groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    order = W.partitionBy(*keys, "rule").orderBy("bucket")  # one row a bucket: a few thousand at most
    merged = merged.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(W.partitionBy(*keys, "rule"))})
    value = F.col("bucket") * base + math.log(2 / (1 + math.exp(base)))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
    found = merged.groupBy(*keys, "rule").agg(F.max("total").alias("n"), at(0.25).alias("q25"), at(0.75).alias("q75"))
    spread = F.greatest(F.col("q75") - F.col("q25"), F.lit(least_spread))
    return found.select(*keys, "rule", "n", (F.col("q25") - reach * spread).alias("low"), (F.col("q75") + reach * spread).alias("high"))


def thresholds(sketches: DataFrame, reach: float = 3.0, prior: float = 50.0, least_spread: float = 0.1) -> DataFrame:
    """One row for each language and source with fences for each rule; null where no document has a value."""
    named = lambda df, p: df.withColumnsRenamed({c: f"{p}_{c}" for c in df.columns})
    own = fences(sketches, ["lang", "source"], reach, least_spread)
    lang = named(fences(sketches, ["lang"], reach, least_spread), "l")
    every = named(fences(sketches, [], reach, least_spread), "a")
    rows = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rule") == F.col("l_rule"))).join(every, F.col("rule") == F.col("a_rule"))
    drawn = lambda n, x, parent: (n * x + prior * parent) / (n + prior)
    fence = lambda c: F.exp(drawn(F.col("n"), F.col(c), drawn(F.col("l_n"), F.col(f"l_{c}"), F.col(f"a_{c}"))))
    rows = rows.select("lang", "source", "rule", fence("low").alias("low"), fence("high").alias("high"))
    out = [F.max(F.when(F.col("rule") == rule, F.col(side))).alias(f"{rule}_{side}") for rule, sides in RULES.items() for side in (("low", "high") if sides == "both" else ("high",))]
    return rows.groupBy("lang", "source").agg(*out)


def quality_verdicts(docs: DataFrame, reach: float = 3.0, prior: float = 50.0) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and the rules that failed, for every row."""
    rows = with_rules(staged(measured(docs), "measured"))
    limits = staged(thresholds(sketch(rows), reach, prior).withColumnsRenamed({"lang": "t_lang", "source": "t_source"}), "fences")
    rows = rows.join(few(limits, 256), F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = [F.when((F.col(r) > F.col(f"{r}_high")) | ((F.col(r) < F.col(f"{r}_low")) if s == "both" else F.lit(False)), F.lit(r)) for r, s in RULES.items()]
    rows = rows.withColumns({"base_failed": base_failed, "failed_rules": F.array_compact(F.array(*failed))})
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"))


ship(__name__)
