"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased, runs of anything but letters become one space, and n-grams of 1 to 3 characters
are hashed to `features` columns. Document frequencies are counted over all rows that may be learnt from;
the classifier is fitted on a bounded, documented sample of them (about `per_class` rows of each language,
those of the lowest hashes of the identifier, twice that in all at most) with follow-the-regularised-leader: per-coordinate rates, an L1 part that keeps
weights at zero, and an L2 part. A temperature, fitted on a part of the sample that training did not see,
calibrates the probabilities.

Defined results: a text that is null or has no letter is `und` with score 0; texts are taken whole, of any
length; ties between languages go to the first by code point; a null language is not learnt from; if there
is nothing to learn from, all texts are `und`; repeated rows give repeated results; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, id_crc, ship, small_batches, staged, text_or_empty

FEATURES = 1 << 13
PER_CLASS = 1200
UNKNOWN = "und"


def gram_counts(text: str, features: int = FEATURES) -> np.ndarray | None:
    """Counts of hashed character 1-, 2- and 3-grams of a whole text; None if it has no letter."""
    letter = regex.compile(r"\p{L}")
    if not letter.search(text):
        return None
    marks = regex.compile(r"[^\p{L}\p{M}]+")
    code = np.frombuffer((" " + marks.sub(" ", text.lower()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.zeros(features, np.int64)
    key = np.zeros(len(code), np.uint64)
    for n in range(1, 4):
        key = key[: len(code) - n + 1] * np.uint64(0x110000) + code[n - 1 :]
        mixed = key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        counts += np.bincount((mixed >> np.uint64(40)).astype(np.int64) & (features - 1), minlength=features)
    return counts


def weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and L2-normalised TF-IDF weights of a text's n-grams; tf is 1 + ln(count)."""
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(1e-12, float(np.sqrt(x @ x)))


class FollowTheLeader:
    """FTRL-proximal for the softmax, with elastic-net penalties l1 and l2."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = np.outer(x, p)
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int, epochs: int = 3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights (the last row: bias) and temperature; every fifth row is kept for the temperature."""
    rng, model = np.random.default_rng(seed), FollowTheLeader(features, classes)
    biased = lambda at, x: (np.append(at.astype(np.int64), features), np.append(x.astype(np.float64), 0.3))
    train = [r for i, r in enumerate(rows) if i % 5] or rows
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            at, x, y = train[i]
            model.step(*biased(at, x), y)
    weights = model.weights(slice(None))
    check = rows[::5]
    logits, labels = np.array([x @ weights[at] for at, x in (biased(*r[:2]) for r in check)]), np.array([y for *_, y in check])
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))  # one number: the best of a fine grid
    target = np.full((len(labels), classes), 1 / (len(labels) + classes))  # smoothed: a separable sample gives no certainty
    target[np.arange(len(labels)), labels] = 1 - (classes - 1) / (len(labels) + classes)
    loss = [-(target * np.log(np.maximum(1e-12, softmax(logits / t)))).sum(axis=1).mean() for t in grid]
    return weights, float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, learn: Column, features: int = FEATURES, per_class: int = PER_CLASS) -> dict:
    """The model: languages, idf, weights, temperature. `learn` says which rows may be learnt from."""
    spark = docs.sparkSession
    small_batches(spark)
    usable = docs.filter(learn & F.col("lang").isNotNull())
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("sample"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not sizes:
        return {"languages": []}
    # a language's rows of the lowest hashes: about per_class of them, without ranking the rows
    limits = {lang: -(1 << 63) + int((1 << 64) * min(1.0, per_class / n)) - 1 for lang, n in sizes.items()}
    languages = sorted(limits)
    rows = usable.select(text_or_empty().alias("text"), "lang", key.alias("key"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, frequency = 0, np.zeros(features, np.int64)
        for batch in batches:
            for text, lang, at_key in zip(batch["text"], batch["lang"], batch["key"], strict=True):
                counts = gram_counts(text, features)
                if counts is None:
                    continue
                total += 1
                frequency += counts > 0
                if at_key <= limits[lang]:
                    at = np.flatnonzero(counts)
                    yield pd.DataFrame({"lang": [lang], "key": [at_key], "columns": [at.astype("<i4").tobytes()], "counts": [counts[at].astype("<i4").tobytes()], "total": [0]})
        yield pd.DataFrame({"lang": [None], "key": [0], "columns": [None], "counts": [frequency.astype("<i8").tobytes()], "total": [total]})

    found = staged(rows.mapInPandas(count, "lang string, key bigint, columns binary, counts binary, total bigint"), "grams")
    # a partition's frequencies are one row of a fixed size; they are added pairwise on the executors
    width = found.filter("columns is null").select("total", "counts")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, frequency = 0, np.zeros(features, np.int64)
        for batch in batches:
            total += int(batch["total"].sum())
            for blob in batch["counts"]:
                frequency += np.frombuffer(blob, "<i8")
        yield pd.DataFrame({"total": [total], "counts": [frequency.tobytes()]})

    while (parts := width.rdd.getNumPartitions()) > 8:
        width = staged(width.coalesce(max(8, parts // 8)).mapInPandas(add, "total bigint, counts binary"), "frequencies")
        if width.rdd.getNumPartitions() >= parts:
            break
    sums = width.coalesce(1).mapInPandas(add, "total bigint, counts binary").first()
    idf = np.log((1 + sums["total"]) / (1 + np.frombuffer(sums["counts"], "<i8"))) + 1
    number = {lang: i for i, lang in enumerate(languages)}
    got = found.filter("columns is not null").orderBy("key", "lang", F.xxhash64("columns", "counts")).limit(per_class * len(languages) * 2).toPandas()
    # the sample as three arrays, with a view for each row: rows of their own would stay with the driver's allocator
    sizes, labels = (got["columns"].str.len() // 4).to_numpy(np.int64), [number[lang] for lang in got["lang"]]
    at, counts = np.frombuffer(b"".join(got["columns"]), "<i4"), np.frombuffer(b"".join(got["counts"]), "<i4")
    del got
    x = ((1 + np.log(counts)) * idf[at]).astype(np.float32)
    ends = np.cumsum(sizes)
    if len(x):
        x /= np.repeat(np.sqrt(np.maximum(1e-24, np.add.reduceat(x * x, ends - sizes))), sizes)
    data = [(at[a:b], x[a:b], y) for a, b, y in zip((ends - sizes).tolist(), ends.tolist(), labels, strict=True)]
    if not data:
        return {"languages": []}
    weights, temperature = fit(data, features, len(languages))
    return {"languages": languages, "idf": idf, "weights": weights, "temperature": temperature, "features": features}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Adds nothing but doc_id, lang_pred, score; lang, source and doc_id are not read for it."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_or_empty().alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            labels, scores = judge(batch["text"], model)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": labels, "score": scores})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def judge(texts, model: dict) -> tuple[list[str], list[float]]:
    labels, scores = [], []
    for text in texts:
        counts = gram_counts(text, model["features"]) if model["languages"] else None
        if counts is None:
            labels.append(UNKNOWN)
            scores.append(0.0)
            continue
        at, x = weigh(counts, model["idf"])
        p = softmax((x @ model["weights"][at] + 0.3 * model["weights"][-1]) / model["temperature"])
        best = int(np.argmax(p))
        labels.append(model["languages"][best])
        scores.append(float(p[best]))
    return labels, scores


def held_out() -> Column:
    return id_crc() % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, learnt from rows that are not held out."""
    model = train(docs, ~held_out())
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns kept, whose language is identified with a score of `least` or more."""
    model = train(docs, ~held_out())
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def accepted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            labels, scores = judge(texts, model)
            yield pd.Series([label != UNKNOWN and score >= least for label, score in zip(labels, scores, strict=True)])
        give_back()

    return docs.filter(accepted(text_or_empty()))


ship(__name__)
