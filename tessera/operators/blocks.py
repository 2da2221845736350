"""The best pairs of each lane by sparse products of blocks: what products() would give, without a table of all pairs.

Entities of equal texts on one side of a country are one class. A country's classes of queries and of targets are
cut in blocks by hash; each pair of blocks, with the country's vocabulary, is one task. It multiplies each query with
the inverted lists of its block of targets and hands on what can be among the best of a lane: for each query by
each forward lane, for each target by the reverse one. Work grows with pairs that share a term, disk with what is kept.

No hit is lost: of classes of equal similarity the k with the least identifiers hold the k least identifiers among
them, and of one class the k least members do. Trigrams are told apart by their three code points, words as they are.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators import terms
from tessera.staging import discard, release, staged

#: Classes in a block of queries and of targets.
QUERIES, TARGETS = 1 << 14, 1 << 16
#: Entries of the reverse lane that are held before they are cut to the best of each target.
HELD = 1_000_000
#: Similarities are ranked at nine places, and those that are 0 there are none.
LEAST, SLACK = 4.9e-10, 2e-9
VIEWS = terms.VIEWS
_SPACES, _RUNS, _WORD = re.compile(r"\s+", re.A), re.compile(r"\s\s+", re.A), re.compile("[a-z0-9]+")


def _trigrams(points: np.ndarray) -> np.ndarray:
    """The key of each window of three code points."""
    p = points.astype(np.int64)
    return (p[:-2] << 42) | (p[1:-1] << 21) | p[2:]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def occurrences(view: str, texts: list[str], known: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text and term of each occurrence of a known term, as terms.analyzed() finds them."""
    if view == "address":
        place = {term: i for i, term in enumerate(known)}
        found = [[place[w] for w in _WORD.findall(t) if w in place] for t in texts]
        return np.repeat(np.arange(len(texts)), [len(f) for f in found]), np.array([i for f in found for i in f], np.int64)
    if view == "name":
        texts = [" " + _SPACES.sub(" ", t).strip(" ") + " " for t in texts]
    else:
        texts = [_RUNS.sub(" ", t.replace(" ", "")) for t in texts]
    sizes, points = np.array([len(t) for t in texts], np.int64), _points("".join(texts))
    if len(points) < 3 or not known:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text, grams = np.repeat(np.arange(len(texts)), sizes), _trigrams(points)
    inside = text[:-2] == text[2:]
    if view == "name":
        inside &= points[1:-1] != 32
    text, grams = text[:-2][inside], grams[inside]
    keys = _trigrams(_points("".join(known)))[::3]
    order = np.argsort(keys)
    at = np.minimum(np.searchsorted(keys[order], grams), len(keys) - 1)
    hit = keys[order][at] == grams
    return text[hit], order[at[hit]]


def _vectors(texts: dict[str, list[str]], known: dict[str, list[str]], idf: dict[str, np.ndarray], by_term: bool) -> tuple[np.ndarray, ...]:
    """starts, places, weights: unit vectors of all views, terms of one view after those of another, either by text
    (places are terms) or by term (places are texts, those of one view after those of another)."""
    n, size, offset, parts = len(texts["name"]), sum(map(len, known.values())), 0, []
    for nth, view in enumerate(VIEWS):
        text, term = occurrences(view, texts[view], known[view])
        width = max(1, len(known[view]))
        key, tf = np.unique(term * n + text if by_term else text * width + term, return_counts=True)
        term, text = (key // n, key % n) if by_term else (key % width, key // width)
        raw = (1.0 + np.log(tf)) * idf[view][term]
        w = raw / np.sqrt(np.bincount(text, raw * raw, n))[text]
        parts.append((term + offset, text + nth * n if by_term else text, w))
        offset += len(known[view])
    term, text, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not by_term:
        order = np.argsort(text, kind="stable")
        term, text, w = term[order], text[order], w[order]
    rows, places, count = (term, text, size) if by_term else (text, term, n)
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=count))]), places, w


def _cut(values: np.ndarray, many: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k, values rounded, ties by place; without those that better ones' members leave no room."""
    order = np.argsort(-values, kind="stable")[:k]
    v = -values[order]
    before = np.concatenate([[0], np.cumsum(np.minimum(many[order], k))])[np.searchsorted(v, v)]
    return order[before < k]


def _best(x: np.ndarray, many: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k of one query's similarities."""
    width, low = len(x) // 64, LEAST
    if width >= 2 * k:
        tops = x[: width * 64].reshape(64, width).max(axis=0)
        low = max(low, np.partition(tops, width - k)[width - k] - SLACK)  # k groups have such a one: so have the best k
    at = np.flatnonzero(x >= low)
    return at[_cut(np.round(x[at], 9), many[at], k)]


def block_pairs(queries: dict[str, list[str]], targets: dict[str, list[str]], q_many: np.ndarray, t_many: np.ndarray, known: dict[str, list[str]], idf: dict[str, np.ndarray], budgets: dict[str, int]) -> dict[str, np.ndarray]:
    """q, t (places), forward, back and a similarity a view of the pairs kept; both sides in order of identifiers."""
    n = len(targets["name"])
    t_starts, slots, t_w = _vectors(targets, known, idf, True)
    q_starts, q_terms, q_w = _vectors(queries, known, idf, False)
    forward, back = [x for x in budgets if x != "reverse"], budgets.get("reverse", 0)
    least = np.full(n, LEAST)
    kept: list[tuple] = []
    held: list[tuple] = []
    waiting = 0

    def settle(held: list[tuple], last: bool = False) -> list[tuple]:
        q, t, both, *views = (np.concatenate(x) for x in zip(*held, strict=True))
        r = np.round(both, 9)
        order = np.lexsort((q, -r, t))
        q, t, both, r = q[order], t[order], both[order], r[order]
        first = np.searchsorted(t, t)
        place = np.arange(len(t)) - first
        full = place == back - 1
        least[t[full]] = np.maximum(LEAST, r[full] - 1e-9)
        some = place < back
        if last and len(t):
            members = np.concatenate([[0], np.cumsum(np.minimum(q_many[q], back))])
            tie = np.concatenate([[True], (t[1:] != t[:-1]) | (r[1:] != r[:-1])])
            start = np.maximum.accumulate(np.where(tie, np.arange(len(t)), 0))
            some &= members[start] - members[first] < back
        return [(q[some], t[some], both[some], *(v[order][some] for v in views))]

    for q in range(len(queries["name"])):
        a, b = q_starts[q], q_starts[q + 1]
        if a == b:
            continue
        spans = [slice(s, e) for s, e in zip(t_starts[q_terms[a:b]].tolist(), t_starts[q_terms[a:b] + 1].tolist(), strict=True)]
        w = np.concatenate([t_w[s] for s in spans])
        if not len(w):
            continue
        w *= np.repeat(q_w[a:b], [s.stop - s.start for s in spans])
        name, compact, address = np.bincount(np.concatenate([slots[s] for s in spans]), w, 3 * n).reshape(3, n)
        both = 0.5 * name
        both += 0.5 * address
        lanes = {"name": name, "compact": compact, "address": address, "combined": both}
        if forward:
            at = np.unique(np.concatenate([_best(lanes[x], t_many, budgets[x]) for x in forward]))
            kept.append((np.full(len(at), q), at, name[at], compact[at], address[at]))
        if back:
            at = np.flatnonzero(both >= least)
            held.append((np.full(len(at), q), at, both[at], name[at], compact[at], address[at]))
            waiting += len(at)
            if waiting > HELD:
                held, waiting = settle(held), 0
    mine = [np.concatenate(x) for x in zip(*kept, strict=True)] if kept else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 3
    theirs = settle(held, True)[0] if held else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 4
    keys = [x[0].astype(np.int64) * n + x[1] for x in (mine, theirs)]
    _, at = np.unique(np.concatenate(keys), return_index=True)
    columns = [np.concatenate([x, y])[at] for x, y in zip(mine, (theirs[0], theirs[1], *theirs[3:]), strict=True)]
    key = np.concatenate(keys)[at]
    return dict(zip(("q", "t", *VIEWS), columns, strict=True)) | {"forward": np.isin(key, keys[0]), "back": np.isin(key, keys[1])}


def _cells(members: DataFrame, words: DataFrame, queries: int, targets: int) -> DataFrame:
    """country, i, j, kind (0 queries, 1 targets, 2 terms), label, name, address, many, idf: each pair of blocks."""
    classes = members.filter("side is not null").groupBy("country", "side", "rep").agg(F.count(F.lit(1)).alias("many"))
    classes = members.filter("nth = 1").select("side", "rep", "name", "address").join(classes, ["side", "rep"])
    sizes = classes.groupBy("country").agg(F.ceil(F.count_if(F.col("side") == 0) / queries).alias("ni"), F.ceil(F.count_if(F.col("side") == 1) / targets).alias("nj"))
    sizes = staged(sizes.filter("ni > 0 and nj > 0").withColumnRenamed("country", "_c"), "sizes")
    here = lambda df: df.join(sizes, F.col("country").eqNullSafe(F.col("_c"))).drop("_c")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    rows = here(classes)
    out = None
    for some, i, j, kind in ((rows.filter("side = 0"), block("ni"), every("nj"), 0), (rows.filter("side = 1"), every("ni"), block("nj"), 1)):
        some = some.withColumns({"i": i, "j": j}).select("country", "i", "j", F.lit(kind).alias("kind"), F.col("rep").alias("label"), "name", "address", "many", F.lit(0.0).alias("idf"))
        out = some if out is None else out.unionByName(some)
    words = here(words).withColumn("i", every("ni")).withColumn("j", every("nj"))
    return out.unionByName(words.select("country", "i", "j", F.lit(2).alias("kind"), F.col("view").alias("label"), F.col("term").alias("name"), F.lit("").alias("address"), F.lit(0).cast("long").alias("many"), "idf"))


def class_pairs(members: DataFrame, words: DataFrame, budgets: dict[str, int], queries: int = QUERIES, targets: int = TARGETS) -> DataFrame:
    """country, q, t (the least identifiers of two classes), q_many (members of q), forward, back, name, compact, address."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["kind"] == k].sort_values("label", ignore_index=True) for k in (0, 1)]
        words = pdf[pdf["kind"] == 2].sort_values(["label", "name"])
        q, t = ({"name": s["name"].tolist(), "compact": s["name"].tolist(), "address": s["address"].tolist()} for s in sides)
        known = {v: words.loc[words["label"] == v, "name"].tolist() for v in VIEWS}
        idf = {v: words.loc[words["label"] == v, "idf"].to_numpy(np.float64) for v in VIEWS}
        names = ["country", "q", "t", "q_many", "forward", "back", *VIEWS]
        if not len(sides[0]) or not len(sides[1]) or not len(words):
            return pd.DataFrame(columns=names).astype({"q_many": "int64", "forward": bool, "back": bool} | dict.fromkeys(VIEWS, float))
        found = block_pairs(q, t, sides[0]["many"].to_numpy(), sides[1]["many"].to_numpy(), known, idf, budgets)
        found |= {"q_many": sides[0]["many"].to_numpy()[found["q"]], "q": sides[0]["label"].to_numpy()[found["q"]], "t": sides[1]["label"].to_numpy()[found["t"]]}
        return pd.DataFrame(found | {"country": pdf["country"].iloc[0]})[names]

    cells = _cells(members, words, queries, targets)
    return cells.groupBy("country", "i", "j").applyInPandas(run, "country string, q string, t string, q_many bigint, forward boolean, back boolean, name double, compact double, address double")


def _nearest_back(found: DataFrame, k: int) -> DataFrame:
    """Of the pairs that several blocks hand on for a class of targets, those whose query class has one of the best k."""
    near = F.round((F.coalesce("name", F.lit(0.0)) * 0.5 + F.coalesce("address", F.lit(0.0)) * 0.5), 9)
    found = found.withColumn("far", -F.round(near * 1e9).cast("long"))
    place = F.row_number().over(W.partitionBy("t").orderBy("far", "q"))
    nearer = F.sum(F.least(F.col("q_many"), F.lit(k))).over(W.partitionBy("t").orderBy("far").rangeBetween(W.unboundedPreceding, -1))
    return found.withColumns({"place": place, "nearer": nearer}).filter((F.col("place") <= k) & F.coalesce(F.col("nearer") < k, F.lit(True))).drop("far", "place", "nearer")


def best_pairs(rows: DataFrame, profile: terms.Profile, queries: int = QUERIES, targets: int = TARGETS) -> DataFrame | None:
    """The rows of products() that can be hits of one of the profile's lanes (of it, or of a variant with fewer lanes
    or smaller budgets), staged, from eligible views() rows; None where identifiers are null or shared."""
    side = F.when(F.col("source") == "S1", 0).when(F.col("source") != "S1", 1)
    rows = rows.withColumn("side", side)
    if rows.groupBy("side", "entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or entity_id is null").take(1):
        return None
    same = W.partitionBy("country", "side", "name", "address").orderBy("entity_id")
    members = staged(rows.withColumns({"nth": F.row_number().over(same), "rep": F.first("entity_id").over(same)}), "members")
    words = terms.vocabulary(members, profile, keyed=True)
    budgets = {lane: profile.budgets[lane] for lane in profile.lanes}
    found = staged(class_pairs(members, words, budgets, queries, targets), "class-pairs")
    release(rows.sparkSession)
    most, back = max((k for lane, k in budgets.items() if lane != "reverse"), default=0), budgets.get("reverse", 0)
    q = members.filter("side = 0").select(F.col("rep").alias("q"), F.col("entity_id").alias("s1_id"), F.col("nth").alias("q_nth"))
    t = members.filter("side = 1").select(F.col("rep").alias("t"), F.col("entity_id").alias("target_id"), F.col("source").alias("target_source"), F.col("nth").alias("t_nth"))
    ahead = found.filter("forward").join(t.filter(F.col("t_nth") <= most), "t").join(q, "q")
    behind = _nearest_back(found.filter("back"), back).join(t, "t").filter(~F.col("forward") | (F.col("t_nth") > most)).join(q.filter(F.col("q_nth") <= back), "q")
    similarity = [F.when(F.col(v) > 0, F.col(v)).alias(v) for v in terms.VIEWS]
    pairs = staged(ahead.unionByName(behind).select("country", "s1_id", "target_id", "target_source", *similarity), "pairs")
    discard(members, found)
    release(rows.sparkSession)
    return pairs


#: Executors get these functions by value; they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
