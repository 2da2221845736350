"""String similarities as Arrow UDFs, over distinct pairs of texts only where the caller makes them so.

ratio is 2 LCS / (m + n) by a bit-parallel longest common subsequence; the others are built from it. Both
texts empty give 1; the pair features gate empty sides themselves. The functions of one pair are the definitions;
those of many pairs give the same numbers, side by side in 64-bit words, and leave longer texts to the former.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: one bit a character of `a` (Hyyrö 2004)."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 1.0 if a == b else 2 * lcs(a, b) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(s)) for s in (left & right, left - right, right - left))
    if both and not (only_a and only_b):
        return 1.0
    with_a, with_b = (f"{both} {x}".strip() for x in (only_a, only_b))
    return max(ratio(with_a, with_b), *((ratio(both, with_a), ratio(both, with_b)) if both else (0.0,)))


def partial(a: str, b: str) -> float:
    def slide(short: str, long: str) -> float:
        """Windows in order of the most they can have, by the characters shared; those that cannot be better are left."""
        n, left, shared, bounds = len(short), Counter(short), 0, []
        for i in range(1 - n, len(long)):
            if i + n <= len(long):
                c = long[i + n - 1]
                left[c] -= 1
                shared += left[c] >= 0
            if i > 0:
                c = long[i - 1]
                shared -= left[c] >= 0
                left[c] += 1
            bounds.append((2 * shared / (n + min(i + n, len(long)) - max(0, i)), i))
        bounds.sort(reverse=True)
        best = 0.0
        for bound, i in bounds:
            if bound <= best:
                break
            best = max(best, ratio(short, long[max(0, i) : i + n]))
        return best

    if not a or not b:
        return float(a == b)
    if len(a) == len(b):
        return max(slide(a, b), slide(b, a))
    return slide(a, b) if len(a) < len(b) else slide(b, a)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, met = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                met.append(c)
                break
    if not met:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    half = sum(x != y for x, y in zip(met, other, strict=True)) // 2
    m = len(met)
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


#: Characters of the shorter and of the longer text of pairs that are worked on side by side, and how many pairs at once.
WORD, LONG, CHUNK = 64, 256, 512
#: What fills up shorter texts and longer ones: no character, and not each other.
_NONE, _NIL = 0xFFFFFFFF, 0xFFFFFFFE


def _sizes(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _matrix(texts: list[str], width: int, fill: int, before: int = 0) -> np.ndarray:
    """A row of code points for each text, after `before` places."""
    out = np.full((len(texts), width), fill, np.uint32)
    at = np.arange(width) - before
    out[(at >= 0) & (at < _sizes(texts)[:, None])] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _places(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """A row for each column of `long`: bits of the places of its character in `short`, which is WORD wide."""
    out = np.empty(long.shape[::-1], np.uint64)
    for j in range(long.shape[1]):
        out[j] = np.packbits(short == long[:, j : j + 1], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _steps(rows: np.ndarray, places: Iterator[np.ndarray]) -> np.ndarray:
    """lcs() of all rows at once; bits beyond a text's length are for the caller to leave out."""
    met, less = np.empty_like(rows), np.empty_like(rows)
    for some in places:
        np.bitwise_and(rows, some, out=met)
        np.subtract(rows, met, out=less)
        rows += met
        rows |= less
    return rows


def _ones(n: np.ndarray) -> np.ndarray:
    """The lowest n bits, n from 0 to 64."""
    return np.where(n > 0, np.uint64(2**64 - 1) >> np.uint64(64 - np.maximum(n, 1)).astype(np.uint64), np.uint64(0))


def _apart(a: list[str], b: list[str], kernel: Callable[[str, str], float], out: np.ndarray) -> np.ndarray:
    """Places of the pairs within the limits; of the others `out` gets the kernel's number."""
    m, n = _sizes(a), _sizes(b)
    within = (np.minimum(m, n) <= WORD) & (np.maximum(m, n) <= LONG)
    for i in np.flatnonzero(~within):
        out[i] = kernel(a[i], b[i])
    return np.flatnonzero(within)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    out = np.ones(len(a))
    some = _apart(a, b, ratio, out)
    shorter, longer = [x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)], [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]
    m, n = _sizes(shorter), _sizes(longer)
    some = some[np.argsort(n[some], kind="stable")]
    some = some[n[some] > 0]
    for at in range(0, len(some), CHUNK):
        i = some[at : at + CHUNK]
        places = _places(_matrix([shorter[x] for x in i], WORD, _NONE), _matrix([longer[x] for x in i], n[i[-1]], _NIL))
        rows = _steps(np.full(len(i), 2**64 - 1, np.uint64), iter(places))
        out[i] = 2 * (m[i] - np.bitwise_count(rows & _ones(m[i])).astype(np.int64)) / (m[i] + n[i])
    return out


def token_sorts(a: list[str], b: list[str]) -> np.ndarray:
    return ratios(*([" ".join(sorted(t.split())) for t in x] for x in (a, b)))


def token_sets(a: list[str], b: list[str]) -> np.ndarray:
    out, at, pairs = np.zeros(len(a)), [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        left, right = set(x.split()), set(y.split())
        if not left or not right:
            continue
        both, only_a, only_b = (" ".join(sorted(s)) for s in (left & right, left - right, right - left))
        if both and not (only_a and only_b):
            out[i] = 1.0
            continue
        with_a, with_b = (f"{both} {t}".strip() for t in (only_a, only_b))
        for pair in [(with_a, with_b), (both, with_a), (both, with_b)][: 3 if both else 1]:
            at.append(i)
            pairs.append(pair)
    if pairs:
        np.maximum.at(out, at, ratios(*map(list, zip(*pairs, strict=True))))
    return out


def partials(a: list[str], b: list[str]) -> np.ndarray:
    """All windows of a pair side by side: texts that go on with no character on both sides have windows of one length."""
    out = np.zeros(len(a))
    some = [i for i in _apart(a, b, partial, out).tolist() if a[i] and b[i]]
    slides = [(i, a[i], b[i]) if len(a[i]) <= len(b[i]) else (i, b[i], a[i]) for i in some]
    slides += [(i, b[i], a[i]) for i in some if len(a[i]) == len(b[i]) and a[i] != b[i]]
    slides.sort(key=lambda s: (len(s[1]), len(s[2])))
    at = 0
    while at < len(slides):
        n, end = len(slides[at][1]), at
        while end < len(slides) and end - at < CHUNK // 2 and len(slides[end][1]) == n:
            end += 1
        which, short, long = map(list, zip(*slides[at:end], strict=True))
        m, at = _sizes(long), end
        many = int(m[-1]) + n - 1
        places = _places(_matrix(short, WORD, _NONE), _matrix(long, many + n - 1, _NIL, n - 1))
        rows = _steps(np.full((many, len(short)), 2**64 - 1, np.uint64), (places[k : k + many] for k in range(n)))
        start = np.arange(1 - n, many - n + 1)[:, None]
        size = np.minimum(start + n, m) - np.maximum(start, 0)
        found = 2 * (n - np.bitwise_count(rows & _ones(np.array(n))).astype(np.int64)) / (n + np.maximum(size, 1))
        np.maximum.at(out, which, np.where(size > 0, found, 0.0).max(axis=0))
    return out


def jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros(len(a))
    m, n = _sizes(a), _sizes(b)
    for i in np.flatnonzero(np.maximum(m, n) > WORD):
        out[i] = jaro_winkler(a[i], b[i])
    some = np.flatnonzero(np.maximum(m, n) <= WORD)
    for at in range(0, len(some), CHUNK):
        i = some[at : at + CHUNK]
        x, y = _matrix([a[k] for k in i], WORD, _NONE), _matrix([b[k] for k in i], WORD, _NIL)
        la, lb = m[i], n[i]
        reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
        free, met = np.full(len(i), 2**64 - 1, np.uint64), np.zeros(x.shape, bool)
        for j, places in enumerate(_places(y, x[:, : max(1, int(la.max()))])):
            near = _ones(np.minimum(lb, j + reach + 1)) & ~_ones(np.clip(j - reach, 0, WORD))
            open_ = places & free & near
            first = open_ & (~open_ + np.uint64(1))
            free ^= first
            met[:, j] = first > 0
        taken = np.unpackbits((~free).astype("<u8")[:, None].view(np.uint8), axis=1, bitorder="little").astype(bool)
        count = met.sum(axis=1)
        differ = np.bincount(np.nonzero(met)[0], x[met] != y[taken], len(i)).astype(np.int64)
        c, same = np.maximum(count, 1), x[:, :4] == y[:, :4]
        jaro = (c / np.maximum(la, 1) + c / np.maximum(lb, 1) + (c - differ // 2) / c) / 3
        prefix = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        value = np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)
        out[i] = np.where(count > 0, value, 0.0)
    out[[x == y for x, y in zip(a, b, strict=True)]] = 1.0
    return out


def trigram_jaccards(a: list[str], b: list[str]) -> np.ndarray:
    """Shared and all distinct windows of three characters as a share; 0 where there are none."""
    out = np.zeros(len(a))
    size = np.maximum(_sizes(a), _sizes(b))
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        i = order[at : at + CHUNK]
        if size[i[-1]] > LONG:
            i = i[: max(1, int((size[i] <= LONG).sum()))]  # a few long texts leave no room for others
        at += len(i)
        width = max(3, int(size[i[-1]]))
        keys = []
        for side, texts in enumerate((a, b)):
            points = _matrix([texts[k] for k in i], width, _NONE).astype(np.uint64)
            key = ((points[:, :-2] << np.uint64(42) | points[:, 1:-1] << np.uint64(21) | points[:, 2:]) << np.uint64(1)) + np.uint64(side)
            key[points[:, 2:] == _NONE] = 2**64 - 1
            keys.append(key)
        both = np.sort(np.concatenate(keys, axis=1), axis=1)
        real = both != np.uint64(2**64 - 1)
        new = real.copy()
        new[:, 1:] &= both[:, 1:] != both[:, :-1]
        hits = (real[:, 1:] & (both[:, 1:] == both[:, :-1] + np.uint64(1)) & (both[:, 1:] % np.uint64(2) == 1)).sum(axis=1)
        union = new.sum(axis=1) - hits
        out[i] = np.where(union > 0, hits / np.maximum(union, 1), 0.0)
    return out


def _column(kernel):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a))
        some = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x and y]
        if some:
            out[some] = kernel(a.iloc[some].tolist(), b.iloc[some].tolist())
        return pd.Series(out)

    return run


ratio_column, token_sort_column, token_set_column, partial_column, jaro_winkler_column, trigram_column = map(_column, (ratios, token_sorts, token_sets, partials, jaro_winklers, trigram_jaccards))


@F.pandas_udf(T.DoubleType())
def best_ratio_column(a: pd.Series, a2: pd.Series, b: pd.Series, b2: pd.Series) -> pd.Series:
    """The best of the four ratios of two spellings each."""
    at, pairs = [], []
    for i, (w, x, y, z) in enumerate(zip(a, a2, b, b2, strict=True)):
        for pair in {(p, q) for p in (w, x) for q in (y, z)}:
            at.append(i)
            pairs.append(pair)
    out = np.zeros(len(a))
    if pairs:
        np.maximum.at(out, at, ratios(*map(list, zip(*pairs, strict=True))))
    return pd.Series(out)


#: Executors get these functions by value; they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
