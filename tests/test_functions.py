import random
import time
import unicodedata

import pytest

from tessera.functions import fuzzy
from tessera.functions.script import script_of
from tessera.functions.text import fold, word_windows, windows
from pyspark.sql import functions as F

STRINGS = ["", "  A  b ", "Straße", "Éáﬁ", "İstanbul", "कमल दुकान", "ΣΊΣΥΦΟΣ", "ẞ", "日本", "à̕"]


def test_fold(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(STRINGS)] + [(99, None)], "i int, s string")
    got = {r.i: r.f for r in df.select("i", fold("s").alias("f")).collect()}
    for i, s in enumerate(STRINGS):
        assert got[i] == "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()
    assert got[99] is None


def test_windows(spark):
    row = spark.createDataFrame([("ab", "abcd", " a  bcd ")], "x string, y string, z string").select(windows(F.col("x")), windows(F.col("y")), word_windows(F.col("z"))).first()
    assert list(row) == [[], ["abc", "bcd"], [" a ", " bc", "bcd", "cd "]]


def test_kernels():
    assert fuzzy.ratio("abcd", "bcde") == pytest.approx(0.75)
    assert fuzzy.ratio("", "") == 1
    assert fuzzy.token_sort("b a", "a b") == 1
    assert fuzzy.token_set("a b", "a b c") == 1
    assert fuzzy.token_set("", "a") == 0
    assert fuzzy.partial("abc", "xxabcxx") == 1
    assert fuzzy.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert fuzzy.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert fuzzy.jaro_winkler("abc", "xyz") == 0


def test_script():
    assert script_of("αβ ab") == "GREEK"
    assert script_of("12") == "UNKNOWN"


def test_kernels_against_brute_force():
    """Longest common subsequences by the full table, and every window for the partial ratio."""
    rng = random.Random(3)

    def common(a: str, b: str) -> int:
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, c in enumerate(a):
            for j, d in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if c == d else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    def alike(a: str, b: str) -> float:
        return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0

    for _ in range(300):
        a, b = ("".join(rng.choice("ab cé日") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert fuzzy.ratio(a, b) == pytest.approx(alike(a, b))
        assert fuzzy.token_sort(a, b) == pytest.approx(alike(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
        if a and b:
            pairs = [(a, b), (b, a)] if len(a) == len(b) else [(a, b) if len(a) < len(b) else (b, a)]
            best = max(alike(s, t[max(0, i) : i + len(s)]) for s, t in pairs for i in range(1 - len(s), len(t)))
            assert fuzzy.partial(a, b) == pytest.approx(best)


def test_partial_leaves_out_windows_that_cannot_be_better(monkeypatch):
    """The best of all windows, by few ratios."""
    import random

    from tessera.functions import fuzzy

    rng, seen, ratio = random.Random(3), [], fuzzy.ratio

    def every(a: str, b: str) -> float:
        slide = lambda s, t: max(ratio(s, t[max(0, i) : i + len(s)]) for i in range(1 - len(s), len(t)))
        return max(slide(a, b), slide(b, a)) if len(a) == len(b) else slide(*sorted((a, b), key=len))

    monkeypatch.setattr(fuzzy, "ratio", lambda a, b: seen.append(1) or ratio(a, b))
    texts = ["".join(rng.choice("abcdefghi ") for _ in range(rng.choice([1, 5, 12, 40, 40]))) for _ in range(300)]
    windows = 0
    for a, b in zip(texts, texts[1:], strict=False):
        assert fuzzy.partial(a, b) == every(a, b)
        windows += (len(a) + len(b) - 1) * (1 + (len(a) == len(b)))
    assert 2 * len(seen) < windows


def test_kernels_of_many_pairs_equal_those_of_one():
    """Bit by bit, for texts of every length about the limits; and in a fraction of the time."""
    rng = random.Random(5)
    sizes = [0, 1, 2, 3, 4, 9, 20, 39, 40, 40, 40, 41, 63, 64, 65, 100, 255, 256, 257]
    texts = ["".join(rng.choice("ab cdé\u65e5\U0001f600 ") for _ in range(rng.choice(sizes))) for _ in range(500)]
    texts += [t[:20] + t[21:] for t in texts[:60]] + texts[:20]
    a, b = texts, rng.sample(texts, len(texts))
    a, b = a + texts[:60] + texts[:9], b + texts[500:560] + texts[:9]
    for one, many in ((fuzzy.ratio, fuzzy.ratios), (fuzzy.token_sort, fuzzy.token_sorts), (fuzzy.token_set, fuzzy.token_sets), (fuzzy.partial, fuzzy.partials), (fuzzy.jaro_winkler, fuzzy.jaro_winklers)):
        some = [i for i in range(len(a)) if a[i] and b[i]]
        x, y = [a[i] for i in some], [b[i] for i in some]
        assert many(x, y).tolist() == [one(*p) for p in zip(x, y, strict=True)]
        assert many([], []).tolist() == []
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    assert fuzzy.trigram_jaccards(a, b).tolist() == [len(grams(x) & grams(y)) / max(1, len(grams(x) | grams(y))) for x, y in zip(a, b, strict=True)]
    assert fuzzy.ratios(a, b).tolist() == [fuzzy.ratio(*p) for p in zip(a, b, strict=True)]
    x, y = (["".join(rng.choice("abcdefghi ") for _ in range(40)) for _ in range(1000)] for _ in range(2))
    began = time.process_time()
    fuzzy.partials(x, y)
    many, began = time.process_time() - began, time.process_time()
    for p in zip(x[:100], y[:100], strict=True):
        fuzzy.partial(*p)
    assert many < time.process_time() - began
