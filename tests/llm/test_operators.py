"""Operators against brute force, round trips and held-out accuracy, and on awkward tables."""

import functools
import hashlib
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, components, exact_dedup, jaccard_join, language_id, license_scan, lm_scoring, mixing, quality_rules, secret_scan, suffix_dedup
from tessera.llm.common import LOWER_AZ, few, release, staged
from tessera.llm.registry import vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, sid bigint, copies bigint, bucket int, kept boolean, label double"
RNG = random.Random(5)
SYLLABLES = "an er en ti ou ing lo sch que ra do the of is".split()


def word() -> str:
    return "".join(RNG.choice(SYLLABLES) for _ in range(RNG.randint(1, 4)))


def prose(n: int) -> str:
    return " ".join(word() for _ in range(n))


@functools.cache
def awkward() -> list[tuple]:
    base = prose(150)
    words = base.split()
    texts = [None, "", "   \n", "one", base, base, base.replace(" ", "  \t"), base.upper(), " ".join(words[:140] + ["new"] + words[141:]), "a" * 3000, "é 日本 " * 40 + "<|endoftext|>", prose(2000), base + " tail", prose(60) + " " + base[:500], "x y z " * 100, "#$% &| " * 50, "Released under the MIT License. " + prose(5), "token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda\" " + prose(8), "12 34 5", "\u0000 odd   nbsp em"]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], 0, 1, 2, 3, 4, True, 0.5) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[0], (None, base, "en", "a", 0, 1, 2, 3, 4, True, 0.5)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_matches_the_library_and_comes_back(table, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    library.no_truncation(), library.no_padding()
    got = {r.doc_id: r for r in bpe.bpe_round_trip(table, vocabulary(), keep_ids=True, keep_text=True).collect()}
    for doc_id, text in {r[0]: r[1] or "" for r in awkward()}.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[doc_id].ids == ids and got[doc_id].n_tokens == len(ids) and got[doc_id].decoded == text
        assert got[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.bpe_round_trip(empty, vocabulary()).count() == 0


def test_quality_counts(table, empty):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = Counter(zip(words, words[1:], words[2:]))
        cover = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines, dup, met = (text or "").split("\n"), 0, set()
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in met
                met.add(line)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)

    rows = quality_rules.quality_verdicts(table).collect()
    assert len(rows) == len(awkward())
    want = {r[0]: brute(r[1]) for r in awkward()}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.quality_verdicts(empty).count() == 0


def test_quality_keeps_the_usual_and_drops_the_odd(spark):
    rows = [(i, prose(200), "en", "s") for i in range(150)] + [(999, " ".join(w + "###" for w in prose(200).split()), "en", "s")]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not kept[999] and sum(kept.values()) >= 148


def brute_repeats(docs, length, keep_first, passage):
    """n_bytes, n_removed, n_spans, kept_sha256, n_passage_words of each document, string by string."""
    seen, first, having, want = Counter(), {}, defaultdict(set), {}
    for i, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] += 1
            first.setdefault(b[s : s + length], (i, s))
        w = b.split()
        for s in range(len(w) - passage + 1):
            having[tuple(w[s : s + passage])].add(i)
    for i, t in docs:
        b, gone = (t or "").encode(), set()
        for s in range(len(b) - length + 1):
            x = b[s : s + length]
            if (first[x] != (i, s)) if keep_first else seen[x] > 1:
                gone |= set(range(s, s + length))
        w = b.split()
        cover = {k for s in range(len(w) - passage + 1) if len(having[tuple(w[s : s + passage])]) > 1 for k in range(s, s + passage)}
        want[i] = (len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in gone)).hexdigest(), len(cover))
    return want


def removed(df, length, keep_first, **sizes):
    rows = suffix_dedup.remove_repeats(df, length, keep_first, **sizes).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) for r in rows}


def test_fences_follow_their_source(spark):
    """A source whose documents have symbols throughout keeps them; elsewhere they are odd; a small source leans on its language."""
    marked = lambda n, k: " ".join(w + "#" * (i % k == 0) for i, w in enumerate(prose(n).split()))
    rows = [(i, marked(120, 40 + i % 30), "en", "plain") for i in range(300)] + [(1000 + i, marked(120, 2 + i % 2), "en", "marked") for i in range(300)]
    rows += [(2000, marked(120, 1), "en", "plain"), (2001, marked(120, 2), "en", "marked"), (2002, marked(120, 50), "en", "small"), (2003, prose(120), None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    limits = {r.source: r for r in quality_rules.thresholds(quality_rules.sketch(quality_rules.with_rules(quality_rules.measured(docs)))).collect()}
    assert limits["marked"].symbol_ratio_high > 3 * limits["plain"].symbol_ratio_high and limits[None].symbol_ratio_high is None
    kept = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(docs).collect()}
    assert not kept[2000] and kept[2001] and kept[2002] and kept[2003] and sum(kept.values()) >= 600


@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats_against_brute_force(spark, empty, keep_first):
    rng, length = random.Random(3), 40
    common = ["".join(rng.choice("ab ") for _ in range(70)) for _ in range(3)]
    docs = []
    for i in range(60):
        bits = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 90))) for _ in range(3)]
        docs.append((i, bits[0] + rng.choice(common) + bits[1] + rng.choice([common[0][:45], "ab" * 60, "é" * 30]) + bits[2]))
    docs += [(60, docs[0][1]), (61, None), (62, ""), (63, "z" * 39), (64, "z" * 41)]
    want = brute_repeats(docs, length, keep_first, 9)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    for crowd in (2000, 3):  # crowded anchors take the other exact way
        assert removed(df, length, keep_first, gram=16, crowd=crowd, passage=9, words=4) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_passages_on_both_sides_of_the_production_sizes(spark):
    """Passages of 45 to 60 words and of 380 to 420 bytes in prose, the whole at 400 bytes and 51 words."""
    shared = [prose(n) for n in (45, 50, 51, 52, 60)] + [prose(90).encode()[:n].decode() for n in (380, 399, 400, 401, 420)]
    docs = [(i, f"{prose(30)}  {shared[i % 10]} {prose(20 + i)}") for i in range(40)] + [(40, prose(700)), (41, "z" * 5000 + " " + prose(60))]
    want = brute_repeats(docs, 400, False, 51)
    got = removed(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), 400, False)
    assert got == want
    assert all((got[i][4] > 0) for i in range(40) if i % 10 in (2, 3, 4)) and got[40][4] == got[0][4] == 0 and got[40][1] == 0


def test_repeats_with_text_identifiers(spark):
    text = prose(120)
    rows = spark.createDataFrame([("a", text), ("b", text), ("b", text), (None, text[:300])], "doc_id string, text string")
    assert [r.n_removed for r in suffix_dedup.remove_repeats(rows, keep_first=False).collect()].count(len(text.encode())) == 3


def test_repeats_on_the_awkward_table(table):
    rows = suffix_dedup.remove_repeats(table, keep_first=False).collect()
    assert len(rows) == len(awkward()) and all(r.n_bytes >= r.n_removed >= 0 for r in rows)
    assert {r.n_removed for r in rows if r.doc_id == 9} == {3000}


def near_docs():
    rng, docs = random.Random(9), []
    for g in range(6):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(30, 90))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 9999)}"
            docs.append(" ".join(words))
    docs += [f"shared passage of many words here {' '.join(f'u{i}x{j}' for j in range(40))}" for i in range(30)]
    docs += [None, "", " ", "a b", "A  B", "a b c", docs[0], docs[0].upper()]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [256, 4])
def test_links_against_brute_force(spark, empty, block, monkeypatch):
    docs = near_docs()

    def grams(text):
        w = (text or "").encode().translate(LOWER_AZ).split()
        return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])

    sets, parent = {i: grams(t) for i, t in docs}, {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    original = jaccard_join.resolve
    monkeypatch.setattr(jaccard_join, "resolve", lambda m, s, p: original(m, s, p, block))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in sets}
    if block == 256:
        assert jaccard_join.jaccard_components(empty).count() == 0


def test_links_on_the_awkward_table(table):
    rows = jaccard_join.jaccard_components(table).collect()
    assert len(rows) == len(awkward())
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.component_id)
    assert by[0] == {0} and by[1] == {1} and by[4] == by[5] == by[6] == by[7] == by[8] == by[None] == {4}
    stay = jaccard_join.keep_one_each(table)
    ids = Counter(r.doc_id for r in stay.collect())
    assert stay.columns == table.columns and ids[0] == 2 and ids[1] == ids[4] == 1 and not {5, 6, 7, 8, None} & set(ids)


def test_links_of_rows_without_an_identifier(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:30], "new", *words[31:]])
    rows = spark.createDataFrame([(None, " ".join(words)), (None, near), (None, prose(40)), (3, prose(40))], "doc_id bigint, text string")
    assert sorted(str(r.component_id) for r in jaccard_join.jaccard_components(rows, percent=70).collect()) == ["3", "None", "None", "None"]
    assert jaccard_join.keep_one_each(rows, percent=70).count() == 3


@pytest.mark.parametrize("local", [components.LOCAL, 5])
def test_components(spark, local):
    """One task's forest, and forests of five edges at a time followed by star rounds."""
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (50, 200)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "u bigint, v bigint"), local).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 50: 50, 200: 50}


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_groups(table, empty, bits):
    """Four bits of digest make texts collide: the bytes decide."""
    groups = defaultdict(list)
    for r in awkward():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    want = {t: (min(i for i in ids if i is not None), len(ids)) for t, ids in groups.items()}
    rows = exact_dedup.exact_groups(table, digest_bits=bits, files_per_trigger=1).collect()
    assert len(rows) == len(awkward()) and sum(r.kept for r in rows) == len(groups)
    by = {hashlib.sha256(t.encode()).hexdigest(): w for t, w in want.items()}
    assert all((r.keep_id, r.group_size) == by[r.text_sha256] for r in rows)
    if bits == 256:
        kept = exact_dedup.exact_dedup(table)
        assert exact_dedup.exact_dedup(empty).count() == 0
        assert kept.columns == table.columns and kept.count() == len(groups)
        assert exact_dedup.exact_groups(empty).count() == 0


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_groups_of_several_batches(spark, empty, tmp_path, bits):
    """A state that lives on: later batches meet the texts of earlier ones, an empty batch changes nothing."""
    kind, path = "doc_id bigint, text string, lang string", str(tmp_path / f"state{bits}")
    first = [(5, "a  b", None), (6, "a b", "x"), (7, "c", None), (8, None, None)]
    second = [(1, "a\tb", None), (2, "d", None), (3, "d", None), (9, "", None), (None, "c", "y")]
    run = lambda rows: {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, kind).repartition(3), bits, 1, path).collect()}
    assert run(first) == {5: (5, 2, True), 6: (5, 2, False), 7: (7, 1, True), 8: (8, 1, True)}
    assert exact_dedup.exact_groups(empty.select("doc_id", "text", "lang"), bits, 1, path).count() == 0
    assert run(second) == {1: (5, 3, False), 2: (2, 2, True), 3: (2, 2, False), 9: (8, 2, False), None: (7, 2, False)}
    assert run([(4, "d", None), (10, "e", None)]) == {4: (2, 3, False), 10: (10, 1, True)}


def test_exact_groups_by_text_identifiers(spark):
    rows = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "doc_id string, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_groups(rows).collect()} == {("a", "a", True), ("b", "a", False), ("c", "c", True)}


def test_mix(table, empty, spark):
    rows = mixing.mix_counts(table).collect()
    assert len(rows) == len(awkward())
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6 for r in rows)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(r.size for r in rows))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, mixing.mix_counts(table.repartition(5)).collect())) == sorted(map(key, rows))
    assert mixing.mix_counts(empty).count() == 0
    assert mixing.mix_rows(table).count() == sum(r.copies for r in rows)
    docs = spark.createDataFrame([(i, prose(RNG.randint(20, 300)), f"s{i % 5}") for i in range(600)], "doc_id bigint, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.mix_counts(docs).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 0.005 * t for s, t in target.items())


def test_mix_of_small_uneven_sources(spark):
    """Copies against the definition: order, prefix sums, one offset, a copy for each integer crossed."""
    rng = random.Random(4)
    docs = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 20)), f"s{i % 6}") for i in range(240)]
    rows = mixing.mix_counts(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        expected, taken, target = own[0].target / own[0].source_size, sum(r.taken for r in own), own[0].target
        assert all(int(expected) <= r.copies <= int(expected) + 1 and r.taken == r.size * r.copies for r in own)
        assert abs(sum(r.copies for r in own) - expected * len(own)) <= 1
        assert abs(taken - target) <= 0.08 * target


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 100), ("z", 0)], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights a 1, b 2, c 3, z 1 (no words), null 2: b, c and null end at three times their size
    assert got == {"a": pytest.approx(760), "b": 30, "c": 30, "z": 0, None: 300}


def test_license_base(table, empty):
    rows = {r.doc_id: r for r in license_scan.scan_licenses(table).collect()}
    assert len(rows) == 21 and rows[16].base_labels == rows[16].labels == "mit" and rows[16].first_word == 1 and rows[16].score == 1
    assert all(not r.labels and r.first_word is None for i, r in rows.items() if i != 16)
    assert license_scan.scan_licenses(empty).count() == 0
    index = license_scan.Index()
    scan = lambda t: index.scan(t.encode().translate(license_scan.TO_WORDS))
    assert scan("CC-BY-NC cc by nc 4.0")[1] == [0, 3]
    assert scan("This work is licensed under the GNU General Public License, version 3.")[3] == {"gpl-3"}
    assert scan("the license of the public general version 3 gnu work")[3] == set()
    assert scan("Licensed under the Apache License, Version 2.0 (the \"License\")")[3] == {"apache-2"}


def test_licenses_by_whole_texts():
    """Each template in prose gets its label; half of it, or its words in another order, don't; what a file costs
    does not depend on the number of templates."""
    from tessera.llm.license_texts import TEMPLATES

    index = license_scan.Index()
    read = lambda text: index.scan(text.encode().translate(license_scan.TO_WORDS))
    for label, text, _ in TEMPLATES:
        assert label in read(f"{prose(50)} Copyright 2020 {text} {prose(30)}")[3]
        words = text.split()
        if len(words) > 60:
            assert label in read(" ".join([*words[:20], "oneword", *words[20:]]))[3]
            RNG.shuffle(words)
            assert label not in read(" ".join(words))[3]
    assert read(prose(400))[3:] == (set(), 0.0)
    many = license_scan.Index([*TEMPLATES, *[(f"x{i}", " ".join(f"q{i}w{k}" for k in range(80)), [f"q{i}w1"]) for i in range(500)]])
    assert many.scan(("a " + " ".join(f"q7w{k}" for k in range(80))).encode())[3] == {"x7"}


def test_languages(spark, table, empty):
    words = {"en": "the and thing with there of".split(), "de": "und der sch nicht zwischen ung".split()}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for i in range(120) for lang in [rng.choice(["en", "de"])]]
    rows += [(500, "... 123", "en"), (501, None, "de"), (502, "the and", None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:120])
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].lang_pred == "en"
    assert language_id.identify(table).count() == len(awkward()) and language_id.identify(empty).count() == 0
    assert language_id.keep_identified(table, 0.0).columns == table.columns


def test_scores(table, empty):
    counts, words = Counter(), {}
    for r in awkward():
        words[r[0]] = (r[1] or "").encode().translate(LOWER_AZ).split() + [b"\n"]
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2:
            counts.update(words[r[0]])
    n, v = sum(counts.values()), len(counts)
    rows = lm_scoring.score_documents(table).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words[r.doc_id]), rel=1e-6)
        assert r.n_tokens == len(words[r.doc_id]) and r.n_known == sum(counts[w] > 0 for w in words[r.doc_id]) and r.train_tokens == n and r.score < 0
    assert lm_scoring.score_documents(empty).count() == 0


def test_scores_follow_the_order_of_words(spark):
    base = prose(60).split()
    rows = [(1000 + i, " ".join(base)) for i in range(12)]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    texts = [" ".join(base), " ".join(sorted(base)), "unseenan", "zqxjkvwq"]
    rows += list(zip(held, texts, strict=True))
    got = {r.doc_id: r for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    right, mixed, like, unlike = [got[i] for i in held]
    assert right.held_out and mixed.held_out and right.base_score == pytest.approx(mixed.base_score)
    assert right.score > mixed.score + 10
    assert like.n_known == unlike.n_known == 1 and like.score > unlike.score  # unknown words are spelt


def test_seats():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 5, 32, 33, 1000, 10**6])
    t = lm_scoring.seat(c, np.full(len(c), 0.5), 0.5, rng)
    assert (t <= c).all() and (t >= np.minimum(c, 1)).all()
    many = lm_scoring.seat(np.full(20000, 2), np.full(20000, 0.5), 0.5, rng)  # two tables: pull / (pull + 1 - discount)
    assert abs((many == 2).mean() - 0.5) < 0.02
    speller = lm_scoring.Speller(*np.unique(np.concatenate([lm_scoring.spelled([b"abc", b"abd"])[0]] * 3), return_counts=True))
    total = sum(np.exp(speller.log_words(*lm_scoring.spelled([bytes([a, b]) for b in range(256)]))).sum() for a in range(256)) + np.exp(speller.log_words(*lm_scoring.spelled([bytes([a]) for a in range(256)]))).sum()
    assert total < 1


def test_secrets(table, empty):
    rows = secret_scan.scan_secrets(table).collect()
    assert [r.doc_id for r in rows if r.secret] == [17]
    assert secret_scan.scan_secrets(empty).count() == 0


def test_secrets_held_out(spark):
    """Findings made from another seed; commits, checksums and identifiers after words that tell of them."""
    forest = secret_scan.train_forest(secret_scan.made_findings(spark))
    got = secret_scan.judged(secret_scan.made_findings(spark, 2000, seed=77), forest).select("label", "score").collect()
    true = sum(r.label == 1 and r.score >= 0.5 for r in got)
    assert true / sum(r.score >= 0.5 for r in got) > 0.93 and true / sum(r.label for r in got) > 0.93
    sha = hashlib.sha1(b"x").hexdigest()
    texts = [f"see commit {sha} of", f"md5: {hashlib.md5(b'y').hexdigest()}", f"checksum={hashlib.sha256(b'z').hexdigest()}", "uuid 123e4567-e89b-12d3-a456-426614174000", f'api_key = "{sha}"']
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("source", F.lit("src"))
    assert {r.doc_id for r in secret_scan.scan_secrets(rows).collect() if r.secret} == {4}


def test_long_secrets_are_taken_whole(spark):
    runs = [hashlib.sha512(b"a").hexdigest() * 4 + end for end in ("b" * 60, "c" * 3000)]
    rows = spark.createDataFrame([(i, f'key = "{x}" end', "a") for i, x in enumerate(runs)], "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in secret_scan.scan_secrets(rows).collect()}
    assert [(got[i].length, got[i].candidate_sha256) for i in (0, 1)] == [(len(x), hashlib.sha256(x.encode()).hexdigest()) for x in runs]


def test_secrets_in_any_surroundings(spark):
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    texts = [f"`{key}`", f"[{key}]", f"<token>{key}</token>", "{" + key + "}", f"a|{key}", f";{key}", f"-----\\n{key}\\n", f" token={key}", f"AWS_SECRET_ACCESS_KEY={key}", f"token = \"{key}==\"", " password=e3b3ed3cc8548923d6"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("source", F.lit("a"))
    found = defaultdict(dict)
    for r in secret_scan.candidates(rows).collect():
        found[r.doc_id][r.candidate] = r.before
    for i in range(len(texts) - 2):
        assert key in found[i], texts[i]
    assert found[7] == {key: "token="} and found[8][key] == "AWS_SECRET_ACCESS_KEY=" and found[9] == {key + "==": 'token = "'}
    assert found[10] == {"e3b3ed3cc8548923d6": "password="}


def test_pipeline(spark, tmp_path, table):
    import corpus_pipeline

    from tessera.llm.common import documents

    rows = [(i, prose(80) if i % 9 else prose(80) + " end", ["en", "de"][i % 2], ["a", "b"][i % 2], 1) for i in range(60)]
    rows += [(100 + i, *rows[i][1:]) for i in range(5)] + [(200, rows[7][1] + " more", "en", "a", 1), (300, "... 12", "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    docs = documents(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert {r.doc_id for r in docs.collect()} == set(range(60))  # copies, the near copy and the wordless text are gone
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len([r for r in rows if r.n_tokens > 0]) > 30
    assert all(len(r.ids) == r.n_tokens and hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 and r.lang and r.source for r in rows)


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_pipeline_on_awkward_tables(spark, tmp_path, table, empty, kind):
    """Nulls, clashing columns, repeated rows; an empty table."""
    import corpus_pipeline

    (table if kind == "awkward" else empty).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns or name == "bpe"
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = Counter(r.doc_id for r in docs.collect())
    if kind == "empty":
        assert not any(kept.values())
        return
    assert not {0, 1, 2} & set(kept["language_id"])  # no letter
    assert not {5, 6, None} & set(kept["exact_dedup"]) and kept["exact_dedup"][4] == 1  # equal texts, a repeated row
    assert not {7, 8} & set(kept["jaccard_join"])


def test_release_collects_the_drivers_garbage_twice():
    """The last plan's shuffles stay after once (measured on a cluster of two executors)."""
    from types import SimpleNamespace as Made

    done = []
    release(Made(sparkSession=Made(_jvm=Made(System=Made(gc=lambda: done.append(1))))))
    assert len(done) == 2


def test_the_last_plans_shuffles_go_when_released(spark):
    """One release is enough, with no plan after it."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    held = lambda: sum(1 for d in folders for _ in Path(d.getPath()).rglob("shuffle_*.data"))
    rows = lambda: spark.range(20_000).groupBy((F.col("id") % 7).alias("k")).applyInPandas(lambda pdf: pdf.head(1), "id bigint")
    release(staged(rows(), "before"))
    release(staged(rows(), "before"))
    time.sleep(1)
    before, found = held(), staged(rows(), "after")
    assert held() > before
    release(found)
    time.sleep(1)
    assert held() <= before


def test_marks_know_all_that_are_wanted_and_few_others(spark):
    """No wanted identifier is lost; the driver holds bits of them, not keys."""
    ids = spark.range(50_000).select(F.col("id").cast("string").alias("wanted"))
    known = jaccard_join.marked(ids.filter("id % 10 = 3"), 5_000)
    found = {int(r.wanted) for r in ids.filter(known(F.xxhash64("wanted"))).collect()}
    assert set(range(3, 50_000, 10)) <= found and len(found) < 9_000


def test_rows_that_go_are_named_not_those_that_stay(spark):
    docs = spark.createDataFrame([(i, prose(40) if i % 50 else "one and the same text of some words") for i in range(200)], "doc_id bigint, text string")
    out = jaccard_join.keep_one_each(docs)
    assert "stay_id" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id for r in out.collect()} == {i for i in range(200) if i % 50 or not i}


def test_workers_give_freed_memory_back():
    code = """
import re
from pathlib import Path
from tessera.llm.common import give_back
held = lambda: sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
rows = [bytes(700) for _ in range(200_000)]
kept = rows[::1000]  # the end of the heap stays in use
del rows
before = held()
give_back()
print(before - held())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    assert float(done.stdout) > 50


def test_words_are_numbered_as_they_come():
    ids = lm_scoring.numbering()
    assert lm_scoring.numbered([b"b", b"a", b"b", b"c"], ids).tolist() == [0, 1, 0, 2]
    assert lm_scoring.numbered([b"c", b"d"], ids).tolist() == [2, 3] and list(ids) == [b"b", b"a", b"c", b"d"]


def test_strips_are_dealt_to_turns(spark):
    """Each bucket's strips are made in one turn, as they are in a single one; so disk holds one turn's shuffle."""
    rows = spark.createDataFrame([(i, prose(80)) for i in range(40)], "doc_id bigint, text string")
    table = lm_scoring.chunks(rows, F.col("doc_id") % 3 != 0, 7).persist()
    made = lambda *turn: {(r.chunk, r.bucket): tuple(r) for r in lm_scoring.stripped(table, 7, *turn).collect()}
    turns = [made(turn, 3) for turn in range(3)]
    assert all(bucket % 3 == turn for turn in range(3) for _, bucket in turns[turn])
    assert turns[0] | turns[1] | turns[2] == made()
    table.unpersist()


def test_scores_leave_only_themselves_on_disk(spark):
    """Neither tables between the stages nor shuffles are left once the scores are written."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    shuffles = lambda: {p.name.split("_")[1] for d in folders for p in Path(d.getPath()).rglob("shuffle_*.data")}
    few = prose(6).split()
    rows = spark.createDataFrame([(i, " ".join(RNG.choices(few, k=9))) for i in range(60)], "doc_id bigint, text string")
    lm_scoring.done(staged(rows, "before"))
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "tessera"
    before, held = set(root.iterdir()), shuffles()
    scores = lm_scoring.score_documents(rows)
    time.sleep(1)
    assert {p.name.split("-")[0] for p in set(root.iterdir()) - before} == {"scores"}
    assert len(shuffles() - held) <= 1  # of the last plan run to let go of the others
    assert scores.count() == 60

def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_side_beyond_its_limit_is_not_broadcast(spark, tmp_path):
    """Compressed files can be small: the planner would broadcast what few() has refused."""
    spark.range(20_000).write.parquet(f"{tmp_path}/side")
    side, rows = spark.read.parquet(f"{tmp_path}/side"), spark.range(100)
    assert "Broadcast" in plan_of(rows.join(side, "id")) and "Broadcast" in plan_of(rows.join(few(side), "id", "left"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert "Broadcast" not in plan_of(rows.join(few(side, most=1 << 20), "id", how))


@pytest.mark.parametrize("most", [0, jaccard_join.FEW])
def test_no_task_has_two_python_workers(spark, monkeypatch, most):
    """Marks are told and sets are made in Python: a shuffle stands between them, or a broadcast tells the rows."""
    seen, stage = {}, jaccard_join.staged
    monkeypatch.setattr(jaccard_join, "FEW", most)
    monkeypatch.setattr(jaccard_join, "staged", lambda df, name: (seen.setdefault(name, plan_of(df)), stage(df, name))[1])
    docs = spark.createDataFrame([(i, prose(40) if i % 50 else "one and the same text of some words") for i in range(200)], "doc_id bigint, text string")
    whole = docs.filter("doc_id % 3 = 0")
    found = jaccard_join._full_sets(docs, whole.select(F.col("doc_id").alias("least_id"), F.col("doc_id").alias("sid")), 4)
    assert found.count() == whole.count()
    lines = seen["sets"].split("\n")
    first = next(i for i, x in enumerate(lines) if "MapInPandas" in x)
    marks = [i for i, x in enumerate(lines) if "ArrowEvalPython" in x]
    assert bool(marks) == (not most) and all(any("Exchange hashpartitioning" in x for x in lines[first:i]) for i in marks)


def test_many_rows_that_go_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id bigint, text string")
    gone = docs.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("gone_id"))
    left = {i for i in range(500) if i % 7}
    assert {r.doc_id for r in jaccard_join._without(docs, gone).collect()} == left
    monkeypatch.setattr(jaccard_join, "FEW", 0)
    out = jaccard_join._without(docs, gone)
    assert "Broadcast" not in plan_of(out) and sorted(r.doc_id for r in out.collect()) == sorted(left)
