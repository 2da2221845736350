"""Licence scans with a positional rare-token index.

Templates, whole licences and the notices that name them, are indexed by word: for each word its inverse
document frequency over the templates and its postings (template, position), kept for the words of highest
IDF of each template. A file's licence words are looked up, those of the highest IDF first, and the postings
found are intersected by relative position: a posting at template position p under a word at file position
q speaks for an alignment that starts at q - p. Only alignments for which at least half of a template's rare
words speak are compared with the whole template, and a label is given only if its mandatory key phrases
stand inside the aligned words. What a file costs depends on the postings of its own words, not on how many
templates there are. The base phrases are found beside, as consecutive words.

Defined results: null and empty texts have no words and no labels; texts of any length are scanned whole;
matches that overlap all count; equal scores give all their labels; repeated rows give repeated results;
an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.llm.common import LOWER_AZ, drop_memos, ship, small_batches, text_or_empty
from tessera.llm.license_texts import TEMPLATES

#: The phrases of the contract.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Bytes that stand in no word become spaces; A-Z become a-z.
TO_WORDS = bytes(
    LOWER_AZ[b] if b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split()


class Index:
    """Postings of the templates' words of highest IDF, `rare` of each template."""

    def __init__(self, templates=TEMPLATES, base=BASE, rare: int = 6, accept: float = 0.8):
        self.rows = [(label, words_of(text), [words_of(k) for k in keys]) for label, text, keys in templates]
        self.base = [(phrase.encode().split(), label) for phrase, label in base.items()]
        self.accept = accept
        seen = Counter(w for _, words, _ in self.rows for w in set(words))
        self.idf = {w: math.log(1 + len(self.rows) / n) for w, n in seen.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []  # how many rare words must speak for an alignment
        for t, (_, words, _) in enumerate(self.rows):
            sought = sorted(set(words), key=lambda w: (-self.idf[w], w))[:rare]
            self.needed.append(-(-len(sought) // 2))
            for p, w in enumerate(words):
                if w in sought:
                    self.postings[w].append((t, p))
        self.anchors = frozenset(self.postings) | {phrase[1] for phrase, _ in self.base}
        self.wanted = frozenset(self.idf) | {w for phrase, _ in self.base for w in phrase}

    def phrase_starts(self, where: dict[bytes, list[int]], words: list[bytes], phrase: list[bytes]) -> list[int]:
        n = len(phrase)
        return [q for q in where.get(phrase[0], ()) if words[q : q + n] == phrase]

    def scan(self, blob: bytes) -> tuple[int, list[int], set[str], set[str], float]:
        """Words, starts of base phrases, base labels, all labels, best score."""
        words = blob.split()
        met = self.anchors.intersection(words)
        if not met:
            return len(words), [], set(), set(), 0.0
        wanted, where = self.wanted, defaultdict(list)
        for q, w in enumerate(words):
            if w in wanted:
                where[w].append(q)
        starts, base, score = [], set(), 0.0
        for phrase, label in self.base:
            if found := self.phrase_starts(where, words, phrase):
                starts += found
                base.add(label)
                score = 1.0
        labels, votes = set(base), defaultdict(set)
        for w in sorted(met & self.postings.keys(), key=lambda w: (-self.idf[w], w)):
            for t, p in self.postings[w]:
                for q in where[w]:
                    votes[t, q - p].add(w)
        for (t, start), speakers in votes.items():
            # a word put in or left out moves what follows to a neighbouring alignment
            if len(set().union(*[votes.get((t, start + d), ()) for d in (-1, 1)], speakers)) >= self.needed[t]:
                share = self.align(t, start, where, words)
                if share >= self.accept:
                    labels.add(self.rows[t][0])
                    score = max(score, share)
        return len(words), starts, base, labels, min(1.0, score)

    def align(self, t: int, start: int, where: dict, words: list[bytes], slack: int = 2) -> float:
        """The share, weighted by IDF, of the template's words met in place by the alignment that starts
        there; 0 without the key phrases."""
        _, template, keys = self.rows[t]
        low, high = start - slack, start + len(template) + slack
        if not all(any(low <= q <= high for q in self.phrase_starts(where, words, key)) for key in keys):
            return 0.0
        near = lambda w, p: bisect_right(where.get(w, ()), start + p + slack) > bisect_left(where.get(w, ()), start + p - slack)
        return sum(self.idf[w] for p, w in enumerate(template) if near(w, p)) / sum(self.idf[w] for w in template)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE, rare: int = 6, accept: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    index = Index(templates, base, rare, accept)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_memos()
        for batch in batches:
            found = [index.scan(text.encode().translate(TO_WORDS)) for text in batch["text"]]
            first = pd.array([min(f[1], default=None) for f in found], dtype="Int64")
            last = pd.array([max(f[1], default=None) for f in found], dtype="Int64")
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_words": [f[0] for f in found], "n_base": [len(f[1]) for f in found], "first_word": first, "last_word": last,
                "base_labels": [",".join(sorted(f[2])) for f in found], "labels": [",".join(sorted(f[3])) for f in found], "score": [f[4] for f in found],
            })

    return rows.mapInPandas(run, schema)


ship(__name__)
