"""Byte-level BPE encoding and decoding.

Merges are found with a segment tree over the ranks of adjacent pairs: the root holds the lowest rank,
a descent that prefers the left child finds its leftmost place, and a merge is three point updates of
logarithmic cost. Words of one length are merged side by side, a tree a row, in numpy.

Defined results: null text is encoded as the empty text (no tokens); any length of text or of a single
word is taken whole; repeated rows give repeated results; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, ship, small_batches, text_or_empty, worker_memo

#: The public byte-level pre-tokenization pattern (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
#: Words, and runs between spaces, that a Python worker remembers.
MEMO = 100_000
#: Pair table: slots (a power of two, many times the merges) and the multiplier of its hash.
SLOTS, SPREAD = 1 << 20, np.int64(0x1E3779B97F4A7C15)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


def load_vocabulary(path: str) -> dict:
    """The tables of a tokenizers JSON file; its size bounds what is broadcast."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    symbols, vocab = byte_symbols(), spec["model"]["vocab"]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = 1 + max([*vocab.values(), *added.values()])
    pieces = [b""] * size
    for token, i in vocab.items():
        pieces[i] = bytes(symbols[c] for c in token)
    for token, i in added.items():
        pieces[i] = token.encode()
    pairs = []
    for rank, merge in enumerate(spec["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs.append((vocab[left] * size + vocab[right], rank, vocab[left + right]))
    slot_key, slot_rank = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int32)
    hashed = np.array([key for key, _, _ in pairs], np.int64) * SPREAD >> 44 & SLOTS - 1
    for (key, rank, _), slot in zip(pairs, hashed.tolist(), strict=True):
        while slot_key[slot] >= 0:
            slot = slot + 1 & SLOTS - 1
        slot_key[slot], slot_rank[slot] = key, rank
    alphabet = np.zeros(256, np.int64)
    for symbol, byte in symbols.items():
        alphabet[byte] = vocab[symbol]
    return {"size": size, "slot_key": slot_key, "slot_rank": slot_rank, "merged": np.array([m for _, _, m in pairs], np.int64), "alphabet": alphabet, "pieces": pieces, "added": added}


def _pair_ranks(tables: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of each pair; NONE: they don't merge. Open addressing, probed until all are settled."""
    wanted = left * tables["size"] + right
    slot = wanted * SPREAD >> 44 & SLOTS - 1
    found = tables["slot_key"][slot]
    rank = np.where(found == wanted, tables["slot_rank"][slot], NONE)
    open_ = np.flatnonzero((found != wanted) & (found >= 0))
    while open_.size:
        slot[open_] = slot[open_] + 1 & SLOTS - 1
        found = tables["slot_key"][slot[open_]]
        hit = found == wanted[open_]
        rank[open_[hit]] = tables["slot_rank"][slot[open_[hit]]]
        open_ = open_[~hit & (found >= 0)]
    return rank


def merge_words(tables: dict, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of words of one length, word after word, and how many each has; `words` is a matrix of
    bytes, a row for each word."""
    count, length = words.shape
    symbols = tables["alphabet"][words]
    if length < 2:
        return symbols.ravel(), np.full(count, length)
    width = 1 << (length - 2).bit_length() if length > 2 else 1
    tree = np.full((count, 2 * width), NONE, np.int32)
    tree[:, width : width + length - 1] = _pair_ranks(tables, symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(count, -1)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    after = np.tile(np.arange(1, length + 1), (count, 1)).ravel()
    before = np.tile(np.arange(-1, length - 1), (count, 1)).ravel()
    alive = np.ones((count, length), bool)
    nodes, ids, live = tree.ravel(), symbols.ravel(), alive.ravel()  # views
    depth = width.bit_length() - 1
    row = np.flatnonzero(tree[:, 1] != NONE)
    while row.size:
        base, first = row * (2 * width), row * length
        lowest = nodes[base + 1]
        node = np.ones(row.size, np.int64)
        for _ in range(depth):
            node += node
            node += nodes[base + node] != lowest  # to the right only if the left half lacks the root's rank
        left = node - width
        here = first + left
        right = after[here]
        gone = first + right
        beyond = after[gone]
        prior = before[here]
        ids[here] = tables["merged"][lowest]
        live[gone] = False
        after[here] = beyond
        inner, has = np.flatnonzero(beyond < length), np.flatnonzero(prior >= 0)
        before[first[inner] + beyond[inner]] = left[inner]
        ranks = _pair_ranks(tables, np.concatenate([ids[here[inner]], ids[first[has] + prior[has]]]), np.concatenate([ids[first[inner] + beyond[inner]], ids[here[has]]]))
        nodes[base + left + width] = NONE
        shut = np.flatnonzero(right < length - 1)
        nodes[base[shut] + right[shut] + width] = NONE
        nodes[base[inner] + left[inner] + width] = ranks[: inner.size]
        nodes[base[has] + prior[has] + width] = ranks[inner.size :]
        at = np.concatenate([left, right[shut], prior[has]]) + width
        of = np.concatenate([base, base[shut], base[has]])
        for _ in range(depth):  # point updates, all three leaves of all words a level at a time
            at >>= 1
            up = of + at
            child = up + at
            nodes[up] = np.minimum(nodes[child], nodes[child + 1])
        row = row[nodes[base + 1] != NONE]
    return symbols[alive], alive.sum(axis=1)


class Encoder:
    """Encodes and decodes batches; memoizes the ids of words and of the runs between single spaces."""

    def __init__(self, tables: dict, words: dict | None = None, runs: dict | None = None):
        self.tables = tables
        self.words, self.runs = {} if words is None else words, {} if runs is None else runs
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(tables["added"], key=len, reverse=True))) + ")") if tables["added"] else None
        self.lengths = np.array([len(p) for p in tables["pieces"]], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(tables["pieces"]), np.uint8)

    def learn(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        raw = {word: word.encode() for word in words}
        for word, code in raw.items():
            by_length.setdefault(len(code), []).append(word)
        for length, group in by_length.items():
            step = max(1, 4_000_000 // (length * 8))
            for at in range(0, len(group), step):
                some = group[at : at + step]
                matrix = np.frombuffer(b"".join([raw[word] for word in some]), np.uint8).reshape(-1, length)
                ids, sizes = merge_words(self.tables, matrix)
                ends = (4 * np.cumsum(sizes)).tolist()
                blob = ids.astype("<u4").tobytes()
                self.words.update(zip(some, [blob[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))

    def parts(self, text: str) -> list[str]:
        """The text in pieces that the pre-tokenizer never joins; a piece without its leading single space
        has it left out, one that begins otherwise has a space put before it (no other piece can hold one)."""
        if "  " in text or text[-1:].isspace() or text[:1].isspace():
            return [" " + w for w in self.split.findall(text)]
        head, *rest = text.split(" ")
        return [" " + head, *rest]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        plans: list[list] = []
        missing: set[str] = set()
        get = self.runs.get
        for text in texts:
            plan: list = []
            bits = self.special.split(text) if self.special and any(a in text for a in self.tables["added"]) else [text]
            for i, bit in enumerate(bits):
                if i % 2:
                    plan.append(int(self.tables["added"][bit]).to_bytes(4, "little"))
                elif bit:
                    parts = self.parts(bit)
                    known = list(map(get, parts))
                    if None in known:
                        missing.update([p for p, k in zip(parts, known, strict=True) if k is None])
                        plan.append(parts)
                    else:
                        plan.append(b"".join(known))
            plans.append(plan)
        split = {run: self.split.findall(run[1:] if run[:1] == " " else " " + run) for run in missing}
        self.learn({w for ws in split.values() for w in ws if w not in self.words})
        look = self.words.__getitem__
        for run, words in split.items():
            self.runs[run] = b"".join(map(look, words))
        look = self.runs.__getitem__
        return [b"".join([p if isinstance(p, bytes) else b"".join(map(look, p)) for p in plan]) for plan in plans]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become the replacement character."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.blob[at].tobytes().decode("utf-8", "replace").encode()


def bpe_round_trip(docs: DataFrame, vocabulary_path: str, keep_ids: bool = False, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; with keep_ids the ids as an array, with
    keep_text the decoded text, and the columns of `carry`."""
    spark = docs.sparkSession
    small_batches(spark)
    tables = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    rows = docs.select("doc_id", text_or_empty().alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    carried = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text + carried

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        encoder = Encoder(tables.value, worker_memo("bpe_words", MEMO), worker_memo("bpe_runs", MEMO))
        for batch in batches:
            encoder.words, encoder.runs = worker_memo("bpe_words", MEMO), worker_memo("bpe_runs", MEMO)
            coded = encoder.encode(batch["text"].tolist())
            ids = [np.frombuffer(c, "<u4") for c in coded]
            text = [encoder.decode(i) for i in ids]
            out = pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(i) for i in ids], "ids_sha256": [hashlib.sha256(c).hexdigest() for c in coded], "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in text]})
            if keep_ids:
                out["ids"] = [i.astype(np.int32) for i in ids]
            if keep_text:
                out["decoded"] = [t.decode() for t in text]
            for c in carry:
                out[c] = batch[f"carry_{c}"]
            yield out

    return rows.mapInPandas(run, schema)


ship(__name__)
