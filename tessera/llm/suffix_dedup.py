"""Removal of repeated substrings with suffix arrays and longest-previous-factor arrays.

A string of `length` bytes that starts at two places is repeated. Anchors bring its places together: of
the GRAM-byte strings inside, the one of least hash (the leftmost of equals) is the same at both places,
so places meet in the bucket of their anchor. An anchor owns a run of start positions and thereby a window
of text. Windows that are equal as a whole, told by digests of 128 bits, are settled in the bucket, as all
their starts repeat; a task settles those it has met itself and sends one on, so a string that very many
documents share reaches its bucket as one row a task. Different windows of one anchor are fetched, joined
and sorted: a suffix array (prefix doubling up to `length`), common prefixes of neighbours, and for each
suffix the previous and next smaller position in suffix order, whose common prefixes give the longest
earlier match. Starts with an earlier match of `length` are removed when the first copy is kept; when all
copies go, starts with a later match are too. An anchor with very many different windows is split by start
position: its strings are told apart by digests of 128 bits.

Passages: beside the bytes, the same anchors over words find strings of PASSAGE words that another document
has as well. A passage of over 50 words can be shorter than `length` bytes; it is counted, not removed.

Defined results: null text is empty; texts shorter than `length` keep all bytes; overlapping and periodic
repeats count; matches never cross documents; equal rows repeat each other (and are one document for
passages); the first copy is that of the smallest doc_id as a number, identifiers that are none come last;
an empty table gives an empty table; other columns are ignored, whatever their names. Bytes are judged on
the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import buckets, drop_memos, few, input_bytes, ship, small_batches, staged, text_or_empty, word_hashes

LENGTH = 400
GRAM = 192
#: Different windows of one anchor beyond which its starts are dealt out one by one.
CROWD = 2_000
#: Words of a passage, and of the string that anchors it.
PASSAGE, WORDS = 51, 24
#: seen: 2 if the row stands for several places (documents, for passages) of its window; done: its verdict is known.
PLACE = np.dtype([("key", "<u8"), ("high", "<u8"), ("low", "<u8"), ("rid", "<i8"), ("doc", "<i8"), ("lo", "<i4"), ("run", "<i2"), ("seen", "i1"), ("done", "i1")])
FOUND = "key bigint, rid bigint, doc bigint, lo int, run int, kind int"


def units_of(data: bytes, words: bool) -> np.ndarray:
    """What strings are made of: bytes, or hashes of words."""
    return word_hashes(data) if words else np.frombuffer(data, np.uint8)


def gram_hashes(data: np.ndarray, gram: int, salt: int = 0) -> np.ndarray:
    """64-bit hashes of all strings of `gram` units, by doubling."""
    if len(data) < gram:
        return np.zeros(0, np.uint64)
    powers, rest, width, at = data.astype(np.uint64), None, 1, 0
    powers = (powers + np.uint64(1 + salt)) * np.uint64(0x9E3779B97F4A7C15 + 2 * salt)
    powers ^= powers >> np.uint64(29)
    while True:
        if gram & width:
            if rest is None:
                rest = powers[: len(data) - gram + 1 + (gram - width)]
                rest = rest if gram == width else rest.copy()
                at = width
            else:
                n = len(data) - at - width + 1
                rest = powers[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + rest[width : width + n]
                rest ^= rest >> np.uint64(31)
                at += width
        if at == gram:
            return rest[: len(data) - gram + 1]
        powers = powers[:-width] * np.uint64(0xD6E8FEB86659FD93) + powers[width:]
        powers ^= powers >> np.uint64(32)
        width *= 2


def least_places(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each run of `window` hashes the place of the least, the leftmost of equals."""
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    least = hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(hashes) - window + 1], least[window - width :])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def places(data: bytes, rid: int, doc: int, length: int = LENGTH, gram: int = GRAM, words: bool = False) -> np.ndarray:
    """The anchors of a document with the starts that each owns."""
    units = units_of(data, words)
    if len(units) < length:
        return np.zeros(0, PLACE)
    hashes = gram_hashes(units, gram)
    least = least_places(hashes, length - gram + 1)
    lo = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    hi = np.append(lo[1:], len(least))
    out = np.zeros(len(lo), PLACE)
    out["key"], out["rid"], out["doc"], out["lo"], out["run"], out["seen"] = hashes[least[lo]], rid, doc, lo, hi - lo, 1
    digest, width = xxhash.xxh3_128_digest, units.itemsize
    raw, rel = (units.tobytes() if words else data), (least[lo] - lo).tolist()
    told = [digest(raw[a * width : (b + length - 1) * width], seed=r) for a, b, r in zip(lo.tolist(), hi.tolist(), rel, strict=True)]
    told = np.frombuffer(b"".join(told), "<u8").reshape(-1, 2)
    out["high"], out["low"] = told[:, 0], told[:, 1]
    return out


class Classes:
    """Rows of places sorted by anchor, window and place, and which of them are of one window."""

    def __init__(self, rows: np.ndarray, across: bool):
        self.rows = rows = rows[np.lexsort((rows["lo"], rows["rid"], rows["doc"], rows["low"], rows["high"], rows["key"]))]
        differs = lambda *names: np.concatenate([[True], np.any([rows[n][1:] != rows[n][:-1] for n in names], axis=0)]) if len(rows) else np.zeros(0, bool)
        self.new_key = differs("key")
        self.new = differs("key", "high", "low")
        self.of, self.first = np.cumsum(self.new) - 1, np.flatnonzero(self.new)
        counted = differs("key", "high", "low", "doc", "rid") if across else np.ones(len(rows), bool)
        # places, or documents, of each window: a row that stands for several counts as many
        self.members = np.bincount(self.of, counted * (1 if across else rows["seen"]), len(self.first)).astype(np.int64)
        if across and len(rows):
            self.members = np.maximum(self.members, np.maximum.reduceat(rows["seen"], self.first))


def combined(rows: np.ndarray, across: bool) -> np.ndarray:
    """What a task sends on of the places it has met: of a window that it has met several times one row,
    which stands for them; the others' verdict is known, as the first has an earlier or a later match in them."""
    of = Classes(rows, across)
    rows, many = of.rows, of.members[of.of] > 1
    rows["seen"] = np.where(many, 2, 1)
    rows["done"] = many & ~of.new
    return rows


def settle(rows: np.ndarray, keep_first: bool, across: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket: places all of whose starts repeat; places whose windows are to be compared; whether
    each of these asks for a verdict or only serves the others; how many windows its anchor has."""
    known = rows[rows["done"] > 0]
    of = Classes(rows[rows["done"] == 0], across)
    rows = of.rows
    if not len(rows):
        return known, rows, np.zeros(0, bool), np.zeros(0, np.int64)
    of_key = (np.cumsum(of.new_key) - 1)[of.first]
    classes = np.bincount(of_key)[of_key]
    several = of.members > 1
    asks = np.ones(len(several), bool) if keep_first else ~several
    compared = (classes > 1) & (np.bincount(of_key, asks) > 0)[of_key]  # where nobody asks all is settled
    all_repeat = ~of.new if keep_first else several[of.of]
    return np.concatenate([known, rows[all_repeat]]), rows[of.first[compared]], asks[compared], classes[compared]


def suffix_array(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `starts` in order of their first `length` bytes, by prefix doubling over the whole
    text, and whether each shares all `length` bytes with the one before it. Equal ones come by position."""
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    rank = np.zeros(len(padded) - 8, np.uint64)
    for i in range(8):
        rank = rank << np.uint64(8) | padded[i : i + len(rank)]
    rank, width = np.unique(rank, return_inverse=True)[1].astype(np.int64), 8
    while width < length:
        step = min(width, length - width)
        second = np.concatenate([rank[step:], np.zeros(step, np.int64)])
        pair = rank * (int(rank.max()) + 1) + second
        if width + step >= length:
            pair = pair[starts]
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            return order, np.concatenate([[False], pair[1:] == pair[:-1]])
        rank, width = np.unique(pair, return_inverse=True)[1].astype(np.int64), width + step
    raise ValueError("length must be above 8")


def smaller_neighbours(order: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix has a previous, a next smaller position in suffix order without leaving the run
    of neighbours joined by full common prefixes: then the longest previous factor is at least as long.
    `order` holds positions; pointers jump over larger ones until they are settled."""

    def previous(order: np.ndarray, joined: np.ndarray) -> np.ndarray:
        n = len(order)
        at = np.where(joined, np.arange(n) - 1, -1)
        open_ = np.flatnonzero(at >= 0)
        while open_.size:
            larger = order[at[open_]] > order[open_]
            open_ = open_[larger]
            at[open_] = at[at[open_]]
            open_ = open_[at[open_] >= 0]
        return at >= 0

    before = previous(order, joined)
    turned = np.concatenate([[False], joined[1:][::-1]]) if len(joined) else joined
    return before, previous(order[::-1], turned)[::-1]


def repeated_starts(windows: list[bytes], owned: np.ndarray, rank: np.ndarray, length: int, keep_first: bool) -> list[np.ndarray]:
    """For each window, which of its first `owned` starts are to be removed; `rank`: order of windows."""
    by_rank = np.argsort(rank, kind="stable")
    sizes = np.array([len(windows[i]) for i in by_rank], np.int64)
    offset = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join([windows[i] for i in by_rank]), np.uint8)
    count = owned[by_rank]
    starts = np.repeat(offset - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    order, joined = suffix_array(data, starts, length)
    previous, following = smaller_neighbours(order, joined)
    gone = np.zeros(len(starts), bool)
    gone[order] = previous | following
    if not keep_first:  # a later match: the same on the order turned around
        previous, following = smaller_neighbours(-order, joined)
        gone[order] |= previous | following
    pieces = np.split(gone, np.cumsum(count)[:-1])
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(windows)
    for i, piece in zip(by_rank, pieces, strict=True):
        out[i] = piece
    return out


def runs_of(flags: np.ndarray, lo: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(lo + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc (its number) and rid: equal rows share both, others don't."""
    text = text_or_empty()
    number = F.coalesce(F.col("doc_id").try_cast("bigint"), F.lit((1 << 63) - 1))
    return docs.select("doc_id", text.alias("text"), number.alias("doc"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).alias("rid"))


def strips(held: list[np.ndarray], across: list[bool], parts: int) -> pd.DataFrame:
    """Places by bucket, those of passages in buckets of their own; what is settled goes by its document."""
    out = []
    for shift, words in ((0, False), (parts, True)):
        if some := [h for h, w in zip(held, across, strict=True) if w == words and len(h)]:
            found = combined(np.concatenate(some), words)
            bucket = (np.where(found["done"] > 0, found["rid"].view("<u8"), found["key"]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for piece in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                out.append((int(bucket[piece[0]]) + shift, found[piece].tobytes()))
    return pd.DataFrame(out, columns=["bucket", "places"]).astype({"bucket": "int32"})


def judge(pdf: pd.DataFrame, keep_first: bool, parts: int, crowd: int) -> pd.DataFrame:
    """kind 0: all starts repeat; 1: to be compared and asking; 2: serving; 3: of a crowded anchor. Passages: 10 on."""
    words = int(pdf["bucket"].iloc[0]) >= parts
    full, windows, asks, classes = settle(np.frombuffer(b"".join(pdf["places"]), PLACE), keep_first and not words, words)
    make = lambda r: {"key": r["key"].view("<i8"), "rid": r["rid"], "doc": r["doc"], "lo": r["lo"], "run": r["run"]}
    kind = 13 if words else np.where(classes > crowd, 3, np.where(asks, 1, 2))
    return pd.concat([pd.DataFrame(make(full) | {"kind": 10 * words}), pd.DataFrame(make(windows) | {"kind": kind})])


def merged(pdf: pd.DataFrame, length: int, passage: int) -> pd.DataFrame:
    """One row for each document of a bucket: its removed runs, and how many of its words stand in passages."""
    rows = pdf[["doc", "rid", "lo", "run"]].to_numpy(np.int64)
    words = pdf["kind"].to_numpy() >= 10
    ids, at = np.unique(rows[:, :2], axis=0, return_inverse=True)
    at = at.ravel()

    def covered(some: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, start and end of each maximal run; documents lie one after another on one line."""
        lo = (at[some] << 33) + rows[some, 2]
        order = np.argsort(lo, kind="stable")
        lo, of = lo[order], at[some][order]
        if not len(lo):
            return of, lo, lo
        hi = np.maximum.accumulate(lo + rows[some, 3][order] + size - 1)
        new = np.concatenate([[True], lo[1:] > hi[:-1]])
        return of[new], lo[new] - (of[new] << 33), hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)] - (of[new] << 33)

    of, low, high = covered(words, passage)
    counts = np.bincount(of, high - low, len(ids)).astype(np.int64)
    of, low, high = covered(~words, length)
    spans = np.column_stack([low, high]).astype("<i8")
    cuts = np.searchsorted(of, np.arange(len(ids) + 1))
    return pd.DataFrame({"doc": ids[:, 0], "rid": ids[:, 1], "spans": [spans[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], "n_passage_words": counts})


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, gram: int = GRAM, crowd: int = CROWD, passage: int = PASSAGE, words: int = WORDS) -> DataFrame:
    """doc, rid, spans (start and end of each maximal removed run, as little-endian 64-bit integers) and
    n_passage_words for rows of keyed() that lose bytes or have passages; passage 0: none are sought."""
    small_batches(docs.sparkSession)
    rows, parts = keyed(docs), buckets(docs)

    def anchor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_memos()
        held, kinds, size = [], [], 0
        for batch in batches:
            for text, rid, doc in zip(batch["text"], batch["rid"], batch["doc"], strict=True):
                data = text.encode()
                held.append(places(data, rid, doc, length, gram))
                kinds.append(False)
                if passage:
                    held.append(places(data, rid, doc, passage, words, True))
                    kinds.append(True)
                size += sum(map(len, held[-2:]))
            if size > 300_000:
                yield strips(held, kinds, parts)
                held, kinds, size = [], [], 0
        if held:
            yield strips(held, kinds, parts)

    dealt = rows.select("text", "rid", "doc").mapInPandas(anchor, "bucket int, places binary")
    judged = staged(dealt.groupBy("bucket").applyInPandas(lambda pdf: judge(pdf, keep_first, parts, crowd), FOUND), "places")

    # windows to be compared, cut from their documents
    asked = judged.filter("kind not in (0, 10)").groupBy("doc", "rid").agg(F.collect_list(F.struct("key", "lo", "run", "kind")).alias("windows"))
    asked = staged(asked, "asked")
    affected = rows.select("doc", "rid", "text").dropDuplicates(["doc", "rid"]) if _repeated(docs) else rows.select("doc", "rid", "text")
    affected = affected.join(few(asked.select("doc", "rid")), ["doc", "rid"], "left_semi").join(asked, ["doc", "rid"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, rid, text, windows in zip(batch["doc"], batch["rid"], batch["text"], batch["windows"], strict=True):
                data = text.encode()
                out += [(w["key"], rid, doc, w["lo"], w["run"], w["kind"], data[w["lo"] : w["lo"] + w["run"] + length - 1]) for w in windows if w["kind"] < 3]
            yield pd.DataFrame(out, columns=["key", "rid", "doc", "lo", "run", "kind", "data"])

    windows = staged(affected.mapInPandas(cut, FOUND + ", data binary"), "windows")
    groups = max(96, input_bytes(windows) // (1 << 20))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "doc", "rid", "lo"], ignore_index=True)
        out, begin, held = [], 0, 0
        ends = np.flatnonzero(np.append(pdf["key"].to_numpy()[1:] != pdf["key"].to_numpy()[:-1], True)) + 1
        size = pdf["data"].str.len().to_numpy()
        for end, bound in zip(ends, [*ends[1:], None], strict=True):  # whole anchors, about a megabyte at a time
            held = int(size[begin:end].sum())
            if bound is not None and held + int(size[end:bound].sum()) <= 1 << 20:
                continue
            some = pdf.iloc[begin:end]
            found = repeated_starts(list(some["data"]), some["run"].to_numpy(np.int64), np.arange(len(some)), length, keep_first)
            for rid, doc, lo, kind, flags in zip(some["rid"], some["doc"], some["lo"], some["kind"], found, strict=True):
                if kind == 1 and flags.any():
                    out += [(rid, doc, a, b, 0) for a, b in runs_of(flags, lo)]
            begin = end
        return pd.DataFrame(out, columns=["rid", "doc", "lo", "run", "kind"]).astype({"rid": "int64", "doc": "int64", "lo": "int32", "run": "int32", "kind": "int32"})

    partly = windows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("group").applyInPandas(compare, "rid bigint, doc bigint, lo int, run int, kind int")

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each start of a passage's window, or of a crowded anchor's, with the digest of its string."""
        held, kinds, size = [], [], 0
        for batch in batches:
            for doc, rid, text, windows in zip(batch["doc"], batch["rid"], batch["text"], batch["windows"], strict=True):
                for kind, of_words, count in ((3, False, length), (13, True, passage)):
                    some = np.array([(w["lo"], w["run"]) for w in windows if w["kind"] == kind], np.int64).reshape(-1, 2)
                    if not len(some):
                        continue
                    units, run = units_of(text.encode(), of_words), some[:, 1]
                    at = np.repeat(some[:, 0] - (np.cumsum(run) - run), run) + np.arange(run.sum())
                    out = np.zeros(len(at), PLACE)
                    out["key"], out["high"] = gram_hashes(units, count)[at], gram_hashes(units, count, 1)[at]
                    out["rid"], out["doc"], out["lo"], out["run"], out["seen"] = rid, doc, at, 1, 1
                    held.append(out)
                    kinds.append(of_words)
                    size += len(out)
            if size > 300_000:
                yield strips(held, kinds, parts)
                held, kinds, size = [], [], 0
        if held:
            yield strips(held, kinds, parts)

    by_start = affected.filter(F.exists("windows", lambda w: w["kind"].isin(3, 13))).mapInPandas(starts, "bucket int, places binary")
    by_start = by_start.groupBy("bucket").applyInPandas(lambda pdf: judge(pdf, keep_first, parts, crowd), FOUND)
    columns = ["rid", "doc", "lo", "run", "kind"]
    spans = judged.filter("kind in (0, 10)").select(*columns).unionByName(partly.select(*columns)).unionByName(by_start.filter("kind in (0, 10)").select(*columns))
    return staged(spans.groupBy(F.pmod("rid", F.lit(groups)).alias("part")).applyInPandas(lambda pdf: merged(pdf, length, passage), "doc bigint, rid bigint, spans binary, n_passage_words bigint"), "spans")


def _repeated(docs: DataFrame) -> bool:
    return bool(docs.groupBy("doc_id").count().filter("count > 1").take(1))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, keep_text: bool = False, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passage_words (words in strings of `passage`
    words that another document has, too) for each row; with keep_text the bytes that stay and the removed
    spans. sizes: those of repeated_spans()."""
    spans = repeated_spans(docs, length, keep_first, **sizes).withColumnsRenamed({"rid": "s_rid", "doc": "s_doc"})
    rows = keyed(docs)
    side = few(spans, 256)
    joined = rows.join(side, (F.col("rid") == F.col("s_rid")) & (F.col("doc") == F.col("s_doc")), "left").select("doc_id", "text", "spans", F.coalesce("n_passage_words", F.lit(0)).alias("n_passage_words"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, blob, words in zip(batch["doc_id"], batch["text"], batch["spans"], batch["n_passage_words"], strict=True):
                data = text.encode()
                cuts = np.frombuffer(blob, "<i8").reshape(-1, 2).tolist() if blob is not None else []
                edges = [0, *[x for cut in cuts for x in cut], len(data)]
                kept = b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                out.append((doc_id, len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), words, kept, [x for cut in cuts for x in cut]))
            made = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "kept", "spans"])
            yield made if keep_text else made.drop(columns=["kept", "spans"])

    return joined.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_words bigint" + ", kept binary, spans array<bigint>" * keep_text)


ship(__name__)
