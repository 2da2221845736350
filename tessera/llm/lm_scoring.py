"""Language-model scoring with a hierarchical Pitman-Yor model.

Each word is the context of a restaurant that has a customer for each training token after it; its tables
are customers of a restaurant of words, whose tables are customers of the restaurants that spell words:
contexts of two, one and no bytes, each context's restaurant the child of the shorter one's, down to a
uniform choice of symbol. A text's probability is that of its words and its end, each given the word before
(the first one: given an end). Words that are not known from training are spelt.

Seating is sampled by Gibbs, a block at a time: all customers of a dish are seated anew given everyone
else. Up to SMALL customers the number of their tables is drawn from its exact conditional (generalised
Stirling numbers); beyond, customers come one after another, later ones by binomial steps. Within a sweep
the other dishes are those of the sweep before, so dishes are sampled side by side on many machines.
Predictive probabilities are averaged over the sweeps after the first ones.

Documents are read once, into chunks: a chunk's distinct words and pairs of words, dealt by hash of the
word, for pairs of the first word, and its documents as numbers of these words. Words and pairs meet in
their bucket, where they are counted over all training documents and each chunk's are numbered. A pair of one
occurrence has one table; the others are sampled in each sweep, for which their buckets and those of the second
words exchange tables and probabilities, words being told apart by 64-bit digests. Results go back to the chunks
by these numbers. Buckets are counted in SLICES turns, and chunks scored in as many, so that disk holds the
shuffles of one turn.
What the driver gathers are sums for strings of three bytes, at most 257 ** 3 whatever the corpus.

Defined results: null text is empty and has its end only; texts of any length are taken whole; with nothing
to learn from, words are spelt uniformly; repeated rows count each; an empty table gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER_AZ, buckets, discard, discarded, id_crc, release, ship, small_batches, staged, text_or_empty

END = b"\n"  # the end of a text, as a word: it stands in no other
CHUNK = 8 << 20
SLICES = 2
EDGE, SYMBOLS = 256, 257  # the symbol at both ends of a word
SMALL = 32
STRENGTH = 0.5


def stirling(discount: float, most: int = SMALL) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t), c and t up to `most`."""
    s = np.full((most + 1, most + 2), -np.inf)
    s[0, 0] = 0.0
    for c in range(1, most + 1):
        for t in range(1, c + 1):
            grow = c - 1 - discount * t
            s[c, t] = np.logaddexp(s[c - 1, t - 1], s[c - 1, t] + math.log(grow) if grow > 0 and t < c else -np.inf)
    return s


def seat(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables for each dish; pull: weight of a new table, (strength + discount * tables) * parent's
    probability."""
    tables = np.minimum(customers, 1).astype(np.int64)
    logs = stirling(discount)
    log_pull = np.log(np.maximum(pull, 1e-300))
    for c in range(2, SMALL + 1):
        at = np.flatnonzero(customers == c)
        if at.size:
            t = np.arange(1, c + 1)
            weight = logs[c, 1 : c + 1] + log_pull[at, None] * t
            weight = np.exp(weight - weight.max(axis=1, keepdims=True)).cumsum(axis=1)
            tables[at] = 1 + (weight < rng.random(at.size)[:, None] * weight[:, -1:]).sum(axis=1)
    at = np.flatnonzero(customers > SMALL)
    if at.size:
        c, a, t, i = customers[at].astype(np.float64), pull[at], np.ones(at.size), np.ones(at.size)
        while (i < c).any():
            step = np.minimum(np.maximum(1, np.floor(i / 16)), c - i)
            t += rng.binomial(step.astype(np.int64), np.clip(a / (a + np.maximum(i - discount * t, 1e-9)), 0, 1))
            i += step
        tables[at] = t
    return tables


def discount_of(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.05, 0.95))


class Speller:
    """The restaurants of contexts; `keys` are strings of three symbols with customers `counts`."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, sweeps: int = 3, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.keys = keys
        levels = [(keys, counts)]
        tables = [np.minimum(counts, 1)]
        for base in (SYMBOLS**2, SYMBOLS):
            short, at = np.unique(levels[-1][0] % base, return_inverse=True)
            levels.append((short, np.bincount(at, tables[-1], len(short)).astype(np.int64)))
            tables.append(np.minimum(levels[-1][1], 1))
        discounts = [discount_of(float((c == 1).sum()), float((c == 2).sum())) for _, c in levels]
        for sweep in range(sweeps + 1):
            # from the shortest context up: probabilities given the seating, then seats given these
            parent = np.full(SYMBOLS, 1 / SYMBOLS)
            probabilities = []
            for depth in (2, 1, 0):
                keys_, counts_ = levels[depth]
                context, dish = keys_ // SYMBOLS, keys_ % SYMBOLS
                contexts, at = np.unique(context, return_inverse=True)
                total, t_total = np.bincount(at, counts_), np.bincount(at, tables[depth])
                base = parent[dish] if depth == 2 else parent[keys_ % SYMBOLS**2] if depth == 1 else parent[keys_ % SYMBOLS**2]
                d = discounts[depth]
                share = (STRENGTH + d * t_total) / (STRENGTH + np.maximum(total, 0)) if len(contexts) else np.zeros(0)
                p = np.maximum(counts_ - d * tables[depth], 0) / (STRENGTH + total[at]) + share[at] * base if len(keys_) else np.zeros(0)
                probabilities.append((keys_, p, contexts, share, base, at, t_total))
                if depth == 2:
                    unigram = parent * (share[0] if len(share) else 1.0)
                    unigram[dish] = p
                    parent = np.tile(unigram, SYMBOLS)
                elif depth == 1:
                    rest = np.ones(SYMBOLS)
                    rest[contexts] = share
                    dense = (rest[:, None] * unigram[None, :]).ravel()
                    dense[keys_] = p
                    parent = dense
            if sweep == sweeps:
                break
            for depth in (0, 1, 2):
                keys_, _, _, _, base, at, t_total = probabilities[2 - depth]
                d = discounts[depth]
                if depth:  # the child's tables are this level's customers
                    child_keys = levels[depth - 1][0] % (SYMBOLS**2 if depth == 1 else SYMBOLS)
                    levels[depth] = (keys_, np.bincount(np.searchsorted(keys_, child_keys), tables[depth - 1], len(keys_)).astype(np.int64))
                pull = (STRENGTH + d * np.maximum(t_total[at] - tables[depth], 0)) * base
                tables[depth] = seat(levels[depth][1], pull, d, rng)
        self.log_seen = np.log(probabilities[2][1])
        self.log_pair = np.log(parent)  # by the two last symbols
        rest = np.ones(SYMBOLS**2)
        rest[probabilities[2][2]] = probabilities[2][3]
        self.log_rest = np.log(rest)

    def log_words(self, strings: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural logarithms of the words' probabilities; `strings`: spelled() of them."""
        pair, context = strings % SYMBOLS**2, strings // SYMBOLS
        value = self.log_rest[context] + self.log_pair[pair]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, strings), len(self.keys) - 1)
            value = np.where(self.keys[at] == strings, self.log_seen[at], value)
        return np.add.reduceat(value, np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0)


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings of three symbols of all words, one for each byte and for the end, and how many a word has."""
    sizes = np.array([len(w) for w in words], np.int64)
    lengths = sizes + 1
    symbols = np.full(int((lengths + 2).sum()), EDGE, np.int64)
    ends = np.cumsum(lengths + 2)
    inside = np.ones(len(symbols), bool)
    for i in (0, 1):
        inside[ends - lengths - 2 + i] = False
    inside[ends - 1] = False
    symbols[inside] = np.frombuffer(b"".join(words), np.uint8)
    strings = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:] if len(symbols) else symbols
    keep = np.ones(len(strings), bool)
    keep[(ends - 1)[:-1]] = False
    keep[(ends - 2)[:-1]] = False
    return strings[keep], lengths


def pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in arrays), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def digests(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def numbering() -> defaultdict:
    """A dict that numbers words as they are looked up, from 0."""
    ids = defaultdict()
    ids.default_factory = ids.__len__
    return ids


def numbered(words: list[bytes], ids: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def paired(tokens: np.ndarray, at: np.ndarray, end: int, words: int) -> np.ndarray:
    """Each token with the one before it, as one number; a text's first token stands after an end."""
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[at] = end
    return before * words + tokens


def chunks(docs: DataFrame, learn: Column, parts: int) -> DataFrame:
    """Rows of chunks: documents as numbers of the chunk's words, which stand in order of their buckets."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))

    def close(number: int, held: list, ids: defaultdict) -> pd.DataFrame:
        words, ids.default_factory = list(ids), None  # no cycle holds the words
        order = np.argsort(digests(words) % np.uint64(parts), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tokens = place[np.concatenate([h[2] for h in held])]
        out = (number, [h[0] for h in held], [h[1] for h in held], [len(h[2]) for h in held], pack(tokens.astype("<u4")), int(place[ids[END]]), b" ".join([words[i] for i in order]))
        return pd.DataFrame([out], columns=["chunk", "doc_ids", "learnt", "n_tokens", "tokens", "last", "words"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        ids = numbering()
        for batch in batches:
            for doc_id, text, learnt in zip(batch["doc_id"], batch["text"], batch["learn"], strict=True):
                words = text.encode().translate(LOWER_AZ).split()
                words.append(END)
                held.append((doc_id, bool(learnt), numbered(words, ids)))
                size += len(text)
                if size >= CHUNK:
                    yield close(number, held, ids)
                    number, held, size, ids = number + 1, [], 0, numbering()
        if held:
            yield close(number, held, ids)

    return rows.mapInPandas(run, f"chunk bigint, doc_ids array<{kind}>, learnt array<boolean>, n_tokens array<bigint>, tokens binary, last bigint, words binary")


def stripped(table: DataFrame, parts: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """Strips of the chunks' words (chunk, bucket, start, spelling, counts) with the words that follow each (degrees,
    followers, pair_counts): numbers of words, and of their pairs, run on from strip to strip. Of `turns` turns each
    has the buckets of its own remainder; disk holds the chunks only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                words, sizes = row.words.split(b" "), np.asarray(row.n_tokens)
                digest, tokens, learnt = digests(words), unpack(row.tokens, "<u4").astype(np.int64), np.repeat(np.asarray(row.learnt, bool), sizes)
                bucket, both = (digest % np.uint64(parts)).astype(np.int64), paired(tokens, np.cumsum(sizes) - sizes, int(row.last), len(words))
                mine = (bucket % turns == turn)[both // len(words)]
                pairs, at = np.unique(both[mine], return_inverse=True)
                times = np.bincount(at[learnt[mine]], minlength=len(pairs)).astype("<u4")
                train = np.bincount(tokens[learnt], minlength=len(words)).astype("<u4")
                followers = digest[pairs % len(words)]
                degrees = np.bincount(pairs // len(words), minlength=len(words)).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(degrees, dtype=np.int64)])
                cuts, out = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(words)], []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if bucket[a] % turns != turn:
                        continue
                    own = slice(ends[a], ends[b])
                    out.append((row.chunk, int(bucket[a]), a, b" ".join(words[a:b]), pack(train[a:b]), pack(degrees[a:b]), followers[own].astype("<u8").tobytes(), pack(times[own])))
                yield pd.DataFrame(out, columns=["chunk", "bucket", "start", "spelling", "counts", "degrees", "followers", "pair_counts"])

    columns = table.select("chunk", "learnt", "n_tokens", "tokens", "last", "words")
    return columns.mapInPandas(run, "chunk bigint, bucket int, start int, spelling binary, counts binary, degrees binary, followers binary, pair_counts binary")


def merged(strips: pd.DataFrame) -> tuple:
    """A bucket's distinct words and pairs with their training counts, pairs by first word and digest of the
    second; then for each strip the numbers of its words and of its pairs."""
    ids = numbering()
    own = [numbered(x.split(b" "), ids) for x in strips["spelling"]]
    found, ids.default_factory = list(ids), None  # no cycle holds the words
    total = np.zeros(len(found), np.int64)
    for at, counts in zip(own, strips["counts"], strict=True):
        total[at] += unpack(counts, "<u4")  # a chunk's words are distinct
    order = sorted(range(len(found)), key=found.__getitem__)
    words, place = [found[i] for i in order], np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    own, total = [place[at] for at in own], total[order]
    first = np.concatenate([np.repeat(i, unpack(x, "<u4")) for i, x in zip(own, strips["degrees"], strict=True)])
    second = np.concatenate([np.frombuffer(x, "<u8") for x in strips["followers"]])
    times = np.concatenate([unpack(x, "<u4") for x in strips["pair_counts"]])
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(first[order]) != 0) | (second[order][1:] != second[order][:-1])
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    count = np.bincount(at, times, int(new.sum())).astype(np.int64)
    ends = np.cumsum([len(x) // 8 for x in strips["followers"]])
    return words, total, first[order][new], second[order][new], count, own, np.split(at, ends[:-1])


def dealt(digest: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct digests in order of their buckets, where each of `digest` is among them, and the buckets."""
    distinct, at = np.unique(digest, return_inverse=True)
    bucket = (distinct % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[at], bucket[order]


def letters(origin: int, distinct: np.ndarray, bucket: np.ndarray, *sums: np.ndarray) -> Iterator[tuple]:
    """(bucket, origin, digests, sums) for each bucket that holds some of the words."""
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), origin, distinct[a:b].astype("<u8").tobytes(), pack(*[x[a:b].astype("<i8") for x in sums])


COUNTED = "kind int, bucket int, origin int, spelling binary, c binary, single binary, ctx binary, digest binary, pc binary, sums binary, tokens bigint, known bigint, ones bigint, twos bigint, tables bigint, chunk bigint, start int, own binary, codes binary"
WORDS = "bucket int, origin int, number int, spelling binary, c binary, single binary, t binary, held binary, a binary, spell binary, ones bigint, twos bigint, tables bigint"
PAIRS = "bucket int, single binary, ctx binary, digest binary, c binary, t binary, e binary, held binary, tables bigint"


def counter(parts: int):
    def run(strips: pd.DataFrame) -> pd.DataFrame:
        """Kind 0: a bucket's words; 1: its pairs of two training occurrences or more; 2: to the buckets of the
        following words, in how many pairs of one occurrence they stand and in how many at all; 3: for each strip the
        numbers of its words, and of its pairs 0 and 1 for as many training occurrences, else 2 and their number."""
        words, c, first, second, count, places, pair_places = merged(strips)
        bucket, twice, once = int(strips["bucket"].iloc[0]), count > 1, count == 1
        single = np.bincount(first[once], minlength=len(words)).astype("<i8")
        none = (None,) * 15
        nowhere = (-1, -1, None, None)
        out = [(0, bucket, -1, b" ".join(words), pack(c.astype("<i8")), *none[5:10], int(c.sum()), int((c > 0).sum()), 0, 0, 0, *nowhere)]
        out.append((1, bucket, -1, None, None, pack(single), pack(first[twice].astype("<i4")), second[twice].astype("<u8").tobytes(), pack(count[twice].astype("<i8")), None, 0, 0, int(once.sum()), int((count == 2).sum()), int((count > 0).sum()), *nowhere))
        distinct, at, goes = dealt(second[count > 0], parts)
        for to, origin, digest, sums in letters(bucket, distinct, goes, np.bincount(at, once[count > 0], len(distinct)), np.bincount(at, minlength=len(distinct))):
            out.append((2, to, origin, *none[3:7], digest, None, sums, 0, 0, 0, 0, 0, *nowhere))
        code = np.where(twice, np.cumsum(twice) + 1, count).astype("<u4")
        for chunk, start, i, j in zip(strips["chunk"], strips["start"], places, pair_places, strict=True):
            out.append((3, bucket, -1, *none[3:10], 0, 0, 0, 0, 0, int(chunk), int(start), pack(i.astype("<u4")), pack(code[j])))
        return pd.DataFrame(out, columns=[x.split()[0] for x in COUNTED.split(", ")])

    return run


def received(spelling: bytes, letters_in: pd.DataFrame, fields: int) -> tuple[np.ndarray, list]:
    """Sums for a bucket's words of what came in, and for each letter the numbers of its words."""
    digest = digests(spelling.split(b" "))
    order = np.argsort(digest)
    total, places = np.zeros((fields, len(digest)), np.int64), []
    for keys, sums in zip(letters_in["digest"], letters_in["sums"], strict=True):
        at = order[np.searchsorted(digest[order], np.frombuffer(keys, "<u8"))]
        total[:, at] += unpack(sums, "<i8").reshape(fields, -1)
        places.append(at)
    return total, places


def start_words(key: tuple, own: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
    row = own.iloc[0]
    (single, n), _ = received(row.spelling, came, 2)
    t = np.minimum(n, 1)
    return pd.DataFrame([(row.bucket, -1, 0, row.spelling, row.c, pack(single), t.astype("<i8").tobytes(), b"", None, None, int((n == 1).sum()), int((n == 2).sum()), int(t.sum()))], columns=[x.split()[0] for x in WORDS.split(", ")])


def done(df: DataFrame) -> None:
    """Delete a staged table, and let Spark drop the last plan's shuffles too: its listeners hold on to that plan until
    another one has run."""
    df.sparkSession.range(1).count()
    discard(df)


def gather_strings(words: DataFrame, seed: int) -> Speller:
    """The spelling restaurants, sampled from the words' tables: sums of at most 257 ** 3 strings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for spelling, t in zip(batch["spelling"], batch["t"], strict=True):
                strings, lengths = spelled(spelling.split(b" "))
                weight = np.repeat(np.frombuffer(t, "<i8"), lengths)
                both = np.concatenate([keys, strings[weight > 0]])
                keys, at = np.unique(both, return_inverse=True)
                sums = np.bincount(at, np.concatenate([sums, weight[weight > 0]]), len(keys)).astype(np.int64)
        yield pd.DataFrame({"string": keys, "n": sums})

    got = words.select("spelling", "t").mapInPandas(run, "string bigint, n bigint").groupBy("string").agg(F.sum("n").alias("n")).toPandas().sort_values("string")
    return Speller(got["string"].to_numpy(np.int64), got["n"].to_numpy(np.int64), seed=seed)


def ask(parts: int):
    """What the pairs of two or more tell the restaurant of words: the tables of each following word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                distinct, at, goes = dealt(np.frombuffer(row.digest, "<u8"), parts)
                yield pd.DataFrame(letters(row.bucket, distinct, goes, np.bincount(at, unpack(row.t, "<i8"), len(distinct))), columns=["bucket", "origin", "digest", "sums"])

    return run


def seat_words(speller, tables: int, discount: float, number: int, keep: bool):
    """Seats a bucket's words anew and answers the buckets that asked with customers less discounts and the
    logarithm of the spelling's probability."""

    def run(key: tuple, own: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        row = own.iloc[0]
        (more,), places = received(row.spelling, came, 1)
        n = unpack(row.single, "<i8") + more
        spell = speller.value.log_words(*spelled(row.spelling.split(b" ")))
        pull = (STRENGTH + discount * np.maximum(tables - np.frombuffer(row.t, "<i8"), 0)) * np.exp(spell)
        t = seat(n, pull, discount, np.random.default_rng([number, row.bucket]))
        a = n - discount * t
        held = row.held + (a.astype("<f4").tobytes() + spell.astype("<f4").tobytes() if keep else b"")
        out = [(row.bucket, -1, 0, row.spelling, row.c, row.single, t.astype("<i8").tobytes(), held, None, None, 0, 0, int(t.sum()))]
        for origin, at in zip(came["origin"], places, strict=True):
            out.append((row.bucket, origin, row.bucket, *(None,) * 5, a[at].astype("<f4").tobytes(), spell[at].astype("<f4").tobytes(), 0, 0, 0))
        return pd.DataFrame(out, columns=[x.split()[0] for x in WORDS.split(", ")])

    return run


def seat_pairs(tokens: int, tables: int, d_word: float, discount: float, number: int, parts: int, keep: bool):
    """Keeps what a bucket's contexts predict as seated, then seats their customers anew."""

    def run(key: tuple, own: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        row = own.iloc[0]
        single, ctx, c, t, e = unpack(row.single, "<i8"), unpack(row.ctx, "<i4"), unpack(row.c, "<i8"), unpack(row.t, "<i8"), unpack(row.e, "<f4")
        total, held = single + np.bincount(ctx, t, len(single)).astype(np.int64), row.held
        if keep:
            e, held = e + (c - discount * t).astype("<f4"), held + total.astype("<f4").tobytes()
        if len(c):
            came = came.sort_values("number")
            a, spell = (np.concatenate([np.frombuffer(x, "<f4") for x in came[k]]).astype(np.float64) for k in ("a", "spell"))
            _, at, _ = dealt(np.frombuffer(row.digest, "<u8"), parts)
            p = ((a + (STRENGTH + d_word * tables) * np.exp(spell)) / (STRENGTH + tokens))[at]
            t = seat(c, (STRENGTH + discount * np.maximum(total[ctx] - t, 0)) * p, discount, np.random.default_rng([number, row.bucket, 2]))
        return pd.DataFrame([(row.bucket, row.single, row.ctx, row.digest, row.c, pack(t.astype("<i8")), pack(e.astype("<f4")), held, int(single.sum() + t.sum()))], columns=[x.split()[0] for x in PAIRS.split(", ")])

    return run


def score_texts(docs: DataFrame, learn: Column, samples: int = 2, burn: int = 1) -> DataFrame:
    """doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = buckets(docs)
    table = staged(chunks(docs, learn, parts), "chunks")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # rows of whole buckets and chunks
    counts = []
    for turn in range(SLICES):
        strips = stripped(table, parts, turn, SLICES)
        counts.append(staged(strips.groupBy("bucket").applyInPandas(counter(parts), COUNTED), "counted", by="kind"))
        del strips
        spark.range(1).count()
        release(table)
    counted = reduce(DataFrame.unionByName, counts)
    sums = counted.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tokens", "known", "ones", "twos", "tables")]).first()
    tokens, known, customers, discount = sums["tokens"], sums["known"], sums["tables"], discount_of(sums["ones"], sums["twos"])
    zeros = F.udf(lambda c: pack(np.zeros(len(unpack(c, "<i8")), "<f4")), "binary")
    ones = F.udf(lambda c: pack(np.ones(len(unpack(c, "<i8")), "<i8")), "binary")
    pairs = counted.filter("kind = 1").select("bucket", "single", "ctx", "digest", F.col("pc").alias("c"), ones("pc").alias("t"), zeros("pc").alias("e"), F.lit(b"").alias("held"), "tables")
    own, came = counted.filter("kind = 0").select("bucket", "spelling", "c"), counted.filter("kind = 2").select("bucket", "digest", "sums")
    words = staged(own.groupBy("bucket").cogroup(came.groupBy("bucket")).applyInPandas(start_words, WORDS), "words")
    pairs = staged(pairs, "pairs")
    places = counted.filter("kind = 3").select("bucket", "chunk", "start", "own", "codes")
    for df in counts:
        for kind in (0, 1, 2):
            discarded(spark, f"{df._tessera_path}/kind={kind}")
    release(table)
    sums = words.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("ones", "twos", "tables")]).first()
    tables, d_word = sums["tables"], discount_of(sums["ones"], sums["twos"])
    levels = []  # of each sample: customers and tables of the restaurant of words
    for number in range(burn + samples):
        keep, old = number >= burn, words
        own = old.filter("origin = -1")
        speller = spark.sparkContext.broadcast(gather_strings(own, number))
        asked = pairs.mapInPandas(ask(parts), "bucket int, origin int, digest binary, sums binary")
        words = staged(own.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(seat_words(speller, tables, d_word, number, keep), WORDS), "words")
        done(old)
        tables = words.agg(F.coalesce(F.sum("tables"), F.lit(0)).alias("tables")).first()["tables"]
        if keep:
            levels.append((customers, tables))
        answers = words.filter("origin >= 0").select("origin", "number", "a", "spell")
        old = pairs
        pairs = staged(old.groupBy("bucket").cogroup(answers.groupBy("origin")).applyInPandas(seat_pairs(customers, tables, d_word, discount, number, parts, keep), PAIRS), "pairs")
        done(old)
        customers = pairs.agg(F.coalesce(F.sum("tables"), F.lit(0)).alias("tables")).first()["tables"]

    def give(key: tuple, strip: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        """To each chunk its words' counts, log probabilities and tables as contexts, of each sample, and of its
        pairs the customers less discounts."""
        if strip.empty or own.empty:
            return pd.DataFrame({x: [] for x in ("chunk", "start", "c", "p", "seated", "e")})
        row = own.iloc[0]
        c = unpack(row.c, "<i8")
        held, seated = np.frombuffer(row.held_words, "<f4").astype(np.float64).reshape(samples, 2, -1), np.frombuffer(row.held_pairs, "<f4").reshape(samples, -1)
        p = np.empty((samples, len(c)), "<f4")
        for k, (n, t) in enumerate(levels):
            with np.errstate(divide="ignore"):
                p[k] = np.logaddexp(np.log(held[k, 0]), math.log(STRENGTH + d_word * t) + held[k, 1]) - math.log(STRENGTH + n)
        e = np.concatenate([[0.0, 1 - discount], unpack(row.e, "<f4") / samples]).astype("<f4")  # by code
        out = []
        for chunk, start, i, j in zip(strip["chunk"], strip["start"], strip["own"], strip["codes"], strict=True):
            i = unpack(i, "<u4")
            out.append((chunk, start, pack(c[i]), pack(p[:, i]), pack(seated[:, i]), pack(e[unpack(j, "<u4")])))
        return pd.DataFrame(out, columns=["chunk", "start", "c", "p", "seated", "e"])

    def score(key: tuple, body: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        back = back.sort_values("start")
        c, e = (np.concatenate([unpack(x, kind) for x in back[name]]) for name, kind in (("c", "<i8"), ("e", "<f4")))
        p, seated = (np.concatenate([unpack(x, "<f4").reshape(samples, -1) for x in back[name]], axis=1).astype(np.float64) for name in ("p", "seated"))
        rest = np.log((STRENGTH + discount * seated) / (STRENGTH + c))
        base = np.log10((c + 1) / (tokens + known + 1))
        out = []
        for row in body.itertuples(index=False):
            found, sizes = unpack(row.tokens, "<u4").astype(np.int64), np.asarray(row.n_tokens)
            at = np.cumsum(sizes) - sizes
            both, where = np.unique(paired(found, at, int(row.last), len(c)), return_inverse=True)
            first, second = both // len(c), both % len(c)
            with np.errstate(divide="ignore"):
                logs = np.log(e.astype(np.float64) / (STRENGTH + c[first]))
            logs = np.logaddexp(logs, np.logaddexp.reduce(rest[:, first] + p[:, second], axis=0) - math.log(samples)) / math.log(10)
            add = lambda x: np.add.reduceat(x, at)  # noqa: B023, E731
            out.append(pd.DataFrame({"doc_id": list(row.doc_ids), "learnt": list(row.learnt), "n_tokens": list(row.n_tokens), "n_known": add((c > 0).astype(np.int64)[found]), "train_tokens": tokens, "base_score": add(base[found]), "score": add(logs[where])}))
        return pd.concat(out)

    seats = words.filter("origin = -1").select("bucket", "c", F.col("held").alias("held_words")).join(pairs.select("bucket", F.col("held").alias("held_pairs"), "e"), "bucket")
    seats = staged(seats, "seats")
    discard(words)
    discard(pairs)
    bodies = table.select("chunk", "doc_ids", "learnt", "n_tokens", "tokens", "last")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scores = []
    for turn in range(SLICES):
        mine = F.pmod(F.xxhash64("chunk"), F.lit(SLICES)) == turn  # not the hash that deals rows to partitions
        answers = places.filter(mine).groupBy("bucket").cogroup(seats.groupBy("bucket")).applyInPandas(give, "chunk bigint, start int, c binary, p binary, seated binary, e binary")
        rows = bodies.filter(mine).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, f"doc_id {kind}, learnt boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
        scores.append(staged(rows, "scores"))
        del answers, rows
        spark.range(1).count()
        release(table)
    for df in (seats, table, *counts):
        discarded(spark, df._tessera_path)
    return reduce(DataFrame.unionByName, scores)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt from rows not held out."""
    out = id_crc() % 7 == 2
    return score_texts(docs, ~out).select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


ship(__name__)
