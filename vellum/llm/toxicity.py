"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary documents, back off from bigrams to unigrams by the
diversity of their contexts (a word's distinct successors in the class) and from there to counts
shared by both classes, gathered from every document of the corpus, labelled or not. Counts are of
documents with a word or bigram. Every word and bigram keeps its counts, however rare; a ratio of the
classes counts as far as these make it likely that the classes differ, and what is left of the weight
goes to the level below, so that noise of many rare words doesn't outweigh a few telling ones.

The score compares length-normalised log-likelihoods: of the whole text and of the most toxic run of
``window`` words, so that a long text does not hide a short passage. A logistic curve, fitted on a
bounded sample of labelled documents that the counts leave out, makes it a probability.

No table is held whole by a task: texts are cut to chunks, each asks once for each of its words and
bigrams, the hashes of all chunks meet in buckets whose number grows with the corpus, are summed there,
and the sums go back to the chunks that asked. A hot word is one row of each chunk's list. Pairs that a
bitmap of the labelled texts' pairs rules out are not asked for: their counts are 0. Words and
bigrams are compared by hashes of 14 bits more than the corpus's tokens are counted by, 64 at most, so that
fewer than one in 16,000 meets another.

Defined results: null, empty and blank texts get the score of no evidence; repeated rows are scored
alike; with no labelled documents every score is 0.5 less an epsilon; conflicting labels of one
document each count; extra columns are ignored. doc_id, lang and source never enter a score.
"""

from __future__ import annotations

import functools
import string

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import broadcast_if_small, dropped, fold_of, freed, give_back, mix64, saved, word_hashes, words_of

WINDOW = 40
MAX_FIT = 20_000
DISCOUNT = 0.75
PRIOR_G = 16.0
CHUNK_TOKENS = 600_000
BUCKET_TOKENS = 800_000
LEAST_BITS, MOST_BITS, BLOCK_BITS = 20, 28, 6
SPARE_BITS = 14
LEAST_BUCKETS = 64
#: The requests and the features are made in so many shares each, whose shuffles are on disk one at a time.
PAIR_SHARES, WORD_SHARES, FEATURE_SHARES = 2, 3, 8
_STRIP = string.punctuation.encode()
_EMPTY = word_hashes([b""])[0]  # cut to the bits in use where compared
_COUNTS = ("a", "b", "c", "d", "e", "f", "g")
_LISTS = "bucket long, chunk long, keys binary, " + ", ".join(f"{c} binary" for c in _COUNTS)


def _tokens(text: str | None) -> list[bytes]:
    return [w.strip(_STRIP) for w in words_of(text.lower())] if text else []


def _pack(a: np.ndarray) -> bytes:
    """An array as compressed planes of bytes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
    return len(a).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(b: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(b[8:], n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).ravel()


def _pack_sorted(a: np.ndarray) -> bytes:
    """Sorted integers as their differences, whose upper bytes are mostly 0."""
    return _pack(np.diff(a, prepend=a.dtype.type(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint64), dtype=np.uint64)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


_CHUNK = pa.schema([("chunk", pa.int64()), ("tokens", pa.int64()), ("bits", pa.int32())] + [(c, pa.binary()) for c in ("texts", "kinds", "sizes", "ids", "ranked", "vocabulary")])
_LIST = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary())] + [(c, pa.binary()) for c in _COUNTS])
_FEATURES = pa.schema([("_h", pa.int64()), ("_whole", pa.float64()), ("_window", pa.float64())])


def _chunks(kinds: DataFrame, bits: int = 64) -> DataFrame:
    """Texts of (_h, text, toxic) as places in a sorted list of their words' hashes, many texts a row. On disk a place is its
    rank by frequency, as small numbers compress better."""

    def cut(batches):
        task, n = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {}
        texts, kind, ids = [], [], []
        size = 0

        def out():
            h = word_hashes(list(number)) >> np.uint64(64 - bits)
            vocabulary, place = np.unique(h, return_inverse=True)
            flat = place.astype(np.int32)[np.concatenate(ids)]
            ranked = np.argsort(-np.bincount(flat, minlength=len(vocabulary)), kind="stable").astype(np.int32)
            rank = np.empty_like(ranked)
            rank[ranked] = np.arange(len(ranked), dtype=np.int32)
            row = (task << 32 | n, len(flat), bits, _pack(np.array(texts, np.int64)), _pack(np.array(kind, np.int8)), _pack(np.fromiter(map(len, ids), np.int32, len(ids))), _pack(rank[flat]), _pack(ranked), _pack_sorted(vocabulary))
            return _batch([row], _CHUNK)

        for batch in batches:
            for h, text, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = _tokens(text)
                if not words:
                    continue
                texts.append(h)
                kind.append(k)
                ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
                size += len(words)
                if size >= CHUNK_TOKENS:
                    yield out()
                    n, size = n + 1, 0
                    for x in (number, texts, kind, ids):
                        x.clear()
        if ids:
            yield out()

    schema = "chunk long, tokens long, bits int, texts binary, kinds binary, sizes binary, ids binary, ranked binary, vocabulary binary"
    return kinds.mapInArrow(freed(cut), schema)


class _Chunk:
    """Words, and pairs of words that follow each other in a text; ``pair`` has each pair's place in ``keys``."""

    def __init__(self, row: dict):
        self.bits = row["bits"]
        self.vocabulary = _unpack_sorted(row["vocabulary"])
        self.ids = _unpack(row["ranked"], np.int32)[_unpack(row["ids"], np.int32)]
        self.sizes = _unpack(row["sizes"], np.int32)
        self.kinds = _unpack(row["kinds"], np.int8)
        self.texts = _unpack(row["texts"], np.int64)
        self.text = np.repeat(np.arange(len(self.sizes), dtype=np.int64), self.sizes)

    def words(self) -> list[np.ndarray]:
        """Texts of each kind with each word: toxic, ordinary, other."""
        size = len(self.vocabulary)
        seen = np.unique(self.text * size + self.ids)
        kind, word = self.kinds[seen // size], seen % size
        return [np.bincount(word[kind == k], minlength=size) for k in (1, 0, 2)]

    def pairs(self, within: tuple[int, int, int] | None = None) -> None:
        """Find the pairs; ``within`` (buckets, lo, hi), only those of buckets lo to hi."""
        size = len(self.vocabulary)
        some = self.vocabulary[self.ids] != _EMPTY >> np.uint64(64 - self.bits)
        second = np.nonzero((self.text[1:] == self.text[:-1]) & some[1:] & some[:-1])[0] + 1
        code, place = np.unique(self.ids[second - 1].astype(np.int64) * size + self.ids[second], return_inverse=True)
        first = code // size
        key = mix64(mix64(self.vocabulary[first]) + self.vocabulary[code % size]) >> np.uint64(64 - self.bits)
        if within is not None:
            of = _bucket_of(key, within[0], self.bits)
            keep = (of >= np.uint64(within[1])) & (of < np.uint64(within[2]))
            here = keep[place]
            second, place = second[here], (np.cumsum(keep) - 1)[place[here]]
            key, first = key[keep], first[keep]
        self.keys, at, back = np.unique(key, return_index=True, return_inverse=True)
        self.second, self.first, self.pair = second, first[at], back.astype(np.int32)[place]

    def only(self, asked: np.ndarray) -> None:
        """Leave the pairs whose keys are asked for."""
        here = asked[self.pair]
        self.second, self.pair = self.second[here], (np.cumsum(asked, dtype=np.int32) - 1)[self.pair[here]]
        self.keys, self.first = self.keys[asked], self.first[asked]

    def pair_counts(self) -> list[np.ndarray]:
        """Toxic and ordinary texts with each pair."""
        labelled = self.kinds[self.text[self.second]] < 2
        size = max(1, len(self.keys))
        seen = np.unique(self.text[self.second[labelled]] * size + self.pair[labelled])
        kind, pair = self.kinds[seen // size], seen % size
        return [np.bincount(pair[kind == k], minlength=len(self.keys)) for k in (1, 0)]


def _slot(keys: np.ndarray, slot_bits: int, bits: int) -> np.ndarray:
    """The hashes' upper bits, so that a range of buckets has its slots side by side."""
    return (keys >> np.uint64(bits - slot_bits)).astype(np.int64)


def _holds(known: tuple[int, int, np.ndarray], keys: np.ndarray, bits: int) -> np.ndarray:
    """Which keys have their slots in a bitmap of _bitmap(), which must reach as far as they do."""
    slot = _slot(keys, known[0], bits) - known[1]
    return (known[2][slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0


def _known_blocks(tokens: DataFrame, size: int) -> tuple[DataFrame, int]:
    """A bitmap of hash slots of the pairs in labelled texts, saved in blocks, and its bits. Pairs in no other slot need not be
    asked for, as their counts are 0. It follows the size of the corpus up to ``MOST_BITS``; when it fills up it only lets more
    pairs be asked for."""
    bits = int(np.clip((2 * size).bit_length(), LEAST_BITS, MOST_BITS))
    block_bits = bits - BLOCK_BITS

    def find(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = _Chunk(row)
                if (c.kinds < 2).any():
                    c.pairs()
                    t, o = c.pair_counts()
                    slot = np.unique(_slot(c.keys[t + o > 0], bits, c.bits)).astype(np.uint64)
                    cuts = np.searchsorted(slot >> np.uint64(block_bits), np.arange((1 << BLOCK_BITS) + 1, dtype=np.uint64))
                    rows = [(b, _pack_sorted(slot[lo:hi])) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if lo < hi]
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "slots"])

    def merge(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(b, np.zeros(1 << block_bits, bool))[_unpack_sorted(x).astype(np.int64) & ((1 << block_bits) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([np.packbits(x).tobytes() for x in seen.values()], pa.binary())], names=["block", "slots"])

    ddl = "block int, slots binary"
    return saved(tokens.mapInArrow(freed(find), ddl).repartition(1 << BLOCK_BITS, "block").mapInArrow(freed(merge), ddl), "known"), bits


def _bitmap(blocks: DataFrame, bits: int, buckets: int = 1, lo: int = 0, hi: int = 1) -> tuple[int, int, np.ndarray]:
    """Its bits, first slot and bytes, of the blocks that keys of buckets lo to hi have their slots in. The driver gets the
    blocks a partition at a time."""
    start, end = (lo << BLOCK_BITS) // buckets, -((-hi << BLOCK_BITS) // buckets)
    step = 1 << (bits - BLOCK_BITS - 3)
    out = np.zeros((end - start) * step, np.uint8)
    for r in blocks.where(f"block >= {start} and block < {end}").toLocalIterator():
        at = (r["block"] - start) * step
        out[at : at + step] = np.frombuffer(r["slots"], np.uint8)
    return bits, start << (bits - BLOCK_BITS), out


def _known_pairs(tokens: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """The whole bitmap."""
    blocks, bits = _known_blocks(tokens, size)
    out = _bitmap(blocks, bits)
    dropped(tokens.sparkSession, blocks)
    return out


def _bucket_of(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Equal ranges of the hashes' upper 32 bits."""
    return (keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)


def _cuts(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Ends of the buckets in sorted keys."""
    return np.searchsorted(_bucket_of(keys, buckets, bits), np.arange(buckets + 1, dtype=np.uint64))


def _lists(keys: np.ndarray, counts: list[np.ndarray], buckets: int, chunk: int, bits: int, more: np.ndarray | None = None, lo_hi: tuple[int, int] | None = None, masks: list[np.ndarray] | None = None):
    """Rows of _LIST, of buckets lo to hi if given; more: values of those keys whose first two counts are not both 0; masks:
    a bitmap for each bucket."""
    cuts = _cuts(keys, buckets, bits)
    for k in range(*(lo_hi or (0, buckets))):
        lo, hi = cuts[k], cuts[k + 1]
        if lo < hi:
            packed = [_pack(c[lo:hi].astype(np.int32)) for c in counts]
            if more is not None:
                packed.append(_pack(more[lo:hi][counts[0][lo:hi] + counts[1][lo:hi] > 0]))
            if masks is not None:
                packed.append(_pack(np.packbits(masks[k])))
            yield (k, chunk, _pack_sorted(keys[lo:hi]), *packed, *[None] * (len(_COUNTS) - len(packed)))


def _requests(tokens: DataFrame, pairs: bool, buckets: int, known=None, lo: int = 0, hi: int | None = None) -> DataFrame:
    """Lists of words, or of pairs that the broadcast bitmap ``known`` may hold, for buckets lo to hi; with pairs, which of the
    chunk's pairs in the bucket these are."""
    hi = buckets if hi is None else hi

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = _Chunk(row)
                if pairs:
                    c.pairs((buckets, lo, hi))
                    asked = np.ones(len(c.keys), bool) if known is None else _holds(known.value, c.keys, c.bits)
                    masks = np.split(asked, _cuts(c.keys, buckets, c.bits)[1:-1])
                    c.only(asked)
                    rows = _lists(c.keys, c.pair_counts(), buckets, row["chunk"], c.bits, c.vocabulary[c.first], (lo, hi), masks)
                else:
                    rows = _lists(c.vocabulary, c.words(), buckets, row["chunk"], c.bits, lo_hi=(lo, hi))
                yield _batch(list(rows), _LIST)

    return tokens.mapInArrow(freed(ask), _LISTS)


def _sums(place: np.ndarray, parts: list[np.ndarray], size: int) -> np.ndarray:
    return np.bincount(place, np.concatenate(parts), size).astype(np.int64)


def _pair_sums(requests: DataFrame, buckets: int, bits: int = 64) -> DataFrame:
    """Toxic and ordinary texts with each pair asked for, and which those are; for chunk -1, by first word: pairs' texts and
    distinct pairs of each class."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lists = [_unpack_sorted(r["keys"]) for r in rows]
        counts = [[_unpack(r[c], np.int32) for r in rows] for c in "ab"]
        keys, place = np.unique(np.concatenate(lists), return_inverse=True)
        t, o = (_sums(place, c, len(keys)) for c in counts)
        out, at = [], 0
        first = np.zeros(len(keys), np.uint64)
        for i, r in enumerate(rows):
            here = place[at : at + len(lists[i])]
            at += len(here)
            first[here[counts[0][i] + counts[1][i] > 0]] = _unpack(r["c"], np.uint64)
            out.append((r["bucket"], r["chunk"], None, _pack(t[here].astype(np.int32)), _pack(o[here].astype(np.int32)), r["d"], *[None] * 4))
        known = t + o > 0
        words, of = np.unique(first[known], return_inverse=True)
        by = [np.bincount(of, x[known], len(words)).astype(np.int64) for x in (t, o, t > 0, o > 0)]
        out += _lists(words, by, buckets, -1, bits)
        return pa.Table.from_batches([_batch(out, _LIST)])

    return requests.groupBy("bucket").applyInArrow(add, _LISTS)


def _word_sums(requests: DataFrame, bits: int = 64) -> DataFrame:
    """Texts of each kind with each word asked for, and its sums as a pair's first; for chunk -1, totals."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asked, firsts = [r for r in rows if r["chunk"] >= 0], [r for r in rows if r["chunk"] < 0]
        lists = [_unpack_sorted(r["keys"]) for r in asked]
        keys, place = np.unique(np.concatenate(lists), return_inverse=True)
        values = [_sums(place, [_unpack(r[c], np.int32) for r in asked], len(keys)) for c in "abc"]
        if firsts:
            of = np.searchsorted(keys, np.concatenate([_unpack_sorted(r["keys"]) for r in firsts]))
            values += [_sums(of, [_unpack(r[c], np.int32) for r in firsts], len(keys)) for c in "abcd"]
        else:
            values += [np.zeros(len(keys), np.int64)] * 4
        out, at = [], 0
        for r, own in zip(asked, lists, strict=True):
            here = place[at : at + len(own)]
            at += len(own)
            out.append((r["bucket"], r["chunk"], None, *[_pack(v[here].astype(np.int32)) for v in values]))
        t, o, other = (v[keys != _EMPTY >> np.uint64(64 - bits)] for v in values[:3])
        totals = np.array([t.sum(), o.sum(), (t > 0).sum(), (o > 0).sum(), (t + o + other).sum(), len(t)], np.int64)
        out.append((rows[0]["bucket"], -1, None, _pack(totals), *[None] * 6))
        return pa.Table.from_batches([_batch(out, _LIST)])

    return requests.groupBy("bucket").applyInArrow(add, _LISTS)


def word_chances(counts: list[np.ndarray], totals: np.ndarray) -> list[np.ndarray]:
    """Chances of words in each class; counts: toxic, ordinary, other; totals: of both classes their counts and types, all counts, all types."""
    t, o, other = (c.astype(float) for c in counts)
    shared = (t + o + other + 0.5) / (totals[4] + 0.5 * (totals[5] + 1))
    return [np.maximum(c - DISCOUNT, 0) / n + DISCOUNT * types / n * shared if n else shared for c, n, types in ((t, totals[0], totals[2]), (o, totals[1], totals[3]))]


def pair_chance(count: np.ndarray, context: np.ndarray, types: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Chances of second words in one class; a first word that the class lacks leaves the word's own chance."""
    n = np.maximum(context, 1)
    return np.where(context > 0, np.maximum(count - DISCOUNT, 0) / n + DISCOUNT * types / n * lower, lower)


def differs(t: np.ndarray, o: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """Chance that counts of both classes, toxic with ``share`` expected, come from classes that differ: by the G
    statistic, less the parameter's cost, against prior odds. It is above 0 for anything seen and 0 for what is not."""
    t, o = t.astype(float), o.astype(float)
    n = t + o
    away = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(e, 1e-9)), 0.0)
    g = 2 * (away(t, n * share) + away(o, n * (1 - share)))
    return np.where(n > 0, 1 / (1 + np.exp(-np.clip((g - np.log(np.maximum(n, 1)) - PRIOR_G) / 2, -40, 40))), 0.0)


def word_ratios(counts: list[np.ndarray], chances: list[np.ndarray], totals: np.ndarray) -> np.ndarray:
    """Log-likelihood ratios of words, towards the shared chance (0) as far as their counts may come from one."""
    return differs(*counts, totals[0] / max(1, totals[0] + totals[1])) * np.log(chances[0] / chances[1])


def pair_ratios(counts: list[np.ndarray], contexts: list[np.ndarray], lower: list[np.ndarray], word: np.ndarray) -> np.ndarray:
    """Log-likelihood ratios of second words after first ones, towards ``word``, the second's own.

    contexts: toxic and ordinary pairs with the first word, and its distinct successors in each; lower: the second's chances.
    """
    p = [pair_chance(counts[k], contexts[k], contexts[2 + k], lower[k]) for k in (0, 1)]
    odds = (contexts[0] + 0.5) / (contexts[1] + 0.5) * lower[0] / lower[1]
    sure = differs(*counts, odds / (1 + odds))
    return word + sure * (np.log(p[0] / p[1]) - word)


def _asked(keys: np.ndarray, rows: list[dict], buckets: int, bits: int) -> np.ndarray:
    """Which keys of a chunk the rows of _pair_sums() answer."""
    out = np.zeros(len(keys), bool)
    cuts = _cuts(keys, buckets, bits)
    for r in rows:
        lo, hi = cuts[r["bucket"]], cuts[r["bucket"] + 1]
        out[lo:hi] = np.unpackbits(_unpack(r["c"], np.uint8), count=hi - lo)
    return out


def _features(tokens: DataFrame, answers: DataFrame, totals: np.ndarray, buckets: int) -> DataFrame:
    """Of each text: length-normalised log-likelihood ratio of the whole, and the greatest of a window."""

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        out = []
        for row in left.to_pylist():
            c = _Chunk(row)
            c.pairs()
            c.only(_asked(c.keys, [r for r in rows if not r["word"]], buckets, c.bits))
            join = lambda col, word: np.concatenate([_unpack(r[col], np.int32) for r in rows if r["word"] == word] or [np.zeros(0, np.int32)])
            values = [join(x, True) for x in _COUNTS]
            chances = word_chances(values[:3], totals)
            word = np.where(c.vocabulary == _EMPTY >> np.uint64(64 - c.bits), 0.0, word_ratios(values[:2], chances, totals))
            # each distinct pair by one of the places where it stands
            at = np.zeros(len(c.keys), np.int64)
            at[c.pair] = c.second
            a, b = c.ids[at - 1], c.ids[at]
            pair = pair_ratios([join(x, False) for x in "ab"], [v[a] for v in values[3:]], [v[b] for v in chances], word[b])
            x = word[c.ids]
            x[c.second] = pair[c.pair]
            ends = np.cumsum(c.sizes)
            for h, end, n in zip(c.texts.tolist(), ends.tolist(), c.sizes.tolist(), strict=True):
                s = np.concatenate(([0.0], np.cumsum(x[end - n : end])))
                w = min(WINDOW, n)
                out.append((h, float(s[-1] / n), float((s[w:] - s[:-w]).max() / max(w, 10))))
        give_back()
        return pa.Table.from_batches([_batch(out, _FEATURES)])

    return tokens.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(measure, "_h long, _whole double, _window double")


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic curve over the features by Newton's steps, lightly held to small weights."""
    if len(np.unique(y)) < 2:
        return np.array([0.0, 0.0, -1e-9])
    x = np.column_stack((x, np.ones(len(x))))
    b = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * b)
        b = b + step
        if np.abs(step).max() < 1e-6:
            break
    return b


def text_features(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> tuple[DataFrame, np.ndarray]:
    """(_h, _whole, _window) of each text that has words, by its hash, and the curve over them.

    Counts from all documents (labelled ones of folds 1 to 3 by class), curve from fold 4 of 5; fold 0 only adds shared counts.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where("toxic is not null").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    # identical rows of labels say the same once
    known = broadcast_if_small(known.distinct())
    fold = fold_of("doc_id", 5)
    joined = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), fold.alias("_fold")).join(known, F.col("doc_id") == F.col("_id"), "left")
    trains = F.col("_fold").between(1, 3) & F.col("toxic").isin(0, 1)
    bits = min(64, max(32, int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 5).bit_length() + SPARE_BITS))
    tokens = saved(_chunks(joined.where("text is not null").select("_h", "text", F.when(trains, F.col("toxic")).otherwise(F.lit(2)).alias("toxic")), bits), "tokens")
    size = tokens.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_TOKENS))
    blocks, slot_bits = _known_blocks(tokens, size)
    split = lambda n: [(buckets * k // n, buckets * (k + 1) // n) for k in range(n)]

    def pair_share(lo: int, hi: int) -> DataFrame:
        # only its part of the bitmap, a copy of which takes memory and disk on the driver and on each executor
        known = spark.sparkContext.broadcast(_bitmap(blocks, slot_bits, buckets, lo, hi))
        out = saved(_pair_sums(_requests(tokens, True, buckets, known, lo, hi), buckets, bits), "pairs")
        known.destroy(blocking=True)
        return out

    pairs = functools.reduce(DataFrame.union, [pair_share(*x) for x in split(PAIR_SHARES)])
    dropped(spark, blocks)
    firsts = lambda lo, hi: pairs.where(f"chunk < 0 and bucket >= {lo} and bucket < {hi}")
    words = functools.reduce(DataFrame.union, [saved(_word_sums(_requests(tokens, False, buckets, None, *x).union(firsts(*x)), bits), "words") for x in split(WORD_SHARES)])
    totals = sum((_unpack(bytes(r[0]), np.int64) for r in words.where("chunk < 0").select("a").toLocalIterator()), np.zeros(6, np.int64))
    answers = words.withColumn("word", F.lit(True)).union(pairs.withColumn("word", F.lit(False))).where("chunk >= 0").drop("keys")
    of = F.pmod(F.xxhash64("chunk"), F.lit(FEATURE_SHARES))
    shares = [saved(_features(tokens.where(of == k), answers.where(of == k), totals, buckets), "features") for k in range(FEATURE_SHARES)]
    both = functools.reduce(DataFrame.union, shares)
    features = saved(both.groupBy("_h").agg(F.max("_whole").alias("_whole"), F.max("_window").alias("_window")), "features")
    for x in (tokens, pairs, words, *shares):
        dropped(spark, x)
    fits = joined.where((F.col("_fold") == 4) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic", "_h", F.xxhash64("doc_id", F.lit(5)).alias("_order"))
    fits = fits.orderBy("_order", "doc_id", "toxic", "_h").limit(max_fit)
    got = fits.join(features, "_h", "left").select(F.coalesce("_whole", F.lit(0.0)).alias("a"), F.coalesce("_window", F.lit(0.0)).alias("b"), F.col("toxic").alias("y")).toPandas().sort_values(["a", "b", "y"])
    return features, fit_curve(got[["a", "b"]].to_numpy(float), got["y"].to_numpy(float))


def toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """All columns of docs, and ``toxic_score`` between 0 and 1."""
    features, c = text_features(docs, labels, **params)
    z = F.coalesce("_whole", F.lit(0.0)) * float(c[0]) + F.coalesce("_window", F.lit(0.0)) * float(c[1]) + F.lit(float(c[2]))
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    keyed = docs.withColumn("_text_hash", F.xxhash64("text"))
    out = keyed.join(features, F.col("_text_hash") == F.col("_h"), "left")
    return out.select(*[keyed[x] for x in docs.columns], (1 / (1 + F.exp(-z))).alias("toxic_score"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query."""
    out = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= 0.5, 1).otherwise(0).alias("predicted"))
