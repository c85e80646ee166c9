"""Substring dedup: words in windows that also start elsewhere, found behind a count-min prefilter.

Equal windows of ``window`` words pick the same anchor, the run of ``gram`` words with the least hash
in them (the leftmost of equals), at the same place in the window, and different places of a window
have different anchors. So the number of an anchor's places is never less than that of any of its
windows, and counting anchors overestimates the counts of windows.

1. Partition sketches of anchor counts, two rows of saturating counters, are sent as sorted slots,
   merged by slot range and reduced to two bitmaps of the slots that reached two. The number of slots
   follows the bytes of text, up to ``MOST_BITS``; a sketch that fills up lets more through, never less.
2. Stretches (the windows of one place that share an anchor) whose anchor the sketch estimates to be
   repeated are counted exactly. A stretch whose words stand at two places or more has only repeated
   windows. Of the rest, and of one place for each distinct stretch beside them, single windows are
   grouped exactly.

Windows are compared by 64-bit hashes of words' 64-bit hashes. Defined results: null, empty and short
texts have no window; a repeated row makes all windows of that row repeated; rows that share doc_id (or
have none) but not text are apart, by a 64-bit hash of the text and its length; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import byte_slices, freed, mix64, prefix_hash, saved, span_hash, word_hashes, words_of

WINDOW = 35
GRAM = 8
ROWS = 2
LEAST_BITS, MOST_BITS = 20, 29
BLOCKS_LOG2 = 6
SLICE_BYTES = 4_000_000
SLICE_ROWS = 200_000
DOC = ["doc_id", "text_hash", "text_length"]


def anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first window, last window) of each stretch of windows with one anchor."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    at = np.arange(len(h) - gram + 1)
    g = span_hash(prefix_hash(h), at, at + gram)
    span = window - gram + 1
    place, size = at, 1
    while size < span:  # leftmost least of ever longer runs, the last two overlapping
        step = min(size, span - size)
        a, b = place[: len(place) - step], place[step:]
        place, size = np.where(g[b] < g[a], b, a), size + step
    first = np.concatenate(([0], np.nonzero(np.diff(place))[0] + 1))
    last = np.append(first[1:] - 1, n - 1)
    return g[place[first]], place[first], first, last


def slot_bits(docs: DataFrame) -> int:
    """Bits of a slot's number: some four slots for each anchor to expect (two in 29 words of six bytes)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(np.clip(int(size * 4 / 87).bit_length(), LEAST_BITS, MOST_BITS))


def _slots(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix64(anchor + np.uint64(r * 0x51ED270B35C5B1F7)) >> np.uint64(64 - bits)).astype(np.int64) for r in range(ROWS)]


def _documents(batch: pa.RecordBatch):
    """(row, word hashes) of the texts of a batch."""
    texts = batch.column("text")
    for i in range(batch.num_rows):
        w = words_of(texts[i].as_py())
        if len(w) >= WINDOW:
            yield i, word_hashes(w)


def sketch(docs: DataFrame, bits: int) -> tuple[np.ndarray, ...]:
    """Bitmaps, one a row of the sketch, of the slots whose merged count is two or more."""
    block_bits = bits - BLOCKS_LOG2

    def count(batches):
        found: list[np.ndarray] = []

        def out():
            a = np.concatenate(found) if found else np.zeros(0, np.uint64)
            found.clear()
            rows = []
            for r, slot in enumerate(_slots(a, bits)):
                slot, n = np.unique(slot, return_counts=True)
                code = (slot & ((1 << block_bits) - 1)) * 2 + (n > 1)
                block = slot >> block_bits
                cut = np.searchsorted(block, np.arange((1 << BLOCKS_LOG2) + 1))
                rows += [(r, b, code[lo:hi].astype("<u4").tobytes()) for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if hi > lo]
            return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["row", "block", "codes"]), schema=_CODES, preserve_index=False)

        held = 0
        for batch in batches:
            for _, h in _documents(batch):
                found.append(anchors(h)[0])
                held += len(found[-1])
                if held > 2_000_000:
                    yield out()
                    held = 0
        yield out()

    def merge(batches):
        seen: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, block, codes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                c = seen.setdefault((row, block), np.zeros(1 << block_bits, np.uint8))
                code = np.frombuffer(codes, "<u4")
                slot = code >> 1
                c[slot] = np.minimum(c[slot] + 1 + (code & 1).astype(np.uint8), 2)
        rows = [(r, b, np.packbits(c >= 2).tobytes()) for (r, b), c in seen.items()]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["row", "block", "codes"]), schema=_CODES, preserve_index=False)

    ddl = "row int, block int, codes binary"
    parts = docs.select("text").mapInArrow(freed(count), ddl).repartition(ROWS << BLOCKS_LOG2, "row", "block").mapInArrow(freed(merge), ddl)
    maps = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(ROWS)]
    size = 1 << (block_bits - 3)
    for r in parts.collect():  # at most ROWS bitmaps of 2**MOST_BITS bits
        maps[r["row"]][r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["codes"], np.uint8)
    return tuple(maps)


_CODES = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("codes", pa.binary())])
_STRETCH = pa.schema([("anchor", pa.int64()), ("stretch", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("text_length", pa.int32()), ("run", pa.int64())])
_WINDOW = pa.schema([("window", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("text_length", pa.int32()), ("start", pa.int64()), ("alone", pa.bool_())])


def estimated(anchor: np.ndarray, maps) -> np.ndarray:
    """Whether the sketch estimates two places or more."""
    out = np.ones(len(anchor), bool)
    for slot, bits in zip(_slots(anchor, (len(maps[0]) * 8 - 1).bit_length()), maps, strict=True):
        out &= (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
    return out


def _rows(batch: pa.RecordBatch, found: list[tuple[int, list[np.ndarray]]], schema: pa.Schema, lead: int) -> pa.RecordBatch:
    """Found values of rows of a batch, with the rows' key columns after the first ``lead`` ones."""
    at = pa.array(np.repeat([i for i, _ in found], [len(v[0]) for _, v in found]))
    cols = [np.concatenate(c) for c in zip(*(v for _, v in found), strict=True)]
    cols = [c.view(np.int64) if c.dtype == np.uint64 else c for c in cols]
    keys = [batch.column(c).take(at) for c in DOC]
    return pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip([*cols[:lead], *keys, *cols[lead:]], schema.types, strict=True)], schema=schema)


def stretches(docs: DataFrame, maps) -> DataFrame:
    """The stretches whose anchor the sketch estimates to be repeated; run is 64 * first + last - first."""
    held = docs.sparkSession.sparkContext.broadcast(maps)  # ROWS bitmaps of 2**MOST_BITS bits at most

    def find(batches):
        for whole in batches:
            for batch in byte_slices(whole, 3, SLICE_BYTES):
                found = []
                for i, h in _documents(batch):
                    a, place, first, last = anchors(h)
                    k = np.nonzero(estimated(a, held.value))[0]
                    if len(k):
                        a, place, first, last = a[k], place[k], first[k], last[k]
                        words = span_hash(prefix_hash(h), first, last + WINDOW)
                        found.append((i, [a, mix64(words + (place - first).astype(np.uint64)), 64 * first + last - first]))
                if found:
                    yield _rows(batch, found, _STRETCH, 2)

    return keyed(docs).mapInArrow(freed(find), "anchor long, stretch long, doc_id long, text_hash long, text_length int, run long")


def keyed(docs: DataFrame) -> DataFrame:
    """A document is known by doc_id, null or not, a 64-bit hash of its text and the text's length."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.length("text"), F.lit(-1)).alias("text_length"), "text")


def _with(docs: DataFrame, side: DataFrame, value: str, how: str) -> DataFrame:
    """Documents with the value that side, keyed by DOC, has for them."""
    side = side.toDF(*(f"_{c}" for c in DOC), value)
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")) & (F.col("text_length") == F.col("_text_length"))
    return keyed(docs).join(side, same, how).select(*DOC, "text", value)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text_length, runs): runs of starts of windows whose words also start elsewhere, each 64 * first + last - first."""
    ship(docs.sparkSession)
    found = saved(stretches(docs, sketch(docs, slot_bits(docs))), "stretches")
    # one row for each distinct stretch, with one of its places
    each = saved(found.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.min(F.struct(*DOC, "run")).alias("at")), "each")
    sure = found.join(each.where("n > 1").select("anchor", "stretch"), ["anchor", "stretch"], "left_semi").select(*DOC, "run")
    mixed = each.groupBy("anchor").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("anchor")
    asks = each.join(mixed, "anchor", "left_semi").select("at.*", (F.col("n") == 1).alias("alone"))
    ask = asks.groupBy(*DOC).agg(F.collect_list(F.expr("2 * run + cast(alone as long)")).alias("asked"))

    def windows(batches):
        for whole in batches:
            for batch in byte_slices(whole, 3, SLICE_BYTES):
                out, held = [], 0
                for i in range(batch.num_rows):
                    h = prefix_hash(word_hashes(words_of(batch.column("text")[i].as_py())))
                    run = batch.column("asked")[i].values.to_numpy()
                    alone, run = run & 1, run >> 1
                    n = (run & 63) + 1
                    at = np.repeat((run >> 6) - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    out.append((i, [span_hash(h, at, at + WINDOW), at, np.repeat(alone, n).astype(bool)]))
                    held += len(at)
                    if held > SLICE_ROWS:
                        yield _rows(batch, out, _WINDOW, 1)
                        out, held = [], 0
                if out:
                    yield _rows(batch, out, _WINDOW, 1)

    asking = _with(docs, ask, "asked", "inner")
    single = saved(asking.mapInArrow(freed(windows), "window long, doc_id long, text_hash long, text_length int, start long, alone boolean"), "windows")
    # a place that stands for many asks for windows known to be repeated, however often its row is there
    twice = single.groupBy("window").agg(F.count("*").alias("n"), F.max("alone").alias("any")).where("n > 1 and any").select("window")
    hits = single.where("alone").join(twice, "window", "left_semi").select(*DOC, (64 * F.col("start")).alias("run"))
    return sure.union(hits).groupBy(*DOC).agg(F.collect_list("run").alias("runs"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_words (joined by one space) and kept_sha256 of every document."""
    every = _with(docs, repeated_windows(docs), "runs", "left")
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_words", "n_removed", "kept_words", "kept_sha256"]

    def cut(batches):
        for whole in batches:
            for batch in byte_slices(whole, 3, SLICE_BYTES):
                out = []
                for i in range(batch.num_rows):
                    w = words_of(batch.column("text")[i].as_py())
                    runs, removed = batch.column("runs")[i], 0
                    if runs.is_valid:
                        run = runs.values.to_numpy()
                        step = np.zeros(len(w) + 1, np.int64)
                        np.add.at(step, run >> 6, 1)
                        np.add.at(step, (run >> 6) + (run & 63) + WINDOW, -1)
                        covered = np.cumsum(step[:-1]) > 0
                        removed = int(covered.sum())
                        w = [x for x, c in zip(w, covered.tolist(), strict=True) if not c]
                    kept = b" ".join(w)
                    out.append((len(w) + removed, removed, kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=names)

    return every.mapInArrow(freed(cut), "doc_id long, n_words long, n_removed long, kept_words string, kept_sha256 string")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
