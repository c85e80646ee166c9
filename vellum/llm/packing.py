"""Packing documents into token sequences by order-preserving dynamic programming.

Documents of a partition keep their order. Cuts may fall at document ends (free), at sentence ends
(a small penalty) and, within long sentences, at every ``stride`` tokens (a larger one). The cost of
a window is the padding up to the sequence length, nothing if its length is a power of two, plus the
penalty of its cut. f(j) = min over i of f(i) + cost(i, j): as padding is linear in i, the minimum
over the sliding range of i comes from a monotone queue, and the powers of two are looked up.

Defined results: a null or empty text is a document of only the end token; a text longer than a block
is packed in blocks of its own; repeated rows are packed each by itself. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import byte_slices, freed

SEQUENCE = 2048
STRIDE = 128
SENTENCE_PENALTY = 1.0
INNER_PENALTY = 8.0
LEAST_GAP = 12
BLOCK_BYTES = 4_000_000
CACHE_BYTES = 96_000_000
END_ID = 1
_COLUMNS = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
_TOKENIZERS: dict[tuple[str, int], ChunkTokenizer] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class ChunkTokenizer:
    """Ids of texts, chunk by chunk between blanks, with a cache of chunks bounded in bytes.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its
    chunks in a row. A chunk's ids lie in ``pool`` from ``start`` on; ``length`` is their number and
    ``ends`` says that a sentence may end after them. Entry 0 is the end token.
    """

    def __init__(self, path: str, end_id: int, max_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.max_bytes = Tokenizer.from_file(path), end_id, max_bytes
        self.model = self.tokenizer.model
        codes = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = [b for b in range(256) if b not in codes]
        self.letters = {b: chr(b) for b in codes} | {b: chr(256 + i) for i, b in enumerate(spare)}
        config = json.loads(self.tokenizer.to_str())
        kinds = [n["type"] for n in (config.get("normalizer") or {}).get("normalizers", [])]
        splits = [n["type"] for n in (config.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        #: lower-cased words of letters are then one unit of the model
        self.plain = "Lowercase" in kinds and splits == ["Split", "ByteLevel"] and config["model"].get("end_of_word_suffix") == "</w>"
        self.reset()

    def reset(self) -> None:
        self.entry: dict[str, int] = {}
        self.stems: dict[str, list[int]] = {}
        self.bytes = 0  # a rough sum of what the two hold
        self.pool = np.zeros(1 << 16, np.uint32)
        self.pool[0], self.used, self.count = self.end_id, 1, 1
        self.start, self.length, self.ends = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)
        self.length[0] = 1

    @classmethod
    def of(cls, path: str, end_id: int) -> ChunkTokenizer:
        if (path, end_id) not in _TOKENIZERS:
            _TOKENIZERS[path, end_id] = cls(path, end_id)
        return _TOKENIZERS[path, end_id]

    def _ids(self, part: str) -> list[int]:
        return self.tokenizer.encode(part, add_special_tokens=False).ids

    def _chunk_ids(self, chunk: str) -> list[int]:
        stem = chunk.rstrip(".,")
        # for these letters, lower-casing one by one and composing them change nothing further
        if not (self.plain and stem and stem.isalpha() and max(stem) < "\u0130"):
            return self._ids(chunk)
        low = stem.lower()
        ids = self.stems.get(low)
        if ids is None:
            unit = low if low.isascii() else "".join(map(self.letters.__getitem__, low.encode()))
            ids = self.stems[low] = [t.id for t in self.model.tokenize(unit)]
            self.bytes += 220 + len(low) + 8 * len(ids)
        tail = chunk[len(stem) :]
        if tail:
            more = self.stems.get(tail)
            if more is None:
                more = self.stems[tail] = self._ids(tail)
            return ids + more
        return ids

    def entries(self, chunks: list[str]) -> np.ndarray:
        """Entry of each of these distinct chunks."""
        if self.bytes > self.max_bytes:
            self.reset()
        out = list(map(self.entry.get, chunks))
        flat: list[int] = []
        sizes, ends = [], []
        stems, tokenize, plain, letters, size = self.stems, self.model.tokenize, self.plain, self.letters.__getitem__, 0
        for k in [k for k, e in enumerate(out) if e is None]:
            chunk = chunks[k]
            stem = chunk.rstrip(".,")
            # as _chunk_ids() does, but only tails are held besides the chunks
            if plain and stem.isalpha() and (stem.isascii() or max(stem) < "\u0130"):
                low = stem.lower()
                unit = low if low.isascii() else "".join(map(letters, low.encode()))
                ids = [t.id for t in tokenize(unit)]
                if len(stem) < len(chunk):
                    tail = chunk[len(stem) :]
                    if tail not in stems:
                        stems[tail] = self._ids(tail)
                    ids = ids + stems[tail]
            else:
                ids = self._chunk_ids(chunk)
            out[k] = self.entry[chunk] = self.count + len(sizes)
            size += 180 + 2 * len(chunk) + 4 * len(ids)
            flat += ids
            sizes.append(len(ids))
            ends.append(bool(ids) and chunk[-1] in ".!?")
        self.bytes += size
        if sizes:
            n, m = len(sizes), len(flat)
            self.pool = _room(self.pool, self.used + m)
            self.pool[self.used : self.used + m] = flat
            for name, values in (("start", self.used + np.cumsum(sizes) - sizes), ("length", sizes), ("ends", ends)):
                a = _room(getattr(self, name), self.count + n)
                a[self.count : self.count + n] = values
                setattr(self, name, a)
            self.used, self.count = self.used + m, self.count + n
        return np.array(out, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end token; where each text ends; where sentences end)."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        if self.plain:  # the normalizer lower-cases anyway, and fewer chunks differ
            texts = pc.ascii_lower(texts)
        parts = pc.split_pattern(texts, " ")
        words = parts.flatten().dictionary_encode()
        entry = self.entries(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)]
        last = parts.offsets.to_numpy().astype(np.int64)[1:] - parts.offsets[0].as_py()
        entry = np.insert(entry, last, 0)
        n = self.length[entry]
        after = np.cumsum(n)
        at = np.repeat(self.start[entry] - (after - n), n)
        at += np.arange(len(at))
        return self.pool[at], after[entry == 0], after[self.ends[entry]]


def _room(a: np.ndarray, need: int) -> np.ndarray:
    return a if need <= len(a) else np.concatenate((a, np.zeros(max(need, 2 * len(a)) - len(a), a.dtype)))


def cut_points(doc_ends: np.ndarray, sentence_ends: np.ndarray, stride: int = STRIDE, least: int = LEAST_GAP) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) where a block of documents may be cut; gaps are at most ``stride``.

    Sentence ends within ``least`` tokens of the place before them are left out.
    """
    marks = np.concatenate(([0], sentence_ends, doc_ends))
    cost = np.concatenate(([0.0], np.full(len(sentence_ends), SENTENCE_PENALTY), np.zeros(len(doc_ends))))
    order = np.lexsort((cost, marks))
    marks, cost = marks[order], cost[order]
    keep = np.concatenate(([True], (cost[1:] == 0) | (np.diff(marks) >= least))) & np.concatenate(([True], np.diff(marks) > 0))
    marks, cost = marks[keep], cost[keep]
    gap = np.diff(marks, prepend=0)
    long = np.nonzero(gap > stride)[0]
    if len(long):
        inner = np.concatenate([np.arange(marks[i] - gap[i] + stride, marks[i], stride) for i in long])
        marks, cost = np.concatenate((marks, inner)), np.concatenate((cost, np.full(len(inner), INNER_PENALTY)))
        order = np.argsort(marks, kind="stable")
        marks, cost = marks[order], cost[order]
    return marks, cost


def best_cuts(pos: np.ndarray, pen: np.ndarray, most: int = SEQUENCE) -> list[int]:
    """Positions of the cheapest cuts, the last position among them; gaps in pos are at most ``most``."""
    n = len(pos)
    exact: dict[int, list[int]] = {}
    k = 1
    while k <= most:  # windows of a power of two have no padding
        i = np.searchsorted(pos, pos - k)
        for j in np.nonzero((pos >= k) & (pos[np.minimum(i, n - 1)] == pos - k))[0].tolist():
            exact.setdefault(j, []).append(int(i[j]))
        k *= 2
    p, q = pos.tolist(), pen.tolist()
    f, back = [0.0] * n, [0] * n
    key = [0.0] * n  # f(i) + p(i)
    queue: deque[int] = deque([0])
    for j in range(1, n):
        pj = p[j]
        low = pj - most
        while p[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = key[i] + most - pj
        for e in exact.get(j, ()):
            if f[e] < best:
                best, i = f[e], e
        f[j] = fj = best + q[j]
        back[j] = i
        key[j] = kj = fj + pj
        while queue and key[queue[-1]] >= kj:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(p[j])
        j = back[j]
    return cuts[::-1]


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, sequence: int = SEQUENCE, stride: int = STRIDE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    sequence_id is the partition's number times 2**32 plus the sequence's rank, so it is gapless
    within a partition and the same whenever the same partition is computed again.
    """
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches):
        tok = ChunkTokenizer.of(path, end_id)
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in byte_slices(batch, 1, block_bytes):
                ids, doc_ends, sentence_ends = tok.encode(part.column(1))
                cuts = np.array(best_cuts(*cut_points(doc_ends, sentence_ends, stride), sequence))
                doc_starts, seq_starts = np.concatenate(([0], doc_ends[:-1])), np.concatenate(([0], cuts[:-1]))
                begin = np.union1d(doc_starts, seq_starts)
                end = np.append(begin[1:], len(ids))
                d, q = np.searchsorted(doc_starts, begin, "right") - 1, np.searchsorted(seq_starts, begin, "right") - 1
                offsets = pa.py_buffer(np.append(4 * begin, 4 * len(ids)).astype(np.int32).tobytes())
                data = pa.Array.from_buffers(pa.binary(), len(begin), [None, offsets, pa.py_buffer(ids.astype("<u4").tobytes())])
                columns = [part.column(0).take(pa.array(d)), begin - doc_starts[d], end - begin, data, (doc_ends - doc_starts)[d], base + q, begin - seq_starts[q]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=_COLUMNS)
                base += len(cuts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(freed(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the pieces with a checksum in place of their ids."""
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
