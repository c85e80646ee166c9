"""Mixing sources to target weights.

Each source's documents, in a pseudorandom but repeatable order, are one stream of words cut into
blocks of (nearly) equal length. Output shards draw their per-source block counts: multinomial
draws conditioned on the sources' totals, which is a multivariate hypergeometric law, so that the
whole mix meets its targets exactly. A slot's rank among its source's slots goes through a
pseudorandom permutation of the source's block numbers, and blocks are joined by that number.

Defined results: a null text counts 0 words; a null source is a source of its own, last in order;
documents without words are never taken; repeated rows are documents of their own; an empty table
gives an empty mix. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .common import WORD, broadcast_if_small, byte_slices, freed, saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
SLICE_BYTES = 4_000_000
_WORD = re.compile(WORD)


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight; a share over ``most`` times its size stops there and the excess is dealt anew."""
    cap = [most * s for s in sizes]
    out, open_, left = [0.0] * len(cap), set(range(len(cap))), float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > cap[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = cap[i]
            left -= cap[i]
            open_.discard(i)
    return out


def _permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at ``index``: a Feistel network, walked until inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2) if n > 1 else 1
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            f = (right + np.uint64((key + r * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _deal(rng: np.random.Generator, here: np.ndarray, left: int) -> np.ndarray:
    """A draw of ``left`` out of so many of each source, source by source, each given those before it.

    Where all are too many for the exact sampler, the hypergeometric law is drawn by its normal limit,
    whose error is then far below one block in a thousand.
    """
    take, rest = np.zeros_like(here), int(here.sum())
    for i, n in enumerate(here.tolist()):
        rest -= n
        if n + rest < 1_000_000_000:
            got = int(rng.hypergeometric(n, rest, left)) if n + rest else 0
        else:
            share = n / (n + rest)
            spread = left * share * (1 - share) * (n + rest - left) / (n + rest - 1)
            got = round(left * share + rng.standard_normal() * spread**0.5)
        take[i] = got = min(max(got, left - rest, 0), n, left)
        left -= int(got)
    return take


def _shard_counts(quota: np.ndarray, shards: int, slots: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per-source counts of one shard and of all shards before it, by halving the shards downwards."""
    lo, hi, here, before = 0, shards, quota.astype(np.int64), np.zeros(len(quota), np.int64)
    total = int(quota.sum())
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = min(total, mid * slots) - lo * slots
        take = _deal(np.random.Generator(np.random.PCG64([seed, lo, hi])), here, left)
        if shard < mid:
            hi, here = mid, take
        else:
            lo, here, before = mid, here - take, before + take
    return here, before


def draws(spark: SparkSession, sources: list[dict], seed: int, slots: int = SHARD_SLOTS) -> DataFrame:
    """Slots of all shards: (shard, slot, source_no, block, epoch, words), words the longest prefix of the block to take (null: all of it)."""
    quota = np.array([s["quota"] for s in sources], np.int64)
    blocks = np.array([s["blocks"] for s in sources], np.int64)
    last = np.array([s["last_words"] for s in sources], np.int64)
    shards = max(1, -(-int(quota.sum()) // slots))

    def deal(batches):
        for pdf in batches:
            for shard in pdf["id"]:
                count, before = _shard_counts(quota, shards, slots, int(shard), seed)
                parts = []
                for s in np.nonzero(count)[0]:
                    rank = np.arange(before[s], before[s] + count[s])
                    epoch, index = rank // blocks[s], rank % blocks[s]
                    block = np.empty(len(rank), np.int64)
                    for e in np.unique(epoch):
                        at = epoch == e
                        block[at] = _permute(index[at], int(blocks[s]), seed * 1_000_003 + int(s) * 7919 + int(e))
                    words = pd.Series(np.where(rank == quota[s] - 1, last[s], -1))
                    parts.append(pd.DataFrame({"source_no": int(s), "block": block, "epoch": epoch, "words": words}))
                if parts:
                    out = pd.concat(parts, ignore_index=True)
                    order = np.random.Generator(np.random.PCG64([seed, 1, int(shard)])).permutation(len(out))
                    out = out.iloc[order]
                    out.insert(0, "slot", np.arange(len(out)))
                    out.insert(0, "shard", int(shard))
                    yield out

    ids = spark.range(0, shards if quota.sum() else 0, 1, max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    out = ids.mapInPandas(deal, "shard long, slot long, source_no int, block long, epoch long, words long")
    return out.withColumn("words", F.expr("nullif(words, -1)"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words of each row."""
    return docs.select("doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("row_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def plan(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, block_words=BLOCK_WORDS, seed: int = 17):
    """(sources, placed): targets per source, and each document's place in its source's stream of words.

    The driver holds one row per source: the sources are the mix's parameters, not its data.
    """
    n_buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # by the whole row, so that rows without an id spread too
    rows = saved(sized(docs).withColumn("bucket", F.pmod(F.xxhash64("row_hash", F.lit(seed)), F.lit(n_buckets)).cast("int")), "sized")
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    w = Window.partitionBy("source").orderBy("bucket")
    starts = totals.select("source", "bucket", (F.sum("bucket_size").over(w) - F.col("bucket_size")).alias("bucket_start"))
    found = totals.groupBy("source").agg(F.sum("bucket_size").alias("size")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r["size"]) for r in found]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), most)
    sources = []
    for i, (r, size, target) in enumerate(zip(found, sizes, targets, strict=True)):
        blocks = -(-size // block_words)
        length = size / blocks if blocks else 0.0
        quota = min(int(np.ceil(target / length - 1e-9)), int(most * blocks)) if blocks else 0
        sources.append({"source_no": i, "source": r["source"], "source_size": size, "target": target, "blocks": blocks, "quota": quota, "last_words": int(round(target - (quota - 1) * length)) if quota else 0})
    names = ["source_no", "source", "source_size", "target", "blocks"]
    table = spark.createDataFrame([tuple(x[n] for n in names) for x in sources], "source_no int, source string, source_size long, target double, blocks long")
    at = Window.partitionBy("source", "bucket").orderBy("doc_id", "row_hash")
    placed = rows.withColumn("within", F.sum("size").over(at.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(starts.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.withColumn("start", F.col("bucket_start") + F.col("within")).drop("s", "b", "within", "bucket_start", "bucket")
    small = broadcast_if_small(table.withColumnRenamed("source", "s"))
    return sources, placed.join(small, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def pieces(placed: DataFrame) -> DataFrame:
    """One row for each block that a document touches (one with a null block if it has no words).

    Block k of a source with B blocks over S words holds its words from k*S div B to (k+1)*S div B.
    """
    # the block of word p is the greatest k with k*S div B <= p, which is ((p+1)*B - 1) div S
    block_of = lambda p: F.expr(f"cast(((cast({p} as decimal(19,0)) + 1) * cast(blocks as decimal(19,0)) - 1) div cast(source_size as decimal(19,0)) as long)")
    has = F.col("size") > 0
    out = placed.withColumn("block", F.explode_outer(F.when(has, F.sequence(block_of("start"), block_of("start + size - 1")))))
    lo = F.expr("cast((cast(block as decimal(19,0)) * source_size) div blocks as long)")
    hi = F.expr("cast((cast(block + 1 as decimal(19,0)) * source_size) div blocks as long)")
    return out.withColumn("block_start", lo).withColumn("block_end", hi)


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """The mix as spans: one row for each time that part of a document is taken, and one row with a
    null shard for each document part that isn't.

    Columns: doc_id, source, row_hash (of id, source and text), size, source_size, target, start (place
    in the source's stream), shard, slot, from_word and n_words (the span within the document; 0 words
    where not taken). A document of any words is told from others by source and start.
    """
    spark = docs.sparkSession
    ship(spark)
    sources, placed = plan(spark, docs, weights, share, most, block_words, seed)
    drawn = draws(spark, sources, seed)
    out = pieces(placed).join(drawn.withColumnRenamed("source_no", "n").withColumnRenamed("block", "k").hint("merge"), (F.col("source_no") == F.col("n")) & (F.col("block") == F.col("k")), "left")
    end = F.least(F.col("start") + F.col("size"), F.col("block_end"), F.coalesce(F.col("block_start") + F.col("words"), F.col("block_end")))
    begin = F.greatest("start", "block_start")
    return out.select("doc_id", "source", "row_hash", "size", "source_size", "target", "start", "shard", "slot", (begin - F.col("start")).alias("from_word"), F.when(F.col("shard").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), end - begin)).cast("long").alias("n_words"))


def _runs(takes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For t = 1, 2, ...: the maximal runs of words taken at least t times, as (from, to)."""
    steps: dict[int, int] = {}
    for a, n in takes:
        steps[a] = steps.get(a, 0) + 1
        steps[a + n] = steps.get(a + n, 0) - 1
    out, open_ = [], []
    for at in sorted(steps):
        while steps[at] > 0:
            open_.append(at)
            steps[at] -= 1
        while steps[at] < 0:
            out.append((open_.pop(), at))
            steps[at] += 1
    return sorted(out)


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix as documents: for t = 1, 2, ... each maximal run of words that the mix takes at least
    t times is a row with the run's text (its inner white space kept) and its document's other columns.

    Rows alike in every way each give their own runs. An ``n_chars`` column gets the new length.
    """
    spans = mix_sources(docs, **params).where("n_words > 0")
    takes = spans.groupBy(F.coalesce("doc_id", F.lit(-(2**63))).alias("_k"), F.col("row_hash").alias("_h")).agg(F.collect_list(F.struct("start", "from_word", "n_words")).alias("_takes"), F.countDistinct("start").alias("_rows"))
    keyed = docs.withColumn("_k", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("_h", F.xxhash64("doc_id", "source", "text"))
    hit = keyed.join(takes, ["_k", "_h"])
    # rows alike in id, source and text share one list of all their takes: one of them stands for all
    hit = hit.where("_rows = 1").unionByName(hit.where("_rows > 1").dropDuplicates(["_k", "_h"]))
    names = docs.columns
    hit = hit.select(*names, "_takes")
    at_text = names.index("text")

    def cut(batches):
        for whole in batches:
            for batch in byte_slices(whole, at_text, SLICE_BYTES):
                place, texts = [], []
                for k in range(batch.num_rows):
                    text = batch.column("text")[k].as_py()
                    ends = [(m.start(), m.end()) for m in _WORD.finditer(text)]
                    by_row: dict[int, list[tuple[int, int]]] = {}
                    for t in batch.column("_takes")[k].as_py():
                        by_row.setdefault(t["start"], []).append((t["from_word"], t["n_words"]))
                    for start in sorted(by_row):
                        for a, b in _runs(by_row[start]):
                            place.append(k)
                            texts.append(text[ends[a][0] : ends[b - 1][1]])
                if place:
                    # all columns stay Arrow, so that no integer passes through a float
                    out = batch.select(names).take(pa.array(place))
                    new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
                    columns = [new[c].cast(out.schema.field(c).type) if c in new else out.column(c) for c in names]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return hit.mapInArrow(freed(cut), docs.schema)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: words of each document that the mix takes."""
    spans = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return spans.groupBy("doc_id", "source", "row_hash", "size", "source_size", "target", "start").agg(F.sum("n_words").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")
