"""N-gram Jaccard join with prefix filters under several global token orders.

Let two sets of na and nb tokens have a Jaccard similarity of at least num/den. Then they share
num / (num + den) * (na + nb) tokens or more, and under any one order of all tokens the first one that they
share has at least as many tokens from it on in each set. Candidates come from order A, by an
inverted index of prefixes that carries the tokens left; a pair must then pass the same test under
orders B and C, on prefixes alone, and leave room for a link in counts by bucket, before any whole set travels. Before
all that, ``MARKS`` parities of each set, gathered once, rule out most pairs where candidates are joined: a bit in which they differ
stands for a token or more that one set lacks, so that no link is lost. Parities by the set's size do the same to what is
left. Every order puts tokens that a
corpus-wide sketch of document counts finds frequent last, so that a passage common to many documents
makes few candidates. The sketch has a fixed size and only affects speed.

Tokens with the same documents are one group of candidates. No group is expanded into all its pairs at
once: its members are first compared with a few pivots of their size, what links is merged, and only pairs
across what is then still apart are compared. Exact copies (equal word sequences, by a 64-bit hash) are
one node.

Defined results: null and blank texts have no shingles and are their own component (of their doc_id);
a text of fewer than ``k`` words is one shingle; repeated rows link to each other; a null doc_id is never
the least; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import broadcast_if_small, byte_slices, components, dropped, freed, gram_hashes, mix64, prefix_hash, saved, span_hash, word_hashes

K = 5
NUM, DEN = 75, 100
SLOT_BITS = 22
BLOCK_BITS = 17
#: Pivots of each group and size in the rounds before the last; more of them once few rows are left.
PIVOTS = (1, 6, 6)
SLICE_BYTES = 2_000_000
#: Parities of a set; more of them tell larger sets apart.
MARKS = 512
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)


def shingles(text: str | None, k: int = K) -> tuple[np.ndarray, int]:
    """(sorted distinct shingle hashes, hash of the whole word sequence)."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64), 0
    h = word_hashes(w)
    whole = int(span_hash(prefix_hash(h), np.array([0]), np.array([len(h)])).view(np.int64)[0])
    g = gram_hashes(h, k) if len(h) >= k else np.array([whole], np.int64).view(np.uint64)
    return np.unique(g), whole


def prefix_size(n: int) -> int:
    return n - -(-n * NUM // DEN) + 1


def prefix(s: np.ndarray, frequent: np.ndarray, order: int) -> np.ndarray:
    """The first tokens of a set under an order, in order, frequent tokens being last in every order."""
    p = prefix_size(len(s))
    slot = (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    late = (frequent[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
    key = (mix64(s ^ np.uint64(order)) >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63))
    first = np.argpartition(key, p - 1)[:p]
    return s[first[np.argsort(key[first])]]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def enough(left: int, sizes: int) -> bool:
    """Whether so many tokens left in each set leave room for a link of sets of so many tokens together."""
    return (NUM + DEN) * left >= NUM * sizes


def marks_of(sets: list[np.ndarray]) -> pa.Array:
    """Of each set, whether an odd number of its tokens falls into each of MARKS buckets, as a list of longs."""
    at = np.repeat(np.arange(len(sets)) * MARKS, [len(s) for s in sets]) + (np.concatenate(sets) & np.uint64(MARKS - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=len(sets) * MARKS).astype(np.uint8) & 1
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (MARKS // 64)), pa.array(np.packbits(odd).view(np.int64)))


def parities(s: np.ndarray) -> bytes:
    """The size of a set, and as marks_of() parities in two to four buckets a token."""
    width = max(MARKS, 1 << (2 * len(s)).bit_length())
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return len(s).to_bytes(4, "little") + np.packbits(odd).tobytes()


def may_link(a: bytes, b: bytes) -> bool:
    """Whether the parities of two sets leave room for a link."""
    x, y = (v[4:] for v in (a, b))
    width = min(len(x), len(y))
    x, y = (v if len(v) == width else np.bitwise_xor.reduce(np.frombuffer(v, np.uint8).reshape(-1, width)).tobytes() for v in (x, y))
    lacking = (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()
    return (NUM + DEN) * lacking <= (DEN - NUM) * (int.from_bytes(a[:4], "little") + int.from_bytes(b[:4], "little"))


def _texts(batches):
    for batch in batches:
        yield from byte_slices(batch, 1, SLICE_BYTES)


def first_pass(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(info, bitmap): doc_id, n_shingles, node, marks and parities of each document; and the slots of tokens in far more
    documents than a slot's share of all tokens, from merged partition sketches."""
    names = ["doc_id", "n_shingles", "node", "marks", "parities", "counts", "block"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int32()]
    ddl = "doc_id long, n_shingles long, node long, marks array<long>, parities binary, counts binary, block int"

    def run(batches):
        c = np.zeros(1 << SLOT_BITS, np.int32)
        for batch in _texts(batches):
            got = [shingles(t.as_py()) for t in batch.column("text")]
            slot, times = np.unique(np.concatenate([x for x, _ in got]) >> np.uint64(64 - SLOT_BITS), return_counts=True)
            c[slot.astype(np.int64)] += times.astype(np.int32)
            none = [None] * len(got)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(([len(s) for s, _ in got], [w for _, w in got]), types[1:3], strict=True)), marks_of([s for s, _ in got]), pa.array([parities(s) for s, _ in got], pa.binary()), *(pa.array(none, t) for t in types[5:])], names=names)
        if c.any():
            parts = np.minimum(c, 255).astype(np.uint8).reshape(-1, 1 << BLOCK_BITS)
            none = [None] * len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((none, none, none, none, none, [x.tobytes() for x in parts], range(len(parts))), types, strict=True)], names=names)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = saved(base.mapInArrow(freed(run), ddl), "info")
    mean = (both.agg(F.sum("n_shingles")).first()[0] or 0) / (1 << SLOT_BITS)
    most = mean + 6 * mean**0.5 + 8

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for counts, block in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts.as_buffer(), np.uint8).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(x > most).tobytes() for x in sums.values()], pa.binary()), pa.array(list(sums), pa.int32())], names=["counts", "block"])

    frequent, size = np.zeros(1 << (SLOT_BITS - 3), np.uint8), 1 << (BLOCK_BITS - 3)
    sketches = both.where("block is not null").select("counts", "block").repartition(1 << (SLOT_BITS - BLOCK_BITS), "block")
    for r in sketches.mapInArrow(merge, "counts binary, block int").collect():  # 2**SLOT_BITS bits in all
        frequent[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["counts"], np.uint8)
    return both.where("block is null").select("doc_id", "n_shingles", "node", "marks", "parities"), frequent


def _prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(token, node, place): the first tokens under order A of each node."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def tokens(batches):
        seen: set[int] = set()
        for batch in _texts(batches):
            out, nodes = [], []
            for t in batch.column("text"):
                s, whole = shingles(t.as_py())
                if not len(s) or whole in seen:
                    continue
                if len(seen) < 100_000:  # a node that comes again is no harm
                    seen.add(whole)
                out.append(prefix(s, held.value, ORDERS[0]))
                nodes.append(whole)
            if out:
                reps = np.fromiter(map(len, out), np.int64, len(out))
                place = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), reps)), pa.array(place.astype(np.int32))], names=["token", "node", "place"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return base.mapInArrow(freed(tokens), "token long, node long, place int")


def _shared(tokens: DataFrame) -> DataFrame:
    """Rows of tokens that two nodes or more have, each once."""
    names = ["token", "node", "place"]

    def run(batches):
        last: list[np.ndarray] | None = None
        with_last = False  # whether the row held back has the token of the row before it
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(3)]
            if not len(cols[0]):
                continue
            if last is not None:
                cols = [np.concatenate(x) for x in zip(last, cols, strict=True)]
            new = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            cols = [x[new] for x in cols]
            same = cols[0][1:] == cols[0][:-1]
            before = np.append(with_last, same)
            keep = before[:-1] | same
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in cols], names=names)
            last, with_last = [x[-1:] for x in cols], bool(before[-1])
        if last is not None and with_last:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], names=names)

    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tokens.repartition(parts, "token").sortWithinPartitions("token", "node").mapInArrow(freed(run), "token long, node long, place int")


def _groups(shared: DataFrame, info: DataFrame) -> DataFrame:
    """(group, node, n, left): tokens of the same nodes are one group; left is how many of a node's n tokens stand
    from the first of them on."""
    alike = [F.count("*"), F.bit_xor(F.xxhash64("node", F.lit(1))), F.bit_xor(F.xxhash64("node", F.lit(2)))]
    named = shared.groupBy("token").agg(*(c.alias(f"_{i}") for i, c in enumerate(alike)))
    named = named.select("token", F.xxhash64("_0", "_1", "_2").alias("group"))
    first = shared.join(named, "token").groupBy("group", "node").agg(F.min("place").alias("place"))
    sizes = info.where("n_shingles > 0").groupBy("node").agg(F.max("n_shingles").cast("int").alias("n"))
    return first.join(sizes, "node").select("group", "node", "n", (F.col("n") - F.col("place")).alias("left"))


def _sets(docs: DataFrame, info: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, tokens): the sets, as sorted 64-bit integers, of the pairs' nodes."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    need = saved(info.groupBy("node").agg(F.min("doc_id").alias("_id")).join(nodes, "node", "left_semi").select("node", "_id"), "need")
    need = broadcast_if_small(need)

    def build(batches):
        for batch in _texts(batches):
            got = [shingles(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([w for _, w in got], pa.int64()), pa.array([s.tobytes() for s, _ in got], pa.binary())], names=["node", "tokens"])

    have = docs.select(F.col("doc_id").cast("long").alias("_d"), "text").join(need, F.col("_d").eqNullSafe(F.col("_id")), "left_semi").select("_d", "text")
    # rows that share a doc_id may bring nodes that nobody asked for, and a node twice: pairs are then compared twice
    return have.mapInArrow(freed(build), "node long, tokens binary").join(need.select("node"), "node", "left_semi")


def orders_of(s: np.ndarray, frequent: np.ndarray) -> bytes:
    """The size of a set, its prefixes under orders B and C, tokens cut to 32 bits, and its tokens in each of so many
    buckets that two hold a token or so at most."""
    width = 1 << max(8, (len(s) // 2).bit_length())
    counts = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return b"".join([len(s).to_bytes(4, "little")] + [prefix(s, frequent, o).astype("<u4").tobytes() for o in ORDERS[1:]] + [np.minimum(counts, 255).astype(np.uint8).tobytes()])


def _parsed(x: bytes) -> tuple[int, list[np.ndarray], np.ndarray]:
    n = int.from_bytes(x[:4], "little")
    end = 4 + 4 * prefix_size(n) * (len(ORDERS) - 1)
    return n, np.split(np.frombuffer(x[4:end], "<u4"), len(ORDERS) - 1), np.frombuffer(x[end:], np.uint8)


def under_orders(a: tuple, b: tuple) -> list[bool]:
    """Under each of the orders B and C: whether a token that both prefixes hold leaves room for a link; and whether the
    buckets do, whose lesser counts add up to no less than what the sets share."""
    out = []
    for x, y in zip(a[1], b[1], strict=True):
        _, i, j = np.intersect1d(x, y, return_indices=True)
        out.append(bool(len(i)) and enough(int(np.minimum(a[0] - i, b[0] - j).max()), a[0] + b[0]))
    most = min(a[0], b[0])
    if a[2].max() < 255 and b[2].max() < 255:  # a full bucket may hold any number
        width = min(len(a[2]), len(b[2]))
        x, y = (v.reshape(-1, width).sum(axis=0, dtype=np.int64) for v in (a[2], b[2]))
        most = min(most, int(np.minimum(x, y).sum()))
    return [*out, enough(most, a[0] + b[0])]


def _compared(pairs: DataFrame, held: DataFrame, prepare, test) -> DataFrame:
    """The pairs (a, b) that pass test(prepare(what a holds), what b holds); held is (node, tokens). Pairs of
    one a stand together, thousands to a share, after what a holds."""

    def run(batches):
        key, own = None, None
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                a, salt, b = (batch.column(i)[k].as_py() for i in range(3))
                if b is None:
                    key, own = (a, salt), prepare(batch.column(3)[k].as_py())
                elif key == (a, salt) and test(own, batch.column(3)[k].as_py()):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / 500)).cast("int")
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    heads = counts.select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    rows = dealt.join(held, F.col("b") == F.col("node")).select("a", "salt", "b", "tokens")
    rows = rows.unionByName(heads.join(held, F.col("a") == F.col("node")).select("a", "salt", F.lit(None).cast("long").alias("b"), "tokens"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(freed(run), "a long, b long")


def _verify(docs: DataFrame, info: DataFrame, marks: DataFrame, pairs: DataFrame, held) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) that pass their parities and orders B and C, and of them those that link by their whole sets; saved."""

    def filters(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([orders_of(np.frombuffer(t.as_py(), np.uint64), held.value) for t in batch.column(1)], pa.binary())], names=["node", "tokens"])

    spark = pairs.sparkSession
    pairs = saved(_compared(pairs, marks.select("node", F.col("parities").alias("tokens")), lambda own: own, may_link), "pairs")
    sets = saved(_sets(docs, info, pairs), "sets")
    orders = sets.mapInArrow(freed(filters), "node long, tokens binary")
    likely = saved(_compared(pairs, orders, _parsed, lambda own, x: all(under_orders(own, _parsed(x)))), "likely")
    links = saved(_compared(likely, sets, lambda x: np.frombuffer(x, np.uint64), lambda own, x: linked(own, np.frombuffer(x, np.uint64))).distinct(), "links")
    dropped(spark, sets)
    dropped(spark, pairs)
    return likely, links


def _apart(groups: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows of groups whose nodes lie in two components or more, with their components."""
    rows = groups.join(comp.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("group", "node", "n", "left", F.coalesce("root", "node").alias("comp"))
    split = rows.groupBy("group").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("group")
    return rows.join(split, "group", "left_semi")


def _pairs(rows: DataFrame, marks: DataFrame, round_: int) -> DataFrame:
    """Candidate pairs of rows of _apart(): of each with pivots of its group and of its size; or, in the last
    round, of all across components, each group's lesser components with all others. Pairs whose marks, of (node, marks, parities), leave
    no room for a link are never rows."""
    apart = " + ".join(f"bit_count(get(marks, {i}) ^ get(_marks, {i}))" for i in range(MARKS // 64))
    fits = F.expr(f"{NUM + DEN} * least(left, _left) >= {NUM} * (n + _n) and comp <> _comp and {NUM + DEN} * ({apart}) <= {DEN - NUM} * (n + _n)")
    marked = lambda df: df.join(marks.select("node", "marks"), "node")
    other = lambda df, by: marked(df).select(*by, F.col("node").alias("_node"), F.col("n").alias("_n"), F.col("left").alias("_left"), F.col("comp").alias("_comp"), F.col("marks").alias("_marks"))
    if round_ < len(PIVOTS):
        by = ["group", "band"]
        rows = rows.withColumn("band", F.floor(F.log("n") / np.log(DEN / NUM)))
        least = [F.min(F.struct(F.xxhash64("node", F.lit(round_), F.lit(k)).alias("h"), "node", "n", "left", "comp")).alias(f"p{k}") for k in range(PIVOTS[round_])]
        first = rows.groupBy(*by).agg(*least).select(*by, F.explode(F.array(*(f"p{k}" for k in range(PIVOTS[round_])))).alias("p")).select(*by, "p.node", "p.n", "p.left", "p.comp").distinct()
        pairs = marked(rows).join(other(first, by), by).where(fits)
    else:
        by = ["group"]
        sizes = rows.groupBy("group", "comp").agg(F.count("*").alias("c"))
        major = sizes.groupBy("group").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"))
        rows = rows.join(major, "group")
        minor = other(rows.where("comp <> major"), by)
        pairs = marked(rows).join(minor, by).where(fits & F.expr("comp = major or _node < node"))
    return pairs.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def jaccard_components(docs: DataFrame, counts: list | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every document. A list ``counts`` gets each round's pairs under order A, those left under B and C, and links."""
    spark = docs.sparkSession
    ship(spark)
    info, frequent = first_pass(docs)
    shared = saved(_shared(_prefixes(docs, frequent)), "shared")
    groups = saved(_groups(shared, info), "groups")
    dropped(spark, shared)
    marks = saved(info.join(groups.select("node").distinct(), "node", "left_semi").select("node", "marks", "parities").dropDuplicates(["node"]), "marks")
    held = spark.sparkContext.broadcast(frequent)
    comp = spark.createDataFrame([], "node long, root long")
    for r in range(len(PIVOTS) + 1):
        rows = saved(_apart(groups, comp), "apart")
        pairs = saved(_pairs(rows, marks, r), "pairs")
        dropped(spark, rows)
        if pairs.isEmpty():
            continue
        likely, more = _verify(docs, info, marks, pairs, held)
        if counts is not None:
            counts.append((pairs.count(), likely.count(), more.count()))
        dropped(spark, pairs)
        dropped(spark, likely)
        if not more.isEmpty():
            # the links of earlier rounds as a star for each of their components
            found = components(spark, comp.toDF("a", "b").union(more))
            earlier, comp = comp, saved(found, "comp")
            dropped(spark, earlier)
            dropped(spark, found)
        dropped(spark, more)
    dropped(spark, groups)
    dropped(spark, marks)
    least = info.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = least.join(comp.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    whole = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = classes.join(whole, "root").select(F.col("node").alias("_node"), "component_id")
    out = info.join(of, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
