"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..intermediate import saved, shared_dir  # noqa: F401

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_SQL = r"([^\\x20\\x09-\\x0D]+)"

_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def freed(work):
    """``work`` over batches, after which the worker gives free memory back, as it may idle beside other stages."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete what saved() wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    jvm.System.gc()  # lets Spark remove the shuffle files of plans that nobody holds any more
    trimmed(spark)


def trimmed(spark: SparkSession) -> bool:
    """Have the driver's JVM give back the native memory that its many threads have freed; not every JVM can."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # by the interface's method, as the class of the server is not public
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
    args = gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(beans, args)
    except Py4JJavaError:
        return False
    return True


def collected(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage, as only then they give back the heap that earlier work took. One task a
    core, so that each idle executor gets some."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Hint a broadcast when a count proves the side small; else leave the join to shuffle and AQE."""
    return F.broadcast(df) if df.count() <= max_rows else df


def fold_of(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; a null id is the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % modulus


def byte_slices(batch: pa.RecordBatch, column: int, most: int):
    """Slices of a batch of about ``most`` bytes of a text column; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; lone surrogates cannot come out of Spark."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    if len(_POWERS.get("p", ())) < n:
        size = max(1 << 15, 1 << (n - 1).bit_length())
        for key, base in (("p", _ODD), ("i", _INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(h: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() takes the hash of any run of words."""
    p, _ = powers(len(h) + 1)
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of words[start:end], the same wherever the run stands; the length is mixed in."""
    _, inv = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return span_hash(prefix_hash(h), at, at + k)


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` by alternating large-star and small-star.

    Returns (node, root) for each node with an edge to another, root being the smallest node it
    reaches. Each round is written to the shared folder, so lost executors cost one round at most;
    nothing is gathered on the driver but a count and a checksum. Self-loops are ignored.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = saved(edges, "edges"), None
    for _ in range(max_rounds):
        # large-star: each neighbour greater than the node is linked to the least neighbour
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: a node and its lesser neighbours are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = saved(small, "edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(spark, now)
        now = new
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not converge")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select("b", "b").distinct().toDF("node", "root"))
