"""Embedding near-dedup by product quantisation behind coarse inverted lists.

Vectors of one label link when their cosine, in double precision, is at least ``threshold``. Equal
vectors of a label are one class. Coarse centroids and the codebooks of the residuals' subspaces are
fitted on a bounded sample (``MAX_FIT`` vectors, the least by a hash of vec_id); every vector is indexed.
A class stands in the list of its nearest centroid and is probed into each list whose border with its
own lies within ``MARGIN``: two linked unit vectors are at most 0.375 apart, and their difference has only
a small share in the direction across the border. Lists are compared in tiles of bounded size: distances
come from tables of the query's products with the codewords (asymmetric), a candidate is what the
quantisation error of the coded vector leaves possible, and candidates are compared exactly.

A tile gives counts for each class and a spanning forest of its links, never all its pairs.

Vectors of each dimension have an index of their own, as those of different dimensions cannot link.

Defined results: null or zero vectors, and those with null or non-finite components, link with nothing and
are kept; so are those with a null label. Repeated rows are vectors of their own. Extra columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import components, saved

THRESHOLD = 0.93
MAX_FIT = 20_000
PER_LIST = 300
MAX_LISTS = 2048
SUBSPACES = 8
CODES = 64
MARGIN = 0.2
TILE = 1500


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (-2 * x @ c.T + (c * c).sum(1)).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Coarse centroids and one codebook for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.centroids = _kmeans(sample, lists, rng)
        r = sample - self.centroids[self.nearest(sample)]
        norm = (self.centroids**2).sum(1)
        self.apart = np.sqrt(np.maximum(norm[:, None] + norm[None] - 2 * self.centroids @ self.centroids.T, 1e-12))
        self.cuts = np.array_split(np.arange(self.dim), min(subspaces, self.dim))
        self.books = [_kmeans(r[:, c], codes, rng) for c in self.cuts]

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(1), 0)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x).argmin(1)

    def lists(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """(own list, lists of lesser number whose border is within the margin) of each vector."""
        d = self.distances(x)
        own = d.argmin(1)
        gap = (d - d[np.arange(len(x)), own][:, None]) / (2 * self.apart[own])
        near = (gap <= margin) & (np.arange(len(self.centroids))[None] < own[:, None])
        return own, [np.nonzero(row)[0] for row in near]

    def encode(self, x: np.ndarray, lst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, quantisation errors) of vectors in their lists."""
        r = x - self.centroids[lst]
        code = np.empty((len(x), len(self.cuts)), np.uint8)
        error = np.zeros(len(x))
        for m, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            d = (r[:, cut] ** 2).sum(1)[:, None] - 2 * r[:, cut] @ book.T + (book**2).sum(1)
            code[:, m] = d.argmin(1)
            error += np.maximum(d.min(1), 0)
        return code, np.sqrt(error)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        return [q[:, cut] @ book.T for cut, book in zip(self.cuts, self.books, strict=True)]


def classes_of(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, valid vectors as ``vector`` (null otherwise) and their ``key``."""
    v = F.col("embedding").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull()
    out = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(F.coalesce(fine, F.lit(False)), v).alias("vector"))
    # adding zero makes -0.0 and 0.0 alike
    text = F.concat_ws(",", F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string")))
    return out.withColumn("key", F.when(F.col("vector").isNotNull(), F.sha2(F.concat_ws("|", "label", text), 256)))


def fit(rows: DataFrame) -> dict[int, Quantiser]:
    """A quantiser for each dimension, on MAX_FIT vectors at most in all (64 for a rare dimension)."""
    valid = rows.where("vector is not null").select(F.size("vector").alias("dim"), F.xxhash64("vec_id", F.lit(3)).alias("h"), "vector")
    counts = {r["dim"]: r["count"] for r in valid.groupBy("dim").count().collect()}
    total, out = sum(counts.values()), {}
    for dim, n in sorted(counts.items()):
        least = valid.where(F.col("dim") == dim).orderBy("h", "vector").limit(max(64, MAX_FIT * n // total)).collect()
        x = _unit(np.array([r["vector"] for r in least], float))
        out[dim] = Quantiser(np.unique(x, axis=0), int(np.clip(n // PER_LIST, 1 if n < 8 * PER_LIST else 8, MAX_LISTS)))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _tile(rows: pd.DataFrame, q: Quantiser, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(positions' links weighted by copies, forest edges) among the tile's sides: home against the rest."""
    x = np.frombuffer(b"".join(rows["unit"]), float).reshape(len(rows), -1)
    side, copies = rows["side"].to_numpy(), rows["copies"].to_numpy()
    lst = int(rows["list"].iloc[0])
    homes = np.nonzero(side != 1)[0]  # coded vectors: the list's own
    asks = np.nonzero(side != 0)[0] if (side == 1).any() or (side == 2).any() else homes
    code, error = q.encode(x[homes], np.full(len(homes), lst))
    counts, edges, root = np.zeros(len(rows), np.int64), [], np.arange(len(rows))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    same = not (side == 1).any() and not (side == 2).any()
    for lo in range(0, len(asks), 256):
        a = asks[lo : lo + 256]
        tables = q.tables(x[a])
        near = np.repeat((x[a] @ q.centroids[lst])[:, None], len(homes), axis=1)
        for m, t in enumerate(tables):
            near += t[:, code[:, m]]
        i, j = np.nonzero(near + error[None] >= threshold - 1e-9)
        i, j = a[i], homes[j]
        if same:  # each pair once
            keep = i < j
            i, j = i[keep], j[keep]
        else:
            keep = i != j
            i, j = i[keep], j[keep]
        cos = np.einsum("ij,ij->i", x[i], x[j])
        hit = cos >= threshold
        i, j = i[hit], j[hit]
        np.add.at(counts, i, copies[j])
        np.add.at(counts, j, copies[i])
        for u, v in zip(i.tolist(), j.tolist(), strict=True):
            ru, rv = find(u), find(v)
            if ru != rv:
                root[rv] = ru
                edges.append((u, v))
    return counts, edges


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    spark = embeddings.sparkSession
    ship(spark)
    rows = saved(classes_of(embeddings), "vectors")
    q = fit(rows)
    single = rows.select("vec_id", "key")
    if not q:
        return single.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    held = spark.sparkContext.broadcast(q)  # for each dimension MAX_LISTS centroids and SUBSPACES * CODES codewords at most
    classes = rows.where("key is not null").groupBy("key", "label").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = classes.withColumn("cid", F.xxhash64("key"))

    def place(batches):
        for whole in batches:
            for dim, pdf in whole.groupby(whole["vector"].map(len)):
                m = held.value[dim]
                x = _unit(np.array(pdf["vector"].tolist(), float))
                for lo in range(0, len(x), 512):
                    part, u = pdf.iloc[lo : lo + 512], x[lo : lo + 512]
                    own, probes = m.lists(u, margin)
                    out = part[["cid", "label", "copies"]].assign(unit=[r.tobytes() for r in u], dim=dim, list=own, home=True)
                    at = np.repeat(np.arange(len(part)), [len(p) for p in probes])
                    yield out
                    if len(at):
                        yield out.iloc[at].assign(list=np.concatenate(probes), home=False)

    placed = saved(classes.select("cid", "label", "copies", "vector").mapInPandas(place, "cid long, label string, copies long, unit binary, dim int, list int, home boolean"), "placed")
    sizes = placed.groupBy("label", "dim", "list").agg(F.sum(F.col("home").cast("int")).alias("nh"), F.count("*").alias("na"))
    sizes = sizes.withColumn("bh", F.greatest(F.lit(1), F.ceil(F.col("nh") / TILE)).cast("int")).withColumn("bp", F.greatest(F.lit(1), F.ceil((F.col("na") - F.col("nh")) / TILE)).cast("int"))
    dealt = placed.join(sizes, ["label", "dim", "list"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.when(F.col("home"), F.col("bh")).otherwise(F.col("bp"))).cast("int"))
    # tiles: home block i with home block j >= i, and probe block p with each home block
    others = F.sequence(F.lit(0), F.col("bh") - 1)
    tiles = F.when(
        F.col("home"),
        F.concat(
            F.transform(others, lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), F.when(j < F.col("block"), 2).otherwise(0).alias("side"))),
            F.when(F.col("na") > F.col("nh"), F.transform(F.sequence(F.lit(0), F.col("bp") - 1), lambda p: F.struct((-1 - p).alias("i"), F.col("block").alias("j"), F.lit(0).alias("side")))).otherwise(F.array()),
        ),
    ).otherwise(F.transform(others, lambda j: F.struct((-1 - F.col("block")).alias("i"), j.alias("j"), F.lit(1).alias("side"))))
    work = dealt.select("cid", "label", "dim", "list", "copies", "unit", F.explode(tiles).alias("t")).select("cid", "label", "dim", "list", "copies", "unit", "t.i", "t.j", "t.side")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "cid"], ignore_index=True)
        if pdf["i"].iloc[0] >= 0 and pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            pdf["side"] = np.where(pdf["side"] == 2, 1, 0)
        counts, edges = _tile(pdf, held.value[int(pdf["dim"].iloc[0])], threshold)
        cid = pdf["cid"].to_numpy()
        k = np.nonzero(counts)[0]
        out = [pd.DataFrame({"a": cid[k], "b": cid[k], "n": counts[k]})]
        if edges:
            u, v = np.array(edges).T
            out.append(pd.DataFrame({"a": cid[u], "b": cid[v], "n": 0}))
        return pd.concat(out, ignore_index=True).astype({"a": "int64", "b": "int64", "n": "int64"})

    found = saved(work.groupBy("label", "dim", "list", "i", "j").applyInPandas(compare, "a long, b long, n long"), "links")
    counts = found.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    comp = components(spark, found.where("a <> b").select("a", "b"))
    named = classes.select("cid", "key", "least", "copies").join(counts, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.select("key", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select(F.col("key").alias("_key"), "n_links", "component_id")
    out = single.join(named, F.col("key") == F.col("_key"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
