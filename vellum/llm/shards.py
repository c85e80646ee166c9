"""Sharding by size-tiered compaction with an atomically committed, versioned manifest.

A store is a folder: ``data/`` holds immutable Parquet shards, ``manifest/v<N>.json`` lists the live
shards of version N. Arrivals are appended as small shards. Compaction groups live shards of one size
tier (powers of ``FAN_IN`` above ``MIN_BYTES``), oldest first, into runs of up to the target size, and
rewrites each run as one shard: a union of one-partition reads, so no row is shuffled. A version becomes
visible by one rename that fails if the version exists (as on HDFS and local disks; an object store needs
a committer with a conditional put); a loser plans anew. Data files are written before the manifest names
them, so a job that dies leaves only files that no version names; vacuum() removes them once they are old.
Every version stays readable until vacuum() drops it.

Defined results: an empty table makes a store without shards; repeated rows, nulls and extra columns are
kept as they are. The driver holds one manifest entry per shard, never rows.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, shared_dir

MIN_BYTES = 1 << 20
FAN_IN = 4
TARGET_BYTES = 48 << 20
LEAST_UNION = 48
ARRIVALS = 8
FULL = 0.75
KEEP_VERSIONS = 16
LEAST_AGE_S = 86_400.0


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, min_bytes: int = MIN_BYTES):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.fan_in, self.least = target_bytes, fan_in, min_bytes
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path("manifest"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("manifest"))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n)))

    def manifest(self, version: int | None = None) -> dict:
        """The live shards of a version, the latest if none is named."""
        found = self.versions()
        if not found:
            return {"version": 0, "schema": None, "shards": []}
        return json.loads(self._read(f"manifest/v{found[-1] if version is None else version}.json"))

    def commit(self, base: dict, shards: list[dict], schema: str | None, note: str) -> dict:
        """Publish the version after ``base``."""
        new = {"version": base["version"] + 1, "schema": schema or base["schema"], "note": note, "shards": shards}
        temp, final = f"manifest/.{uuid.uuid4().hex}.tmp", f"manifest/v{new['version']}.json"
        out = self.fs.create(self._path(temp), False)
        try:
            out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        finally:
            out.close()
        if self.fs.exists(self._path(final)) or not self.fs.rename(self._path(temp), self._path(final)):
            self.fs.delete(self._path(temp), False)
            raise CommitConflict(final)
        return new

    def _entries(self, folder: str) -> list[dict]:
        """Manifest entries of the Parquet files below a folder just written."""
        files, todo = {}, [self._path(folder)]
        while todo:
            for s in self.fs.listStatus(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                elif s.getPath().getName().endswith(".parquet"):
                    files[s.getPath().toString()] = s.getLen()
        if not files:
            return []
        rows = {r[0]: r[1:] for r in self.spark.read.parquet(*files).groupBy(F.col("_metadata.file_path")).agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).collect()}
        plain = lambda p: re.sub(r"^file:/+", "/", p)
        rows = {plain(k): v for k, v in rows.items()}
        out = [{"path": p, "bytes": n, "rows": rows[plain(p)][0], "least": rows[plain(p)][1], "most": rows[plain(p)][2]} for p, n in sorted(files.items()) if plain(p) in rows]
        return out

    def append(self, df: DataFrame, note: str = "append", retries: int = 5) -> dict:
        """Write arrivals as small shards and publish them."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        new = self._entries(folder)
        return self._publish(lambda base: base["shards"] + new, df.schema.json(), note, retries)

    def append_batches(self, df: DataFrame, batch: str) -> list[dict]:
        """Arrivals told apart by a column: one write, then one version for each batch in order."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.partitionBy(batch).parquet(f"{self.path}/{folder}")
        schema, out = df.drop(batch).schema.json(), []
        by: dict[int, list[dict]] = {}
        for e in self._entries(folder):
            by.setdefault(int(re.search(rf"/{re.escape(batch)}=(-?\d+)/", e["path"])[1]), []).append(e)
        for k in sorted(by):
            out.append(self._publish(lambda base, k=k: base["shards"] + by[k], schema, f"arrival {k}", 5))
        return out

    def _publish(self, change, schema, note, retries) -> dict:
        for _ in range(retries):
            base = self.manifest()
            try:
                return self.commit(base, change(base), schema, note)
            except CommitConflict:
                continue
        raise CommitConflict(note)

    def tier(self, size: int) -> int:
        return 0 if size <= self.least else 1 + int(math.log(size / self.least, self.fan_in))

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Runs of shards of one tier to merge, up to the target size: ``fan_in`` or more, or enough to fill a shard."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < FULL * self.target:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        runs: list[list[dict]] = []
        for _, members in sorted(tiers.items()):
            run, size = [], 0
            for s in members:
                if run and size + s["bytes"] > self.target:
                    runs.append(run)
                    run, size = [], 0
                run, size = [*run, s], size + s["bytes"]
            runs.append(run)
        return [r for r in runs if len(r) >= self.fan_in or len(r) > 1 and sum(s["bytes"] for s in r) >= FULL * self.target]

    def compact(self, retries: int = 5) -> dict:
        """Merge until no tier holds enough similar shards; each round is one version."""
        most = max(LEAST_UNION, 2 * self.spark.sparkContext.defaultParallelism)
        while True:  # each round leaves fewer shards
            base = self.manifest()
            runs = self.plan(base["shards"])[:most]
            if not runs:
                return base
            schema = _schema(base["schema"])
            parts = [self.spark.read.schema(schema).parquet(*[s["path"] for s in run]).coalesce(1) for run in runs]
            merged = parts[0]
            for p in parts[1:]:
                merged = merged.union(p)
            folder = f"data/{uuid.uuid4().hex}"
            merged.write.option("maxRecordsPerFile", 0).parquet(f"{self.path}/{folder}")
            new, old = self._entries(folder), {s["path"] for run in runs for s in run}
            if sum(e["rows"] for e in new) != sum(s["rows"] for run in runs for s in run):
                raise RuntimeError("compaction lost or added rows")
            try:
                self.commit(base, [s for s in base["shards"] if s["path"] not in old] + new, None, f"compact {len(old)} into {len(new)}")
            except CommitConflict:
                retries -= 1
                if not retries:
                    raise

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        if version is not None and version not in self.versions():
            raise LookupError(f"version {version} is not there, or no longer")
        m = self.manifest(version)
        schema = _schema(m["schema"]) if m["schema"] else "doc_id long"
        if not m["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s["path"] for s in m["shards"]])

    def vacuum(self, keep_versions: int = KEEP_VERSIONS, least_age_s: float = LEAST_AGE_S) -> int:
        """Drop all but the last versions, and data files that no version left names; returns how many.

        A file younger than ``least_age_s`` stays: a writer may be about to name it.
        """
        for v in self.versions()[:-keep_versions]:
            self.fs.delete(self._path(f"manifest/v{v}.json"), False)
        live = {re.sub(r"^file:/+", "/", s["path"]) for v in self.versions() for s in self.manifest(v)["shards"]}
        todo, gone = [self._path("data")] if self.fs.exists(self._path("data")) else [], 0
        while todo:
            for s in self.fs.listStatus(todo.pop()):
                p = s.getPath()
                if s.isDirectory():
                    todo.append(p)
                elif p.getName().endswith(".parquet") and s.getModificationTime() / 1000 <= time.time() - least_age_s and re.sub(r"^file:/+", "/", p.toString()) not in live:
                    gone += bool(self.fs.delete(p, False))
        return gone


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(text))


def shard_documents(docs: DataFrame, path: str | None = None, arrivals: int = ARRIVALS, **params) -> ShardStore:
    """Append the documents as ``arrivals`` batches, by a hash of doc_id, and compact."""
    spark = docs.sparkSession
    store = ShardStore(spark, path or shared_dir(spark), **params)
    batch = "_vellum_arrival"
    store.append_batches(docs.withColumn(batch, F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(arrivals)).cast("int")), batch)
    store.compact()
    return store


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its shard in the last version, and the shard's rows and tier."""
    store = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    m = store.manifest()
    name = lambda p: p.rsplit("/", 1)[1]
    shards = spark.createDataFrame([(name(s["path"]), i, s["rows"], store.tier(s["bytes"])) for i, s in enumerate(m["shards"])], "_file string, shard_id int, shard_rows long, tier int")
    rows = store.read().select("doc_id", F.col("_metadata.file_name").alias("_file")) if m["shards"] else store.read().select("doc_id", F.lit("").alias("_file"))
    return rows.join(broadcast_if_small(shards), "_file").select("doc_id", "shard_id", "shard_rows", "tier", F.lit(m["version"]).cast("long").alias("version"))
