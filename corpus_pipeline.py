"""The corpus pipeline: toxicity, line dedup, near-duplicate documents, mixing, packing.

Each stage takes (spark, docs, sf_dir), with docs as its predecessor left them, and returns a DataFrame;
all but the last keep the columns of ``documents``. Each result is written to the shared folder and read
again. Before each stage the executors give back the heap that its predecessor took. The stages take nulls, empty and repeated rows as their operators define it; the Jaccard stage
tells rows apart even if they share a doc_id or have none, and keeps all blank ones.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import jaccard, lines, mixing, packing, toxicity
from vellum.llm.common import collected, saved

#: SQL cannot express the trained model, the draws or the packing. The tests run the Jaccard stage and hold the operators to known
#: or brute-force results, but run neither the other stages nor the whole pipeline.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict to be toxic."""
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("toxic_score < 0.5").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier in the corpus; n_chars follows the text."""
    out = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that links join, the one with the least doc_id (a null one last)."""
    # rows may share a doc_id or have none, so each gets a key of its own
    keyed = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    found = saved(jaccard.jaccard_components(keyed.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")), "groups")
    several = found.where("_row <> _group").select("_group").distinct()
    rows = found.join(several, "_group", "left_semi").join(keyed.select("_row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_row").alias("_place")), "_row")
    first = rows.groupBy("_group").agg(F.min("_place")["_row"].alias("_first"))
    gone = rows.join(first, "_group").where("_row <> _first").select("_row")
    return keyed.join(gone, "_row", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, as documents."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _lean(stage: Stage) -> Stage:
    """``stage`` on executors without the garbage of earlier ones, whose heaps would stand beside its Python workers."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collected(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _lean(drop_toxic)),
    ("line_dedup", _lean(dedup_lines)),
    ("jaccard_join", _lean(keep_one_of_each_group)),
    ("mixing", _lean(mix)),
    ("packing", _lean(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
