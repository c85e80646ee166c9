"""Sources: strict tab-separated tables, observation records and input files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import natural_key

# File types that are taken as input.
INPUT_TYPES = ("pdf", "png", "jpg", "jpeg", "heic", "heif", "tiff", "tif", "bmp", "gif", "webp")
BOX = "struct<x:double,y:double,width:double,height:double>"
PAGES_SCHEMA = f"array<struct<page:int,observations:array<struct<boundingBox:{BOX},text:string,confidence:double>>>>"


def tsv_rows(lines: DataFrame, names: list[str], head: int) -> DataFrame:
    """(n, cells by name) of the lines (n, value) after the header's number: comments and blank lines are passed over, a short
    row is padded with empty cells, as a torn last row is short, and what a long one has too many is cut off."""
    data = lines.where((F.col("n") > head) & ~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("_c", F.split("value", "\t", -1))
    return data.select("n", *(F.coalesce(F.get("_c", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(names)))


def tsv_header(lines: DataFrame, columns: list[str]) -> tuple[list[str], int]:
    """(names, number) of the header, the first line that is no comment and not blank; it must name the columns."""
    first = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).orderBy("n").limit(1).collect()
    if not first:
        raise ValueError("a table without a header")
    names = first[0]["value"].split("\t")
    if missing := [c for c in columns if c not in names]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return names, first[0]["n"]


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of one tab-separated file, in a session that reads its splits in order."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    return tsv_rows(lines, *tsv_header(lines, columns)).drop("n")


def strict_rows(lines: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, bad) of lines without a header: a row has exactly the columns' number of fields, any other line is bad."""
    cells = lines.withColumn("_c", F.split("value", "\t", -1))
    fine = F.size("_c") == len(columns)
    keep = [c for c in lines.columns if c != "value"]
    return cells.where(fine).select(*keep, *(F.get("_c", F.lit(i)).alias(c) for i, c in enumerate(columns))), cells.where(~fine).select(*keep, "value")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page, pos, box, text, confidence) from files that hold one JSON array of pages each."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.from_json("value", PAGES_SCHEMA).alias("pages"))
    pages = files.select("doc", F.explode("pages").alias("p"))
    return pages.select("doc", F.col("p.page").alias("page"), F.posexplode("p.observations").alias("pos", "o")).select("doc", "page", "pos", F.col("o.boundingBox").alias("box"), "o.text", "o.confidence")


def collect_files(spark: SparkSession, folder: str) -> DataFrame:
    """Input files below a folder by extension, each once, with a key of their natural order; hidden files are passed over.

    ``binaryFile`` without its content reads no bytes.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    found = found.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("ext").isin(*INPUT_TYPES))
    return found.dropDuplicates(["path"]).withColumn("order", natural_key(F.col("path")))


def need_columns(df: DataFrame, schema: StructType) -> None:
    """Refuse a table that lacks a column, before anything runs."""
    if missing := [f.name for f in schema if f.name not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
