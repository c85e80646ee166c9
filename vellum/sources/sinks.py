"""Sinks: page records as JSON lines with sorted keys, text, and tables of a fixed width."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json_lines(pages: DataFrame) -> DataFrame:
    """One JSON object a row, its keys sorted."""
    return pages.select(F.to_json(F.struct(*sorted(pages.columns))).alias("value"))


def write_json_lines(pages: DataFrame, path: str) -> None:
    to_json_lines(pages).write.text(path)


def write_table(df: DataFrame, path: str, columns: list[str]) -> None:
    """A tab-separated table; refuses a frame that does not have exactly these columns. Null is ``-``."""
    if df.columns != columns:
        raise ValueError(f"expected {columns}, got {df.columns}")
    df.write.option("sep", "\t").option("header", "true").option("nullValue", "-").option("quote", "").csv(path)
