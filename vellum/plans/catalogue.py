"""All registered queries of the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import control_queries, image_queries, page_queries, report_queries, structure_queries, text_queries  # noqa: F401  (they register their queries)
from .registry import ORACLE, QUERIES  # noqa: F401


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stratified page estimate."""
    return page_queries.stratified(spark, sf_dir)
