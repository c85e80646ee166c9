"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard, language, lines, mixing, neighbours, packing, quality, repeats, shards, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_packing": packing.op2_packing,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_quality": quality.op4_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_language": language.op6_language,
    "op7_shards": shards.op7_shards,
    "op8_lines": lines.op8_lines,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_repeats": repeats.op10_repeats,
}

ORACLE: dict[str, str] = {
    "op4_quality": quality.op4_sql(),
    "op8_lines": lines.op8_sql(),
}
