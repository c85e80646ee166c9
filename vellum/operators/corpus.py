"""Corpus questions: stratified estimates, library joins and the size survey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The survey's bars.
LEAST_SCANS, LEAST_BYTES_PER_PAGE, OUTLIER_RATIO = 100, 150 * 1024, 3.0


class Refused(ValueError):
    """The tables contradict each other; an estimate from them would be wrong."""


def repeated_pages(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc", "page").agg(F.count("*").alias("times")).where("times > 1")


def stray_pages(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows of pages that the sample does not hold."""
    return rows.join(sample.select("doc", "page").distinct(), ["doc", "page"], "left_anti")


def uncovered(sample: DataFrame, census: DataFrame) -> DataFrame:
    """Sampled documents that the census lacks or gives fewer pages than were sampled; (doc, sampled, pages)."""
    per = sample.groupBy("doc").agg(F.count("*").alias("sampled"))
    return per.join(census.select("doc", "pages"), "doc", "left").where("pages is null or sampled > pages")


def read_census(rows: DataFrame, prefix: str = "testdocs/") -> DataFrame:
    """(doc, pages) of (path, pages) cells: a path without its prefix, a whole number of pages."""
    cells = rows.select(F.when(F.col("path").startswith(prefix), F.expr(f"substring(path, {len(prefix) + 1})")).otherwise(F.col("path")).alias("doc"), F.trim("pages").try_cast("bigint").alias("pages"))
    if not cells.groupBy("doc").count().where("count > 1").isEmpty():
        raise Refused("the census names a document twice")
    if not cells.where("pages is null").isEmpty():
        raise Refused("a number of pages is not a whole number")
    return cells


def check_sample(rows: DataFrame, sample: DataFrame, census: DataFrame) -> None:
    """Refuse repeated pages, rows outside the sample, and samples that the census doesn't cover."""
    if not repeated_pages(sample).isEmpty():
        raise Refused("a page is sampled twice")
    if not stray_pages(rows, sample).isEmpty():
        raise Refused("a row lies outside the sample")
    if not uncovered(sample, census).isEmpty():
        raise Refused("the census does not cover the sample")


def stratified_estimate(hits: DataFrame, sample: DataFrame, census: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Pages hit and their value, scaled by each document's share of sampled pages; and the pooled estimate.

    ``documents`` counts documents with a hit, and the exact subtotals are of those sampled whole. Refuses a
    hit without a value, and no hit at all.
    """
    if not hits.where("value is null").isEmpty():
        raise Refused("a selected page has no value")
    if not allow_empty and hits.isEmpty():
        raise Refused("the selection is empty")
    per = sample.groupBy("doc").agg(F.count("*").alias("sampled")).join(census.select("doc", "pages"), "doc")
    found = hits.groupBy("doc").agg(F.count("*").alias("hits"), F.sum("value").alias("value"))
    per = per.join(found, "doc", "left")
    factor, whole = F.col("pages") / F.col("sampled"), F.col("pages") == F.col("sampled")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = per.agg(
        F.count("hits").alias("documents"),
        zero(F.sum("hits")).alias("sampled_hits"),
        zero(F.sum("value")).alias("sampled_value"),
        zero(F.sum(F.col("hits") * factor)).alias("hits"),
        zero(F.sum(F.col("value") * factor)).alias("value"),
        F.count(F.when(whole, F.col("hits"))).alias("exact_documents"),
        zero(F.sum(F.when(whole, F.col("hits")))).alias("exact_hits"),
        zero(F.sum(F.when(whole, F.col("value")))).alias("exact_value"),
        F.count_if(whole).alias("whole_documents"),
        zero(F.sum("sampled")).alias("sample_pages"),
    )
    total = census.agg(F.sum("pages").alias("corpus_pages"), F.count("*").alias("census_documents"))
    share = F.col("corpus_pages") / F.col("sample_pages")
    return out.crossJoin(total).withColumns({"pooled_hits": F.col("sampled_hits") * share, "pooled_value": F.col("sampled_value") * share})


def library(items: DataFrame, attachments: DataFrame, types: DataFrame, dates: DataFrame, parentless: bool = False) -> DataFrame:
    """Stored attachments with their item's type and year; without ``parentless``, those of no item are left out."""
    stored = attachments.where(F.col("path").startswith("storage:"))
    out = stored.join(items, "item", "left" if parentless else "inner")
    out = out.join(types, "type_id", "left" if parentless else "inner").join(dates, "item", "left")
    return out.select("attachment", "item", F.coalesce("type", F.lit("(no item)")).alias("type"), F.coalesce(F.substring("date", 1, 4), F.lit("?")).alias("year"), "path")


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median): exact medians, the mean of both middle values of an even number.

    Approximate percentiles bracket the middle by five times their error; a second pass counts the values below
    the bracket and sorts only those inside, a thousandth of all, so that no task holds a whole group.
    """
    bounds = rows.groupBy(key).agg(F.count(value).alias("n"), F.percentile_approx(value, [0.4995, 0.5005], 10_000).alias("_p")).where("n > 0")
    bounds = bounds.select(F.col(key).alias("_key"), "n", F.col("_p")[0].alias("_low"), F.col("_p")[1].alias("_high"))
    near = rows.join(bounds, F.col(key).eqNullSafe(F.col("_key"))).where(F.col(value) <= F.col("_high"))
    inside = F.when(F.col(value) >= F.col("_low"), F.col(value))
    out = near.groupBy("_key", "n").agg(F.count_if(F.col(value) < F.col("_low")).alias("_below"), F.array_sort(F.collect_list(inside)).alias("_v"))
    at = lambda rank: F.get("_v", (rank - F.col("_below")).cast("int"))
    return out.select(F.col("_key").alias(key), "n", ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"))


def judge_sizes(rows: DataFrame, least_scans: int = LEAST_SCANS, least_bytes: float = LEAST_BYTES_PER_PAGE, ratio: float = OUTLIER_RATIO) -> DataFrame:
    """Each scan's bytes a page against the median of its type, or of the library where a type has few scans."""
    scans = rows.where("scanned and per_page is not null")
    by_type = medians(scans, "type", "per_page").where(F.col("n") >= least_scans).select(F.col("type"), F.col("median").alias("type_median"))
    whole = medians(scans.withColumn("_all", F.lit(1)), "_all", "per_page").agg(F.max("median").alias("library_median"))
    out = rows.join(F.broadcast(whole)).join(by_type, "type", "left")
    median = F.coalesce("type_median", "library_median")
    out = out.withColumn("basis", F.when(F.col("type_median").isNotNull(), "type").otherwise("library")).withColumn("ratio", F.try_divide("per_page", median))
    outlier = F.col("scanned") & (F.col("per_page") >= least_bytes) & (F.col("ratio") >= ratio)
    return out.withColumn("verdict", F.when(outlier & (F.col("basis") == "type"), "candidate").when(outlier, "review").otherwise("fine"))


def stratified_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """Up to ``n`` rows of each stratum, in an order that depends on the seed and the key alone."""
    w = Window.partitionBy(*strata).orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def upper_median(values: str):
    """The upper of the two middle values, not their mean."""
    return F.expr(f"get(array_sort(collect_list({values})), cast(count({values}) div 2 as int))")


def nearest_rank(values: str, percent: float):
    """The value at round(percent / 100 * (n - 1)), halves away from zero."""
    return F.expr(f"get(array_sort(collect_list({values})), cast(round({percent} / 100 * (count({values}) - 1)) as int))")


def document_signals(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc").agg(F.count("*").alias("pages"), F.avg("chars").alias("mean_chars"), F.max("px").alias("max_px"), upper_median("dpi").alias("median_dpi"), nearest_rank("chars", 95).alias("p95_chars"))


def tally(outcomes: DataFrame) -> DataFrame:
    """Rows of each outcome, as one row with a sorted map."""
    counts = outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
    return counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("outcome", "n"))), lambda x: F.concat_ws("=", x["outcome"], x["n"].cast("string"))), ",").alias("tally"), F.sum("n").alias("total"))


def not_yet_done(wanted: DataFrame, done: DataFrame, key: str = "doc") -> DataFrame:
    """Documents that an earlier run has not completed."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")
