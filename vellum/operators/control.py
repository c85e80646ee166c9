"""Inputs, releases and resumed runs: what is offered, owed, torn, changed or still to be tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .corpus import Refused


def corpus_documents(paths: DataFrame, root: str) -> DataFrame:
    """(key, path) of the PDF files below a folder, by their path relative to it; refuses one that a table cannot hold."""
    base = root.rstrip("/") + "/"
    found = paths.where(F.col("path").startswith(base) & F.lower("path").endswith(".pdf"))
    out = found.select(F.expr(f"substring(path, {len(base) + 1})").alias("key"), "path")
    if not out.where(F.col("key").rlike("[\\t\\n]")).isEmpty():
        raise Refused("a path holds a tab or a line break")
    return out


def release(feed: Column) -> Column:
    """(state, version, notes) of a release feed: ``offer``, ``none`` for drafts and odd versions, ``unreadable`` for all else."""
    r = F.from_json(feed, "tag_name string, html_url string, draft boolean, prerelease boolean, body string")
    version = F.regexp_replace(r["tag_name"], "^v", "")
    readable = r["tag_name"].isNotNull() & F.coalesce(F.lower(r["html_url"]).startswith("https://"), F.lit(False))
    early = F.coalesce(r["draft"], F.lit(False)) | F.coalesce(r["prerelease"], F.lit(False))
    state = F.when(~F.coalesce(readable, F.lit(False)), "unreadable").when(early, "none").when(~version.rlike("^[0-9]"), "unreadable").when(~version.rlike(r"^[0-9]+(\.[0-9]+)*$"), "none").otherwise("offer")
    offered = state == "offer"
    return F.struct(state.alias("state"), F.when(offered, version).alias("version"), F.when(offered, F.coalesce(r["body"], F.lit(""))).alias("notes"))


def owed_documents(logs: DataFrame, header: str = "document") -> DataFrame:
    """(file, document) that a log (file, content) cut off in its last row owes: that row's and, as it may belong to the
    same write, the one of the last whole row; header and comments are none."""
    lines = F.split("content", "\n", -1)
    torn = logs.where((F.length("content") > 0) & ~F.col("content").endswith("\n"))
    last = F.slice(lines, F.greatest(F.size(lines) - 1, F.lit(1)), F.lit(2))
    keys = F.transform(last, lambda x: F.split(x, "\t")[0])
    return torn.select("file", F.explode(F.array_distinct(F.filter(keys, lambda k: (k != "") & (k != header) & ~k.startswith("#")))).alias("document"))


def whole_rows(logs: DataFrame) -> DataFrame:
    """Logs without what stands after their last line break."""
    return logs.withColumn("content", F.when(F.col("content").endswith("\n"), F.col("content")).otherwise(F.regexp_replace("content", r"[^\n]*\z", "")))


def without_documents(rows: DataFrame, owed: DataFrame) -> DataFrame:
    """Rows of a log whose documents need not be measured anew."""
    return rows.join(owed.select("document").distinct(), "document", "left_anti")


def still_owed(wanted: DataFrame, rows: DataFrame, owed: DataFrame) -> DataFrame:
    """Documents that a resumed run measures: those without a row, and those owed."""
    return wanted.join(without_documents(rows, owed).select("document").distinct(), "document", "left_anti")


def remaining_mutants(catalogue: DataFrame, log: DataFrame) -> DataFrame:
    """Mutants that no whole row (four fields, a verdict) of a log names."""
    done = log.where((F.size("fields") == 4) & (F.col("fields")[0] != "mutant") & (F.col("fields")[1] != "")).select(F.col("fields")[0].alias("mutant")).distinct()
    return catalogue.join(done, "mutant", "left_anti")


def retried(outcomes: DataFrame) -> DataFrame:
    """Files of a run that failed, in their order."""
    return outcomes.where("outcome = 'failed'").select("run", "file", F.row_number().over(Window.partitionBy("run").orderBy("at")).alias("at"))


def list_status(files: DataFrame) -> DataFrame:
    """What a list's line says: nothing, running with how many are done, stopped, or done with how many failed."""
    n, done = F.count("*"), F.count_if(F.col("outcome").isNotNull())
    failed, cancelled = F.count_if(F.col("outcome") == "failed"), F.count_if(F.col("outcome") == "cancelled")
    text = F.when(done == 0, F.concat(n.cast("string"), F.lit(" files"))).when(done < n, F.concat(done.cast("string"), F.lit(" of "), n.cast("string")))
    text = text.when(cancelled > 0, F.concat(F.lit("stopped, "), cancelled.cast("string"), F.lit(" not done"))).when(failed > 0, F.concat(F.lit("done, "), failed.cast("string"), F.lit(" failed"))).otherwise("done")
    return files.groupBy("run").agg(text.alias("status"))


def changed_settings(before: DataFrame, after: DataFrame) -> DataFrame:
    """(run, label): settings (run, label, value) that a preset changes."""
    both = before.join(after.withColumnRenamed("value", "_new"), ["run", "label"])
    return both.where(~F.col("value").eqNullSafe(F.col("_new"))).select("run", "label")


def projected_verdicts(rows: DataFrame) -> DataFrame:
    """(path, verdict, pages) of classifier rows; a number of pages that is none counts 0."""
    return rows.select("path", "verdict", F.coalesce(F.trim("pages").try_cast("int"), F.lit(0)).alias("pages"))


def diverging(a: DataFrame, b: DataFrame, key: list[str], most: float = 1e-12) -> DataFrame:
    """Keys whose value differs between two ways to compute it, or that one lacks."""
    both = a.withColumnRenamed("value", "_a").join(b.withColumnRenamed("value", "_b"), key, "full")
    return both.where(F.coalesce(F.abs(F.col("_a") - F.col("_b")) > most, F.lit(True))).select(*key)


def drawn_census(pages: DataFrame, most: float = 0.05) -> DataFrame:
    """Pages by the verdict on their images, and how many resolutions part by a share of ``most`` or more."""
    apart = F.abs(F.col("drawn_dpi") - F.col("listed_dpi")) / F.col("listed_dpi") >= most
    return pages.groupBy("verdict").agg(F.count("*").alias("pages"), F.count_if(apart).alias("diverging"))


def failing_lines(lines: DataFrame, runs: DataFrame, edge: float = 0.15, least: int = 12) -> DataFrame:
    """Longer lines (doc, page, pos, x, y, width, height, text) with no run's box over their first or last ``edge`` of width."""
    long = lines.where(F.length("text") > least)
    r = runs.select("doc", "page", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    rows = F.col("_x").isNotNull() & (F.least(F.col("y") + F.col("height"), F.col("_y") + F.col("_h")) > F.greatest("y", "_y"))
    over = lambda low, high: F.coalesce(F.bool_or(rows & (F.least(high, F.col("_x") + F.col("_w")) > F.greatest(low, F.col("_x")))), F.lit(False))
    left, right = F.col("x"), F.col("x") + F.col("width")
    hit = long.join(r, ["doc", "page"], "left").groupBy("doc", "page", "pos").agg(over(left, left + edge * F.col("width")).alias("start"), over(right - edge * F.col("width"), right).alias("end"))
    return hit.where("not start or not end")


def json_pages(lines: DataFrame) -> DataFrame:
    """A document's pages and lines as one JSON array, keys in order."""
    line = F.array_sort(F.collect_list(F.struct("pos", "confidence", "text")))
    page = lines.groupBy("doc", "page").agg(F.transform(line, lambda x: F.struct(x["confidence"].alias("confidence"), x["text"].alias("text"))).alias("observations"))
    pages = F.array_sort(F.collect_list(F.struct("page", "observations")))
    return page.groupBy("doc").agg(F.to_json(F.transform(pages, lambda p: F.struct(p["observations"].alias("observations"), p["page"].alias("page")))).alias("json"))


def text_like(parts: DataFrame) -> DataFrame:
    """Components (img, x, y, width, height, area, run) of the size and stroke of their image's glyphs.

    The glyph height and run are upper medians over the image.
    """
    sizes = parts.groupBy("img", "height", "run").agg(F.count("*").alias("n"))

    def middle(value: str) -> DataFrame:
        n = sizes.where(F.col(value).isNotNull()).groupBy("img", value).agg(F.sum("n").alias("n"))
        image = Window.partitionBy("img").orderBy(value)
        upto = F.sum("n").over(image.rowsBetween(Window.unboundedPreceding, 0))
        total = F.sum("n").over(image.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return n.withColumns({"_upto": upto, "_n": total}).where("_upto > _n div 2").groupBy("img").agg(F.min(value).alias(f"_{value}"))

    glyph = middle("height").join(middle("run"), "img")
    fits = (F.col("area") >= 4) & F.col("height").between(0.5 * F.col("_height"), 3 * F.col("_height")) & (F.col("run") <= 2 * F.col("_run"))
    return parts.join(glyph, "img").where(fits).select(*parts.columns, F.col("_height").alias("glyph"))


def ink_lines(parts: DataFrame, least: int = 4, gap: float = 3.0) -> DataFrame:
    """Lines of components (img, at, x, y, width, height, area, glyph): bands of those that overlap the band's last member by half
    their height, cut at gaps of more than three glyph heights, of four members or more.

    An image's components pass by in order, with only the bands in memory that still reach down to them.
    """
    rows = parts.select("img", "at", "x", "y", (F.col("y") + F.col("height") - 1).alias("bottom"), (F.col("x") + F.col("width") - 1).alias("right"), "area")
    rows = rows.repartition("img").sortWithinPartitions("img", "y", "at", "x", "bottom", "right", "area")

    def banded(batches):
        import pyarrow as pa

        image, live, n = object(), [], 0
        for batch in batches:
            found = []
            for img, y, bottom in zip(*(batch.column(c).to_pylist() for c in ("img", "y", "bottom"))):
                if img != image:
                    image, live, n = img, [], 0
                for band in live if y is not None and bottom is not None else ():
                    over = min(bottom, band[2]) - max(y, band[1]) + 1
                    if over > 0 and over >= 0.5 * min(bottom - y + 1, band[2] - band[1] + 1):
                        band[1:] = y, bottom
                        break
                else:
                    n += 1
                    band = [n, y, bottom]
                    if y is not None and bottom is not None:
                        live = [*(b for b in live if b[2] >= y), band]  # the others end above all that follow
                found.append(band[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "band"])

    members = rows.mapInArrow(banded, T.StructType([*rows.schema.fields, T.StructField("band", T.LongType())]))
    glyph = parts.groupBy(F.col("img").alias("_img")).agg(F.max("glyph").alias("glyph"))
    members = members.join(glyph, F.col("img").eqNullSafe(F.col("_img")))
    order = Window.partitionBy("img", "band").orderBy("x", "at")
    cut = F.coalesce((F.col("x") - F.lag("right").over(order) > gap * F.col("glyph")).cast("int"), F.lit(0))
    members = members.withColumn("_cut", cut).withColumn("part", F.sum("_cut").over(order))
    out = members.groupBy("img", "band", "part").agg(F.count("*").alias("members"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("right") - F.min("x") + 1).alias("width"), (F.max("bottom") - F.min("y") + 1).alias("height"), F.sum("area").alias("area"))
    return out.where(F.col("members") >= least).drop("band", "part")
