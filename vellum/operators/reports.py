"""Counts and summaries that a run, a survey or a measurement ends with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Bands of ink outside text, buckets of skew, bars of the gate and the release check.
INK_BANDS = ((0.0, 0.045), (0.045, 0.08), (0.08, 1.01))
SKEW_BARS = (0.25, 0.5, 1.0)
WRONG_DEGREES, FADED, BLANK_INK, LEAST_REPEATS = 0.25, 0.5, 0.001, 3


def at_rank(values: str, rank: str) -> Column:
    """The sorted value at an index that may use n, their number; null of nothing."""
    n = f"count({values})"
    return F.expr(f"get(array_sort(collect_list({values})), cast({rank.replace('n', n)} as int))")


def p95(values: str) -> Column:
    """The value at a whole 95 hundredths of the number of values."""
    return at_rank(values, "least(n * 95 div 100, n - 1)")


def reclaimable(judged: DataFrame) -> DataFrame:
    """Candidates of a survey, their bytes, and those above their type's median a page, each cut to whole bytes."""
    over = F.expr("cast(bytes - coalesce(type_median, 0) * pages as bigint)")
    return judged.where("verdict = 'candidate'").agg(F.count("*").alias("candidates"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.greatest(F.coalesce(F.sum(over), F.lit(0)), F.lit(0)).alias("reclaimable"))


def borrowed_types(judged: DataFrame) -> DataFrame:
    """Types judged by the library's median: their files, and how many of these are scans."""
    return judged.where("basis = 'library'").groupBy("type").agg(F.count("*").alias("files"), F.count_if("scanned").alias("scans"))


def survey_order(judged: DataFrame) -> DataFrame:
    """Rank of each row: candidates first, then those with a median of their type, then by ratio."""
    w = Window.partitionBy("stratum").orderBy(F.col("verdict") != "candidate", F.col("basis") != "type", F.desc(F.coalesce("ratio", F.lit(0.0))), "doc")
    return judged.withColumn("rank", F.row_number().over(w))


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    """(section, key, n) for each value of each column, in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("section"), F.col(c).cast("string").alias("key")) for c in columns))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.section", "p.key").agg(F.count("*").alias("n"))


def first_statuses(rows: DataFrame) -> DataFrame:
    """(document, status): the first that a log (n, document, page, status, ...) gives each document."""
    return rows.groupBy("document").agg(F.min_by("status", "n").alias("status"))


def measured_pages(rows: DataFrame) -> DataFrame:
    """Measured rows of a log, the first of each page, with the number of its rows as ``times``."""
    w = Window.partitionBy("document", "page")
    ok = rows.where("status = 'ok'").withColumns({"_rank": F.row_number().over(w.orderBy("n")), "times": F.count("*").over(w)})
    return ok.where("_rank = 1").drop("_rank")


def bar_report(rows: DataFrame) -> DataFrame:
    """(section, key, n): documents by status, pages by route and verdict, bands of ink, and what the bar would move.

    A page moves if it reads all-text and, by the first word of ``bar_verdict``, picture. Bytes count where both are numbers.
    """
    pages = measured_pages(rows)
    ink = F.col("ink").try_cast("double")
    band = F.when(ink.isNull(), "none")
    for low, high in INK_BANDS:
        band = band.when((ink >= low) & (ink < high), f"{low:g}-{high:g}")
    moved = (F.col("verdict") == "all-text") & (F.split("bar_verdict", " ")[0] == "picture") & ink.isNotNull()
    now, then = F.col("layered").try_cast("bigint"), F.col("at_bar").try_cast("bigint")
    priced = moved & now.isNotNull() & then.isNotNull()
    totals = {
        "pages": F.count("*"), "repeated": F.coalesce(F.sum(F.col("times") - 1), F.lit(0)), "moved": F.count_if(moved), "unpriced": F.count_if(moved & ~priced),
        "shipped": F.coalesce(F.sum(F.when(priced, now)), F.lit(0)), "at_bar": F.coalesce(F.sum(F.when(priced, then)), F.lit(0)),
    }
    sums = pages.agg(F.array(*(F.struct(F.lit("total").alias("section"), F.lit(k).alias("key"), c.cast("bigint").alias("n")) for k, c in totals.items())).alias("t")).select(F.inline("t"))
    by = counts_by(pages.withColumn("band", band.otherwise("outside")), "route", "verdict", "band")
    return counts_by(first_statuses(rows), "status").union(by).union(sums)


def tool_rows(lines: DataFrame, columns: list[str]) -> DataFrame:
    """(file, n, fields, error) of a tool's output (file, n, value): rows after the header up to a blank line.

    A file whose header or row is not as expected gives one row with the error and no fields.
    """
    file, before = Window.partitionBy("file"), Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.trim("value") == ""
    out = lines.withColumn("_head", F.min(F.when(~blank, F.col("n"))).over(file))
    out = out.withColumn("_ended", F.max(F.when((F.col("n") > F.col("_head")) & blank, 1)).over(before)).where("n >= _head and _ended is null")
    fields = F.split("value", "\t", -1)
    wrong = F.when((F.col("n") == F.col("_head")) & (F.col("value") != "\t".join(columns)), "header drift").when((F.col("n") > F.col("_head")) & (F.size(fields) != len(columns)), "row width")
    order = F.when(wrong == "header drift", 0).otherwise(1)
    out = out.select("file", "n", "_head", fields.alias("fields"), F.min_by(wrong, F.when(wrong.isNotNull(), F.struct(order, "n"))).over(file).alias("error"))
    good = out.where("error is null and n > _head").select("file", "n", "fields", "error")
    return good.unionByName(out.where("error is not null and n = _head").select("file", "n", F.lit(None).cast("array<string>").alias("fields"), "error"))


def and_more(names: Column, most: int) -> Column:
    """The first names, and how many more there are."""
    rest = F.size(names) - most
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(rest > 0, F.concat(F.lit(" and "), rest.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def shortages(candidates: DataFrame, strata: list[str], wanted: int) -> DataFrame:
    """Strata with fewer scans than wanted, and what else they hold."""
    scan = F.col("verdict") == "scanned"
    return candidates.groupBy(*strata).agg(F.count_if(scan).alias("scans"), F.count_if(~scan).alias("rejected")).where(F.col("scans") < wanted)


def offset_summary(lines: DataFrame) -> DataFrame:
    """Per document: lines whose text was found at an offset, the upper median of these, and lines ambiguous or not found."""
    return lines.groupBy("doc").agg(F.count("offset").alias("located"), F.count_if("ambiguous").alias("ambiguous"), F.count_if(F.col("offset").isNull()).alias("unplaced"), at_rank("offset", "n div 2").alias("median"))


def nearest_step(found: DataFrame) -> DataFrame:
    """The first step of each line in search order: nearest first, of two as near the upward one."""
    return found.groupBy("doc", "page", "pos").agg(F.min_by("step", F.struct(F.abs("step"), -F.col("step"))).alias("offset"))


def skew_buckets(pages: DataFrame) -> DataFrame:
    """Pages by their skew: characters before and after straightening, and pages that gained or lost."""
    a = F.abs("degrees")
    label = F.when(a < SKEW_BARS[0], "< 0.25").when(a < SKEW_BARS[1], "0.25-0.5").when(a < SKEW_BARS[2], "0.5-1.0").otherwise(">= 1.0")
    return pages.groupBy(label.alias("bucket")).agg(F.count("*").alias("pages"), F.sum("before").alias("before"), F.sum("after").alias("after"), F.count_if(F.col("after") > F.col("before")).alias("better"), F.count_if(F.col("after") < F.col("before")).alias("worse"))


def skew_validation(attempts: DataFrame) -> DataFrame:
    """Planted against measured angles (doc, start, planted, measured): how often measured, abstained and wrong, and the errors."""
    error = F.abs(F.col("measured") - (F.col("start") + F.col("planted")))
    out = attempts.withColumn("error", error).groupBy("doc").agg(
        F.count("error").alias("measured"), F.count_if(F.col("error").isNull()).alias("abstained"), F.count_if(F.col("error") > WRONG_DEGREES).alias("wrong"),
        at_rank("error", "n div 2").alias("median"), p95("error").alias("p95"), F.max("error").alias("worst"),
    )
    return out.withColumn("correct", F.try_divide(100.0 * (F.col("measured") - F.col("wrong")), F.col("measured")))


def repeatability(blocks: DataFrame) -> DataFrame:
    """(doc, pages, mean, worst): how much each block (doc, page, block, mean) of a page, over the page's brightest, varies."""
    share = blocks.withColumn("_share", F.col("mean") / F.max("mean").over(Window.partitionBy("doc", "page")))
    by = share.groupBy("doc", "block").agg(F.stddev_pop("_share").alias("sd"), F.count("*").alias("pages")).where(F.col("pages") >= LEAST_REPEATS)
    return by.groupBy("doc").agg(F.max("pages").alias("pages"), F.avg("sd").alias("mean"), F.max("sd").alias("worst"))


def routing_summary(pages: DataFrame) -> DataFrame:
    return pages.groupBy("route").agg(F.count("*").alias("pages"), (F.sum("bytes") / F.count("*") / 1024).alias("kb_a_page"))


def gate_rows(pages: DataFrame) -> DataFrame:
    """One row a document: characters, bytes, pages, mean ink, blank pages, the worst and faded pages, the dimmest ink ratio."""
    return pages.groupBy("doc").agg(
        F.sum("chars").alias("characters"), F.sum("bytes").alias("bytes"), F.count("*").alias("pages"), F.avg("ink").alias("ink"), F.count_if(F.col("ink") < BLANK_INK).alias("blank"),
        F.min_by("page", F.struct("resemblance", "page")).alias("worst_page"), F.count_if(F.col("ratio") < FADED).alias("faded"), F.min("ratio").alias("dimmest"),
    )


def gate_tally(rows: DataFrame) -> DataFrame:
    """All documents of a gate run."""
    return rows.agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"), F.sum("characters").alias("characters"), F.sum("bytes").alias("bytes"), F.sum("blank").alias("blank"), F.sum("faded").alias("faded"), F.min("dimmest").alias("dimmest"))


def unmatched_pages(source: DataFrame, output: DataFrame) -> DataFrame:
    """Pages that only one side has."""
    both = source.select("doc", "page", F.lit(True).alias("_s")).join(output.select("doc", "page", F.lit(True).alias("_o")), ["doc", "page"], "full")
    return both.where("_s is null or _o is null").select("doc", "page", F.when(F.col("_s").isNull(), "source").otherwise("output").alias("missing"))


def layer_choice(pages: DataFrame) -> DataFrame:
    """Bytes of pages in layers and as one image, and of the smaller of both, which is layers only where they are smaller."""
    kept = F.col("layered") < F.col("single")
    return pages.groupBy("doc").agg(F.count("*").alias("pages"), F.count_if(kept).alias("layered_pages"), F.sum("single").alias("single"), F.sum("layered").alias("layered"), F.sum(F.when(kept, F.col("layered")).otherwise(F.col("single"))).alias("kept"))


def codec_totals(pages: DataFrame) -> DataFrame:
    """By quality: bytes of two codecs (a, b) and the worst loss of decibels of the second."""
    return pages.groupBy("quality").agg(F.sum("a_bytes").alias("a_bytes"), F.sum("b_bytes").alias("b_bytes"), F.min(F.col("b_db") - F.col("a_db")).alias("worst_delta"))


def route_totals(pages: DataFrame) -> DataFrame:
    """Bytes layered and in two tones, over all pages, the all-text ones and those whose verdict another bar moves."""
    text, moved = F.col("verdict") == "all-text", F.col("verdict") != F.col("bar_verdict")
    total = lambda c, by: F.coalesce(F.sum(F.when(by, F.col(c))), F.lit(0))
    return pages.groupBy("doc").agg(
        F.sum("layered").alias("layered"), F.sum("two_tone").alias("two_tone"), F.count_if(text).alias("text_pages"), total("layered", text).alias("text_layered"), total("two_tone", text).alias("text_two_tone"),
        F.count_if(moved).alias("moved_pages"), (total("two_tone", moved) - total("layered", moved)).alias("moved_delta"),
    )


def document_info(pages: DataFrame) -> DataFrame:
    """Pages, pages with text, characters."""
    return pages.groupBy("doc").agg(F.count("*").alias("pages"), F.count_if(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) > 0).alias("pages_with_text"), F.sum(F.length("text")).alias("characters"))


def annotation_report(marks: DataFrame) -> DataFrame:
    """Marks copied and dropped of each document, by subtype in order."""
    listed = lambda done: F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col("copied") == done, F.struct("subtype", "n"))), lambda x: x.isNotNull())), lambda x: F.concat_ws(" ", x["subtype"], x["n"].cast("string"))), ", ")
    return marks.groupBy("doc", "subtype", "copied").agg(F.count("*").alias("n")).groupBy("doc").agg(listed(True).alias("copied"), listed(False).alias("dropped"))


def all_empty(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Whether no page of a document (doc, n_pages) holds any line."""
    per = lines.groupBy("doc").agg(F.count("*").alias("_n"))
    return documents.join(per, "doc", "left").select("doc", (F.coalesce("_n", F.lit(0)) == 0).alias("empty"))


def paired_marks(source: DataFrame, output: DataFrame) -> DataFrame:
    """Marks (doc, page, subtype, at, ...) of a source with those of its output, the k-th of a page and subtype with the k-th; null where none is left."""
    w = Window.partitionBy("doc", "page", "subtype").orderBy("at")
    keys = ["doc", "page", "subtype", "k"]
    return source.withColumn("k", F.row_number().over(w)).join(output.withColumn("k", F.row_number().over(w)).select(*keys, F.col("at").alias("output_at")), keys, "left")


def differing_marks(source: DataFrame, output: DataFrame) -> DataFrame:
    """Marks that one side has more often than the other."""
    return source.exceptAll(output).withColumn("side", F.lit("source")).union(output.exceptAll(source).withColumn("side", F.lit("output")))


def last_durations(log: DataFrame, owed: int, last: int = 5) -> DataFrame:
    """Least and greatest seconds of the last runs that finished, and what ``owed`` more would take."""
    rank = log.where("seconds > 0 and verdict in ('killed', 'SURVIVED')").orderBy(F.desc("n")).limit(last)
    return rank.agg(F.min("seconds").alias("least"), F.max("seconds").alias("most"), (F.min("seconds") * owed).alias("least_total"), (F.max("seconds") * owed).alias("most_total"))


def collected_inputs(paths: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Paths (at, path, named) of readable kinds, each standardised one once, the first; hidden files found in folders are passed over."""
    plain = F.regexp_replace(F.regexp_replace("path", r"/(\./)+", "/"), r"/+", "/")
    kind = F.lower(F.regexp_extract(plain, r"\.([^./]+)$", 1)).isin(*extensions)
    hidden = plain.rlike(r"/\.[^/]+$") & ~F.col("named")
    kept = paths.withColumn("path", plain).where(kind & ~hidden)
    return kept.groupBy("path").agg(F.min("at").alias("at"))


def ignored_inputs(paths: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """How many paths that were named themselves are of no readable kind."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)
    return paths.agg(F.count_if(F.col("named") & ~kind).alias("ignored"))


def distinct_steps(values: Column, apart: float = 0.05) -> Column:
    """Values of an array that differ by ``apart`` or more from all kept before them."""
    kept = F.slice(values, 1, 0)
    return F.aggregate(values, kept, lambda k, x: F.when(F.exists(k, lambda y: F.abs(y - x) < apart), k).otherwise(F.concat(k, F.array(x))))


def batch(files: DataFrame, skipped: DataFrame, digital: DataFrame) -> DataFrame:
    return files.select("doc").exceptAll(skipped.select("doc").union(digital.select("doc")).distinct())


def embedded_text(pages: DataFrame) -> DataFrame:
    """(doc, text, skipped) of documents with any text: pages in order, a placeholder for those without, whose numbers are listed."""
    has = F.coalesce(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) > 0, F.lit(False))
    piece = F.when(F.col("text").isNull(), "[unreadable page]").when(has, F.col("text")).otherwise("[no text on this page]")
    out = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", piece.alias("t"), has.alias("has")))).alias("p"), F.bool_or(has).alias("_any")).where("_any")
    missing = F.transform(F.filter("p", lambda x: ~x["has"]), lambda x: x["page"].cast("string"))
    return out.select("doc", F.array_join("p.t", "\n\n").alias("text"), F.array_join(missing, ",").alias("skipped"))


def unique_names(files: DataFrame, suffix: str, extension: str) -> DataFrame:
    """(folder, at, base, name): an output name for each file, in order, that no file and no earlier output of its folder has, whatever the case.

    Only bases that are one but for numbers behind them can come to one name, so the ordered fold runs over those of a folder.
    Its memory holds the next number of each base and the names without a number of its own, not all that were given.
    """
    tail = F.lower(F.lit(f"{suffix}.{extension}"))
    body = lambda name: F.left(name, F.length(name) - F.length(tail))
    # a small sigma's form depends on what follows it
    family = F.translate(F.regexp_replace("body", r"( [1-9][0-9]*)+\z", ""), "ς", "σ")
    names = files.select("folder", F.lit(1).alias("kind"), "at", "base", body(F.lower(F.concat("base", F.lit(f"{suffix}.{extension}")))).alias("body"), F.lower(F.concat("base", F.lit(" "))).alias("head"))
    there = files.select("folder", F.lower("file").alias("low")).where(F.col("low").endswith(tail)).distinct()
    there = there.select("folder", F.lit(0).alias("kind"), body(F.col("low")).alias("body"))
    rows = there.unionByName(names, allowMissingColumns=True).withColumn("family", family)
    rows = rows.repartition("folder", "family").sortWithinPartitions("folder", "family", "kind", "at", "base")

    def numbered(batches):
        import pyarrow as pa

        now, taken, following = object(), set(), {}
        for batch in batches:
            out = []
            for folder, family, kind, body, head in zip(*(batch.column(c).to_pylist() for c in ("folder", "family", "kind", "body", "head"))):
                if (folder, family) != now:
                    now, taken, following = (folder, family), set(), {}
                n = 1
                if kind and body is not None:
                    front, space, k = body.rpartition(" ")
                    own = k.isascii() and k.isdigit() and k[0] != "0" and len(k) < 19
                    # all numbers of a base below its next one are taken
                    if body in taken or own and 2 <= int(k) < following.get(front + space, 2):
                        n = following.get(head, 2)
                        while f"{head}{n}" in taken:
                            n += 1
                        following[head] = n + 1
                if n == 1 and body is not None:
                    taken.add(body)
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "n"])

    out = rows.mapInArrow(numbered, T.StructType([*rows.schema.fields, T.StructField("n", T.LongType())])).where("kind = 1")
    number = F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit(" "), F.col("n").cast("string")))
    return out.select("folder", "at", "base", F.concat("base", number, F.lit(f"{suffix}.{extension}")).alias("name"))


def run_report(outcomes: DataFrame) -> DataFrame:
    """A run's report: how many of each outcome, then each failure with its message."""
    count = lambda kind: F.count_if(F.col("outcome") == kind).cast("string")
    failed = F.collect_list(F.when(F.col("outcome") == "failed", F.struct("file", "message")))
    lines = F.transform(F.array_sort(failed), lambda x: F.concat(F.lit("  "), x["file"], F.lit(": "), x["message"]))
    head = F.concat(count("succeeded"), F.lit(" succeeded, "), count("failed"), F.lit(" failed, "), count("cancelled"), F.lit(" cancelled"))
    return outcomes.groupBy("run").agg(F.array_join(F.concat(F.array(head), lines), "\n").alias("report"))


def sample_manifest(rows: DataFrame) -> DataFrame:
    return rows.select("type", "era", "file", "key").orderBy("type", "era", "file", "key")


def extracted_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, at, page) of wanted pages, numbered as asked for; refuses repeated and missing ones."""
    from .corpus import Refused

    if not wanted.groupBy("doc", "page").count().where("count > 1").isEmpty() or not wanted.join(pages, ["doc", "page"], "left_anti").isEmpty():
        raise Refused("a page is asked for twice or is not there")
    return wanted.join(pages, ["doc", "page"]).select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("at")).alias("number"), "page")


def outcome(cancelled: Column, error: Column) -> Column:
    """A cancelled file stays cancelled, whatever error that led to."""
    return F.when(cancelled, "cancelled").when(error.isNotNull(), "failed").otherwise("succeeded")


def document_status(code: Column, timed_out: Column, pages: Column, parsed: Column) -> Column:
    return F.when(timed_out.isNotNull(), F.concat(F.lit("timeout:"), timed_out.cast("string"))).when(code != 0, F.concat(F.lit("error:"), code.cast("string"))).when(~parsed, "error:parse").when(pages == 0, "no-pages").otherwise("ok")


def mixed_stamps(log: DataFrame) -> DataFrame:
    """Files whose rows were measured with more than one bar or corpus; the binary may differ."""
    return log.groupBy("file").agg(F.countDistinct("bar", "corpus").alias("stamps"), F.countDistinct("binary").alias("binaries")).where("stamps > 1")


def confidence_readout(threshold: Column) -> Column:
    return F.when(threshold <= 0, "off").otherwise(F.concat(F.format_number(F.round(threshold * 100), 0), F.lit("%")))


def page_text(text: Column) -> Column:
    """A page's text on one line, or a mark that it has none."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n", " / "), F.lit("")), F.lit("<NO EMBEDDED TEXT>"))


def display_box(rotation: Column, media: Column, crop: Column) -> Column:
    """(width, height) of the crop box, or of the media box where it is empty, as shown: a quarter turn swaps them."""
    box = F.when((crop["width"] > 0) & (crop["height"] > 0), crop).otherwise(media)
    turned = F.pmod(rotation, F.lit(180)) == 90
    return F.struct(F.when(turned, box["height"]).otherwise(box["width"]).alias("width"), F.when(turned, box["width"]).otherwise(box["height"]).alias("height"))


def native_dpi(pixels: Column, points: Column) -> Column:
    return F.when((pixels > 0) & (points > 0), pixels * 72 / points).otherwise(72.0)


def line_boxes(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Pixel bounds, inclusive, as shares of the page."""
    return F.struct((left / width).alias("x"), (top / height).alias("y"), ((right - left + 1) / width).alias("width"), ((bottom - top + 1) / height).alias("height"))


def dpi_race(candidates: DataFrame, truth: str = "words") -> DataFrame:
    """Of each page's resolutions, the least number of bytes among those that keep the most words."""
    return candidates.groupBy("doc", "page").agg(F.max("retained").alias("retained"), F.min_by("dpi", F.struct(-F.col("retained"), F.col("bytes"), F.col("dpi"))).alias("dpi"))
