"""Page and document verdicts: predicates over signal columns, all plain expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bars of the page router and the document verdict.
TONE_BAR, TONE_WITH_INK, INK_BAR, SATURATION_BAR, EXTENT_BAR = 0.12, 0.03, 0.15, 0.06, 0.05
SCAN_WIDTH, SCAN_DPI = 900, (72.0, 1400.0)
DEFAULT_DPI, LEAST_DPI, LEAST_WIDTH = 300.0, 150.0, 600
COLOUR_MEGAPIXELS, PAGE_MEGAPIXELS, SAMPLED_PAGES, LEAST_CHARS, NOTED_GROWTH = 100, 400, 4, 120, 1.25
TEXTUAL_CHARS, PHOTO_ILLUMINATION, PHOTO_SATURATION, PHOTO_BOTH = 200, 0.16, 0.10, 0.10

_COMPARE = {"ge": "__ge__", "gt": "__gt__", "le": "__le__", "lt": "__lt__"}


def parse_where(text: str) -> Column:
    """``COL:OP:VALUE``; ge, gt, le and lt compare numbers, a cell that is none never matches; eq and ne compare strings."""
    name, op, value = text.split(":", 2)
    cell = F.col(name)
    if op in _COMPARE:
        bar = float(value)
        if math.isnan(bar):  # nothing compares with it
            return F.lit(False)
        number = cell.try_cast("double")
        return F.coalesce(~F.isnan(number) & getattr(number, _COMPARE[op])(bar), F.lit(False))
    if op not in ("eq", "ne"):
        raise ValueError(f"unknown comparison {op!r}")
    same = F.coalesce(cell.cast("string"), F.lit("-")) == value
    return same if op == "eq" else ~same


def where_all(df: DataFrame, conditions: list[str]) -> DataFrame:
    """Rows that meet every condition."""
    return df.where(reduce(lambda a, b: a & b, map(parse_where, conditions), F.lit(True)))


def count_unreadable(df: DataFrame, conditions: list[str]) -> DataFrame:
    """How many rows have a cell that is no number under a numeric condition."""
    cells = [F.col(c.split(":", 2)[0]).try_cast("double").isNull() for c in conditions if c.split(":", 2)[1] in _COMPARE]
    return df.agg(F.coalesce(F.sum(reduce(lambda a, b: a | b, cells, F.lit(False)).cast("long")), F.lit(0)).alias("unreadable"))


def is_picture(tone, ink, saturation, mark_tone, extent) -> Column:
    """Whether a page must keep its tones instead of becoming black and white."""
    return (tone > TONE_BAR) | ((tone > TONE_WITH_INK) & (ink > INK_BAR)) | (saturation > SATURATION_BAR) | (mark_tone > TONE_BAR) | (extent > EXTENT_BAR)


def is_scanned_image(width, dpi) -> Column:
    return (width >= SCAN_WIDTH) & dpi.between(*SCAN_DPI)


def rebuild_dpi(dpi, width) -> Column:
    """The resolution to rebuild a page at: its own if good enough, else the default."""
    return F.when(dpi.isNotNull() & ((dpi >= LEAST_DPI) | (width >= LEAST_WIDTH)), dpi).otherwise(F.lit(DEFAULT_DPI))


def document_verdict(unreadable, digital, image_pages, chars_per_page, illumination, saturation) -> Column:
    photographed = (illumination > PHOTO_ILLUMINATION) | ((saturation > PHOTO_SATURATION) & (illumination > PHOTO_BOTH))
    return (
        F.when(unreadable, "unreadable")
        .when(digital, "born-digital")
        .when(image_pages == 0, F.when(chars_per_page > TEXTUAL_CHARS, "textual").otherwise("no-page-image"))
        .when(photographed, "photographed")
        .otherwise("scanned")
    )


def era(year: Column) -> Column:
    return F.when(year.isNull() | (year == 0), "unk").when(year < 1960, "old").when(year < 2000, "mid").otherwise("new")


def sample_indices(count: Column, wanted: int) -> Column:
    """Indices of pages to look at: all, or ``wanted`` spread evenly and away from both ends."""
    spread = F.transform(F.sequence(F.lit(1), F.lit(wanted)), lambda i: F.floor(i * count / (wanted + 1)))
    return F.when(count <= 0, F.array().cast("array<bigint>")).when(count <= wanted, F.sequence(F.lit(0).cast("bigint"), count - 1)).otherwise(spread)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def digital_documents(pages: DataFrame) -> DataFrame:
    """Documents of which more than half of up to four looked-at pages hold text and no page image.

    Pages (doc, page from 1, text, px, dpi) are numbered without gaps; which are looked at follows from their number.
    """
    looked = pages.join(pages.groupBy("doc").agg(F.count("*").alias("_n")), "doc")
    looked = looked.where(F.array_contains(sample_indices(F.col("_n"), SAMPLED_PAGES), F.col("page") - 1))
    digital = (F.length(trimmed(F.coalesce("text", F.lit("")))) >= LEAST_CHARS) & ~F.coalesce(is_scanned_image(F.col("px"), F.col("dpi")), F.lit(False))
    return looked.groupBy("doc").agg((2 * F.sum(digital.cast("long")) > F.count("*")).alias("digital"))


def files_with_digital_text(files: DataFrame, pages: DataFrame) -> DataFrame:
    return files.join(digital_documents(pages).where("digital"), "doc", "left_semi")


def embedded_text(pages: DataFrame) -> DataFrame:
    """Whether any page of a document holds more than white space."""
    return pages.groupBy("doc").agg(F.coalesce(F.bool_or(trimmed(F.col("text")) != ""), F.lit(False)).alias("has_text"))


def top_candidates(candidates: DataFrame) -> DataFrame:
    """The first of each line's ranked readings; lines without any are left out."""
    return candidates.groupBy("doc", "page", "pos").agg(F.min_by(F.struct("text", "confidence"), "rank").alias("_c")).select("doc", "page", "pos", "_c.*")


def keeps_colour(automatic: Column, saturation: Column, pixels: Column) -> Column:
    return automatic & (saturation > SATURATION_BAR) & (pixels <= COLOUR_MEGAPIXELS * 1_000_000)


def rebuild_dpi_of(kind: Column, drawn_dpi: Column, drawn_width: Column, listed_dpi: Column, listed_width: Column) -> Column:
    """By the image drawn; where that cannot be read by the one listed, and by none where nothing is drawn."""
    none = F.lit(None).cast("double")
    return F.when(kind == "unreadable", rebuild_dpi(listed_dpi, listed_width)).when(kind == "none", rebuild_dpi(none, none)).otherwise(rebuild_dpi(drawn_dpi, drawn_width))


def half_up(x: Column) -> Column:
    """Rounded to whole numbers, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def size_guard(width: Column, height: Column, scale: Column) -> Column:
    """``pageFailed`` for a page without pixels, ``pageTooLarge`` for one of too many, null for one that can be drawn."""
    wide, high = half_up(width * scale), half_up(height * scale)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(~(finite(wide) & finite(high) & (wide >= 1) & (high >= 1)), "pageFailed").when(wide * high > PAGE_MEGAPIXELS * 1_000_000, "pageTooLarge")


def wants_jbig2(rebuild: Column, use: Column, mode_can: Column, available: Column, crop_lost: Column) -> Column:
    return rebuild & use & mode_can & available & ~crop_lost


def will_rebuild(has_text: Column, rebuild: Column, wants: Column) -> Column:
    """Pages are drawn anew to strip their text, or to code them in two tones."""
    return (rebuild & has_text) | wants


def warns_of_digital_text(mode: Column, rebuild: Column) -> Column:
    """Extraction always hands back a reading of text that was there; a searchable copy only if it destroys that text."""
    return F.when(mode == "text", F.lit(True)).otherwise(rebuild)


def trimmed_documents(pages: DataFrame) -> DataFrame:
    """Documents with a page whose crop box differs from its sheet; pages (doc, crop, sheet)."""
    return pages.groupBy("doc").agg(F.bool_or(~F.col("crop").eqNullSafe(F.col("sheet"))).alias("trimmed"))


def drawn_verdict(listed_width: Column, kind: Column, drawn_width: Column) -> Column:
    """How the largest image that a page lists compares with the one it draws."""
    return (
        F.when(kind == "unreadable", "unreadable")
        .when(kind == "none", F.when(listed_width.isNull(), "noDictImage").otherwise("drawsNoImage"))
        .when(listed_width.isNull(), "drawnOnly")
        .when(drawn_width == listed_width, "agree")
        .when(drawn_width < listed_width, "smaller")
        .otherwise("wider")
    )


def unsupported(asked: Column, known: Column) -> Column:
    """Asked-for names that are not known, whatever their case; none if nothing is known at all."""
    low = F.transform(known, F.lower)
    return F.when(F.size(known) == 0, F.array().cast("array<string>")).otherwise(F.filter(asked, lambda x: ~F.array_contains(low, F.lower(x))))


def grew(name: Column, before: Column, after: Column) -> Column:
    """Whether a PDF's copy is larger than the original by a ratio worth a note."""
    pdf = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)) == "pdf"
    return F.coalesce(pdf & (before > 0) & (after > before) & (after / before >= NOTED_GROWTH), F.lit(False))


def helper_settings(arguments: Column) -> Column:
    """A struct of ``--name value`` pairs; null if a pair is no such, a value is missing or a flag is neither 0 nor 1.

    Of a repeated name the last value counts.
    """
    def bound(value: Column, body) -> Column:
        """``body`` of a value that is worked out once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def parsed(pairs: Column) -> Column:
        # the last of a name is the first from behind; place 0, of a name that is not there, gives null
        value = lambda name: F.get(pairs["values"], F.array_position(pairs["names"], f"--{name}").cast("int") - 1)
        flag = lambda name: bound(value(name), lambda v: F.when(v == "1", True).when(v == "0", False))
        out = {
            "fast": flag("fast"), "correction": flag("language-correction"), "languages": value("languages"), "words": value("custom-words"),
            "least_height_on": flag("min-text-height-on"), "least_height": value("min-text-height").try_cast("double"), "confidence": value("confidence").try_cast("double"),
        }

        def whole(found: Column) -> Column:
            ok = pairs["even"] & F.forall(pairs["names"], lambda n: n.startswith("--"))
            for k in out:
                ok = ok & found[k].isNotNull()
            return F.when(ok, found)

        return bound(F.struct(*(c.alias(k) for k, c in out.items())), whole)

    every = lambda a, rest: F.reverse(F.filter(a, lambda _, i: i % 2 == rest))
    return bound(arguments, lambda a: bound(F.struct(every(a, 0).alias("names"), every(a, 1).alias("values"), (F.size(a) % 2 == 0).alias("even")), parsed))


def scorer_pages(count: Column) -> Column:
    """Up to three pages: all, or the second, the middle one and that at three quarters."""
    return F.when(count <= 3, F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1)).otherwise(F.array().cast("array<bigint>"))).otherwise(F.array(F.least(F.lit(1).cast("bigint"), count - 1), F.floor(count / 2), F.least(count - 1, F.floor(count * 3 / 4))))


def reading_pages(count: Column, wanted: int) -> Column:
    """Pages evenly from the second to the last but one; all of a short document."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.greatest(F.lit(0).cast("bigint"), F.least(count - 1, 1 + F.floor(i * (count - 2) / max(wanted - 1, 1)))))
    return F.when(count <= 0, F.array().cast("array<bigint>")).when(count <= wanted, F.sequence(F.lit(0).cast("bigint"), count - 1)).otherwise(steps)


def missing_pages(documents: DataFrame, recognised: DataFrame) -> DataFrame:
    """(doc, page) of pages 1 to n that nothing was recognised for; an empty list still counts as recognised."""
    spine = documents.where("n_pages > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_pages"))).alias("page"))
    return spine.join(recognised.select("doc", "page").distinct(), ["doc", "page"], "left_anti")
