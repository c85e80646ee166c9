"""Scalar expressions over strings, versions and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_list(text: Column) -> Column:
    """Items between commas and white space, without empty ones."""
    return F.filter(F.split(text, r"[,\n\r\t ]+"), lambda x: x != "")


def is_newer(version: Column, than: Column) -> Column:
    """Whether a dotted version is greater: of each part its digits count, missing parts and parts without any being 0."""
    number = lambda x: F.coalesce(F.regexp_replace(x, r"[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))
    parts = lambda v: F.transform(F.filter(F.split(v, r"\."), lambda x: x != ""), number)
    zero = F.lit(0).cast("bigint")
    padded = lambda a, b: F.concat(a, F.array_repeat(zero, F.greatest(F.lit(0), F.size(b) - F.size(a))))
    return padded(parts(version), parts(than)) > padded(parts(than), parts(version))


def announces(version: Column, current: Column, skipped: Column) -> Column:
    """A newer version that is not the one the user wants to skip."""
    return is_newer(version, current) & ~version.eqNullSafe(skipped)


def is_due(now: Column, last: Column, enabled: Column, interval: float = 86_400.0) -> Column:
    """Whether to look again: never done, long ago, or done in what is the future now."""
    return enabled & ((last <= 0) | (now - last >= interval) | (now < last))


def safe_int(x: Column) -> Column:
    """Truncated to a whole number; not-a-number and infinities give 0, and the ends are held."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0).cast("bigint")).otherwise(F.least(F.greatest(x, F.lit(-9e18)), F.lit(9e18)).cast("bigint"))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, cut off; null of nothing."""
    return F.floor(F.try_divide(100.0 * part, whole)).cast("bigint")


def duration(seconds: Column) -> Column:
    """``Hh MMm SSs``, without leading zero parts."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), pad(m), F.lit("m "), pad(s), F.lit("s"))).when(m > 0, F.concat(m.cast("string"), F.lit("m "), pad(s), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def pdf_string(text: Column) -> Column:
    """A literal in parentheses for ASCII, else hexadecimal UTF-16 with its mark."""
    escaped = F.regexp_replace(text, r"([()\\])", r"\\$1")
    return F.when(text.rlike(r"^[\x20-\x7E]*$"), F.concat(F.lit("("), escaped, F.lit(")"))).otherwise(F.concat(F.lit("<FEFF"), F.hex(F.encode(text, "UTF-16BE")), F.lit(">")))


def fnv48(text: Column) -> Column:
    """The lower 48 bits of the 64-bit FNV-1a hash of a text's UTF-8, as 12 hexadecimal digits.

    The prime is 2**40 + 435, so the lower 48 bits of a product need no more than the lower 48 of its factors.
    """
    digits = F.hex(F.encode(text, "UTF-8"))
    at = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))

    def step(h: Column, i: Column) -> Column:
        x = h.bitwiseXOR(F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("bigint"))
        return (x * 435 + F.shiftleft(x.bitwiseAND(F.lit(255)), 40)).bitwiseAND(F.lit((1 << 48) - 1))

    start = F.lit(0xCBF29CE484222325 & ((1 << 48) - 1)).cast("bigint")
    return F.lower(F.lpad(F.hex(F.aggregate(at, start, step)), 12, "0"))


def same_words(a: Column, b: Column) -> Column:
    """Whether two texts differ in white space at most."""
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    return words(a) == words(b)


def natural_key(text: Column) -> Column:
    """A key by which numbers in texts sort as numbers and letters whatever their case."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(F.lower(x))), "")


def stamp(seconds: Column) -> Column:
    """A date for names of files, without characters that file systems refuse."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH.mm.ss")
