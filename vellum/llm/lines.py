"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line of at least ``MIN_CHARS`` characters goes if the same line, or one within edit distance ``TAU``
(insertions, deletions and substitutions of characters), stands earlier in the corpus; earlier means a
smaller (doc_id, text hash, line number), judged on the input. Equal lines are one class (by a 64-bit
hash and the length). Each class is cut into TAU + 1 segments; a line within TAU edits has one of
them unchanged, so it is found by a few substrings for each segment whose places and lengths the edits
allow. Candidates are verified by a banded bit-parallel automaton: TAU + 1 words of 2 * TAU + 1 bits,
one bit a diagonal, in one long.

Defined results: a null text stays null and has no lines; rows alike in doc_id and text count as one
document, so that neither loses lines to the other; null ids come first; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

TAU = 2
MIN_CHARS = 20


def segment_keys(lines: DataFrame, own: bool, tau: int = TAU) -> DataFrame:
    """(id, len, key, own) of each line: its own segments, which index it, and unless ``own`` also the
    substrings that may equal segments of lines up to ``tau`` characters shorter.

    The places are rows of literals, so that one short expression is compiled and not one for each.
    """
    parts, places = tau + 1, []
    for d in range(tau + 1):
        for k in range(parts):
            for shift in range(max(-k, d - (tau - k)), min(k, d + (tau - k)) + 1):
                if not own or (d == 0 and shift == 0):
                    places.append(f"named_struct('d', {d}, 'k', {k}, 's', {shift})")
    out = lines.withColumn("p", F.explode(F.expr(f"array({', '.join(places)})"))).selectExpr("id", "len", "line", "p.d", "p.k", "p.s", "len - p.d as short")
    # later segments are the longer ones
    out = out.selectExpr("*", f"short div {parts} as base", f"short % {parts} as extra")
    out = out.selectExpr("*", f"cast(k * base + greatest(0, k - {parts} + extra) + s as int) as at", f"cast(base + if(k >= {parts} - extra, 1, 0) as int) as size")
    return out.where("at >= 0 and at + size <= len").selectExpr("id", "len", "xxhash64(k, short, substring(line, at + 1, size)) as key", "d = 0 and s = 0 as own")


def within(a: Column, b: Column, tau: int = TAU) -> Column:
    """Whether two strings are within ``tau`` edits: a banded automaton over the characters of ``a``.

    Bit d + tau of level e says that the first i + d characters of b are within e edits of the first
    i characters of a.
    """
    width = 2 * tau + 1
    full = (1 << width) - 1
    start = 0
    for e in range(tau + 1):
        start |= sum(1 << (d + tau) for d in range(e + 1)) << (e * width)

    def step(x: Column, y: Column):
        def advance(state: Column, i: Column) -> Column:
            c = F.get(x, i)
            match = F.lit(0).cast("long")
            for d in range(-tau, tau + 1):
                match = match + F.when(F.get(y, i + d) == c, F.lit(1 << (d + tau)).cast("long")).otherwise(F.lit(0).cast("long"))
            levels: list[Column] = []
            for e in range(tau + 1):
                here = F.shiftrightunsigned(state, e * width).bitwiseAND(F.lit(full))
                new = here.bitwiseAND(match)
                if e:
                    before = F.shiftrightunsigned(state, (e - 1) * width).bitwiseAND(F.lit(full))
                    new = new.bitwiseOR(before).bitwiseOR(F.shiftrightunsigned(before, 1)).bitwiseOR(F.shiftleft(levels[-1], 1).bitwiseAND(F.lit(full)))
                levels.append(new)
            out = levels[0]
            for e in range(1, tau + 1):
                out = out.bitwiseOR(F.shiftleft(levels[e], e * width))
            # no state left: nothing can match any more
            return F.when(state == 0, state).otherwise(out)

        return advance

    def run(x: Column) -> Column:
        return F.element_at(F.transform(F.array(F.split(b, "")), lambda y: F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), F.lit(start).cast("long"), step(x, y))), 1)

    last = F.length(b) - F.length(a) + tau  # the diagonal of both ends
    state = F.element_at(F.transform(F.array(F.split(a, "")), run), 1)
    top = F.shiftrightunsigned(state, tau * width)
    return (F.abs(F.length(a) - F.length(b)) <= tau) & F.when(F.length(a) == 0, F.lit(True)).otherwise(F.pmod(F.floor(top / F.pow(F.lit(2.0), last)), F.lit(2)) == 1)


def bigram_bits(line: Column) -> Column:
    """64 parities: whether an odd number of the pairs of neighbouring characters hash to a bit. An edit takes
    away and adds at most two pairs each, so lines within ``tau`` edits differ in 4 * tau bits at most; parities,
    unlike bits that are only set, do not fill up in long lines."""

    def mark(chars: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(chars) - 1), F.lit(0).cast("long"), lambda bits, i: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.get(chars, i - 1), F.get(chars, i)), F.lit(64)).cast("int"))))

    return F.element_at(F.transform(F.array(F.split(line, "")), lambda c: F.when(F.size(c) > 1, mark(c)).otherwise(F.lit(0).cast("long"))), 1)


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, line_no, line) of each line that is long enough."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(F.length("line") >= min_chars)


def removed_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, removed): numbers of the lines that go."""
    occ = occurrences(docs, min_chars)
    place = F.struct("doc_id", "text_hash", "line_no")
    seen = saved(occ.select("doc_id", "text_hash", "line_no", F.xxhash64("line").alias("id"), F.length("line").alias("len")), "lines")
    classes = saved(seen.groupBy("id", "len").agg(F.min(place).alias("first"), F.max(place).alias("last")), "classes")
    lines = occ.select(F.xxhash64("line").alias("id"), F.length("line").alias("len"), "line")
    # a line has a partner if the index holds another line under one of its keys: one row a key tells
    groups = segment_keys(lines, True, tau).groupBy("key").agg(F.min(F.struct("id", "len")).alias("lo"), F.max(F.struct("id", "len")).alias("hi"))
    probe = segment_keys(lines, False, tau).join(groups.hint("shuffle_hash"), "key").where("id <> lo.id or len <> lo.len or id <> hi.id or len <> hi.len")
    hits = saved(probe.select("key", "id", "len", "own", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("only")).distinct(), "hits")
    # where a key indexes two lines or more, each of them is a hit itself
    index = hits.where("own").select("key", "id", "len").union(hits.where("only is not null").select("key", "only.*").distinct())
    need = hits.select("id", "len").union(index.select("id", "len")).distinct()
    where = classes.join(need, ["id", "len"]).select("first.*", "id", "len")
    asked = where.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line_no", "id", "len")).alias("asked"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_h"), "text")
    found = texts.join(asked, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("text_hash")))
    lines = found.select(F.split("text", "\n", -1).alias("_lines"), F.explode("asked").alias("x")).select("x.id", "x.len", F.get("_lines", F.col("x.line_no")).alias("line"))
    lines = saved(lines.dropDuplicates(["id", "len"]).withColumn("bits", bigram_bits(F.col("line"))), "texts")
    # most candidates share a segment and little else: bits in the join's condition keep it from making these pairs
    marks = lines.select("id", "len", "bits")
    left = index.join(marks, ["id", "len"]).toDF("a", "la", "key", "bits_a")
    right = hits.select("key", "id", "len", "own").join(marks, ["id", "len"]).toDF("b", "lb", "key", "own", "bits_b")
    # of two lines of one length, found from both sides by their own segments, one order is enough
    likely = left.join(right, "key").where("(la <> lb or a <> b) and (not own or la <> lb or a < b)")
    likely = saved(likely.where(F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= 4 * tau).select("a", "la", "b", "lb").distinct(), "likely")
    both = likely.join(lines.select(F.col("id").alias("a"), F.col("len").alias("la"), F.col("line").alias("sa")), ["a", "la"])
    both = both.join(lines.select(F.col("id").alias("b"), F.col("len").alias("lb"), F.col("line").alias("sb")), ["b", "lb"])
    links = saved(both.where(within(F.col("sa"), F.col("sb"), tau)).select("a", "la", "b", "lb"), "links")
    sides = links.union(links.select("b", "lb", "a", "la")).toDF("id", "len", "other", "other_len")
    earliest = sides.join(classes.select(F.col("id").alias("other"), F.col("len").alias("other_len"), F.col("first").alias("_f")), ["other", "other_len"]).groupBy("id", "len").agg(F.min("_f").alias("near"))
    judged = classes.join(earliest, ["id", "len"], "left").where("first <> last or near < first")
    judged = judged.select("id", "len", F.when(F.col("near") < F.col("first"), F.lit(None)).otherwise(F.col("first")).alias("stays"))
    gone = seen.join(judged, ["id", "len"]).where(F.col("stays").isNull() | (F.struct("doc_id", "text_hash", "line_no") != F.col("stays")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("removed"))


def dedup_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the text that is left, and _n_lines and _n_removed."""
    gone = removed_lines(docs, tau, min_chars).withColumnRenamed("doc_id", "_d").withColumnRenamed("text_hash", "_h")
    gone = gone.withColumnRenamed("removed", "_removed")
    keyed = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_hash", F.xxhash64("text"))
    out = keyed.join(gone, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left")
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_removed", i)), "\n")
    return out.select(
        *[F.when(F.col("_removed").isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("_n_lines"),
        F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("_n_removed"),
    )


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and a checksum of what is left of each document."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("_n_lines")).cast("long").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_sql() -> str:
    return f"""
WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
c AS (SELECT s, length(s) AS n, min(doc_id * 1000000 + i) AS f FROM l WHERE length(s) >= {MIN_CHARS} GROUP BY s),
near AS (SELECT b.s, min(a.f) AS g FROM c a JOIN c b ON a.n BETWEEN b.n - {TAU} AND b.n + {TAU} AND a.f < b.f AND levenshtein(a.s, b.s) <= {TAU} GROUP BY b.s),
v AS (SELECT l.doc_id, l.i, l.s, c.f IS NOT NULL AND (near.g IS NOT NULL OR c.f <> l.doc_id * 1000000 + l.i) AS gone
      FROM l LEFT JOIN c ON l.s = c.s LEFT JOIN near ON l.s = near.s)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM v GROUP BY doc_id"""
