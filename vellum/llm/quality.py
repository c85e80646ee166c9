"""Quality rules: a table of thresholds compiled into one Spark projection.

Every metric is a built-in expression (no user functions) over one row, so the whole verdict is one
projection above the scan: no shuffle, and only doc_id and text are read.

Defined results: a null text has no words and fails; an empty table gives an empty result; rows are
judged each by itself, so repeated rows and ties don't matter. Other columns are left alone by
quality_verdicts(), which names its own columns first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD

WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
LOWER = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß"
# The most common function words of the languages that the rules know.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on that the this to was with "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "aber auf das dem den der des die ein eine es für im in ist mit nicht sich sie und von zu "
    "al como con del el ella en es la las lo los más no para pero por se su un una y"
)


@dataclass(frozen=True)
class Rule:
    """A document is kept only if least <= metric <= most."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios are of words, characters or lines as the metric says.
RULES = (
    Rule("too_short", "n_words", least=20),
    Rule("repeats_itself", "repeat_ratio", most=0.3),
    Rule("word_length", "mean_word_length", least=2.0, most=14.0),
    Rule("symbols", "symbol_ratio", most=0.3),
    Rule("capitals", "upper_ratio", most=0.6),
    Rule("stop_words", "stop_ratio", least=0.04),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
)


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _let(value: Column, body) -> Column:
    """Bind an expression to a name, so that it is worked out once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by 64-bit hashes; only texts that repeat some window pay for sorting them.
    """
    n = F.size(words) - (window - 1)

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        starts = _let(by_hash, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: same(s, i, i - 1) | same(s, i, i + 1)), lambda x: x["i"])))
        # a start covers its window, but not beyond the next start
        return _let(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x))

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, window)))

    body = _let(hashed(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(n > 1, body).otherwise(F.lit(0)).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """The counts that rules are made of, one row a document, beside its doc_id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", text.alias("text")).withColumn("_words", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(0)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    out = out.withColumn("_lines", lines)
    stop = [F.lit(w) for w in dict.fromkeys(STOP_WORDS.split())]
    return out.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _without(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("_n_lines"),
        _without(F.col("text"), UPPER).alias("_upper"),
        _without(F.col("text"), LOWER).alias("_lower"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*stop))).alias("_stop"),
    )


METRICS = {
    "n_words": "n_words",
    "repeat_ratio": "try_divide(n_repeat_words, n_words)",
    "mean_word_length": "try_divide(word_chars, n_words)",
    "symbol_ratio": "try_divide(n_symbols, n_words)",
    "upper_ratio": "try_divide(_upper, _upper + _lower)",
    "stop_ratio": "try_divide(_stop, n_words)",
    "dup_line_ratio": "try_divide(n_dup_lines, _n_lines)",
}


def compile_rules(rules=RULES) -> Column:
    """The names of the rules that a document breaks, as one array expression; a metric without a value breaks none."""
    broken = []
    for r in rules:
        m = F.expr(METRICS[r.metric])
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (m < r.least)
        if r.most is not None:
            bad = bad | (m > r.most)
        broken.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def quality_verdicts(docs: DataFrame, rules=RULES) -> DataFrame:
    """Counts, the rules broken and the verdict of each document."""
    out = base_counts(docs).withColumn("broken", compile_rules(rules))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.size("broken") == 0))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query."""
    out = quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS.split()))
    count = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
p AS (SELECT r, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) > {WINDOW}),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(ws, i, i + {WINDOW - 1})) AS n FROM p),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM g, range(0, {WINDOW}) AS o(k) WHERE n > 1 GROUP BY r),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        {count(SYMBOLS)} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
        len(ls) AS n_lines, {count(UPPER)} AS u, {count(LOWER)} AS l, len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS s
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(word_chars / n_words BETWEEN 2.0 AND 14.0, true) AND coalesce(n_symbols / n_words <= 0.3, true)
  AND (u + l = 0 OR u / (u + l) <= 0.6) AND coalesce(s / n_words >= 0.04, true) AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AS kept
FROM b"""
