"""Registered queries of pages, layouts and rasters, with the SQL that checks them; catalogue.py has all.

The inputs are deterministic stand-ins made from the test tables: lines of documents with made-up boxes,
embeddings as 8 x 8 grey rasters, orders as documents whose line items are sampled pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import corpus, layout, pages
from ..sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

OBS_SQL = """l AS (SELECT doc_id AS doc, unnest(range(0, len(ls))) AS i, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
obs AS (SELECT doc, i // 20 + 1 AS page, i % 20 AS pos, ((doc * 7 + i * 13) % 40) / 100.0 AS x, ((i % 20) * 45 + ((doc + i) % 3) * 2) / 1000.0 AS y,
  (30 + (doc + i * 5) % 50) / 100.0 AS width, 0.03 AS height, CASE WHEN (doc + i) % 7 = 0 THEN '  ' WHEN (doc + i) % 3 = 0 THEN rtrim(t, '.') || '-' ELSE t END AS text, ((doc * 31 + i * 17) % 100) / 100.0 AS confidence FROM l)"""
PAGES_SQL = OBS_SQL + """,
pg AS (SELECT doc, page, sum(length(text)) AS chars, 300 + (doc * 37 + page * 101) % 1500 AS px, 50 + (doc * 11 + page * 7) % 400 AS dpi FROM obs GROUP BY doc, page)"""
PIXELS_SQL = """px AS (SELECT vec_id AS img, (k - 1) // 8 AS y, (k - 1) % 8 AS x, CAST(least(255, greatest(0, floor((CAST(embedding[k] AS DOUBLE) + 0.5) * 255))) AS BIGINT) AS v
  FROM embeddings, range(1, 65) AS r(k))"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(df: DataFrame, most: int = 8 << 20, most_rows: int = 10_000) -> int:
    """So many partitions that each stands for ``most`` bytes of the files read and ``most_rows`` of their rows, but no fewer than a shuffle has."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // most), -(-df.count() // most_rows))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("i", "t"))
    return lines.selectExpr(
        "doc", "cast(i div 20 + 1 as long) as page", "cast(i % 20 as long) as pos", "((doc * 7 + i * 13) % 40) / 100.0D as x", "((i % 20) * 45 + ((doc + i) % 3) * 2) / 1000.0D as y",
        "(30 + (doc + i * 5) % 50) / 100.0D as width", "0.03D as height",
        "case when (doc + i) % 7 = 0 then '  ' when (doc + i) % 3 = 0 then rtrim('.', t) || '-' else t end as text", "((doc * 31 + i * 17) % 100) / 100.0D as confidence",
    )


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = observations(spark, sf_dir).groupBy("doc", "page").agg(F.sum(F.length("text")).alias("chars"))
    return out.selectExpr("doc", "page", "chars", "300 + (doc * 37 + page * 101) % 1500 as px", "50 + (doc * 11 + page * 7) % 400 as dpi")


@query("pages_where", f"WITH {PAGES_SQL} SELECT doc, page, CAST(chars AS BIGINT) AS chars FROM pg WHERE chars >= 2000 AND dpi < 300")
def pages_where(spark, sf_dir):
    return pages.where_all(page_table(spark, sf_dir), ["chars:ge:2000", "dpi:lt:300"]).select("doc", "page", "chars")


@query("page_routes", f"""WITH {PAGES_SQL} SELECT doc, page, px >= 900 AND dpi BETWEEN 72 AND 1400 AS scanned,
  CAST(CASE WHEN dpi >= 150 OR px >= 600 THEN dpi ELSE 300 END AS DOUBLE) AS rebuild,
  CASE WHEN px % 11 = 0 THEN 'unreadable' WHEN dpi % 5 = 0 THEN 'born-digital' WHEN px % 3 = 0 THEN CASE WHEN chars > 200 THEN 'textual' ELSE 'no-page-image' END
    WHEN dpi % 100 / 500.0 > 0.16 OR px % 100 / 500.0 > 0.10 AND dpi % 100 / 500.0 > 0.10 THEN 'photographed' ELSE 'scanned' END AS verdict,
  (dpi % 20) / 100.0 > 0.12 OR (dpi % 20) / 100.0 > 0.03 AND (px % 30) / 100.0 > 0.15 OR (px % 9) / 100.0 > 0.06 OR (px % 13) / 100.0 > 0.12 OR (dpi % 7) / 100.0 > 0.05 AS picture FROM pg""")
def page_routes(spark, sf_dir):
    p, c = page_table(spark, sf_dir), lambda e: F.expr(e)
    verdict = pages.document_verdict(c("px % 11 = 0"), c("dpi % 5 = 0"), c("px % 3"), F.col("chars"), c("dpi % 100 / 500D"), c("px % 100 / 500D"))
    picture = pages.is_picture(c("(dpi % 20) / 100D"), c("(px % 30) / 100D"), c("(px % 9) / 100D"), c("(px % 13) / 100D"), c("(dpi % 7) / 100D"))
    return p.select("doc", "page", pages.is_scanned_image(F.col("px"), F.col("dpi")).alias("scanned"), pages.rebuild_dpi(F.col("dpi"), F.col("px")).cast("double").alias("rebuild"), verdict.alias("verdict"), picture.alias("picture"))


@query("missing_pages", f"WITH {PAGES_SQL}, n AS (SELECT doc, max(page) + doc % 3 AS n FROM pg GROUP BY doc) SELECT doc, p AS page FROM n, range(1, 1000) AS r(p) WHERE p <= n AND NOT EXISTS (SELECT 1 FROM pg WHERE pg.doc = n.doc AND pg.page = p)")
def missing(spark, sf_dir):
    p = page_table(spark, sf_dir)
    return pages.missing_pages(p.groupBy("doc").agg(F.max("page").alias("m")).selectExpr("doc", "m + doc % 3 as n_pages"), p)


@query("sample_indices", f"WITH {PAGES_SQL}, n AS (SELECT doc, count(*) AS n FROM pg GROUP BY doc), s AS (SELECT doc, CASE WHEN n <= 2 THEN range(0, n) ELSE [n // 3, 2 * n // 3] END AS i FROM n) SELECT doc, unnest(i) AS page FROM s")
def samples(spark, sf_dir):
    n = page_table(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("n"))
    return n.select("doc", F.explode(pages.sample_indices(F.col("n"), 2)).alias("page"))


@query("document_signals", f"""WITH {PAGES_SQL}, o AS (SELECT doc, count(*) AS pages, avg(chars) AS mean_chars, max(px) AS max_px, list_sort(list(dpi)) AS d, list_sort(list(chars)) AS c FROM pg GROUP BY doc)
SELECT doc, pages, round(mean_chars, 6) AS mean_chars, max_px, d[pages // 2 + 1] AS median_dpi, CAST(c[CAST(round(0.95 * (pages - 1)) AS INT) + 1] AS BIGINT) AS p95_chars FROM o""")
def signals(spark, sf_dir):
    return corpus.document_signals(page_table(spark, sf_dir)).withColumn("mean_chars", F.round("mean_chars", 6))


@query("outcome_tally", "WITH c AS (SELECT CASE event_type WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE event_type END AS outcome, count(*) AS n FROM events GROUP BY 1) SELECT string_agg(outcome || '=' || n, ',' ORDER BY outcome) AS tally, CAST(sum(n) AS BIGINT) AS total FROM c")
def outcome_tally(spark, sf_dir):
    return corpus.tally(table(spark, sf_dir, "events").select(F.expr("case event_type when 'click' then 'succeeded' when 'error' then 'failed' else event_type end").alias("outcome")))


LIBRARY_SQL = """a AS (SELECT l_orderkey AS item, count(*) AS n, sum(CAST(l_extendedprice AS DOUBLE)) AS bytes FROM lineitem GROUP BY 1),
lib AS (SELECT o_orderkey AS attachment, CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE o_custkey END AS item, CASE WHEN o_orderkey % 4 = 0 THEN 'linked:' ELSE 'storage:' END || o_orderkey AS path FROM orders)"""


def _library(spark, sf_dir, parentless):
    attachments = table(spark, sf_dir, "orders").selectExpr("o_orderkey as attachment", "case when o_orderkey % 9 = 0 then -1 else o_custkey end as item", "case when o_orderkey % 4 = 0 then 'linked:' else 'storage:' end || o_orderkey as path")
    customers = table(spark, sf_dir, "customer")
    types = table(spark, sf_dir, "nation").selectExpr("n_nationkey as type_id", "n_name as type")
    dates = customers.where("c_custkey % 3 <> 0").selectExpr("c_custkey as item", "concat(1900 + c_custkey % 120, '-01-01') as date")
    return corpus.library(customers.selectExpr("c_custkey as item", "c_nationkey as type_id"), attachments, types, dates, parentless)


for _name, _join, _left in (("library_with_items", "JOIN", False), ("library_all", "LEFT JOIN", True)):
    query(_name, f"""WITH {LIBRARY_SQL} SELECT attachment, item, coalesce(n_name, '(no item)') AS type, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN CAST(1900 + c_custkey % 120 AS VARCHAR) END, '?') AS year, path
FROM lib {_join} customer ON item = c_custkey {_join} nation ON c_nationkey = n_nationkey WHERE path LIKE 'storage:%'""")(lambda s, d, left=_left: _library(s, d, left))


@query("size_survey", """
WITH r AS (SELECT l_orderkey AS doc, sum(CAST(l_extendedprice AS DOUBLE)) / count(*) AS per_page FROM lineitem GROUP BY 1),
j AS (SELECT doc, round(per_page, 4) AS per_page, n_name AS type, doc % 5 <> 0 AS scanned FROM r JOIN orders ON doc = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT type, median(per_page) AS m FROM j WHERE scanned GROUP BY type HAVING count(*) >= 450),
k AS (SELECT j.*, m, per_page / coalesce(m, (SELECT median(per_page) FROM j WHERE scanned)) AS ratio FROM j LEFT JOIN t USING (type))
SELECT doc, type, CASE WHEN m IS NULL THEN 'library' ELSE 'type' END AS basis, round(ratio, 6) AS ratio,
  CASE WHEN NOT (scanned AND per_page >= 30000 AND ratio >= 1.5) THEN 'fine' WHEN m IS NULL THEN 'review' ELSE 'candidate' END AS verdict FROM k""")
def size_survey(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg((F.sum(F.col("l_extendedprice").cast("double")) / F.count("*")).alias("per_page"))
    j = per.join(table(spark, sf_dir, "orders"), F.col("doc") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = j.selectExpr("doc", "round(per_page, 4) as per_page", "n_name as type", "doc % 5 <> 0 as scanned")
    out = corpus.judge_sizes(rows, least_scans=450, least_bytes=30000, ratio=1.5)
    return out.select("doc", "type", "basis", F.round("ratio", 6).alias("ratio"), "verdict")


@query("usable_lines", f"WITH {OBS_SQL} SELECT doc, page, pos FROM obs WHERE trim(text) <> '' AND confidence >= 0.3")
def usable_lines(spark, sf_dir):
    return layout.usable(observations(spark, sf_dir), 0.3).select("doc", "page", "pos")


@query("headroom", f"""WITH {OBS_SQL}, b AS (SELECT *, (1 - CAST(y AS DOUBLE) - CAST(height AS DOUBLE) + 0.22 * CAST(height AS DOUBLE)) * 792 AS base FROM obs)
SELECT a.doc, a.page, a.pos, round(min(abs(b.base - a.base)) / 1.5, 6) AS room FROM b a LEFT JOIN b ON a.doc = b.doc AND a.page = b.page AND a.pos <> b.pos
  AND (least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * 612 > 1 AND abs(b.base - a.base) > 0.5 AND NOT abs(b.base - a.base) < 0.4 * least(a.height, b.height) * 792 GROUP BY 1, 2, 3""")
def headroom(spark, sf_dir):
    return layout.headroom(observations(spark, sf_dir)).withColumn("room", F.round("room", 6))


@query("order_faults", f"""WITH {OBS_SQL}, n AS (SELECT doc, page, x >= 0.35 AS b, y, lag(x >= 0.35) OVER w AS pb, lag(y) OVER w AS py FROM obs WINDOW w AS (PARTITION BY doc, page ORDER BY pos))
SELECT doc, page, count(*) AS lines, count(*) FILTER (b <> pb) AS switches, count(*) FILTER (b = pb AND y < py - 0.005) AS inversions FROM n GROUP BY doc, page""")
def order_faults(spark, sf_dir):
    return layout.order_faults(observations(spark, sf_dir))


@query("extract_text", f"""WITH {OBS_SQL}, p AS (SELECT doc, page, string_agg(text, chr(10) ORDER BY pos) AS text FROM obs GROUP BY doc, page), n AS (SELECT doc, count(*) AS pages FROM p GROUP BY doc)
SELECT doc, any_value(pages) AS pages, CASE WHEN any_value(pages) > 1 THEN string_agg('==> ' || doc || ' (page ' || page || '/' || pages || ') <==' || chr(10) || text, chr(10) || chr(10) ORDER BY page) ELSE any_value(text) END AS text
FROM p JOIN n USING (doc) GROUP BY doc""")
def extract_text(spark, sf_dir):
    return layout.extract_text(observations(spark, sf_dir))


@query("page_json", f"WITH {PAGES_SQL} SELECT '{{\"chars\":' || CAST(chars AS BIGINT) || ',\"doc\":' || doc || ',\"page\":' || page || '}}' AS value FROM pg")
def page_json(spark, sf_dir):
    return sinks.to_json_lines(page_table(spark, sf_dir).select("doc", "page", "chars"))


OTSU_SQL = PIXELS_SQL + """, h AS (SELECT img, v, count(*) AS n FROM px GROUP BY img, v),
c AS (SELECT img, v, sum(n) OVER u AS n0, sum(n * v) OVER u AS s0, sum(n) OVER w AS n, sum(n * v) OVER w AS s FROM h WINDOW u AS (PARTITION BY img ORDER BY v), w AS (PARTITION BY img)),
o AS (SELECT img, v, round(CASE WHEN n > n0 THEN CAST(n0 AS DOUBLE) * CAST(n - n0 AS DOUBLE) * pow(CAST(s0 AS DOUBLE) / n0 - CAST(s - s0 AS DOUBLE) / (n - n0), 2) ELSE 0 END, 3) AS b FROM c),
t AS (SELECT img, CAST(least(greatest(arg_min(v, {'b': -b, 'v': v}), 90), 230) AS BIGINT) AS threshold FROM o GROUP BY img)"""


@query("newer_versions", "SELECT o_orderkey, (o_orderkey % 4, o_orderkey % 10, o_orderkey % 3) > (o_orderkey % 3, o_orderkey % 7, 0) AS newer, CAST(floor(100.0 * (o_orderkey % 17) / nullif(o_orderkey % 23, 0)) AS BIGINT) AS share FROM orders")
def newer_versions(spark, sf_dir):
    k = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat_ws('.', o_orderkey % 4, o_orderkey % 10, o_orderkey % 3) as a", "concat_ws('.', o_orderkey % 3, o_orderkey % 7) as b")
    return k.select("o_orderkey", scalars.is_newer(F.col("a"), F.col("b")).alias("newer"), scalars.percent(F.expr("o_orderkey % 17"), F.expr("o_orderkey % 23")).alias("share"))
