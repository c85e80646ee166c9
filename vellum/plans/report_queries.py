"""Registered queries of reports and set operations, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, reports
from .registry import query, table

JUDGED_SQL = """jd AS (SELECT o_orderkey AS doc, o_custkey % 12 AS type, o_orderkey % 7 AS stratum, o_orderkey % 3 <> 0 AS scanned, CASE o_orderkey % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'review' ELSE 'fine' END AS verdict,
  CASE WHEN o_custkey % 4 = 0 THEN 'library' ELSE 'type' END AS basis, 1000 + o_orderkey % 5000 AS bytes, 1 + o_orderkey % 9 AS pages, CASE WHEN o_custkey % 4 > 0 THEN (o_custkey % 300)::DOUBLE + 0.5::DOUBLE END AS type_median, CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey % 37)::DOUBLE END AS ratio FROM orders)"""


def judged(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as doc", "o_custkey % 12 as type", "o_orderkey % 7 as stratum", "o_orderkey % 3 <> 0 as scanned", "case o_orderkey % 5 when 0 then 'candidate' when 1 then 'review' else 'fine' end as verdict",
        "if(o_custkey % 4 = 0, 'library', 'type') as basis", "1000 + o_orderkey % 5000 as bytes", "1 + o_orderkey % 9 as pages", "if(o_custkey % 4 > 0, cast(o_custkey % 300 as double) + 0.5D, null) as type_median", "if(o_orderkey % 11 > 0, cast(o_orderkey % 37 as double), null) as ratio",
    )


@query("reclaimable", f"WITH {JUDGED_SQL} SELECT count(*) AS candidates, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(greatest(0, sum(CAST(trunc(bytes - coalesce(type_median, 0) * pages) AS BIGINT))) AS BIGINT) AS reclaimable FROM jd WHERE verdict = 'candidate'")
def reclaimable(spark, sf_dir):
    return reports.reclaimable(judged(spark, sf_dir))


@query("borrowed_types", f"WITH {JUDGED_SQL} SELECT type, count(*) AS files, count(*) FILTER (scanned) AS scans FROM jd WHERE basis = 'library' GROUP BY type")
def borrowed_types(spark, sf_dir):
    return reports.borrowed_types(judged(spark, sf_dir))


@query("survey_order", f"WITH {JUDGED_SQL} SELECT doc, row_number() OVER (PARTITION BY stratum ORDER BY verdict <> 'candidate', basis <> 'type', coalesce(ratio, 0) DESC, doc) AS rank FROM jd")
def survey_order(spark, sf_dir):
    return reports.survey_order(judged(spark, sf_dir)).select("doc", "rank")


@query("survey_counts", f"WITH {JUDGED_SQL} SELECT 'verdict' AS section, verdict AS key, count(*) AS n FROM jd GROUP BY verdict UNION ALL SELECT 'basis', basis, count(*) FROM jd GROUP BY basis")
def survey_counts(spark, sf_dir):
    return reports.counts_by(judged(spark, sf_dir), "verdict", "basis")


LOG_SQL = """lg AS (SELECT l_partkey * 100000 + l_suppkey * 100 + l_linenumber AS n, l_orderkey % 400 AS document, l_linenumber % 3 AS page, CASE WHEN l_orderkey % 400 % 11 = 0 THEN 'timeout:9' ELSE 'ok' END AS status, CASE WHEN l_orderkey % 400 % 2 = 0 THEN 'layered' ELSE 'single' END AS route,
  CASE (l_orderkey % 400 + l_linenumber % 3) % 3 WHEN 0 THEN 'picture' ELSE 'all-text' END AS verdict, CASE (l_orderkey % 400) % 4 WHEN 0 THEN 'picture' WHEN 1 THEN 'picture STENCIL-MOVED' ELSE 'all-text' END AS bar_verdict,
  CASE WHEN l_orderkey % 400 % 9 = 0 THEN '-' WHEN l_orderkey % 400 % 10 = 0 THEN '1.5' ELSE CAST((l_orderkey % 400) / 400.0 AS VARCHAR) END AS ink, CASE WHEN l_orderkey % 400 % 13 = 0 THEN '-' ELSE CAST(l_orderkey % 400 * 10 AS VARCHAR) END AS layered, CAST(l_orderkey % 400 * 12 AS VARCHAR) AS at_bar FROM lineitem)"""


def log(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey * 100000 + l_suppkey * 100 + l_linenumber as n", "l_orderkey % 400 as document", "l_linenumber % 3 as page").selectExpr(
        "*", "if(document % 11 = 0, 'timeout:9', 'ok') as status", "if(document % 2 = 0, 'layered', 'single') as route", "if((document + page) % 3 = 0, 'picture', 'all-text') as verdict",
        "case document % 4 when 0 then 'picture' when 1 then 'picture STENCIL-MOVED' else 'all-text' end as bar_verdict", "case when document % 9 = 0 then '-' when document % 10 = 0 then '1.5' else cast(document / 400D as string) end as ink",
        "if(document % 13 = 0, '-', cast(document * 10 as string)) as layered", "cast(document * 12 as string) as at_bar",
    )


@query("bar_report", f"""WITH {LOG_SQL}, st AS (SELECT document, arg_min(status, n) AS status FROM lg GROUP BY document), ok AS (SELECT DISTINCT document, page, route, verdict, bar_verdict, TRY_CAST(ink AS DOUBLE) AS ink, TRY_CAST(layered AS BIGINT) AS a, TRY_CAST(at_bar AS BIGINT) AS b FROM lg WHERE status = 'ok'),
mv AS (SELECT * FROM ok WHERE ink IS NOT NULL AND verdict = 'all-text' AND bar_verdict LIKE 'picture%')
SELECT 'status' AS section, status AS key, count(*) AS n FROM st GROUP BY status UNION ALL SELECT 'route', route, count(*) FROM ok GROUP BY route UNION ALL SELECT 'verdict', verdict, count(*) FROM ok GROUP BY verdict
UNION ALL SELECT 'band', CASE WHEN ink IS NULL THEN 'none' WHEN ink < 0 OR ink >= 1.01 THEN 'outside' WHEN ink < 0.045 THEN '0-0.045' WHEN ink < 0.08 THEN '0.045-0.08' ELSE '0.08-1.01' END, count(*) FROM ok GROUP BY 2
UNION ALL SELECT 'total', 'pages', count(*) FROM ok UNION ALL SELECT 'total', 'repeated', (SELECT count(*) FROM lg WHERE status = 'ok') - count(*) FROM ok UNION ALL SELECT 'total', 'moved', count(*) FROM mv UNION ALL SELECT 'total', 'unpriced', count(*) FROM mv WHERE a IS NULL
UNION ALL SELECT 'total', 'shipped', CAST(coalesce(sum(a), 0) AS BIGINT) FROM mv WHERE a IS NOT NULL UNION ALL SELECT 'total', 'at_bar', CAST(coalesce(sum(b), 0) AS BIGINT) FROM mv WHERE a IS NOT NULL""")
def bar_report(spark, sf_dir):
    return reports.bar_report(log(spark, sf_dir))


@query("resume_statuses", f"WITH {LOG_SQL} SELECT document, arg_min(status, n) AS status FROM lg GROUP BY document")
def resume_statuses(spark, sf_dir):
    return reports.first_statuses(log(spark, sf_dir))


OUTPUT_SQL = """ou AS (SELECT c_custkey AS file, n, CASE WHEN n < c_custkey % 3 THEN ' ' WHEN n = c_custkey % 3 THEN CASE WHEN c_custkey % 8 = 0 THEN 'a' || chr(9) || 'x' ELSE 'a' || chr(9) || 'b' END WHEN n = 8 THEN '' WHEN n > 8 THEN 'summary' WHEN c_custkey % 5 = 0 AND n = 6 THEN 'one' ELSE n || chr(9) || c_nationkey END AS value FROM customer, range(0, 11) AS r(n)),
hd AS (SELECT file, n AS h FROM ou JOIN customer ON file = c_custkey WHERE n = c_custkey % 3)"""


@query("tool_rows", f"""WITH {OUTPUT_SQL} SELECT ou.file, ou.n, CASE WHEN ou.file % 8 > 0 AND ou.file % 5 > 0 THEN value END AS value, CASE WHEN ou.file % 8 = 0 THEN 'header drift' WHEN ou.file % 5 = 0 THEN 'row width' END AS error FROM ou JOIN hd ON ou.file = hd.file
WHERE CASE WHEN ou.file % 8 = 0 OR ou.file % 5 = 0 THEN ou.n = h ELSE ou.n > h AND ou.n < 8 END""")
def tool_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), "c_nationkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(10).cast("bigint"))).alias("n"))
    lines = lines.selectExpr("file", "n", "case when n < file % 3 then ' ' when n = file % 3 then if(file % 8 = 0, 'a\\tx', 'a\\tb') when n = 8 then '' when n > 8 then 'summary' when file % 5 = 0 and n = 6 then 'one' else n || '\\t' || c_nationkey end as value")
    return reports.tool_rows(lines, ["a", "b"]).select("file", "n", F.array_join("fields", "\t").alias("value"), "error")


@query("names_and_more", "WITH g AS (SELECT c_nationkey AS k, list(c_name ORDER BY c_name) AS l FROM customer GROUP BY 1) SELECT k, array_to_string(l[:3], ', ') || CASE WHEN len(l) > 3 THEN ' and ' || (len(l) - 3) || ' more' ELSE '' END AS names FROM g")
def names_and_more(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_list("c_name")).alias("l"))
    return g.select("k", reports.and_more(F.col("l"), 3).alias("names"))


@query("shortages", "SELECT c_nationkey AS type, c_custkey % 3 AS era, count(*) FILTER (c_custkey % 2 = 0) AS scans, count(*) FILTER (c_custkey % 2 <> 0) AS rejected FROM customer GROUP BY 1, 2 HAVING count(*) FILTER (c_custkey % 2 = 0) < 2")
def shortages(spark, sf_dir):
    return reports.shortages(table(spark, sf_dir, "customer").selectExpr("c_nationkey as type", "c_custkey % 3 as era", "if(c_custkey % 2 = 0, 'scanned', 'textual') as verdict"), ["type", "era"], 2)


STEPS_SQL = "sp AS (SELECT l_orderkey AS doc, l_linenumber AS pos, (l_partkey % 25 - 12) / 10.0 AS step FROM lineitem WHERE l_partkey % 4 > 0), of AS (SELECT doc, pos, arg_min(step, abs(step) * 1000 - sign(step)) AS off FROM sp GROUP BY doc, pos)"


@query("offset_summary", f"WITH {STEPS_SQL}, al AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS pos FROM lineitem), j AS (SELECT al.doc, al.pos, off FROM al LEFT JOIN of ON al.doc = of.doc AND al.pos = of.pos) SELECT doc, count(off) AS located, count(*) FILTER (pos % 3 = 0) AS ambiguous, count(*) - count(off) AS unplaced, list_sort(list(off) FILTER (off IS NOT NULL))[count(off) // 2 + 1] AS median FROM j GROUP BY doc")
def offset_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    found = reports.nearest_step(li.where("l_partkey % 4 > 0").selectExpr("l_orderkey as doc", "1 as page", "l_linenumber as pos", "(l_partkey % 25 - 12) / 10D as step"))
    lines = li.selectExpr("l_orderkey as doc", "l_linenumber as pos").distinct().join(found.drop("page"), ["doc", "pos"], "left").withColumn("ambiguous", F.expr("pos % 3 = 0"))
    return reports.offset_summary(lines)


@query("skew_buckets", "WITH s AS (SELECT (l_partkey % 300 - 150) / 100.0 AS d, l_suppkey AS b, l_suppkey + l_partkey % 5 - 2 AS a FROM lineitem) SELECT CASE WHEN abs(d) < 0.25 THEN '< 0.25' WHEN abs(d) < 0.5 THEN '0.25-0.5' WHEN abs(d) < 1 THEN '0.5-1.0' ELSE '>= 1.0' END AS bucket, count(*) AS pages, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after, count(*) FILTER (a > b) AS better, count(*) FILTER (a < b) AS worse FROM s GROUP BY 1")
def skew_buckets(spark, sf_dir):
    return reports.skew_buckets(table(spark, sf_dir, "lineitem").selectExpr("(l_partkey % 300 - 150) / 100D as degrees", "l_suppkey as before", "l_suppkey + l_partkey % 5 - 2 as after"))


@query("skew_validation", """WITH a AS (SELECT l_suppkey AS doc, (l_partkey % 10) / 100.0 AS start, (l_linenumber - 3) / 2.0 AS planted, CASE WHEN l_partkey % 6 > 0 THEN (l_linenumber - 3) / 2.0 + (l_orderkey % 70) / 100.0 END AS measured FROM lineitem),
e AS (SELECT doc, abs(measured - (start + planted)) AS e FROM a), g AS (SELECT doc, count(e) AS m, count(*) - count(e) AS abstained, count(*) FILTER (e > 0.25) AS wrong, list_sort(list(e) FILTER (e IS NOT NULL)) AS l, max(e) AS worst FROM e GROUP BY doc)
SELECT doc, m AS measured, abstained, wrong, round(l[m // 2 + 1], 9) AS median, round(l[least(m * 95 // 100, m - 1) + 1], 9) AS p95, round(worst, 9) AS worst, round(100.0 * (m - wrong) / nullif(m, 0), 6) AS correct FROM g""")
def skew_validation(spark, sf_dir):
    out = reports.skew_validation(table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as doc", "(l_partkey % 10) / 100D as start", "(l_linenumber - 3) / 2D as planted", "if(l_partkey % 6 > 0, (l_linenumber - 3) / 2D + (l_orderkey % 70) / 100D, null) as measured"))
    return out.withColumns({c: F.round(c, 9) for c in ("median", "p95", "worst")} | {"correct": F.round("correct", 6)})


@query("repeatability", """WITH b AS (SELECT l_suppkey AS doc, l_orderkey AS page, l_linenumber AS block, max(100.0 + l_partkey % 50) AS m FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT doc, block, m / max(m) OVER (PARTITION BY doc, page) AS s FROM b),
d AS (SELECT doc, block, stddev_pop(s) AS sd, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 3) SELECT doc, max(n) AS pages, round(avg(sd), 9) AS mean, round(max(sd), 9) AS worst FROM d GROUP BY doc""")
def repeatability(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block")).agg(F.max(F.expr("100D + l_partkey % 50")).alias("mean"))
    return reports.repeatability(b).withColumns({"mean": F.round("mean", 9), "worst": F.round("worst", 9)})


@query("routing_summary", "SELECT CASE l_partkey % 3 WHEN 0 THEN 'bilevel' WHEN 1 THEN 'grey' ELSE 'colour' END AS route, count(*) AS pages, round(sum(l_suppkey) / count(*) / 1024, 9) AS kb_a_page FROM lineitem GROUP BY 1")
def routing_summary(spark, sf_dir):
    out = reports.routing_summary(table(spark, sf_dir, "lineitem").selectExpr("element_at(array('bilevel', 'grey', 'colour'), cast(l_partkey % 3 + 1 as int)) as route", "l_suppkey as bytes"))
    return out.withColumn("kb_a_page", F.round("kb_a_page", 9))


GATE_SQL = """gp AS (SELECT l_orderkey AS doc, l_linenumber AS page, max(l_partkey) AS chars, max(l_suppkey) AS bytes, max((l_partkey % 40) / 1000.0) AS ink, min((l_partkey % 100) / 100.0) AS res, min((l_suppkey % 17) / 16.0) AS ratio FROM lineitem GROUP BY 1, 2),
gr AS (SELECT doc, CAST(sum(chars) AS BIGINT) AS characters, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS pages, avg(ink) AS ink, count(*) FILTER (ink < 0.001) AS blank, arg_min(page, res * 100000 + page) AS worst_page, count(*) FILTER (ratio < 0.5) AS faded, min(ratio) AS dimmest FROM gp GROUP BY doc)"""


def gate_pages(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).agg(F.max("l_partkey").alias("chars"), F.max("l_suppkey").alias("bytes"), F.max(F.expr("(l_partkey % 40) / 1000D")).alias("ink"), F.min(F.expr("(l_partkey % 100) / 100D")).alias("resemblance"), F.min(F.expr("(l_suppkey % 17) / 16D")).alias("ratio"))


@query("gate_rows", f"WITH {GATE_SQL} SELECT doc, characters, bytes, pages, round(ink, 9) AS ink, blank, worst_page, faded, dimmest FROM gr")
def gate_rows(spark, sf_dir):
    return reports.gate_rows(gate_pages(spark, sf_dir)).withColumn("ink", F.round("ink", 9))


@query("gate_tally", f"WITH {GATE_SQL} SELECT count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(characters) AS BIGINT) AS characters, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(faded) AS BIGINT) AS faded, min(dimmest) AS dimmest FROM gr")
def gate_tally(spark, sf_dir):
    return reports.gate_tally(reports.gate_rows(gate_pages(spark, sf_dir)))


@query("unmatched_pages", "WITH s AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS page FROM lineitem WHERE l_partkey % 5 > 0), o AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS page FROM lineitem WHERE l_suppkey % 3 > 0) SELECT coalesce(s.doc, o.doc) AS doc, coalesce(s.page, o.page) AS page, CASE WHEN s.doc IS NULL THEN 'source' ELSE 'output' END AS missing FROM s FULL JOIN o ON s.doc = o.doc AND s.page = o.page WHERE s.doc IS NULL OR o.doc IS NULL")
def unmatched_pages(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    side = lambda c: li.where(c).selectExpr("l_orderkey as doc", "l_linenumber as page").distinct()
    return reports.unmatched_pages(side("l_partkey % 5 > 0"), side("l_suppkey % 3 > 0"))


@query("layer_choice", "WITH p AS (SELECT l_orderkey AS doc, l_partkey AS single, l_suppkey * 15 AS layered FROM lineitem) SELECT doc, count(*) AS pages, count(*) FILTER (layered < single) AS layered_pages, CAST(sum(single) AS BIGINT) AS single, CAST(sum(layered) AS BIGINT) AS layered, CAST(sum(least(single, layered)) AS BIGINT) AS kept FROM p GROUP BY doc")
def layer_choice(spark, sf_dir):
    return reports.layer_choice(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "l_partkey as single", "l_suppkey * 15 as layered"))


@query("codec_totals", "SELECT l_linenumber AS quality, CAST(sum(l_partkey) AS BIGINT) AS a_bytes, CAST(sum(l_suppkey) AS BIGINT) AS b_bytes, round(min(l_suppkey % 50 / 2.0 - l_partkey % 40 / 4.0), 9) AS worst_delta FROM lineitem GROUP BY 1")
def codec_totals(spark, sf_dir):
    return reports.codec_totals(table(spark, sf_dir, "lineitem").selectExpr("l_linenumber as quality", "l_partkey as a_bytes", "l_suppkey as b_bytes", "l_partkey % 40 / 4D as a_db", "l_suppkey % 50 / 2D as b_db")).withColumn("worst_delta", F.round("worst_delta", 9))


@query("route_totals", """WITH p AS (SELECT l_orderkey AS doc, l_partkey AS layered, l_suppkey AS two, l_partkey % 3 > 0 AS txt, (l_partkey % 3 > 0) <> (l_suppkey % 4 > 0) AS mv FROM lineitem)
SELECT doc, CAST(sum(layered) AS BIGINT) AS layered, CAST(sum(two) AS BIGINT) AS two_tone, count(*) FILTER (txt) AS text_pages, CAST(coalesce(sum(layered) FILTER (txt), 0) AS BIGINT) AS text_layered, CAST(coalesce(sum(two) FILTER (txt), 0) AS BIGINT) AS text_two_tone,
  count(*) FILTER (mv) AS moved_pages, CAST(coalesce(sum(two - layered) FILTER (mv), 0) AS BIGINT) AS moved_delta FROM p GROUP BY doc""")
def route_totals(spark, sf_dir):
    return reports.route_totals(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "l_partkey as layered", "l_suppkey as two_tone", "if(l_partkey % 3 > 0, 'all-text', 'picture') as verdict", "if(l_suppkey % 4 > 0, 'all-text', 'picture') as bar_verdict"))


PARTS_SQL = "pp AS (SELECT doc_id AS doc, unnest(range(1, len(l) + 1)) AS page, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def parts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).selectExpr("doc", "cast(p + 1 as bigint) as page", "text")


@query("document_info", f"WITH {PARTS_SQL} SELECT doc, count(*) AS pages, count(*) FILTER (regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '') AS pages_with_text, CAST(sum(length(text)) AS BIGINT) AS characters FROM pp GROUP BY doc")
def document_info(spark, sf_dir):
    return reports.document_info(parts(spark, sf_dir))


@query("annotation_report", """WITH m AS (SELECT l_orderkey AS doc, CASE l_partkey % 4 WHEN 0 THEN 'Link' WHEN 1 THEN 'Text' WHEN 2 THEN 'Ink' ELSE 'Stamp' END AS s, l_suppkey % 3 > 0 AS c FROM lineitem), g AS (SELECT doc, s, c, count(*) AS n FROM m GROUP BY 1, 2, 3)
SELECT doc, coalesce(string_agg(s || ' ' || n, ', ' ORDER BY s) FILTER (c), '') AS copied, coalesce(string_agg(s || ' ' || n, ', ' ORDER BY s) FILTER (NOT c), '') AS dropped FROM g GROUP BY doc""")
def annotation_report(spark, sf_dir):
    return reports.annotation_report(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "element_at(array('Link', 'Text', 'Ink', 'Stamp'), cast(l_partkey % 4 + 1 as int)) as subtype", "l_suppkey % 3 > 0 as copied"))


@query("all_empty", "SELECT o_orderkey AS doc, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) AS empty FROM orders")
def all_empty(spark, sf_dir):
    return reports.all_empty(table(spark, sf_dir, "orders").selectExpr("o_orderkey as doc"), table(spark, sf_dir, "lineitem").where("l_quantity > 40").selectExpr("l_orderkey as doc"))


MARKS_SQL = "ms AS (SELECT l_suppkey AS doc, l_linenumber AS page, l_returnflag AS subtype, l_orderkey * 1000 + l_partkey AS spot FROM lineitem)"


def marks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as doc", "l_linenumber as page", "l_returnflag as subtype", "l_orderkey * 1000 + l_partkey as at")


@query("paired_marks", f"WITH {MARKS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY doc, page, subtype ORDER BY spot) AS k FROM ms), b AS (SELECT *, row_number() OVER (PARTITION BY doc, page, subtype ORDER BY spot) AS k FROM ms WHERE spot % 3 > 0) SELECT a.doc, a.page, a.subtype, a.k, a.spot AS source_at, b.spot AS output_at FROM a LEFT JOIN b ON a.doc = b.doc AND a.page = b.page AND a.subtype = b.subtype AND a.k = b.k")
def paired_marks(spark, sf_dir):
    m = marks(spark, sf_dir)
    return reports.paired_marks(m, m.where("at % 3 > 0")).withColumnRenamed("at", "source_at")


@query("differing_marks", "WITH a AS (SELECT l_suppkey AS doc, l_returnflag AS subtype, count(*) FILTER (l_partkey % 3 > 0) AS n, count(*) FILTER (l_partkey % 4 > 0) AS m FROM lineitem GROUP BY 1, 2) SELECT doc, subtype, CASE WHEN n > m THEN 'source' ELSE 'output' END AS side FROM a, range(0, 100000) AS r(i) WHERE i < abs(n - m)")
def differing_marks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    side = lambda c: li.where(c).selectExpr("l_suppkey as doc", "l_returnflag as subtype")
    return reports.differing_marks(side("l_partkey % 3 > 0"), side("l_partkey % 4 > 0"))


@query("mutation_tally", "WITH l AS (SELECT o_orderkey AS n, CASE o_orderkey % 4 WHEN 0 THEN 'killed' WHEN 1 THEN 'SURVIVED' WHEN 2 THEN 'INVALID' ELSE 'NOT-APPLIED' END AS verdict, o_custkey % 30 AS s FROM orders), t AS (SELECT s FROM l WHERE s > 0 AND verdict IN ('killed', 'SURVIVED') ORDER BY n DESC LIMIT 5) SELECT min(s) AS least, max(s) AS most, min(s) * 12 AS least_total, max(s) * 12 AS most_total FROM t")
def mutation_tally(spark, sf_dir):
    return reports.last_durations(table(spark, sf_dir, "orders").selectExpr("o_orderkey as n", "element_at(array('killed', 'SURVIVED', 'INVALID', 'NOT-APPLIED'), cast(o_orderkey % 4 + 1 as int)) as verdict", "o_custkey % 30 as seconds"), 12)


PATHS_SQL = """pa AS (SELECT o_orderkey AS spot, '/d' || o_custkey % 9 || CASE WHEN o_orderkey % 3 = 0 THEN '//' WHEN o_orderkey % 3 = 1 THEN '/./' ELSE '/' END || CASE WHEN o_orderkey % 7 = 0 THEN '.' ELSE '' END || 'f' || o_custkey % 50 || CASE o_orderkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' ELSE '.jpg' END AS path, o_orderkey % 2 = 0 AS named FROM orders)"""


def paths(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as at", "'/d' || o_custkey % 9 || element_at(array('//', '/./', '/'), cast(o_orderkey % 3 + 1 as int)) || if(o_orderkey % 7 = 0, '.', '') || 'f' || o_custkey % 50 || element_at(array('.pdf', '.PNG', '.txt', '.jpg'), cast(o_orderkey % 4 + 1 as int)) as path", "o_orderkey % 2 = 0 as named")


@query("collected_inputs", f"WITH {PATHS_SQL} SELECT replace(replace(path, '//', '/'), '/./', '/') AS path, min(spot) AS first FROM pa WHERE lower(split_part(path, '.', -1)) IN ('pdf', 'png', 'jpg') AND (named OR replace(replace(path, '//', '/'), '/./', '/') NOT LIKE '%/.f%') GROUP BY 1")
def collected_inputs(spark, sf_dir):
    return reports.collected_inputs(paths(spark, sf_dir), ("pdf", "png", "jpg")).withColumnRenamed("at", "first")


@query("ignored_inputs", f"WITH {PATHS_SQL} SELECT count(*) AS ignored FROM pa WHERE named AND path LIKE '%.txt'")
def ignored_inputs(spark, sf_dir):
    return reports.ignored_inputs(paths(spark, sf_dir), ("pdf", "png", "jpg"))


@query("distinct_steps", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '300,299.9' WHEN o_orderkey % 3 = 1 THEN '300,300.06' ELSE '300' END || CASE WHEN o_orderkey % 2 = 0 THEN ',150' ELSE '' END AS kept FROM orders")
def distinct_steps(spark, sf_dir):
    c = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat(array(300D, 300.04D), array(element_at(array(299.9D, 300.06D, 300.01D), cast(o_orderkey % 3 + 1 as int))), if(o_orderkey % 2 = 0, array(150D, 150.01D), array(300.03D))) as c")
    return c.select("o_orderkey", F.array_join(F.transform(reports.distinct_steps(F.col("c")), lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), ",").alias("kept"))


@query("batch", "SELECT o_orderkey AS doc FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 > 0")
def batch(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey as doc")
    return reports.batch(o, o.where("doc % 3 = 0"), o.where("doc % 5 = 0"))


@query("text_with_placeholders", f"""WITH {PARTS_SQL}, q AS (SELECT doc, page, CASE WHEN (doc + page) % 6 = 0 THEN NULL WHEN (doc + page) % 5 = 0 OR doc % 9 = 0 THEN '  ' ELSE text END AS text FROM pp)
SELECT doc, string_agg(CASE WHEN text IS NULL THEN '[unreadable page]' WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN '[no text on this page]' ELSE text END, chr(10) || chr(10) ORDER BY page) AS text,
  coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') = ''), '') AS skipped FROM q GROUP BY doc HAVING bool_or(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') <> '')""")
def text_with_placeholders(spark, sf_dir):
    return reports.embedded_text(parts(spark, sf_dir).selectExpr("doc", "page", "case when (doc + page) % 6 = 0 then null when (doc + page) % 5 = 0 or doc % 9 = 0 then '  ' else text end as text"))


NAMES_SQL = """nf AS (SELECT c_nationkey AS folder, c_custkey AS spot, CASE WHEN c_custkey % 4 = 0 THEN 'A' ELSE 'a' END || CASE WHEN c_custkey % 7 = 0 THEN ' 2' ELSE '' END AS base FROM customer), nk AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY spot) AS k FROM nf),
un AS (SELECT folder, 0 AS k, CAST(NULL AS BIGINT) AS spot, CAST(NULL AS VARCHAR) AS name, list(DISTINCT lower(base || '.pdf')) AS taken FROM nf GROUP BY folder
  UNION ALL SELECT s.folder, s.k, s.spot, s.name, list_append(s.taken, lower(s.name)) FROM (SELECT nk.folder, nk.k, nk.spot, un.taken, list_filter(list_prepend(nk.base || ' ocr.pdf', list_transform(range(2, len(un.taken) + 3), lambda n: nk.base || ' ' || n || ' ocr.pdf')), lambda t: NOT list_contains(un.taken, lower(t)))[1] AS name FROM un JOIN nk ON nk.folder = un.folder AND nk.k = un.k + 1) s)"""


@query("unique_names", f"WITH RECURSIVE {NAMES_SQL} SELECT folder, spot, name FROM un WHERE k > 0")
def unique_names(spark, sf_dir):
    files = table(spark, sf_dir, "customer").selectExpr("c_nationkey as folder", "c_custkey as at", "if(c_custkey % 4 = 0, 'A', 'a') || if(c_custkey % 7 = 0, ' 2', '') as base").selectExpr("*", "base || '.pdf' as file")
    return reports.unique_names(files, " ocr", "pdf").selectExpr("folder", "at as spot", "name")


@query("run_report", "WITH r AS (SELECT c_nationkey AS run, c_name AS file, CASE c_custkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'succeeded' ELSE 'cancelled' END AS o FROM customer) SELECT run, count(*) FILTER (o = 'succeeded') || ' succeeded, ' || count(*) FILTER (o = 'failed') || ' failed, ' || count(*) FILTER (o = 'cancelled') || ' cancelled' || coalesce(chr(10) || string_agg('  ' || file || ': no text', chr(10) ORDER BY file) FILTER (o = 'failed'), '') AS report FROM r GROUP BY run")
def run_report(spark, sf_dir):
    out = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("run"), F.col("c_name").alias("file"), reports.outcome(F.expr("c_custkey % 3 = 2"), F.expr("if(c_custkey % 3 = 1, null, 'no text')")).alias("outcome"), F.lit("no text").alias("message"))
    return reports.run_report(out)


@query("sample_manifest", "SELECT c_nationkey AS type, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS era, c_name AS file, c_custkey AS key FROM customer")
def sample_manifest(spark, sf_dir):
    return reports.sample_manifest(table(spark, sf_dir, "customer").selectExpr("c_nationkey as type", "if(c_custkey % 2 = 0, 'old', 'new') as era", "c_name as file", "c_custkey as key"))


@query("extracted_pages", f"WITH {PARTS_SQL} SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY -page) AS number FROM pp WHERE page % 2 = 1")
def extracted_pages(spark, sf_dir):
    p = parts(spark, sf_dir)
    return reports.extracted_pages(p.select("doc", "page"), p.where("page % 2 = 1").selectExpr("doc", "page", "-page as at"))


@query("document_states", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'timeout:' || o_orderkey % 90 WHEN o_custkey % 4 > 0 THEN 'error:' || o_custkey % 4 WHEN o_orderkey % 3 = 0 THEN 'error:parse' WHEN o_orderkey % 7 = 0 THEN 'no-pages' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 6 = 0 THEN 'cancelled' WHEN o_custkey % 4 > 0 THEN 'failed' ELSE 'succeeded' END AS outcome, CASE WHEN o_orderkey % 101 = 0 THEN 'off' ELSE CAST(o_orderkey % 101 AS VARCHAR) || '%' END AS readout FROM orders")
def document_states(spark, sf_dir):
    status = reports.document_status(F.expr("o_custkey % 4"), F.expr("if(o_orderkey % 5 = 0, o_orderkey % 90, null)"), F.expr("o_orderkey % 7"), F.expr("o_orderkey % 3 <> 0"))
    outcome = reports.outcome(F.expr("o_orderkey % 6 = 0"), F.expr("if(o_custkey % 4 > 0, 'x', null)"))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), outcome.alias("outcome"), reports.confidence_readout(F.expr("(o_orderkey % 101) / 100D")).alias("readout"))


@query("mixed_stamps", "SELECT l_suppkey AS file, count(DISTINCT (l_linenumber % 2, l_partkey % 50 = 0)) AS stamps, count(DISTINCT l_returnflag) AS binaries FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_linenumber % 2, l_partkey % 50 = 0)) > 1")
def mixed_stamps(spark, sf_dir):
    return reports.mixed_stamps(table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as file", "l_linenumber % 2 as bar", "l_partkey % 50 = 0 as corpus", "l_returnflag as binary"))


@query("page_lines", f"WITH {PARTS_SQL} SELECT doc_id AS doc, CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN '<NO EMBEDDED TEXT>' ELSE replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' / ') END AS line FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE text END AS text FROM documents)")
def page_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), reports.page_text(F.expr("if(doc_id % 6 = 0, ' ', text)")).alias("line"))


@query("boxes", """WITH b AS (SELECT o_orderkey AS k, (o_orderkey % 5 - 2) * 90 AS rot, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 400 + o_custkey % 100 END::DOUBLE AS cw, 500::DOUBLE AS ch FROM orders), s AS (SELECT *, CASE WHEN cw > 0 THEN cw ELSE 612 END AS w, CASE WHEN cw > 0 THEN ch ELSE 792 END AS h FROM b)
SELECT k AS o_orderkey, CASE WHEN abs(rot) % 180 = 90 THEN h ELSE w END AS width, CASE WHEN abs(rot) % 180 = 90 THEN w ELSE h END AS height, CASE WHEN cw > 0 THEN round((k % 3000) * 72 / cw, 9) ELSE 72 END AS dpi FROM s WHERE k % 3000 > 0""")
def boxes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3000 > 0").selectExpr("o_orderkey", "named_struct('width', 612D, 'height', 792D) as media", "named_struct('width', if(o_orderkey % 7 = 0, 0D, 400D + o_custkey % 100), 'height', 500D) as crop")
    box = reports.display_box(F.expr("(o_orderkey % 5 - 2) * 90"), F.col("media"), F.col("crop"))
    return o.select("o_orderkey", box["width"].alias("width"), box["height"].alias("height"), F.round(reports.native_dpi(F.expr("o_orderkey % 3000"), F.col("crop.width")), 9).alias("dpi"))


@query("dpi_race", "WITH c AS (SELECT l_orderkey AS doc, l_linenumber % 2 AS page, 100 + l_partkey % 4 * 50 AS dpi, max(l_suppkey % 5) AS r, min(l_partkey) AS b FROM lineitem GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY r DESC, b, dpi) AS n FROM c) SELECT doc, page, r AS retained, dpi FROM k WHERE n = 1")
def dpi_race(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "l_linenumber % 2 as page", "100 + l_partkey % 4 * 50 as dpi", "l_suppkey % 5 as r", "l_partkey as b").groupBy("doc", "page", "dpi").agg(F.max("r").alias("retained"), F.min("b").alias("bytes"))
    return reports.dpi_race(c)


@query("sampled_strata", "WITH s AS (SELECT c_nationkey AS type, c_custkey AS key FROM customer) SELECT type, count(*) AS n FROM (SELECT type, key, row_number() OVER (PARTITION BY type ORDER BY sha256('7:' || key), key) AS r FROM s) WHERE r <= 3 GROUP BY type")
def sampled_strata(spark, sf_dir):
    return corpus.stratified_sample(table(spark, sf_dir, "customer").selectExpr("c_nationkey as type", "c_custkey as key"), ["type"], "key", 3, 7).groupBy("type").agg(F.count("*").alias("n"))
