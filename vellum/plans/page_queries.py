"""Registered queries of page predicates, refusals and estimates, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import corpus, pages
from .registry import OBS_SQL, observations, query, table

CELLS_SQL = "cl AS (SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'NaN' WHEN 1 THEN '-' WHEN 2 THEN NULL WHEN 3 THEN ' 12 ' ELSE CAST(o_custkey % 20 AS VARCHAR) END AS c, CASE WHEN o_orderkey % 3 = 0 THEN 'scan' ELSE 'photo' END AS kind FROM orders)"


def cells(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "case o_orderkey % 7 when 0 then 'NaN' when 1 then '-' when 2 then null when 3 then ' 12 ' else cast(o_custkey % 20 as string) end as c", "if(o_orderkey % 3 = 0, 'scan', 'photo') as kind")


@query("cells_where", f"WITH {CELLS_SQL} SELECT k, c FROM cl WHERE TRY_CAST(trim(c) AS DOUBLE) >= 5 AND NOT isnan(TRY_CAST(trim(c) AS DOUBLE)) AND kind <> 'scan'")
def cells_where(spark, sf_dir):
    return pages.where_all(cells(spark, sf_dir), ["c:ge:5", "kind:ne:scan"]).select("k", "c")


@query("cells_not_comparable", f"WITH {CELLS_SQL} SELECT (SELECT count(*) FROM cl WHERE c IS NULL OR c = '-') AS unreadable, (SELECT count(*) FROM cl WHERE 1 = 0) AS below_nan")
def cells_not_comparable(spark, sf_dir):
    c = cells(spark, sf_dir)
    return pages.count_unreadable(c, ["c:lt:3", "kind:eq:scan"]).crossJoin(pages.where_all(c, ["c:lt:nan"]).agg(F.count("*").alias("below_nan")))


@query("eras", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 6 = 0 THEN 'unk' WHEN 1900 + o_orderkey % 120 >= 2000 THEN 'new' WHEN 1900 + o_orderkey % 120 >= 1960 THEN 'mid' ELSE 'old' END AS era FROM orders")
def eras(spark, sf_dir):
    year = F.expr("case when o_orderkey % 5 = 0 then null when o_orderkey % 6 = 0 then 0 else 1900 + o_orderkey % 120 end")
    return table(spark, sf_dir, "orders").select("o_orderkey", pages.era(year).alias("era"))


TEXTS_SQL = OBS_SQL + """,
pt AS (SELECT doc, page, CASE WHEN (doc + page) % 4 = 0 THEN '  ' ELSE string_agg(text, chr(10) ORDER BY pos) END AS text, 300 + (doc * 37 + page * 101) % 1500 AS px, CASE WHEN page % 5 = 0 THEN NULL ELSE 50 + (doc * 11 + page * 7) % 400 END AS dpi FROM obs GROUP BY doc, page)"""


def page_texts(spark, sf_dir):
    out = observations(spark, sf_dir).groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"))
    return out.selectExpr("doc", "page", "if((doc + page) % 4 = 0, '  ', array_join(l.text, '\\n')) as text", "300 + (doc * 37 + page * 101) % 1500 as px", "if(page % 5 = 0, null, 50 + (doc * 11 + page * 7) % 400) as dpi")


DIGITAL_SQL = TEXTS_SQL + """,
nn AS (SELECT doc, count(*) AS n FROM pt GROUP BY doc), lk AS (SELECT pt.* FROM pt JOIN nn ON pt.doc = nn.doc WHERE n <= 4 OR page - 1 IN (n // 5, 2 * n // 5, 3 * n // 5, 4 * n // 5)),
dg AS (SELECT doc, 2 * count(*) FILTER (length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 120 AND NOT coalesce(px >= 900 AND dpi BETWEEN 72 AND 1400, FALSE)) > count(*) AS digital FROM lk GROUP BY doc)"""


@query("digital_documents", f"WITH {DIGITAL_SQL} SELECT doc, digital FROM dg")
def digital(spark, sf_dir):
    return pages.digital_documents(page_texts(spark, sf_dir))


@query("files_with_digital_text", f"WITH {DIGITAL_SQL} SELECT doc_id AS doc, source FROM documents WHERE doc_id IN (SELECT doc FROM dg WHERE digital)")
def files_with_digital_text(spark, sf_dir):
    return pages.files_with_digital_text(table(spark, sf_dir, "documents").selectExpr("doc_id as doc", "source"), page_texts(spark, sf_dir))


@query("embedded_text", f"WITH {TEXTS_SQL} SELECT doc, bool_or(trim(text) <> '') AS has_text FROM pt GROUP BY doc")
def embedded_text(spark, sf_dir):
    return pages.embedded_text(page_texts(spark, sf_dir))


ESTIMATE_SQL = """r AS (SELECT l_orderkey AS doc, l_linenumber AS page, max(l_quantity) AS q, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2),
s AS (SELECT doc, count(*) AS n, count(*) FILTER (q >= 45) AS hits, sum(CAST(value AS DOUBLE)) FILTER (q >= 45) AS value FROM r GROUP BY doc),
c AS (SELECT o.doc, coalesce(n, 0) + o.doc % 3 AS pages FROM (SELECT DISTINCT o_orderkey AS doc FROM orders) o LEFT JOIN s ON o.doc = s.doc)"""


def sampled(spark, sf_dir):
    """(hits, sample, census): one row a line item, grouped once."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").cast("double").alias("value"))
    per = rows.groupBy("doc").agg(F.count("*").alias("n"))
    census = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc")).distinct().join(per, "doc", "left").selectExpr("doc", "coalesce(n, 0) + doc % 3 as pages")
    return pages.where_all(rows, ["q:ge:45"]).select("doc", "page", "value"), rows.select("doc", "page"), census


@query("stratified_estimate", f"""WITH {ESTIMATE_SQL} SELECT count(*) FILTER (hits > 0) AS documents, CAST(sum(hits) AS BIGINT) AS sampled_hits, round(sum(value), 0) AS sampled_value, round(sum(hits * pages / n), 4) AS hits, round(sum(value * pages / n), 0) AS value,
  count(*) FILTER (hits > 0 AND pages = n) AS exact_documents, CAST(coalesce(sum(hits) FILTER (pages = n), 0) AS BIGINT) AS exact_hits, round(sum(value) FILTER (pages = n), 0) AS exact_value, count(*) FILTER (pages = n) AS whole_documents,
  CAST(sum(n) AS BIGINT) AS sample_pages, (SELECT CAST(sum(pages) AS BIGINT) FROM c) AS corpus_pages, (SELECT count(*) FROM c) AS census_documents,
  round(sum(hits) * (SELECT sum(pages) FROM c) / sum(n), 4) AS pooled_hits, round(sum(value) * (SELECT sum(pages) FROM c) / sum(n), 0) AS pooled_value FROM s JOIN c USING (doc)""")
def stratified(spark, sf_dir):
    out = corpus.stratified_estimate(*sampled(spark, sf_dir))
    whole = {c: F.round(c, 0) for c in ("sampled_value", "value", "exact_value", "pooled_value")}
    return out.withColumns(whole | {c: F.round(c, 4) for c in ("hits", "pooled_hits")})


@query("stray_pages", "SELECT l_orderkey AS doc, l_linenumber AS page FROM lineitem WHERE l_quantity > 30 EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND l_linenumber % 2 = 0")
def stray_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"))
    return corpus.stray_pages(rows, rows.where("page % 2 = 0")).distinct()


@query("repeated_pages", "SELECT l_suppkey AS doc, l_linenumber AS page, count(*) AS times FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_pages(spark, sf_dir):
    return corpus.repeated_pages(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page")))


@query("uncovered_samples", "WITH s AS (SELECT l_orderkey AS doc, count(*) AS sampled FROM lineitem GROUP BY 1), c AS (SELECT o_orderkey AS doc, 1 + o_orderkey % 6 AS pages FROM orders WHERE o_orderkey % 5 <> 0) SELECT s.doc, sampled, pages FROM s LEFT JOIN c ON s.doc = c.doc WHERE pages IS NULL OR sampled > pages")
def uncovered_samples(spark, sf_dir):
    census = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").selectExpr("o_orderkey as doc", "1 + o_orderkey % 6 as pages")
    return corpus.uncovered(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")), census)


@query("census", "SELECT CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'a/' END || c_custkey || '.pdf' AS doc, c_nationkey AS pages FROM customer")
def census(spark, sf_dir):
    return corpus.read_census(table(spark, sf_dir, "customer").selectExpr("if(c_custkey % 2 = 0, 'testdocs/', 'a/') || c_custkey || '.pdf' as path", "' ' || c_nationkey as pages"))


@query("earlier_manifest", "SELECT o_orderkey AS doc FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def earlier_manifest(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("doc"))
    return corpus.not_yet_done(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc")), done)


@query("top_candidates", "WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS pos, min(CAST(l_discount * 100 AS BIGINT) * 100 + CAST(l_tax * 100 AS BIGINT)) AS r FROM lineitem GROUP BY 1, 2) SELECT doc, 1 AS page, pos, 'r' || r AS text, r / 10000.0 AS confidence FROM r")
def top_candidates(spark, sf_dir):
    ranked = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "1 as page", "l_linenumber as pos", "cast(l_discount * 100 as bigint) * 100 + cast(l_tax * 100 as bigint) as rank")
    return pages.top_candidates(ranked.selectExpr("*", "'r' || rank as text", "rank / 10000D as confidence"))


@query("page_guards", """WITH g AS (SELECT o_orderkey AS k, CASE o_orderkey % 11 WHEN 0 THEN 0.1 WHEN 1 THEN 9000.5 ELSE 612.5 END::DOUBLE AS w, CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN 8000 ELSE 792 END::DOUBLE AS h, (1 + o_orderkey % 6)::DOUBLE AS s FROM orders),
r AS (SELECT *, floor(w * s + 0.5) AS wide, floor(h * s + 0.5) AS high FROM g)
SELECT k AS o_orderkey, CASE WHEN NOT coalesce(wide >= 1 AND high >= 1, FALSE) THEN 'pageFailed' WHEN wide * high > 400000000 THEN 'pageTooLarge' END AS error, k % 2 = 0 AND (k % 20) / 100.0 > 0.06 AND coalesce(w * h <= 10000000, FALSE) AS colour FROM r""")
def page_guards(spark, sf_dir):
    g = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(case o_orderkey % 11 when 0 then 0.1 when 1 then 9000.5 else 612.5 end as double) as w", "cast(case o_orderkey % 13 when 0 then null when 1 then 8000 else 792 end as double) as h", "cast(1 + o_orderkey % 6 as double) as s")
    colour = pages.keeps_colour(F.expr("o_orderkey % 2 = 0"), F.expr("(o_orderkey % 20) / 100D"), F.expr("w * h * 10"))
    return g.select("o_orderkey", pages.size_guard(F.col("w"), F.col("h"), F.col("s")).alias("error"), F.coalesce(colour, F.lit(False)).alias("colour"))


@query("rebuild_of_drawn", """WITH d AS (SELECT o_orderkey AS k, o_orderkey % 3 AS kind, (50 + o_orderkey % 300)::DOUBLE AS dd, 300 + o_custkey % 900 AS dw, CASE WHEN o_custkey % 4 <> 0 THEN (60 + o_custkey % 250)::DOUBLE END AS ld, 400 + o_orderkey % 500 AS lw FROM orders),
e AS (SELECT *, CASE kind WHEN 0 THEN ld WHEN 2 THEN dd END AS dpi, CASE kind WHEN 0 THEN lw ELSE dw END AS width FROM d)
SELECT k AS o_orderkey, CASE WHEN dpi >= 150 OR (dpi IS NOT NULL AND width >= 600) THEN dpi ELSE 300 END AS dpi FROM e""")
def rebuild_of_drawn(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "element_at(array('unreadable', 'none', 'largest'), cast(o_orderkey % 3 + 1 as int)) as kind", "cast(50 + o_orderkey % 300 as double) as dd", "300 + o_custkey % 900 as dw", "cast(if(o_custkey % 4 <> 0, 60 + o_custkey % 250, null) as double) as ld", "400 + o_orderkey % 500 as lw")
    return d.select("o_orderkey", pages.rebuild_dpi_of(*map(F.col, ("kind", "dd", "dw", "ld", "lw"))).alias("dpi"))


@query("run_modes", """WITH f AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS rebuild, o_orderkey % 3 = 0 AS jb, o_orderkey % 5 > 0 AS can, o_orderkey % 7 > 0 AS av, o_orderkey % 11 = 0 AS lost, o_custkey % 2 = 0 AS txt FROM orders)
SELECT k AS o_orderkey, rebuild AND jb AND can AND av AND NOT lost AS jbig2, rebuild AND (txt OR jb AND can AND av AND NOT lost) AS rebuilds, CASE WHEN k % 3 = 1 THEN TRUE ELSE rebuild END AS warns FROM f""")
def run_modes(spark, sf_dir):
    rebuild = F.expr("o_orderkey % 2 = 0")
    wants = pages.wants_jbig2(rebuild, F.expr("o_orderkey % 3 = 0"), F.expr("o_orderkey % 5 > 0"), F.expr("o_orderkey % 7 > 0"), F.expr("o_orderkey % 11 = 0"))
    mode = F.expr("if(o_orderkey % 3 = 1, 'text', 'searchablePDF')")
    return table(spark, sf_dir, "orders").select("o_orderkey", wants.alias("jbig2"), pages.will_rebuild(F.expr("o_custkey % 2 = 0"), rebuild, wants).alias("rebuilds"), pages.warns_of_digital_text(mode, rebuild).alias("warns"))


@query("trimmed_documents", "SELECT l_orderkey AS doc, bool_or(l_partkey % 9 = 0) AS trimmed FROM lineitem GROUP BY 1")
def trimmed_documents(spark, sf_dir):
    return pages.trimmed_documents(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "named_struct('w', 612, 'h', if(l_partkey % 9 = 0, 700, 792)) as crop", "named_struct('w', 612, 'h', 792) as sheet"))


@query("drawn_verdicts", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'unreadable' WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_custkey % 3 = 0 THEN 'noDictImage' ELSE 'drawsNoImage' END WHEN o_custkey % 3 = 0 THEN 'drawnOnly'
  WHEN o_orderkey % 5 = o_custkey % 5 THEN 'agree' WHEN o_orderkey % 5 < o_custkey % 5 THEN 'smaller' ELSE 'wider' END AS verdict FROM orders""")
def drawn_verdicts(spark, sf_dir):
    kind = F.expr("element_at(array('unreadable', 'none', 'largest', 'largest'), cast(o_orderkey % 4 + 1 as int))")
    return table(spark, sf_dir, "orders").select("o_orderkey", pages.drawn_verdict(F.expr("if(o_custkey % 3 = 0, null, o_custkey % 5)"), kind, F.expr("o_orderkey % 5")).alias("verdict"))


@query("unsupported_languages", """WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'en-US,  DE-de' ELSE 'fr' END || CASE WHEN o_orderkey % 3 = 0 THEN ',' ELSE ' xx' || o_orderkey % 4 END AS t, o_orderkey % 5 = 0 AS none FROM orders),
u AS (SELECT k, none, unnest(regexp_split_to_array(t, '[, \\n\\r\\t]+')) AS w FROM a) SELECT k AS o_orderkey, coalesce(string_agg(w, '|' ORDER BY w) FILTER (w <> '' AND NOT none AND lower(w) NOT IN ('en-us', 'de-de', 'xx1')), '') AS missing FROM u GROUP BY k""")
def unsupported_languages(spark, sf_dir):
    asked = scalars.split_list(F.expr("if(o_orderkey % 2 = 0, 'en-US,  DE-de', 'fr') || if(o_orderkey % 3 = 0, ',', ' xx' || o_orderkey % 4)"))
    known = F.expr("if(o_orderkey % 5 = 0, cast(array() as array<string>), array('en-US', 'de-DE', 'XX1'))")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(pages.unsupported(asked, known)), "|").alias("missing"))


@query("size_notes", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 100 > 0 AND o_custkey % 200 > o_orderkey % 100 AND (o_custkey % 200)::DOUBLE / (o_orderkey % 100) >= 1.25")
def size_notes(spark, sf_dir):
    name = F.expr("element_at(array('a.b.png', 'x.PDF', 'y/z.pdf'), cast(o_orderkey % 3 + 1 as int))")
    return table(spark, sf_dir, "orders").where(pages.grew(name, F.expr("o_orderkey % 100"), F.expr("o_custkey % 200"))).select("o_orderkey")


@query("helper_settings", """SELECT o_orderkey, o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 3 AND o_orderkey % 7 <> 0 AS valid, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 3 AND o_orderkey % 7 <> 0 THEN o_orderkey % 4 = 1 END AS fast, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 3 AND o_orderkey % 7 <> 0 THEN 0.25 END::DOUBLE AS confidence FROM orders""")
def helper_settings(spark, sf_dir):
    args = F.expr("concat(array('--fast', case o_orderkey % 4 when 3 then 'yes' when 1 then '1' else '0' end, '--language-correction', '1', '--languages', 'en', '--custom-words', '', '--min-text-height-on', '0', '--min-text-height', '0.5', '--confidence', if(o_orderkey % 7 = 0, 'high', '0.25')), if(o_orderkey % 5 = 0, array('--odd'), cast(array() as array<string>)))")
    return table(spark, sf_dir, "orders").select("o_orderkey", pages.helper_settings(args).alias("s")).select("o_orderkey", F.col("s").isNotNull().alias("valid"), "s.fast", "s.confidence")


@query("page_samples", """WITH n AS (SELECT o_orderkey AS k, o_orderkey % 30 AS n FROM orders)
SELECT k AS o_orderkey, CASE WHEN n <= 3 THEN array_to_string(range(0, n), ',') ELSE '1,' || n // 2 || ',' || n * 3 // 4 END AS scorer, CASE WHEN n <= 4 THEN array_to_string(range(0, n), ',') ELSE '1,' || 1 + (n - 2) // 3 || ',' || 1 + 2 * (n - 2) // 3 || ',' || n - 1 END AS reading,
  CASE WHEN n <= 5 THEN array_to_string(range(0, n), ',') ELSE array_to_string([n // 6, 2 * n // 6, 3 * n // 6, 4 * n // 6, 5 * n // 6], ',') END AS even FROM n""")
def page_samples(spark, sf_dir):
    n = F.expr("o_orderkey % 30")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", text(pages.scorer_pages(n)).alias("scorer"), text(pages.reading_pages(n, 4)).alias("reading"), text(pages.sample_indices(n, 5)).alias("even"))


@query("release_checks", """WITH v AS (SELECT o_orderkey AS k, o_orderkey % 4 AS a1, o_orderkey % 12 AS a2, o_custkey % 4 AS b1, o_custkey % 12 AS b2 FROM orders)
SELECT k AS o_orderkey, (a1, a2) > (b1, b2) AS newer, (a1, a2) > (b1, b2) AND k % 3 <> 0 AS announced, k % 5 <> 0 AND (k % 6 = 0 OR k % 6 > 2) AS due FROM v""")
def release_checks(spark, sf_dir):
    a, b = F.expr("o_orderkey % 4 || '.' || o_orderkey % 12 || 'b.x'"), F.expr("'v' || o_custkey % 4 || '..' || o_custkey % 12")
    due = scalars.is_due(F.lit(1_000_000.0), F.expr("case o_orderkey % 6 when 0 then 0D when 1 then 999999D when 2 then 950000D when 3 then 1000001D else 913600D end"), F.expr("o_orderkey % 5 <> 0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.is_newer(a, b).alias("newer"), scalars.announces(a, b, F.when(F.expr("o_orderkey % 3 = 0"), a)).alias("announced"), due.alias("due"))


@query("same_but_for_space", "SELECT o_orderkey, o_orderkey % 3 <> 0 AS same FROM orders")
def same_but_for_space(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.same_words(F.expr("' a  b' || o_orderkey"), F.expr("if(o_orderkey % 3 = 0, 'a ', 'a\\n') || if(o_orderkey % 3 = 0, 'c', 'b') || o_orderkey || ' '")).alias("same"))
