"""Registered queries of inputs, releases and resumed runs, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import control, imaging, reports
from ..sources import tables
from .image_queries import images
from .registry import OBS_SQL, PIXELS_SQL, observations, query, table
from .report_queries import LOG_SQL, log


@query("corpus_documents", "SELECT o_custkey || '/b' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.PDF' ELSE '.pdf' END AS key FROM orders WHERE o_orderkey % 4 <> 3 AND o_orderkey % 5 <> 0")
def corpus_documents(spark, sf_dir):
    paths = table(spark, sf_dir, "orders").selectExpr("if(o_orderkey % 5 = 0, '/other/', '/corpus/') || o_custkey || '/b' || o_orderkey || case o_orderkey % 4 when 3 then '.txt' when 1 then '.pdf' else '.PDF' end as path")
    return control.corpus_documents(paths, "/corpus").select("key")


@query("releases", """WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'none' WHEN 2 THEN 'unreadable' WHEN 3 THEN 'none' WHEN 4 THEN 'unreadable' ELSE 'offer' END AS state FROM orders)
SELECT k AS o_orderkey, state, CASE WHEN state = 'offer' THEN '1.' || k % 9 END AS version, CASE WHEN state = 'offer' THEN CASE WHEN k % 2 = 0 THEN 'n' ELSE '' END END AS notes FROM r""")
def releases(spark, sf_dir):
    feed = F.expr("""case o_orderkey % 6 when 0 then 'no json' when 1 then '{"tag_name": "v2", "html_url": "https://x", "draft": true}' when 2 then '{"tag_name": "v1", "html_url": "http://x"}' when 3 then '{"tag_name": "1.2b", "html_url": "HTTPS://x"}'
      when 4 then '{"tag_name": "vv1", "html_url": "https://x"}' else '{"tag_name": "v1.' || o_orderkey % 9 || '", "html_url": "https://x"' || if(o_orderkey % 2 = 0, ', "body": "n"', '') || '}' end""")
    return table(spark, sf_dir, "orders").select("o_orderkey", control.release(feed).alias("r")).select("o_orderkey", "r.*")


TORN_SQL = "tn AS (SELECT c_custkey AS file, c_custkey % 4 AS k, 'd' || c_custkey AS d FROM customer)"


def torn(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as file", "case c_custkey % 4 when 0 then '' when 1 then 'document\\tpage\\nd' || c_custkey || '\\t1\\n' when 2 then 'document\\tpage\\nd' || c_custkey || '\\t1\\nd' || c_custkey || 'x' else '# stamp\\nd' || c_custkey end as content")


@query("owed_documents", f"WITH {TORN_SQL} SELECT file, d AS document FROM tn WHERE k >= 2 UNION ALL SELECT file, d || 'x' FROM tn WHERE k = 2")
def owed_documents(spark, sf_dir):
    return control.owed_documents(torn(spark, sf_dir))


@query("whole_rows", f"WITH {TORN_SQL} SELECT file, CASE k WHEN 0 THEN '' WHEN 3 THEN '# stamp' || chr(10) ELSE 'document' || chr(9) || 'page' || chr(10) || d || chr(9) || '1' || chr(10) END AS content FROM tn")
def whole_rows(spark, sf_dir):
    return control.whole_rows(torn(spark, sf_dir))


@query("still_owed", f"WITH {LOG_SQL} SELECT i AS document FROM range(0, 500) AS r(i) WHERE i NOT IN (SELECT document FROM lg) OR i % 17 = 0")
def still_owed(spark, sf_dir):
    wanted = spark.range(500).selectExpr("id as document")
    return control.still_owed(wanted, log(spark, sf_dir), wanted.where("document % 17 = 0"))


@query("remaining_mutants", "SELECT c_custkey AS mutant FROM customer WHERE c_custkey % 3 <> 0")
def remaining_mutants(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as mutant")
    rows = c.selectExpr("case mutant % 3 when 0 then array(cast(mutant as string), 'killed', '9', '') when 1 then array(cast(mutant as string), 'killed') else array(cast(mutant as string), '', '0', '') end as fields")
    return control.remaining_mutants(c.selectExpr("cast(mutant as string) as mutant"), rows).selectExpr("cast(mutant as bigint) as mutant")


RUN_SQL = "rn AS (SELECT c_nationkey AS run, c_custkey AS spot, c_name AS file, CASE WHEN c_nationkey % 5 = 0 THEN NULL WHEN c_nationkey % 5 = 1 AND c_custkey % 2 = 0 THEN NULL WHEN c_nationkey % 5 = 2 AND c_custkey % 3 = 0 THEN 'cancelled' WHEN c_nationkey % 5 = 3 AND c_custkey % 2 = 0 THEN 'failed' ELSE 'succeeded' END AS outcome FROM customer)"


def runs(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_nationkey as run", "c_custkey as at", "c_name as file", "case when c_nationkey % 5 = 0 then null when c_nationkey % 5 = 1 and c_custkey % 2 = 0 then null when c_nationkey % 5 = 2 and c_custkey % 3 = 0 then 'cancelled' when c_nationkey % 5 = 3 and c_custkey % 2 = 0 then 'failed' else 'succeeded' end as outcome")


@query("retried", f"WITH {RUN_SQL} SELECT run, file, row_number() OVER (PARTITION BY run ORDER BY spot) AS nth FROM rn WHERE outcome = 'failed'")
def retried(spark, sf_dir):
    return control.retried(runs(spark, sf_dir)).withColumnRenamed("at", "nth")


@query("list_status", f"WITH {RUN_SQL}, g AS (SELECT run, count(*) AS n, count(outcome) AS d, count(*) FILTER (outcome = 'failed') AS f, count(*) FILTER (outcome = 'cancelled') AS c FROM rn GROUP BY run) SELECT run, CASE WHEN d = 0 THEN n || ' files' WHEN d < n THEN d || ' of ' || n WHEN c > 0 THEN 'stopped, ' || c || ' not done' WHEN f > 0 THEN 'done, ' || f || ' failed' ELSE 'done' END AS status FROM g")
def list_status(spark, sf_dir):
    return control.list_status(runs(spark, sf_dir))


@query("changed_settings", "SELECT c_nationkey AS run, c_name AS label FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0 AND c_custkey % 7 <> 0")
def changed_settings(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return control.changed_settings(c.selectExpr("c_nationkey as run", "c_name as label", "if(c_custkey % 5 = 0, null, 1) as value"), c.selectExpr("c_nationkey as run", "c_name as label", "case when c_custkey % 3 = 0 then 2 when c_custkey % 35 = 0 then null else 1 end as value"))


@query("projected_verdicts", "SELECT c_name AS path, 'scanned' AS verdict, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_nationkey END AS pages FROM customer")
def projected_verdicts(spark, sf_dir):
    return control.projected_verdicts(table(spark, sf_dir, "customer").selectExpr("c_name as path", "'scanned' as verdict", "if(c_custkey % 4 = 0, '-', ' ' || c_nationkey) as pages"))


@query("diverging", "SELECT c_custkey AS k FROM customer WHERE c_custkey % 6 = 0 OR c_custkey % 7 = 0")
def diverging(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return control.diverging(c.selectExpr("c_custkey as k", "c_custkey / 7D as value"), c.where("c_custkey % 6 <> 0").selectExpr("c_custkey as k", "c_custkey / 7D + if(c_custkey % 7 = 0, 0.001D, 0D) as value"), ["k"])


@query("drawn_census", "SELECT CASE l_partkey % 3 WHEN 0 THEN 'agree' WHEN 1 THEN 'smaller' ELSE 'wider' END AS verdict, count(*) AS pages, count(*) FILTER (abs(l_suppkey % 40) / 100.0 >= 0.05) AS diverging FROM lineitem GROUP BY 1")
def drawn_census(spark, sf_dir):
    return control.drawn_census(table(spark, sf_dir, "lineitem").selectExpr("element_at(array('agree', 'smaller', 'wider'), cast(l_partkey % 3 + 1 as int)) as verdict", "100D as listed_dpi", "100D + l_suppkey % 40 as drawn_dpi"))


@query("failing_lines", f"""WITH {OBS_SQL}, o AS (SELECT doc, page, pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(width AS DOUBLE) AS w, CAST(height AS DOUBLE) AS h, text FROM obs), r AS (SELECT doc, page, pos, x + 0.2 * w AS x, y, CASE WHEN pos % 3 = 0 THEN 0.5 * w ELSE w END AS w, h FROM o WHERE pos % 4 > 0),
j AS (SELECT o.doc, o.page, o.pos, bool_or(r.x IS NOT NULL AND least(o.x + 0.15 * o.w, r.x + r.w) > greatest(o.x, r.x)) AS s, bool_or(r.x IS NOT NULL AND least(o.x + o.w, r.x + r.w) > greatest(o.x + o.w - 0.15 * o.w, r.x)) AS e FROM o LEFT JOIN r ON o.doc = r.doc AND o.page = r.page AND least(o.y + o.h, r.y + r.h) > greatest(o.y, r.y) WHERE length(text) > 12 GROUP BY 1, 2, 3)
SELECT doc, page, pos, coalesce(s, FALSE) AS start, coalesce(e, FALSE) AS "end" FROM j WHERE NOT coalesce(s, FALSE) OR NOT coalesce(e, FALSE)""".replace('AS "end"', "AS finish"))
def failing_lines(spark, sf_dir):
    o = observations(spark, sf_dir)
    return control.failing_lines(o, o.where("pos % 4 > 0").selectExpr("doc", "page", "x + 0.2D * width as x", "y", "if(pos % 3 = 0, 0.5D * width, width) as width", "height")).withColumnRenamed("end", "finish")


@query("json_pages", f"""WITH {OBS_SQL}, p AS (SELECT doc, page, '{{"observations":[' || string_agg('{{"confidence":' || CAST(CAST(pos AS DOUBLE) / 2 AS VARCHAR) || ',"text":"t' || pos || '"}}', ',' ORDER BY pos) || '],"page":' || page || '}}' AS j FROM obs GROUP BY doc, page) SELECT doc, '[' || string_agg(j, ',' ORDER BY page) || ']' AS json FROM p GROUP BY doc""")
def json_pages(spark, sf_dir):
    return control.json_pages(observations(spark, sf_dir).selectExpr("doc", "page", "pos", "cast(pos as double) / 2 as confidence", "'t' || pos as text"))


INK_SQL = "g0 AS (SELECT l_orderkey AS o, l_linenumber AS l, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY 1, 2), gl AS (SELECT o // 4 % 12 AS img, o * 10 + l AS spot, p * 7 % 300 AS x, l * 12 + p % 5 AS y, 3 + p % 4 AS width, CASE WHEN p % 11 = 0 THEN 40 ELSE 5 + s % 4 END AS height, 2 + p % 30 AS area, 1 + p % 7 AS run FROM g0)"


def glyphs(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 = 0").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l")).agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    return g.selectExpr("o div 4 % 12 as img", "o * 10 + l as at", "p * 7 % 300 as x", "l * 12 + p % 5 as y", "3 + p % 4 as width", "cast(if(p % 11 = 0, 40, 5 + s % 4) as bigint) as height", "2 + p % 30 as area", "1 + p % 7 as run")


GLYPH_SQL = INK_SQL + """, gm AS (SELECT img, list_sort(list(height))[count(*) // 2 + 1] AS h, list_sort(list(run))[count(*) // 2 + 1] AS r FROM gl GROUP BY img),
tl AS (SELECT gl.*, h AS glyph FROM gl JOIN gm USING (img) WHERE area >= 4 AND height >= 0.5 * h AND height <= 3 * h AND run <= 2 * r)"""


@query("text_like", f"WITH {GLYPH_SQL} SELECT img, spot, glyph FROM tl")
def text_like(spark, sf_dir):
    return control.text_like(glyphs(spark, sf_dir)).selectExpr("img", "at as spot", "glyph")


@query("ink_lines", f"""WITH RECURSIVE {GLYPH_SQL}, tk AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY y, spot, x) AS n, count(*) OVER (PARTITION BY img) AS total FROM tl),
fb AS (SELECT img, 0 AS n, CAST(NULL AS BIGINT) AS spot, CAST(NULL AS BIGINT) AS band, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS lasts FROM tk WHERE n = 1
  UNION ALL SELECT s.img, s.n, s.spot, coalesce(s.best, len(s.lasts) + 1), CASE WHEN s.best IS NULL THEN list_append(s.lasts, {{'a': s.y, 'b': s.y + s.height - 1}}) ELSE list_concat(list_concat(s.lasts[:s.best - 1], [{{'a': s.y, 'b': s.y + s.height - 1}}]), s.lasts[s.best + 1:]) END
  FROM (SELECT tk.img, tk.n, tk.spot, tk.y, tk.height, fb.lasts, list_filter(range(1, len(fb.lasts) + 1), lambda i: least(tk.y + tk.height - 1, fb.lasts[i].b) - greatest(tk.y, fb.lasts[i].a) + 1 > 0
    AND least(tk.y + tk.height - 1, fb.lasts[i].b) - greatest(tk.y, fb.lasts[i].a) + 1 >= 0.5 * least(tk.height, fb.lasts[i].b - fb.lasts[i].a + 1))[1] AS best FROM fb JOIN tk ON tk.img = fb.img AND tk.n = fb.n + 1) s),
mb AS (SELECT tl.*, band, CASE WHEN tl.x - lag(tl.x + width - 1) OVER (PARTITION BY tl.img, band ORDER BY tl.x, tl.spot) > 3 * glyph THEN 1 ELSE 0 END AS cut FROM fb JOIN tl ON tl.img = fb.img AND tl.spot = fb.spot), mp AS (SELECT *, sum(cut) OVER (PARTITION BY img, band ORDER BY x, spot) AS part FROM mb)
SELECT img, count(*) AS members, min(x) AS x, min(y) AS y, max(x + width - 1) - min(x) + 1 AS width, max(y + height - 1) - min(y) + 1 AS height, CAST(sum(area) AS BIGINT) AS area FROM mp GROUP BY img, band, part HAVING count(*) >= 4""")
def ink_lines(spark, sf_dir):
    return control.ink_lines(control.text_like(glyphs(spark, sf_dir)))


@query("footprints", f"""WITH {PIXELS_SQL}, d AS (SELECT img, y - 1 AS y, x - 2 AS x, abs(v - (v + x * img) % 256) > 12 AS c FROM px WHERE y BETWEEN 1 AND 6 AND x BETWEEN 2 AND 7) SELECT img, round(count(*) FILTER (c) / 36, 6) AS coverage, round(coalesce(avg(x) FILTER (c) / 6, 0), 6) AS cx, round(coalesce(avg(y) FILTER (c) / 6, 0), 6) AS cy FROM d GROUP BY img""")
def footprints(spark, sf_dir):
    import numpy as np

    def work(data, img, width, height):
        g = imaging.plane(data, width, height).astype(int)
        other = (g + np.arange(8)[None] * img) % 256
        yield tuple(round(v, 6) for v in imaging.footprint(g, other, (slice(1, 7), slice(2, 8))))

    return imaging.per_image(images(spark, sf_dir).withColumn("id", F.col("img")), ["grey", "id", "width", "height"], work, "img long, coverage double, cx double, cy double")


@query("layered_documents", "SELECT l_orderkey AS doc, sum(l_partkey) < sum(l_suppkey * 15) AS layered, CAST(least(sum(l_partkey), sum(l_suppkey * 15)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1")
def layered_documents(spark, sf_dir):
    totals = reports.layer_choice(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "l_partkey as layered", "l_suppkey * 15 as single"))
    return totals.selectExpr("doc", "layered < single as layered", "least(layered, single) as bytes")


@query("tsv_rows", "SELECT c_custkey AS n, c_name AS a, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS b FROM customer WHERE c_custkey > 2 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0")
def tsv_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").selectExpr("c_custkey as n", "case when c_custkey = 1 then '# bar' when c_custkey = 2 then 'a\\tb' when c_custkey % 7 = 0 then '#' || c_name when c_custkey % 11 = 0 then '  ' when c_custkey % 4 = 0 then c_name when c_custkey % 5 = 0 then c_name || '\\t' || c_nationkey || '\\tmore' else c_name || '\\t' || c_nationkey end as value")
    return tables.tsv_rows(lines, *tables.tsv_header(lines, ["b"]))


@query("strict_rows", "SELECT c_custkey AS n, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS a, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS b, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS bad FROM customer")
def strict_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").selectExpr("c_custkey as n", "if(c_custkey % 3 = 0, c_name, c_name || '\\t' || c_nationkey) as value")
    rows, bad = tables.strict_rows(lines, ["a", "b"])
    return rows.withColumn("bad", F.lit(None).cast("string")).unionByName(bad.selectExpr("n", "cast(null as string) as a", "cast(null as string) as b", "value as bad"))


@query("natural_order", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 40, c_custkey) AS place FROM customer")
def natural_order(spark, sf_dir):
    from pyspark.sql.window import Window

    names = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey", "if(c_custkey % 2 = 0, 'Page ', 'page ') || c_custkey % 40 || '/' || c_custkey as name")
    return names.select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(scalars.natural_key(F.col("name")))).alias("place"))


@query("scalars", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE CAST(trunc(o_custkey / 7.0) AS BIGINT) END AS whole,
  CASE WHEN o_orderkey % 9000 >= 3600 THEN o_orderkey % 9000 // 3600 || 'h ' || lpad(CAST(o_orderkey % 9000 % 3600 // 60 AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || 's' WHEN o_orderkey % 9000 >= 60 THEN o_orderkey % 9000 % 3600 // 60 || 'm ' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || 's' ELSE o_orderkey % 9000 % 60 || 's' END AS took,
  CASE WHEN o_orderkey % 3 = 0 THEN '(a ' || chr(92) || '(' || o_orderkey || chr(92) || ') ' || chr(92) || chr(92) || ')' ELSE '<FEFF00E9' || CASE WHEN o_orderkey % 2 = 0 THEN '0041' ELSE '0042' END || '>' END AS pdf FROM orders""")
def scalar_functions(spark, sf_dir):
    text = F.when(F.expr("o_orderkey % 3 = 0"), F.concat(F.lit("a ("), F.col("o_orderkey").cast("string"), F.lit(") \\"))).when(F.expr("o_orderkey % 2 = 0"), "éA").otherwise("éB")
    whole = F.expr("case when o_orderkey % 10 = 0 then cast('NaN' as double) when o_orderkey % 5 = 0 then cast('Infinity' as double) else o_custkey / 7D end")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.safe_int(whole).alias("whole"), scalars.duration(F.expr("o_orderkey % 9000")).alias("took"), scalars.pdf_string(text).alias("pdf"))
