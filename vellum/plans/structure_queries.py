"""Registered queries of trees and references, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure
from .registry import query, table

NODES_SQL = """nd AS (SELECT c_custkey % 3 AS doc, c_custkey // 3 AS id, CASE WHEN c_custkey // 3 > 2 THEN c_custkey // 9 END AS parent, (c_custkey * 7) % 5 AS at_, c_name AS title, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 20 END AS page FROM customer WHERE c_custkey >= 3),
kp AS (SELECT * FROM nd WHERE page IS NOT NULL OR EXISTS (SELECT 1 FROM nd k WHERE k.doc = nd.doc AND k.parent = nd.id)),
tr AS (SELECT doc, id, parent, title, page, 1 AS level, [{'a': at_, 'i': id}] AS path FROM kp WHERE parent IS NULL OR parent = 0
  UNION ALL SELECT k.doc, k.id, k.parent, k.title, k.page, tr.level + 1, list_append(tr.path, {'a': k.at_, 'i': k.id}) FROM kp k JOIN tr ON k.doc = tr.doc AND k.parent = tr.id WHERE k.parent > 0),
nb AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY path) AS number FROM tr)"""


def nodes(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey >= 3").selectExpr("c_custkey % 3 as doc", "c_custkey div 3 as id", "nullif(if(c_custkey div 3 > 2, c_custkey div 9, null), 0) as parent", "(c_custkey * 7) % 5 as at", "c_name as title", "if(c_custkey % 4 <> 0, c_custkey % 20, null) as page")


@query("outline", f"""WITH RECURSIVE {NODES_SQL}, q AS (SELECT *, lead(number) OVER w AS nxt, lag(number) OVER w AS prv FROM nb WINDOW w AS (PARTITION BY doc, parent ORDER BY number))
SELECT q.doc, q.id, q.number, q.level, q.title, q.page, (SELECT number FROM nb p WHERE p.doc = q.doc AND p.id = q.parent) AS parent_number, q.nxt AS next, q.prv AS previous, (SELECT min(number) FROM nb c WHERE c.doc = q.doc AND c.parent = q.id) AS first,
  (SELECT max(number) FROM nb c WHERE c.doc = q.doc AND c.parent = q.id) AS last, (SELECT count(*) FROM nb d WHERE d.doc = q.doc AND len(d.path) > len(q.path) AND d.path[:len(q.path)] = q.path) AS below FROM q""")
def outline(spark, sf_dir):
    return structure.outline(nodes(spark, sf_dir))


@query("mapped_outline", "WITH n AS (SELECT c_custkey AS id, c_custkey % 3 AS doc, c_custkey % 20 AS page FROM customer), m AS (SELECT r AS doc, s AS page, s + 100 AS new_page FROM range(0, 3) AS a(r), range(0, 15) AS b(s)) SELECT id, n.doc, new_page AS page FROM n LEFT JOIN m ON n.doc = m.doc AND n.page = m.page")
def mapped_outline(spark, sf_dir):
    pages = spark.range(45).selectExpr("id % 3 as doc", "id div 3 as page", "id div 3 + 100 as new_page")
    return structure.mapped_outline(table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_custkey % 3 as doc", "c_custkey % 20 as page"), pages)


PAGES_SQL = """pn AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent, c_custkey % 3 AS at_, CASE WHEN c_custkey % 5 = 0 THEN (c_custkey % 7) * 90 - 180 END AS rotate, CASE WHEN c_custkey % 6 = 1 THEN 'box' || c_custkey % 4 END AS box,
  NOT EXISTS (SELECT 1 FROM customer k WHERE k.c_custkey // 2 = c.c_custkey AND k.c_custkey > 1) AS leaf FROM customer c)"""


@query("page_tree", f"""WITH RECURSIVE {PAGES_SQL}, t AS (SELECT id, parent, leaf, rotate, box, 1 AS level FROM pn WHERE parent IS NULL UNION ALL SELECT pn.id, pn.parent, pn.leaf, coalesce(pn.rotate, t.rotate), coalesce(pn.box, t.box), level + 1 FROM pn JOIN t ON pn.parent = t.id)
SELECT id, ((coalesce(rotate, 0) % 360) + 360) % 360 AS rotate, box, level - 1 AS depth FROM t WHERE leaf""")
def page_tree(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    inner = c.where("c_custkey > 1").selectExpr("c_custkey div 2 as id").distinct().withColumn("inner", F.lit(True))
    n = c.selectExpr("c_custkey as id", "if(c_custkey > 1, c_custkey div 2, null) as parent", "c_custkey % 3 as at", "if(c_custkey % 5 = 0, (c_custkey % 7) * 90 - 180, null) as rotate", "if(c_custkey % 6 = 1, 'box' || c_custkey % 4, null) as box").join(inner, "id", "left")
    return structure.page_tree(n.withColumn("leaf", F.col("inner").isNull()).drop("inner")).drop("path")


EDGES_SQL = "ed AS (SELECT DISTINCT c_custkey AS f, c_custkey // 2 + c_custkey % 3 AS t FROM customer UNION SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 4 = 0), ro AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 10 = 3)"


def edges(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.selectExpr("c_custkey as from_node", "c_custkey div 2 + c_custkey % 3 as to_node").union(c.where("c_custkey % 4 = 0").selectExpr("c_custkey", "c_nationkey")).distinct(), c.where("c_custkey % 10 = 3").selectExpr("c_custkey as node")


@query("closure", f"WITH RECURSIVE {EDGES_SQL}, t(root, node) AS (SELECT node, node FROM ro UNION SELECT t.root, ed.t FROM t JOIN ed ON ed.f = t.node) SELECT root, node FROM t")
def closure(spark, sf_dir):
    return structure.closure(*edges(spark, sf_dir))


@query("copied_ids", f"WITH RECURSIVE {EDGES_SQL}, t(root, node) AS (SELECT node, node FROM ro UNION SELECT t.root, ed.t FROM t JOIN ed ON ed.f = t.node AND ed.t % 7 <> 0) SELECT root, node, 99 + row_number() OVER (PARTITION BY root ORDER BY node) AS new_id FROM t")
def copied_ids(spark, sf_dir):
    e, r = edges(spark, sf_dir)
    pages = e.select(F.col("to_node").alias("node")).where("node % 7 = 0").distinct()
    return structure.copied_ids(e, r, pages, 100)


@query("resolved_values", "SELECT a.o_orderkey AS id, CASE WHEN a.o_orderkey % 3 = 0 THEN b.o_orderpriority ELSE 'plain ' || a.o_custkey END AS value FROM orders a LEFT JOIN orders b ON a.o_orderkey % 3 = 0 AND b.o_orderkey = a.o_custkey")
def resolved_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return structure.resolved(o.selectExpr("o_orderkey as id", "if(o_orderkey % 3 = 0, o_custkey || ' 0 R', 'plain ' || o_custkey) as value"), o.selectExpr("o_orderkey as object", "o_orderpriority as content"))


@query("moved_geometry", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey + 5) || ',' || (o_custkey - 7) || ',' || (o_orderkey + 15) || ',' || (o_custkey + 13) END AS rect, CASE WHEN o_orderkey % 6 <> 0 THEN 6 || ',' || (o_orderkey - 7) || ';' || 8 || ',' || (-4) END AS ink FROM orders""")
def moved_geometry(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "array(cast(o_orderkey as double), o_custkey, if(o_orderkey % 4 = 0, null, o_orderkey + 10), o_custkey + 20) as rect", "array(array(1D, if(o_orderkey % 6 = 0, null, cast(o_orderkey as double))), array(3D, 3D)) as ink")
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("bigint").cast("string")), ",")
    ink = structure.moved_strokes(F.col("ink"), F.lit(5.0), F.lit(-7.0))
    return o.select("o_orderkey", text(structure.moved(F.col("rect"), F.lit(5.0), F.lit(-7.0))).alias("rect"), F.array_join(F.transform(ink, text), ";").alias("ink"))


@query("appended_marks", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_custkey || ' 0 R,' END || o_orderkey || ' 0 R' AS marks FROM orders")
def appended_marks(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(structure.appended(F.expr("if(o_orderkey % 3 = 0, null, array(o_custkey || ' 0 R'))"), F.expr("array(o_orderkey || ' 0 R')")), ",").alias("marks"))


@query("transplanted_marks", """WITH m AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_partkey AS k, CASE l_partkey % 4 WHEN 0 THEN 'Link' WHEN 1 THEN 'Text' WHEN 2 THEN 'Ink' ELSE 'Movie' END AS subtype, l_partkey % 9 = 0 AS broken FROM lineitem),
p AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS page, (l_orderkey % 5) * 90 % 450 AS rotate FROM lineitem WHERE l_linenumber < 6)
SELECT m.doc, m.page, k, CASE WHEN rotate IS NULL THEN 'no page' WHEN subtype = 'Movie' THEN 'subtype' WHEN rotate % 360 <> 0 THEN 'rotated' WHEN broken THEN 'geometry' END AS refused,
  CASE WHEN rotate % 360 = 0 AND subtype <> 'Movie' AND NOT broken THEN (k - 10)::DOUBLE END AS x FROM m LEFT JOIN p ON m.doc = p.doc AND m.page = p.page""")
def transplanted_marks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = li.selectExpr("l_orderkey as doc", "l_linenumber as page", "l_partkey as k", "element_at(array('Link', 'Text', 'Ink', 'Movie'), cast(l_partkey % 4 + 1 as int)) as subtype", "array(cast(l_partkey as double), if(l_partkey % 9 = 0, null, 1D), 2D, 3D) as rect")
    p = li.where("l_linenumber < 6").selectExpr("l_orderkey as doc", "l_linenumber as page", "(l_orderkey % 5) * 90 as rotate", "10D as x", "20D as y").distinct()
    return structure.transplanted(m, p, ("Link", "Text", "Ink")).select("doc", "page", "k", "refused", F.get("moved", F.lit(0)).alias("x"))


@query("object_numbers", "WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS page, count(*) AS images FROM lineitem GROUP BY 1, 2) SELECT doc, page, images, CAST(3 + coalesce(sum(images + 2) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_object FROM p")
def object_numbers(spark, sf_dir):
    return structure.object_numbers(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).agg(F.count("*").alias("images")))


@query("object_offsets", "WITH o AS (SELECT c_nationkey AS doc, c_custkey AS number, length(c_name) AS bytes FROM customer) SELECT a.doc, a.number, a.bytes, CAST(15 + coalesce((SELECT sum(b.bytes) FROM o b WHERE b.doc = a.doc AND b.number < a.number), 0) AS BIGINT) AS at_byte FROM o a")
def object_offsets(spark, sf_dir):
    return structure.offsets(table(spark, sf_dir, "customer").selectExpr("c_nationkey as doc", "c_custkey as number", "cast(length(c_name) as bigint) as bytes"), 15)
