"""Registered queries of the text layer, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import layout, textlayer
from .registry import OBS_SQL, observations, pieces, query, table

LINES_SQL = OBS_SQL + """,
o AS (SELECT doc, page, pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height, text,
  (1 - CAST(y AS DOUBLE) - CAST(height AS DOUBLE) + 0.22::DOUBLE * CAST(height AS DOUBLE)) * 792 AS base FROM obs),
u AS (SELECT * FROM o WHERE trim(text) <> '')"""
FRAGMENTS_SQL = LINES_SQL + """,
fr AS (SELECT doc, page, pos, ((pos * 29) % 90) / 100.0::DOUBLE AS x, (pos // 3) * 0.05::DOUBLE + (pos % 3) * 0.004::DOUBLE AS y, 0.35::DOUBLE AS width, 0.02::DOUBLE + (pos % 2) * 0.015::DOUBLE AS height, text FROM u)"""
FRAGMENTS = ["doc", "page", "pos", "((pos * 29) % 90) / 100.0D as x", "(pos div 3) * 0.05D + (pos % 3) * 0.004D as y", "0.35D as width", "0.02D + (pos % 2) * 0.015D as height", "text"]
TWINS_SQL = OBS_SQL + ", tw AS (SELECT doc, page, pos, 'w' || (pos % 4) AS text, ((pos * 7) % 3) / 100.0::DOUBLE AS x, pos * 0.002::DOUBLE AS y, 0.03::DOUBLE AS height, 0.1::DOUBLE AS width FROM obs)"
COLUMNS_SQL = OBS_SQL + """,
co AS (SELECT doc, page, pos, CASE WHEN doc % 3 = 0 THEN 0.05::DOUBLE ELSE (pos % 2) * 0.5::DOUBLE + 0.05::DOUBLE END + ((doc + pos) % 5) / 100.0::DOUBLE AS x, 0.3::DOUBLE AS width, ((pos * 7 + doc) % 20) / 20.0::DOUBLE AS y, 0.03::DOUBLE AS height FROM obs)"""


def fragments(spark, sf_dir):
    return layout.usable(observations(spark, sf_dir)).selectExpr(*FRAGMENTS)


def twins(spark, sf_dir):
    return observations(spark, sf_dir).selectExpr("doc", "page", "pos", "'w' || (pos % 4) as text", "((pos * 7) % 3) / 100.0D as x", "pos * 0.002D as y", "0.03D as height", "0.1D as width")


def columns(spark, sf_dir):
    return observations(spark, sf_dir).selectExpr("doc", "page", "pos", "case when doc % 3 = 0 then 0.05D else (pos % 2) * 0.5D + 0.05D end + ((doc + pos) % 5) / 100.0D as x", "0.3D as width", "((pos * 7 + doc) % 20) / 20.0D as y", "0.03D as height")


@query("without_doubles", f"""WITH RECURSIVE {TWINS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY doc, page, text ORDER BY pos) AS n FROM tw),
f AS (SELECT doc, page, text, 0 AS n, CAST(NULL AS BIGINT) AS pos, FALSE AS keep, CAST([] AS STRUCT(x DOUBLE, y DOUBLE)[]) AS kept FROM k WHERE n = 1
  UNION ALL SELECT k.doc, k.page, k.text, k.n, k.pos, len(list_filter(f.kept, lambda e: abs(e.x - k.x) * 612 < k.height * 792 AND abs(e.y - k.y) * 792 < 0.3 * k.height * 792)) = 0,
    CASE WHEN len(list_filter(f.kept, lambda e: abs(e.x - k.x) * 612 < k.height * 792 AND abs(e.y - k.y) * 792 < 0.3 * k.height * 792)) = 0 THEN list_append(f.kept, {{'x': k.x, 'y': k.y}}) ELSE f.kept END
  FROM f JOIN k ON f.doc = k.doc AND f.page = k.page AND f.text = k.text AND k.n = f.n + 1)
SELECT doc, page, pos FROM f WHERE keep""")
def without_doubles(spark, sf_dir):
    return layout.without_doubles(twins(spark, sf_dir)).select("doc", "page", "pos")


JOIN_SQL = LINES_SQL + """,
n AS (SELECT *, lead(x) OVER w AS nx, lead(base) OVER w AS nbase, lead(width) OVER w AS nw, lead(height) OVER w AS nh, regexp_extract(text, '^(.*\\p{L})[-‐‑­]$', 1) AS head,
  regexp_extract(lead(text) OVER w, '^(\\p{Ll}\\p{L}*)', 1) AS tail FROM u WINDOW w AS (PARTITION BY doc, page ORDER BY pos)),
t AS (SELECT doc, page - 1 AS page, y, regexp_extract(text, '^(\\p{Ll}\\p{L}*)', 1) AS tail, row_number() OVER (PARTITION BY doc, page ORDER BY y, pos) AS r FROM u),
c AS (SELECT doc, page, arg_min(tail, r) AS over_tail FROM t WHERE r <= 3 AND y <= 0.25 AND tail <> '' GROUP BY doc, page),
j AS (SELECT n.doc, n.page, pos, x, y, width, height, base, CASE WHEN head = '' THEN text
  WHEN tail <> '' AND base > nbase AND abs(base - nbase) >= 0.4 * least(height, nh) * 792 AND base - nbase < 2.5 * greatest(height * 792, 1)
    AND (least(x + width, nx + nw) - greatest(x, nx)) / least(width, nw) >= 0.6 THEN head || tail
  WHEN y + height >= 0.75 AND over_tail IS NOT NULL THEN head || over_tail ELSE text END AS text FROM n LEFT JOIN c ON n.doc = c.doc AND n.page = c.page)"""


@query("prepared_lines", f"WITH {JOIN_SQL} SELECT doc, page, pos, text FROM j")
def prepared_lines(spark, sf_dir):
    return textlayer.prepared(observations(spark, sf_dir)).select("doc", "page", "pos", "text")


RUNS_SQL = JOIN_SQL + f""",
hr AS (SELECT a.doc, a.page, a.pos, min(abs(b.base - a.base)) / 1.5 AS room FROM j a JOIN j b ON a.doc = b.doc AND a.page = b.page AND a.pos <> b.pos AND (least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * 612 > 1
  AND abs(b.base - a.base) > 0.5 AND abs(b.base - a.base) >= 0.4 * least(a.height, b.height) * 792 GROUP BY 1, 2, 3),
rl AS (SELECT a.doc, a.page, a.pos, min(b.x) * 612 AS lim FROM j a JOIN j b ON a.doc = b.doc AND a.page = b.page AND a.pos <> b.pos AND b.x > a.x AND abs(b.base - a.base) < 0.4 * greatest(a.height, b.height) * 792
  AND (least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) / least(a.width, b.width) <= 0.5 GROUP BY 1, 2, 3),
p AS (SELECT j.doc, j.page, j.pos, text, width * 612 AS bw, height * 792 AS bh, x * 612 AS l, room, lim, greatest(height * 792, 1) AS ref,
  greatest(height * 792, 1) * list_sum(list_transform(string_split(text, ''), lambda c: CASE WHEN ascii(c) BETWEEN 32 AND 126 THEN {list(textlayer.HELVETICA)}[CAST(ascii(c) AS BIGINT) - 31] ELSE 556 END)) / 1000.0 AS adv
  FROM j LEFT JOIN hr ON j.doc = hr.doc AND j.page = hr.page AND j.pos = hr.pos LEFT JOIN rl ON j.doc = rl.doc AND j.page = rl.page AND j.pos = rl.pos),
q AS (SELECT *, (lim - l) / (1 + 0.25 * ref / adv) AS allowed, least(0.86 * bh, coalesce(room, 1e300)) AS wanted FROM p),
r AS (SELECT *, coalesce(allowed > 0 AND allowed < bw, FALSE) AS limited, least(greatest(ref * (CASE WHEN allowed > 0 AND allowed < bw THEN allowed ELSE bw END) / adv, 0.5), 400) AS s FROM q),
run AS (SELECT *, CASE WHEN wanted / s < 0.25 THEN wanted / 0.25 ELSE s END AS size, least(greatest(wanted / CASE WHEN wanted / s < 0.25 THEN wanted / 0.25 ELSE s END, 0.25), 3) AS vertical FROM r)"""


@query("placed_runs", f"WITH {RUNS_SQL} SELECT doc, page, pos, round(size, 6) AS size, round(vertical, 6) AS vertical, limited FROM run")
def placed_runs(spark, sf_dir):
    out = textlayer.placement(textlayer.prepared(observations(spark, sf_dir)))
    return out.select("doc", "page", "pos", F.round("size", 6).alias("size"), F.round("vertical", 6).alias("vertical"), "limited")


@query("placed_fragments", f"""WITH {FRAGMENTS_SQL}, j AS (SELECT *, (1 - y - height + 0.22::DOUBLE * height) * 792 AS base FROM fr), {RUNS_SQL[len(JOIN_SQL) + 2:]}
SELECT doc, page, pos, round(size, 6) AS size, round(vertical, 6) AS vertical, limited, round((lim - l) / bw, 6) AS room FROM run WHERE limited""")
def placed_fragments(spark, sf_dir):
    out = textlayer.placement(fragments(spark, sf_dir)).where("limited")
    return out.select("doc", "page", "pos", F.round("size", 6).alias("size"), F.round("vertical", 6).alias("vertical"), "limited", F.round("room_share", 6).alias("room"))


@query("run_census", f"""WITH {RUNS_SQL}, w AS (SELECT *, adv * size / ref / bw AS ws, size * vertical / (0.86 * bh) AS hs FROM run)
SELECT doc, count(DISTINCT page) AS pages, count(*) AS fragments, CAST(0 AS BIGINT) AS refused, count(*) FILTER (limited) AS limited, count(*) FILTER (ws < 0.15) AS sliver15, count(*) FILTER (ws < 0.5) AS sliver50,
  count(*) FILTER (ws < 0.5 AND hs < 0.5) AS crushed, round(min(ws), 6) AS least_share, round(min(hs), 6) AS least_height FROM w GROUP BY doc""")
def run_census(spark, sf_dir):
    out = textlayer.run_census(textlayer.placement(textlayer.prepared(observations(spark, sf_dir))))
    return out.withColumns({"least_share": F.round("least_share", 6), "least_height": F.round("least_height", 6)})


@query("worst_runs", f"WITH {RUNS_SQL} SELECT doc, page, pos, round(adv * size / ref / bw, 6) AS share FROM run ORDER BY adv * size / ref / bw, doc, page, pos LIMIT 20")
def worst_runs(spark, sf_dir):
    out = textlayer.worst_runs(textlayer.placement(textlayer.prepared(observations(spark, sf_dir))), 20)
    return out.select("doc", "page", "pos", F.round("width_share", 6).alias("share"))


VISUAL_SQL = FRAGMENTS_SQL + """,
vo AS (SELECT *, (1 - y - height + 0.22::DOUBLE * height) * 792 AS base, height * 792 AS high FROM fr), vk AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY -base, pos) AS n FROM vo),
vf AS (SELECT doc, page, 0 AS n, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS g, CAST([] AS STRUCT(base DOUBLE, high DOUBLE)[]) AS reps FROM vk WHERE n = 1
  UNION ALL SELECT s.doc, s.page, s.n, s.pos, coalesce(s.best, len(s.reps) + 1), CASE WHEN s.best IS NULL THEN list_append(s.reps, {'base': s.base, 'high': s.high}) ELSE s.reps END
  FROM (SELECT vk.doc, vk.page, vk.n, vk.pos, vk.base, vk.high, vf.reps, list_sort(list_transform(list_filter(range(1, len(vf.reps) + 1), lambda i: abs(vf.reps[i].base - vk.base) < 0.4 * least(vf.reps[i].high, vk.high)),
      lambda i: {'d': abs(vf.reps[i].base - vk.base), 'i': i}))[1].i AS best FROM vf JOIN vk ON vf.doc = vk.doc AND vf.page = vk.page AND vk.n = vf.n + 1) s),
vl AS (SELECT vf.doc, vf.page, g - 1 AS line, arg_min(base, {'x': x, 'p': vk.pos}) AS baseline, min(x) AS lft, max(x + width) AS rgt, string_agg(text, ' ' ORDER BY x, vk.pos) AS text, list(text ORDER BY x, vk.pos) AS fragments
  FROM vf JOIN vk ON vf.doc = vk.doc AND vf.page = vk.page AND vf.pos = vk.pos GROUP BY 1, 2, 3)"""


@query("visual_lines", f"WITH RECURSIVE {VISUAL_SQL} SELECT doc, page, line, round(baseline, 4) AS baseline, round(lft, 4) AS lft, round(rgt, 4) AS rgt, text FROM vl")
def visual_lines(spark, sf_dir):
    out = textlayer.visual_lines(fragments(spark, sf_dir))
    return out.select("doc", "page", "line", F.round("baseline", 4).alias("baseline"), F.round("left", 4).alias("lft"), F.round("right", 4).alias("rgt"), "text")


#: Two visual lines in four run together, and fragments of every fifth line without a space.
EXTRACTED_SQL = VISUAL_SQL + """,
ex AS (SELECT doc, page, line - CASE WHEN line % 4 = 1 THEN 1 ELSE 0 END AS spot, string_agg(CASE WHEN line % 5 = 0 THEN array_to_string(fragments, '') ELSE text END, ' ' ORDER BY line) AS text FROM vl GROUP BY 1, 2, 3),
pt AS (SELECT doc, page, string_agg(text, chr(10) ORDER BY spot) AS whole FROM ex GROUP BY doc, page)"""


def extracted(lines):
    out = lines.selectExpr("doc", "page", "line - if(line % 4 = 1, 1, 0) as at", "line", "if(line % 5 = 0, array_join(fragments, ''), text) as t")
    return out.groupBy("doc", "page", "at").agg(F.array_sort(F.collect_list(F.struct("line", "t"))).alias("e")).select("doc", "page", "at", F.array_join("e.t", " ").alias("text"))


@query("welded_fragments", f"""WITH RECURSIVE {EXTRACTED_SQL}, pr AS (SELECT doc, page, trim(fragments[i]) AS a, trim(fragments[i + 1]) AS b FROM vl, range(1, 100) AS r(i) WHERE i < len(fragments))
SELECT pr.doc, count(*) AS pairs, count(*) FILTER (contains(whole, right(a, 6) || left(b, 6))) AS welded FROM pr JOIN pt ON pr.doc = pt.doc AND pr.page = pt.page WHERE length(a) >= 3 AND length(b) >= 3 GROUP BY pr.doc""")
def welded_fragments(spark, sf_dir):
    lines = textlayer.visual_lines(fragments(spark, sf_dir))
    pages = extracted(lines).groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("e")).select("doc", "page", F.array_join("e.text", "\n").alias("text"))
    return textlayer.welds(lines, pages)


ANCHOR_SQL = EXTRACTED_SQL + """,
aw AS (SELECT vl.doc, vl.page, line, whole, list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 4) AS ws FROM vl JOIN pt ON vl.doc = pt.doc AND vl.page = pt.page),
ar AS (SELECT doc, page, line, whole, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM aw),
at8 AS (SELECT *, row_number() OVER (PARTITION BY doc, page, line ORDER BY -length(w), i) AS k FROM ar),
an AS (SELECT doc, page, line, arg_min(w, k) AS anchor FROM at8 WHERE k <= 8 AND len(string_split(whole, w)) = 2 GROUP BY doc, page, line)"""


@query("line_anchors", f"WITH RECURSIVE {ANCHOR_SQL} SELECT vl.doc, vl.page, vl.line, anchor FROM vl LEFT JOIN an ON vl.doc = an.doc AND vl.page = an.page AND vl.line = an.line")
def line_anchors(spark, sf_dir):
    lines = textlayer.visual_lines(fragments(spark, sf_dir))
    pages = extracted(lines).groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("e")).select("doc", "page", F.array_join("e.text", "\n").alias("whole"))
    return lines.join(pages, ["doc", "page"]).select("doc", "page", "line", textlayer.anchor(F.col("text"), F.col("whole")).alias("anchor"))


@query("line_separation", f"""WITH RECURSIVE {ANCHOR_SQL}, hm AS (SELECT an.doc, an.page, line, CASE WHEN count(*) = 1 THEN min(spot) END AS home FROM an JOIN ex ON an.doc = ex.doc AND an.page = ex.page AND contains(ex.text, anchor) GROUP BY 1, 2, 3),
lh AS (SELECT vl.doc, vl.page, vl.line, baseline, lft, rgt, text, home FROM vl LEFT JOIN hm ON vl.doc = hm.doc AND vl.page = hm.page AND vl.line = hm.line),
nx AS (SELECT *, lead(lft) OVER w AS l2, lead(rgt) OVER w AS r2, lead(home) OVER w AS h2 FROM lh WINDOW w AS (PARTITION BY doc, page ORDER BY baseline DESC, line)),
pp AS (SELECT doc, count(*) AS visual_lines, count(*) FILTER (l2 IS NOT NULL AND least(rgt, r2) - greatest(lft, l2) > 0.02 AND home IS NOT NULL AND h2 IS NOT NULL) AS judged,
  count(*) FILTER (l2 IS NOT NULL AND least(rgt, r2) - greatest(lft, l2) > 0.02 AND (home IS NULL OR h2 IS NULL)) AS skipped, count(*) FILTER (l2 IS NOT NULL AND least(rgt, r2) - greatest(lft, l2) > 0.02 AND home = h2) AS merged, max(length(text)) AS longest_visual FROM nx GROUP BY doc),
lg AS (SELECT doc, page, max(length(text)) AS m FROM vl GROUP BY doc, page),
ch AS (SELECT ex.doc, coalesce(sum(length(text)) FILTER (length(text) > m), 0) AS runaway_chars, sum(length(text)) AS total_chars FROM ex JOIN lg ON ex.doc = lg.doc AND ex.page = lg.page GROUP BY ex.doc)
SELECT pp.doc, visual_lines, judged, skipped, merged, CAST(runaway_chars AS BIGINT) AS runaway_chars, CAST(total_chars AS BIGINT) AS total_chars, longest_visual FROM pp JOIN ch ON pp.doc = ch.doc""")
def line_separation(spark, sf_dir):
    lines = textlayer.visual_lines(fragments(spark, sf_dir))
    return textlayer.separation(lines, extracted(lines))


BANDS_SQL = COLUMNS_SQL + """,
bi AS (SELECT DISTINCT doc, page, unnest(range(greatest(0, least(199, CAST(floor(x * 200) AS BIGINT))), greatest(0, least(199, CAST(floor((x + width) * 200) AS BIGINT))) + 1)) AS b FROM co WHERE width >= 0.01),
bg AS (SELECT *, CASE WHEN b - lag(b) OVER (PARTITION BY doc, page ORDER BY b) - 1 >= 7 THEN 1 ELSE 0 END AS fresh FROM bi), bn AS (SELECT *, sum(fresh) OVER (PARTITION BY doc, page ORDER BY b) AS band FROM bg),
bb AS (SELECT doc, page, CAST(band AS BIGINT) AS band, min(b) / 200.0 AS low, CASE WHEN band = max(band) OVER (PARTITION BY doc, page) THEN 1.0 ELSE (max(b) + 1) / 200.0 END AS high FROM bn GROUP BY doc, page, band),
bl AS (SELECT co.doc, co.page, co.pos, co.y, min(band) AS band FROM co JOIN bb ON co.doc = bb.doc AND co.page = bb.page AND x + width / 2 BETWEEN low AND high GROUP BY 1, 2, 3, 4)"""


@query("column_bands", f"WITH {BANDS_SQL} SELECT doc, page, band, round(low, 6) AS low, round(CAST(high AS DOUBLE), 6) AS high FROM bb")
def column_bands(spark, sf_dir):
    return textlayer.bands(columns(spark, sf_dir)).select("doc", "page", "band", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("lines_in_bands", f"WITH {BANDS_SQL} SELECT co.doc, co.page, co.pos, band FROM co LEFT JOIN bl ON co.doc = bl.doc AND co.page = bl.page AND co.pos = bl.pos")
def lines_in_bands(spark, sf_dir):
    lines = columns(spark, sf_dir)
    return textlayer.banded(lines, textlayer.bands(lines)).select("doc", "page", "pos", "band")


@query("interleaving", f"""WITH {BANDS_SQL}, pg8 AS (SELECT doc, page FROM co GROUP BY doc, page HAVING count(*) >= 8), pop AS (SELECT doc, page, band FROM bl GROUP BY 1, 2, 3 HAVING count(*) >= 4),
pc AS (SELECT doc, page, count(*) AS columns FROM pop GROUP BY doc, page HAVING count(*) >= 2),
sq AS (SELECT bl.*, columns, lag(bl.band) OVER w AS pb, lag(bl.y) OVER w AS py FROM bl JOIN pop USING (doc, page, band) JOIN pc USING (doc, page) JOIN pg8 USING (doc, page) WINDOW w AS (PARTITION BY doc, page ORDER BY pos))
SELECT doc, page, columns, count(*) FILTER (band <> pb) AS switches, count(*) FILTER (band = pb AND y < py - 0.005) AS inversions, count(*) FILTER (band <> pb) / greatest(columns - 1, 1) AS ratio FROM sq GROUP BY doc, page, columns""")
def interleaving(spark, sf_dir):
    return textlayer.interleaving(columns(spark, sf_dir))


@query("tight_pairs", f"""WITH {LINES_SQL}, n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(width) OVER w AS nw FROM o WINDOW w AS (PARTITION BY doc, page ORDER BY y, pos))
SELECT doc, page, count(*) FILTER (nx IS NOT NULL AND least(x + width, nx + nw) - greatest(x, nx) > 0.02) AS pairs, count(*) FILTER (nx IS NOT NULL AND least(x + width, nx + nw) - greatest(x, nx) > 0.02 AND ny - y < 0.6 * height) AS tight FROM n GROUP BY doc, page""")
def tight_pairs(spark, sf_dir):
    return textlayer.tight_pairs(observations(spark, sf_dir))


@query("word_retention", r"""WITH w AS (SELECT doc_id, lower(unnest(regexp_split_to_array(text, '\s+'))) AS a FROM documents), g AS (SELECT doc_id, lower(unnest(regexp_split_to_array(replace(text, 'er', ' '), '\s+'))) AS a FROM documents),
t AS (SELECT doc_id, a, count(*) AS n FROM w WHERE a <> '' GROUP BY 1, 2), o AS (SELECT doc_id, a, count(*) AS m FROM g WHERE a <> '' GROUP BY 1, 2)
SELECT t.doc_id AS doc, CAST(sum(least(n, coalesce(m, 0))) AS BIGINT) AS matched, CAST(sum(n) AS BIGINT) AS total FROM t LEFT JOIN o ON t.doc_id = o.doc_id AND t.a = o.a GROUP BY 1""")
def word_retention(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return textlayer.retention(docs.selectExpr("doc_id as doc", "text"), docs.selectExpr("doc_id as doc", "replace(text, 'er', ' ') as text"))


INK_SQL = OBS_SQL + """,
ik AS (SELECT doc, page, x, CASE WHEN x BETWEEN 45 AND 45 + page % 6 + doc % 3 OR x < 8 OR x > 95 - doc % 4 THEN 0 WHEN (x * 7 + doc) % 13 = 0 THEN 1 ELSE 50 + (x * doc) % 100 END AS ink FROM (SELECT DISTINCT doc, page FROM obs), range(0, 100) AS r(x)),
ip AS (SELECT *, max(ink) OVER (PARTITION BY doc, page) AS peak FROM ik), iq AS (SELECT *, ink <= greatest(1, peak // 100) AS quiet FROM ip WHERE peak > 0),
ir AS (SELECT *, x - row_number() OVER (PARTITION BY doc, page, quiet ORDER BY x) AS island FROM iq),
gt AS (SELECT doc, page, min(x) AS low, max(x) + 1 AS high FROM ir WHERE quiet GROUP BY doc, page, island HAVING count(*) >= 3 AND min(x) > 12 AND max(x) + 1 < 88)"""


def ink_columns(spark, sf_dir):
    # a hundred rows a page: partitions by the size of the documents, as AQE would join them by that of the pages; behind distinct() they would be dropped
    pages = observations(spark, sf_dir).select("doc", "page").repartition(pieces(table(spark, sf_dir, "documents")), "doc", "page").distinct()
    pages = pages.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(99).cast("bigint"))))
    return pages.selectExpr("doc", "page", "x", "case when x between 45 and 45 + page % 6 + doc % 3 or x < 8 or x > 95 - doc % 4 then 0 when (x * 7 + doc) % 13 = 0 then 1 else 50 + (x * doc) % 100 end as ink")


@query("gutters", f"WITH {INK_SQL} SELECT doc, page, low, high FROM gt")
def gutters(spark, sf_dir):
    return textlayer.gutters(ink_columns(spark, sf_dir), 100)


@query("gutter_crossings", f"WITH {INK_SQL} SELECT doc, page, pos FROM obs WHERE EXISTS (SELECT 1 FROM gt WHERE gt.doc = obs.doc AND gt.page = obs.page AND CAST(x AS DOUBLE) * 100 < low AND (CAST(x AS DOUBLE) + CAST(width AS DOUBLE)) * 100 > high)")
def gutter_crossings(spark, sf_dir):
    return textlayer.crossings(observations(spark, sf_dir), textlayer.gutters(ink_columns(spark, sf_dir), 100), 100).select("doc", "page", "pos")


MATRIX = "case o_orderkey % 4 when 0 then array(1D, 0D, 0D, 1D, 0D, 0D) when 1 then array(0D, -1D, 1D, 0D, 0D, 612D) when 2 then array(-1D, 0D, 0D, -1D, 612D, 792D) else array(0D, 1D, -1D, 0D, 792D, 0D) end"


@query("mapped_points", """WITH p AS (SELECT o_orderkey AS k, o_orderkey % 4 AS r, (o_orderkey % 700)::DOUBLE AS x, (o_custkey % 900)::DOUBLE AS y, CASE WHEN o_orderkey % 2 = 0 THEN 612.0::DOUBLE ELSE 792.0::DOUBLE END AS w, CASE WHEN o_orderkey % 2 = 0 THEN 792.0::DOUBLE ELSE 612.0::DOUBLE END AS h FROM orders),
m AS (SELECT *, CASE r WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 612 - x ELSE 792 - y END AS mx, CASE r WHEN 0 THEN y WHEN 1 THEN 612 - x WHEN 2 THEN 792 - y ELSE x END AS my FROM p),
v AS (SELECT *, CASE r WHEN 1 THEN y WHEN 3 THEN 792 - y END AS vx, CASE r WHEN 0 THEN y WHEN 2 THEN 792 - y END AS vy FROM m)
SELECT k AS o_orderkey, greatest(0, least(mx, w)) AS x, greatest(0, least(my, h)) AS y, CASE WHEN vx IS NOT NULL THEN greatest(0, least(vx, w)) END AS axis_left, CASE WHEN vy IS NOT NULL THEN greatest(0, least(vy, h)) END AS axis_top FROM v""")
def mapped_points(spark, sf_dir):
    k = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{MATRIX} as m", "cast(o_orderkey % 700 as double) as x", "cast(o_custkey % 900 as double) as y", "if(o_orderkey % 2 = 0, 612D, 792D) as w", "if(o_orderkey % 2 = 0, 792D, 612D) as h")
    point = textlayer.map_point(*map(F.col, ("x", "y", "m", "w", "h")))
    axis = textlayer.map_axis(F.col("y"), F.lit(True), *map(F.col, ("m", "w", "h")))
    return k.select("o_orderkey", point["x"].alias("x"), point["y"].alias("y"), axis["left"].alias("axis_left"), axis["top"].alias("axis_top"))


@query("crop_regions", """WITH p AS (SELECT o_orderkey AS k, (o_orderkey % 50)::DOUBLE - 10 AS x, (o_custkey % 60)::DOUBLE - 10 AS y, CASE WHEN o_orderkey % 7 = 0 THEN 0::DOUBLE ELSE (500 + o_orderkey % 200)::DOUBLE END AS w, (600 + o_custkey % 300)::DOUBLE AS h FROM orders),
c AS (SELECT *, greatest(x, 0) AS l, greatest(y, 0) AS b, least(x + w, 612) AS r, least(y + h, 792) AS t FROM p)
SELECT k AS o_orderkey, CASE WHEN w <= 0 THEN 0 ELSE l END AS x, CASE WHEN w <= 0 THEN 0 ELSE b END AS y, CASE WHEN w <= 0 THEN 612 ELSE r - l END AS width, CASE WHEN w <= 0 THEN 792 ELSE t - b END AS height FROM c""")
def crop_regions(spark, sf_dir):
    k = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "named_struct('x', 0D, 'y', 0D, 'width', 612D, 'height', 792D) as media", "array(1D, 0D, 0D, 1D, 0D, 0D) as m",
        "named_struct('x', o_orderkey % 50 - 10D, 'y', o_custkey % 60 - 10D, 'width', if(o_orderkey % 7 = 0, 0D, 500D + o_orderkey % 200), 'height', 600D + o_custkey % 300) as crop")
    return k.select("o_orderkey", textlayer.crop_region(F.col("media"), F.col("crop"), F.col("m")).alias("c")).select("o_orderkey", "c.*")


@query("text_hashes", """WITH b AS (SELECT o_orderkey, o_comment, list_transform(range(0, octet_length(encode(o_comment))), lambda i: CAST(('0x' || substr(hex(encode(o_comment)), 2 * i + 1, 2)) AS BIGINT)) AS bytes FROM (SELECT o_orderkey, 'a ' || o_orderkey || ' é ' || o_custkey AS o_comment FROM orders))
SELECT o_orderkey, lower(lpad(hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 % 281474976710656 AS HUGEINT), list_transform(bytes, lambda v: CAST(v AS HUGEINT))), lambda h, v: (xor(h, v) * 1099511628211) % 281474976710656) AS BIGINT)), 12, '0')) AS hash FROM b""")
def text_hashes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.fnv48(F.expr("'a ' || o_orderkey || ' é ' || o_custkey")).alias("hash"))
