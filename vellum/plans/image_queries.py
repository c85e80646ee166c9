"""Registered queries of rasters, one row an image, checked by SQL over single pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import imaging
from .registry import OTSU_SQL, PIXELS_SQL, query, table


def images(spark, sf_dir):
    v = "transform(embedding, e -> cast(least(255, greatest(0, floor((cast(e as double) + 0.5D) * 255))) as long))"
    plane = lambda f: f"unhex(concat_ws('', transform({v}, x -> lpad(hex({f}), 2, '0'))))"
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id as img", f"{plane('x')} as grey", f"{plane('x')} as red", f"{plane('(x * 7 + 13) % 256')} as green", f"{plane('(x * 3 + 40) % 256')} as blue", "8 as width", "8 as height")


def one(spark, sf_dir, work, schema, columns=("grey", "width", "height")):
    return imaging.per_image(images(spark, sf_dir), list(columns), work, f"img long, {schema}")


@query("otsu_ink_tone", f"WITH {OTSU_SQL} SELECT img, threshold, round(avg(CASE WHEN v < threshold THEN 1.0 ELSE 0 END), 6) AS ink, round(avg(CASE WHEN abs(v - threshold) < 45 THEN 1.0 ELSE 0 END), 6) AS tone FROM px JOIN t USING (img) GROUP BY img, threshold")
def otsu_ink_tone(spark, sf_dir):
    return imaging.signals(images(spark, sf_dir)).select("img", "threshold", F.round("ink", 6).alias("ink"), F.round("tone", 6).alias("tone"))


@query("downsample", f"WITH {PIXELS_SQL} SELECT img, y // 3 AS y, x // 3 AS x, CAST(sum(v) // count(*) AS BIGINT) AS v FROM px WHERE y < 6 AND x < 6 GROUP BY 1, 2, 3")
def downsample(spark, sf_dir):
    return imaging.pixels_of(images(spark, sf_dir), lambda g: imaging.downsampled(g, 3))


@query("upsample", f"""WITH {PIXELS_SQL}, o AS (SELECT i, (i + 0.5::DOUBLE) * 8 / 11 - 0.5::DOUBLE AS f FROM range(0, 11) AS r(i)), c AS (SELECT i, least(greatest(CAST(floor(f) AS BIGINT), 0), 7) AS lo, least(greatest(CAST(floor(f) AS BIGINT), 0) + 1, 7) AS hi, f - greatest(floor(f), 0) AS w FROM o),
s AS (SELECT a.img, cy.i AS y, cx.i AS x, cy.w AS wy, a.v + (b.v - a.v) * cx.w AS top, p.v + (q.v - p.v) * cx.w AS low FROM c cy, c cx JOIN px a ON a.x = cx.lo JOIN px b ON b.img = a.img AND b.x = cx.hi AND b.y = a.y JOIN px p ON p.img = a.img AND p.x = cx.lo JOIN px q ON q.img = a.img AND q.x = cx.hi AND q.y = p.y WHERE a.y = cy.lo AND p.y = cy.hi)
SELECT img, y, x, CAST(greatest(0, least(255, floor(top + (low - top) * wy + 0.5))) AS BIGINT) AS v FROM s""")
def upsample(spark, sf_dir):
    return imaging.pixels_of(images(spark, sf_dir), lambda g: imaging.upsampled(g, 11, 11))


@query("psnr", f"WITH {PIXELS_SQL}, m AS (SELECT img, avg(pow(CASE WHEN img % 5 = 0 THEN 0 ELSE CAST(v - v // 16 * 16 AS DOUBLE) END, 2)) AS m FROM px GROUP BY img) SELECT img, round(CASE WHEN m > 0 THEN 10 * log10(65025.0 / m) ELSE 999 END, 6) AS psnr FROM m")
def psnr(spark, sf_dir):
    def work(data, img, width, height):
        g = imaging.plane(data, width, height)
        yield (min(imaging.psnr(g, g if img % 5 == 0 else g // 16 * 16), 999.0),)

    out = imaging.per_image(images(spark, sf_dir).withColumn("id", F.col("img")), ["grey", "id", "width", "height"], work, "img long, psnr double")
    return out.withColumn("psnr", F.round("psnr", 6))


@query("dark_cells", f"WITH {PIXELS_SQL} SELECT img, y // 2 AS r, x // 2 AS c, round(avg(255 - v), 6) AS dark FROM px GROUP BY 1, 2, 3")
def dark_cells(spark, sf_dir):
    def work(data, width, height):
        dark = (255.0 - imaging.plane(data, width, height)).reshape(4, 2, 4, 2).mean(axis=(1, 3))
        for r, c in np.ndindex(4, 4):
            yield r, c, float(dark[r, c])

    return one(spark, sf_dir, work, "r long, c long, dark double").withColumn("dark", F.round("dark", 6))


@query("local_threshold", f"""WITH {PIXELS_SQL}, n AS (SELECT a.img, a.y, a.x, a.v, avg(CAST(b.v AS DOUBLE)) AS m, avg(CAST(b.v * b.v AS DOUBLE)) AS q FROM px a JOIN px b ON a.img = b.img AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY 1, 2, 3, 4)
SELECT img, y, x, CAST(v < m * (1 + 0.34 * (sqrt(greatest(0, q - m * m)) / 128 - 1)) AS BIGINT) AS v FROM n""")
def local_threshold(spark, sf_dir):
    return imaging.pixels_of(images(spark, sf_dir), lambda g: imaging.local_marks(g, 20.0))


@query("bilevel_bytes", f"WITH {OTSU_SQL}, b AS (SELECT img, y, CAST(sum(CASE WHEN v >= threshold THEN 1 << CAST(7 - x AS INT) ELSE 0 END) AS BIGINT) AS byte FROM px JOIN t USING (img) GROUP BY img, y) SELECT img, string_agg(lpad(CAST(byte AS VARCHAR), 3, '0'), ' ' ORDER BY y) AS bits FROM b GROUP BY img")
def bilevel_bytes(spark, sf_dir):
    def work(data, width, height):
        g = imaging.plane(data, width, height)
        yield (" ".join(f"{b:03d}" for b in imaging.packed_bits(g, imaging.otsu(g))),)

    return one(spark, sf_dir, work, "bits string")


RGB_SQL = PIXELS_SQL + """, cl AS (SELECT img, v::DOUBLE AS r, ((v * 7 + 13) % 256)::DOUBLE AS g, ((v * 3 + 40) % 256)::DOUBLE AS b FROM px), lu AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b >= 176 AS bright FROM cl),
pc AS (SELECT img, count(*) FILTER (bright) / count(*) >= 0.15 AS paper, avg(r) FILTER (bright) AS pr, avg(g) FILTER (bright) AS pg, avg(b) FILTER (bright) AS pb FROM lu GROUP BY img),
bc AS (SELECT cl.img, r * CASE WHEN paper AND least(pr, pg, pb) > 0 THEN greatest(pr, pg, pb) / pr ELSE 1 END AS r, g * CASE WHEN paper AND least(pr, pg, pb) > 0 THEN greatest(pr, pg, pb) / pg ELSE 1 END AS g, b * CASE WHEN paper AND least(pr, pg, pb) > 0 THEN greatest(pr, pg, pb) / pb ELSE 1 END AS b FROM cl JOIN pc USING (img)),
sa AS (SELECT img, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END AS s FROM bc)"""


@query("paper_colour", f"WITH {RGB_SQL} SELECT img, CASE WHEN paper THEN round(pr, 6) END AS red, CASE WHEN paper THEN round(pg, 6) END AS green, CASE WHEN paper THEN round(pb, 6) END AS blue FROM pc")
def paper_colour(spark, sf_dir):
    def work(red, green, blue, width, height):
        paper = imaging.paper_colour(np.stack([imaging.plane(x, width, height) for x in (red, green, blue)], axis=-1).astype(float))
        yield (None,) * 3 if paper is None else tuple(round(float(x), 6) for x in paper)

    return one(spark, sf_dir, work, "red double, green double, blue double", ("red", "green", "blue", "width", "height"))


@query("saturation", f"WITH {RGB_SQL} SELECT img, round(avg(s), 6) AS saturation, round(avg(CASE WHEN s > 0.3 THEN 1.0 ELSE 0 END), 6) AS saturated FROM sa GROUP BY img")
def saturation(spark, sf_dir):
    return imaging.colour_signals(images(spark, sf_dir)).select("img", F.round("saturation", 6).alias("saturation"), F.round("saturated", 6).alias("saturated"))


@query("illumination", f"""WITH {PIXELS_SQL}, b AS (SELECT img, y * 3 // 8 AS r0, v, x, y, CASE WHEN y < 2 THEN 0 WHEN y < 5 THEN 1 ELSE 2 END AS r, CASE WHEN x < 2 THEN 0 WHEN x < 5 THEN 1 ELSE 2 END AS c FROM px), m AS (SELECT img, r, c, avg(CAST(v AS DOUBLE)) AS m FROM b WHERE v > 140 GROUP BY 1, 2, 3 HAVING count(*) > 1),
g AS (SELECT img, max(m) AS hi, min(m) AS lo, count(*) AS n FROM m GROUP BY img) SELECT e.vec_id AS img, coalesce(CASE WHEN n >= 6 THEN round((hi - lo) / hi, 6) END, 0) AS gradient, coalesce(n, 0) AS blocks FROM embeddings e LEFT JOIN g ON g.img = e.vec_id""")
def illumination(spark, sf_dir):
    def work(data, width, height):
        means = imaging.block_means(imaging.plane(data, width, height), 1, 1)
        yield round(imaging.gradient(means), 6), sum(m is not None for m in means)

    return one(spark, sf_dir, work, "gradient double, blocks long")


MARKS_SQL = OTSU_SQL + """, br AS (SELECT img, threshold, v, count(*) AS n FROM px JOIN t USING (img) WHERE v >= threshold GROUP BY 1, 2, 3), pv AS (SELECT img, threshold, arg_min(v, {'n': -n, 'v': v}) AS paper FROM br GROUP BY 1, 2),
sp AS (SELECT pv.img, pv.threshold, paper, sum(n * (v - paper)) / sum(n) AS spread FROM pv JOIN br ON br.img = pv.img AND v >= paper GROUP BY 1, 2, 3), lm AS (SELECT img, threshold, paper - greatest(3 * spread, 24) AS lim FROM sp),
ik AS (SELECT px.img, y, x, v < t.threshold AS ink, v >= t.threshold AND v < coalesce(lim, t.threshold) AS faint FROM px JOIN t USING (img) LEFT JOIN lm ON lm.img = px.img),
pl AS (SELECT a.img, a.y, a.x, a.ink, a.faint AND NOT EXISTS (SELECT 1 FROM ik b WHERE b.img = a.img AND b.ink AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1) AS pale FROM ik a)"""


@query("page_marks", f"WITH {MARKS_SQL} SELECT img, count(*) FILTER (ink) AS ink, count(*) FILTER (pale) AS pale FROM pl GROUP BY img")
def page_marks(spark, sf_dir):
    def work(data, width, height):
        g = imaging.plane(data, width, height)
        ink, pale, _, _ = imaging.page_marks(g, imaging.otsu(g), 150.0)
        yield int(ink.sum()), int(pale.sum())

    return one(spark, sf_dir, work, "ink long, pale long")


PARTS_SQL = OTSU_SQL + """, ic AS (SELECT px.img, y * 8 + x AS c, y, x FROM px JOIN t USING (img) WHERE v < threshold AND img % 4 = 0), rc(img, c, r) AS (SELECT img, c, c FROM ic UNION SELECT a.img, b.c, rc.r FROM rc JOIN ic a ON a.img = rc.img AND a.c = rc.c JOIN ic b ON b.img = a.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
lb AS (SELECT img, c, min(r) AS l FROM rc GROUP BY img, c), cp AS (SELECT lb.img, l, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS area FROM lb JOIN ic ON ic.img = lb.img AND ic.c = lb.c GROUP BY lb.img, l HAVING count(*) >= 3)"""


@query("mark_components", f"WITH RECURSIVE {PARTS_SQL} SELECT img, x, y, width, height, area FROM cp")
def mark_components(spark, sf_dir):
    return imaging.mark_components(images(spark, sf_dir).where("img % 4 = 0"))


@query("large_mark_tone", f"""WITH RECURSIVE {PARTS_SQL}, pt AS (SELECT cp.img, l, avg(CASE WHEN abs(v - threshold) < 45 THEN 1.0 ELSE 0 END) AS tone FROM cp JOIN px ON px.img = cp.img AND px.x BETWEEN cp.x AND cp.x + width - 1 AND px.y BETWEEN cp.y AND cp.y + height - 1 JOIN t ON t.img = cp.img WHERE width * height / 64 >= 0.02 AND area / (width * height) >= 0.25 GROUP BY cp.img, l)
SELECT e.vec_id AS img, round(coalesce(max(tone), 0), 6) AS tone FROM embeddings e LEFT JOIN pt ON pt.img = e.vec_id WHERE e.vec_id % 4 = 0 GROUP BY 1""")
def large_mark_tone(spark, sf_dir):
    return imaging.signals(images(spark, sf_dir).where("img % 4 = 0")).select("img", F.round("mark_tone", 6).alias("tone"))


@query("ink_outside_text", f"""WITH {OTSU_SQL}, rg AS (SELECT px.img, v < threshold AS ink, y BETWEEN 1 AND 4 AND x BETWEEN img % 3 AND 5 AS inside FROM px JOIN t USING (img)) SELECT img, round(coalesce(count(*) FILTER (ink AND NOT inside) / nullif(count(*) FILTER (ink), 0), 0), 6) AS share FROM rg GROUP BY img""")
def ink_outside_text(spark, sf_dir):
    def work(data, img, width, height):
        g = imaging.plane(data, width, height)
        # a box of a height of 0.3, so padded by 0.075 to all sides
        region = imaging.text_region([(img % 3 / 8 + 0.08, 0.21, 0.65 - img % 3 / 8 - 0.08 - 0.02, 0.3), (float("nan"), 0.0, 1.0, 1.0)], width, height)
        yield (round(imaging.ink_outside(g, region, imaging.otsu(g)), 6),)

    return imaging.per_image(images(spark, sf_dir).withColumn("id", F.col("img")), ["grey", "id", "width", "height"], work, "img long, share double")


@query("grown_marks", f"WITH {OTSU_SQL}, k AS (SELECT px.img, y, x, v < threshold AS ink FROM px JOIN t USING (img)) SELECT a.img, a.y, a.x, CAST(bool_or(b.ink) AS BIGINT) AS v FROM k a JOIN k b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3")
def grown_marks(spark, sf_dir):
    return imaging.pixels_of(images(spark, sf_dir), lambda g: imaging.grown(g < imaging.otsu(g), 1))


@query("filled_holes", f"""WITH {PIXELS_SQL}, h AS (SELECT *, v < 60 OR v > 240 AS hole FROM px), a AS (SELECT p.img, p.y, p.x, p.v, p.hole, CAST(sum(q.v) FILTER (NOT q.hole) // nullif(count(*) FILTER (NOT q.hole), 0) AS BIGINT) AS m FROM h p JOIN h q ON p.img = q.img AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT img, y, x, CASE WHEN hole AND m IS NOT NULL THEN m ELSE v END AS v, hole, hole AND m IS NULL AS live FROM a), g AS (SELECT img, CAST(sum(v) FILTER (NOT hole) // nullif(count(*) FILTER (NOT hole), 0) AS BIGINT) AS mean FROM b GROUP BY img)
SELECT img, y, x, CASE WHEN live THEN coalesce(mean, 255) ELSE v END AS v FROM b JOIN g USING (img)""")
def filled_holes(spark, sf_dir):
    return imaging.pixels_of(images(spark, sf_dir), lambda g: imaging.filled(g, (g < 60) | (g > 240), 1, 1))


@query("resemblance", f"""WITH {PIXELS_SQL}, d AS (SELECT img, y, x, (255 - v) / 255.0 AS a, (255 - (v * 5 + x * 9 + y) % 256) / 255.0 AS b FROM px), hp AS (SELECT p.img, p.y, p.x, p.a, p.b, p.a - avg(q.a) AS ah, p.b - avg(q.b) AS bh FROM d p JOIN d q ON p.img = q.img AND abs(p.y - q.y) <= 2 AND abs(p.x - q.x) <= 2 GROUP BY 1, 2, 3, 4, 5),
c AS (SELECT img, corr(a, b) AS raw, corr(ah, bh) AS high, avg(a) AS da, avg(b) AS db, var_pop(a) > 1e-6 AND var_pop(b) > 1e-6 AS ok FROM hp GROUP BY img) SELECT img, round(CASE WHEN NOT ok THEN NULL WHEN db >= 0.01 AND da > 2 * db THEN raw ELSE greatest(raw, high) END, 6) AS score FROM c""")
def resemblance(spark, sf_dir):
    def work(data, width, height):
        g = imaging.plane(data, width, height).astype(int)
        y, x = np.indices(g.shape)
        score = imaging.resemblance((255 - g) / 255.0, (255 - (g * 5 + x * 9 + y) % 256) / 255.0, np.ones(g.shape, bool))
        yield (None if score is None else round(score, 6),)

    return one(spark, sf_dir, work, "score double")


@query("page_fates", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'flat' WHEN (o_orderkey % 100) / 100.0 < 0.45 THEN 'lost' WHEN (o_custkey % 10) / 10.0 < 0.5 THEN 'faded' WHEN (o_orderkey % 100) / 100.0 < 0.75 THEN 'watch' ELSE 'kept' END AS fate FROM orders")
def page_fates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", imaging.page_fate(F.expr("if(o_orderkey % 9 = 0, null, (o_orderkey % 100) / 100D)"), F.expr("(o_custkey % 10) / 10D")).alias("fate"))


@query("thumbnail_sizes", "WITH s AS (SELECT o_orderkey AS k, (o_orderkey % 900)::DOUBLE AS w, (o_custkey * 40)::DOUBLE AS h FROM orders), f AS (SELECT *, least(40.0::DOUBLE / 72.0::DOUBLE, 4000 / greatest(w, h)) AS f FROM s WHERE w > 0 AND h > 0) SELECT k AS o_orderkey, CAST(greatest(1, least(4000, floor(w * f))) AS BIGINT) AS width, CAST(greatest(1, least(4000, floor(h * f))) AS BIGINT) AS height FROM f")
def thumbnail_sizes(spark, sf_dir):
    out = table(spark, sf_dir, "orders").select("o_orderkey", imaging.thumbnail_size(F.expr("cast(o_orderkey % 900 as double)"), F.expr("cast(o_custkey * 40 as double)")).alias("s"))
    return out.where("s is not null").select("o_orderkey", "s.*")
