"""Recognised lines of a page: cleaning, joining, geometry and reading order.

Boxes are shares of the page with the origin at the top left. A line's baseline, counted from the page's
bottom, is (1 - y - height + 0.22 * height) times the page's height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Geometry of the text layer.
BASELINE_SHARE, SAME_LINE, LEAST_GAP, ROOM_SHARE, LEAST_OVERLAP = 0.22, 0.4, 0.5, 1.5, 1.0
HYPHENS = "-‐‑­"

PAGE = ["doc", "page"]


def usable(lines: DataFrame, least_confidence: float = 0.0) -> DataFrame:
    """Lines with text and, if a bar is set, with that confidence."""
    out = lines.where(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) > 0)
    return out.where(F.col("confidence") >= least_confidence) if least_confidence > 0 else out


def without_doubles(lines: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """Of lines with one text whose boxes nearly coincide, the first; compared with kept lines only, in order.

    Only lines of one text on one page can be doubles, so the ordered fold runs over those.
    """
    rest = [c for c in lines.columns if c not in (*PAGE, "text")]
    order = ["pos", *(c for c in rest if c != "pos")]
    groups = lines.groupBy(*PAGE, "text").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("boxes"))

    def keep(kept: Column, b: Column) -> Column:
        h = F.greatest(b["height"] * page_height, F.lit(1.0))
        double = F.exists(kept, lambda k: (F.abs(k["x"] - b["x"]) * page_width < h) & (F.abs(k["y"] - b["y"]) * page_height < 0.3 * h))
        return F.when(double, kept).otherwise(F.concat(kept, F.array(b)))

    none = F.slice(F.col("boxes"), 1, 0)
    kept = groups.select(*PAGE, "text", F.explode(F.aggregate("boxes", none, keep)).alias("b"))
    return kept.select(*[c if c in (*PAGE, "text") else F.col(f"b.{c}").alias(c) for c in lines.columns])


def shared_width(ax: Column, aw: Column, bx: Column, bw: Column) -> Column:
    """Overlap in x over the narrower width; negative if apart, 0 without width."""
    narrow = F.least(aw, bw)
    return F.when(narrow <= 0, 0.0).otherwise((F.least(ax + aw, bx + bw) - F.greatest(ax, bx)) / narrow)


def baseline(y: Column, height: Column, page_height: Column | float) -> Column:
    return (1 - y - height + BASELINE_SHARE * height) * page_height


def headroom(lines: DataFrame, page_height: float = 792.0, page_width: float = 612.0) -> DataFrame:
    """Room of each line: the least distance to a baseline among lines that overlap it, over 1.5; null if none."""
    base = lines.select(*PAGE, "pos", "height", "x", "width", baseline(F.col("y"), F.col("height"), page_height).alias("base"))
    a, b = base.alias("a"), base.alias("b")
    overlap = (F.least(F.col("a.x") + F.col("a.width"), F.col("b.x") + F.col("b.width")) - F.greatest("a.x", "b.x")) * page_width
    gap = F.abs(F.col("b.base") - F.col("a.base"))
    same = gap < SAME_LINE * F.least("a.height", "b.height") * page_height
    hit = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.pos") != F.col("b.pos"))
    room = a.join(b, hit & (overlap > LEAST_OVERLAP) & (gap > LEAST_GAP) & ~same, "left")
    return room.groupBy(F.col("a.doc").alias("doc"), F.col("a.page").alias("page"), F.col("a.pos").alias("pos")).agg((F.min(gap) / ROOM_SHARE).alias("room"))


def right_limit(lines: DataFrame, page_height: float = 792.0) -> DataFrame:
    """Left edge of the nearest line to the right on the same visual line; null if none."""
    base = lines.select(*PAGE, "pos", "height", "x", "width", baseline(F.col("y"), F.col("height"), page_height).alias("base"))
    a, b = base.alias("a"), base.alias("b")
    same = F.abs(F.col("a.base") - F.col("b.base")) < SAME_LINE * F.greatest("a.height", "b.height") * page_height
    hit = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.page") == F.col("b.page")) & (F.col("b.x") > F.col("a.x"))
    side = shared_width(F.col("a.x"), F.col("a.width"), F.col("b.x"), F.col("b.width")) <= 0.5
    found = a.join(b, hit & same & side, "left")
    return found.groupBy(F.col("a.doc").alias("doc"), F.col("a.page").alias("page"), F.col("a.pos").alias("pos")).agg(F.min("b.x").alias("limit"))


def order_faults(lines: DataFrame, column_at: float = 0.35) -> DataFrame:
    """Switches between columns and steps upwards, line after line, of each page."""
    w = Window.partitionBy(*PAGE).orderBy("pos")
    out = lines.withColumn("band", (F.col("x") >= column_at).cast("int"))
    switch = (F.col("band") != F.lag("band").over(w)).cast("long")
    up = ((F.col("band") == F.lag("band").over(w)) & (F.col("y") < F.lag("y").over(w) - 0.005)).cast("long")
    out = out.select(*PAGE, F.coalesce(switch, F.lit(0)).alias("s"), F.coalesce(up, F.lit(0)).alias("u"))
    return out.groupBy(*PAGE).agg(F.count("*").alias("lines"), F.sum("s").alias("switches"), F.sum("u").alias("inversions"))


def extract_text(lines: DataFrame) -> DataFrame:
    """Text of each page, lines in order; and the document's, pages headed where there are several."""
    page = lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    doc = page.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    n = F.size("p")
    headed = F.transform("p", lambda x: F.concat(F.lit("==> "), F.col("doc").cast("string"), F.lit(" (page "), x["page"].cast("string"), F.lit("/"), n.cast("string"), F.lit(") <==\n"), x["text"]))
    return doc.select("doc", n.cast("long").alias("pages"), F.when(n > 1, F.array_join(headed, "\n\n")).otherwise(F.get("p", F.lit(0))["text"]).alias("text"))
