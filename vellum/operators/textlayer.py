"""The text layer: lines prepared, placed as runs, grouped to visual lines and judged against extracted text.

Boxes are shares of the page with the origin at the top left; runs are in points from the bottom left.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .layout import HYPHENS, LEAST_GAP, LEAST_OVERLAP, PAGE, ROOM_SHARE, SAME_LINE, baseline, shared_width, usable, without_doubles

# Geometry of joins and runs.
NEXT_SHARED_WIDTH, NEXT_DROP, PAGE_EDGE, CONTINUATIONS = 0.6, 2.5, 0.25, 3
RESERVE_EMS, HEIGHT_SHARE, LEAST_VERTICAL, MOST_VERTICAL, LEAST_SIZE, MOST_SIZE, LEAST_BOX = 0.25, 0.86, 0.25, 3.0, 0.5, 400.0, 0.5
# Column bands.
BINS, LEAST_GUTTER_BINS, LEAST_BAND_WIDTH, LEAST_BAND_LINES, LEAST_LINES, INVERSION = 200, 7, 0.01, 4, 8, 0.005
# Advance widths of Helvetica, a thousandth of an em, characters 32 to 126.
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556,
    556, 556, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556,
    556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
OTHER_ADVANCE = 556


def page_tops(lines: DataFrame) -> DataFrame:
    """The topmost usable lines of each page, under the number of the page before it."""
    first = Window.partitionBy(*PAGE).orderBy("y", "pos")
    tops = usable(lines).withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= CONTINUATIONS)
    tops = tops.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("_rank", "y", "text"))).alias("_tops"))
    return tops.withColumn("page", F.col("page") - 1)


def join_hyphenated(lines: DataFrame, all_lines: DataFrame | None = None, page_height: float = 792.0) -> DataFrame:
    """``joined``: the text of a line that ends in a hyphenated letter takes the leading letters of its continuation.

    That is the next line, if it stands close below in the same column, else, for a line at the page's foot, the first
    fitting one of the next page's topmost lines. The continuation itself is not shortened.
    """
    tail = lambda t: F.regexp_extract(t, r"^(\p{Ll}\p{L}*)", 1)
    out = lines.withColumn("_next", F.lead(F.struct("x", "y", "width", "height", "text")).over(Window.partitionBy(*PAGE).orderBy("pos")))
    if all_lines is not None:
        out = out.join(page_tops(all_lines), PAGE, "left")
    else:
        out = out.withColumn("_tops", F.lit(None).cast("array<struct<_rank:int,y:double,text:string>>"))
    head = F.regexp_extract("text", rf"(?s)^(.*\p{{L}})[{HYPHENS}]$", 1)
    drop = baseline(F.col("y"), F.col("height"), page_height) - baseline(F.col("_next.y"), F.col("_next.height"), page_height)
    below = (drop > 0) & (F.abs(drop) >= SAME_LINE * F.least("height", "_next.height") * page_height)
    below = below & (drop < NEXT_DROP * F.greatest(F.col("height") * page_height, F.lit(1.0)))
    column = shared_width(F.col("x"), F.col("width"), F.col("_next.x"), F.col("_next.width")) >= NEXT_SHARED_WIDTH
    here = F.coalesce(below & column & (tail(F.col("_next.text")) != ""), F.lit(False))
    over = F.filter("_tops", lambda t: (t["y"] <= PAGE_EDGE) & (tail(t["text"]) != ""))
    at_foot = F.col("y") + F.col("height") >= 1 - PAGE_EDGE
    joined = F.when(head == "", F.col("text")).when(here, F.concat(head, tail(F.col("_next.text")))).when(at_foot & (F.size(over) > 0), F.concat(head, tail(F.get(over, F.lit(0))["text"]))).otherwise(F.col("text"))
    return out.withColumn("joined", joined).drop("_next", "_tops")


def prepared(lines: DataFrame, join: bool = True) -> DataFrame:
    """Usable lines without doubles, hyphenated words joined; pages are numbered without gaps."""
    out = without_doubles(usable(lines))
    return join_hyphenated(out, lines).withColumn("text", F.col("joined")).drop("joined") if join else out


def advance(text: Column) -> Column:
    """Natural width of a text in ems."""
    widths = F.array(*(F.lit(w) for w in HELVETICA))
    total = F.aggregate(F.split(text, ""), F.lit(0), lambda n, c: n + F.coalesce(F.get(widths, F.ascii(c) - 32), F.lit(OTHER_ADVANCE)))
    return F.when(F.length(text) > 0, total).otherwise(0) / 1000.0


def neighbours(lines: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """lines with their headroom() and right_limit(), of which each page's are found in one list of its lines.

    Lines of one place on a page share the least of both.
    """
    line = F.struct(*(F.col(c) for c in lines.columns), baseline(F.col("y"), F.col("height"), page_height).alias("_base"))
    found = lines.groupBy(*PAGE).agg(F.collect_list(line).alias("_l"))

    def near(a: Column) -> Column:
        def nearer(best: Column, b: Column) -> Column:
            gap = F.abs(b["_base"] - a["_base"])
            over = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
            known = F.col("doc").isNotNull() & F.col("page").isNotNull() & a["pos"].isNotNull()
            above = known & (gap > LEAST_GAP) & (over * page_width > LEAST_OVERLAP) & (a["pos"] != b["pos"]) & ~(gap < SAME_LINE * F.least(a["height"], b["height"]) * page_height)
            right = known & (b["x"] > a["x"]) & (gap < SAME_LINE * F.greatest(a["height"], b["height"]) * page_height) & (shared_width(a["x"], a["width"], b["x"], b["width"]) <= 0.5)
            return F.struct(F.when(above, F.least(best["gap"], gap)).otherwise(best["gap"]).alias("gap"), F.when(right, F.least(best["limit"], b["x"])).otherwise(best["limit"]).alias("limit"))

        none = F.struct(F.lit(None).cast("double").alias("gap"), F.lit(None).cast("double").alias("limit"))
        return F.struct(a.alias("l"), F.aggregate("_l", none, nearer).alias("n"))

    def shared(e: Column) -> Column:
        same = F.filter("_e", lambda o: o["l"]["pos"] == e["l"]["pos"])
        return F.struct(e["l"].alias("l"), F.struct(F.array_min(same["n"]["gap"]).alias("gap"), F.array_min(same["n"]["limit"]).alias("limit")).alias("n"))

    found = found.withColumn("_e", F.transform("_l", near)).drop("_l")
    once = F.size(F.array_distinct("_e.l.pos")) == F.size("_e")
    found = found.select(F.explode(F.when(once, F.col("_e")).otherwise(F.transform("_e", shared))).alias("_e"))
    return found.select(*(F.col(f"_e.l.{c}").alias(c) for c in lines.columns), (F.col("_e.n.gap") / ROOM_SHARE).alias("room"), F.col("_e.n.limit").alias("limit"))


def placement(lines: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """Each line's run: size, vertical squash, place, shares of the wanted width and height, or why it is ``refused``.

    The width of a line follows its box, but stops short of the next fragment on its visual line; the height
    follows the ink and the room to the neighbouring lines, and wins where both cannot be had.
    """
    keys = [*PAGE, "pos"]
    # measured below the page's list, where no filter on what follows from it can repeat it
    out = neighbours(lines.withColumn("_ems", advance(F.col("text"))), page_width, page_height)
    out = out.withColumns({"box_width": F.col("width") * page_width, "box_height": F.col("height") * page_height, "left": F.col("x") * page_width})
    out = out.withColumns({"bottom": page_height - F.col("y") * page_height - F.col("box_height"), "reference": F.greatest(F.col("box_height"), F.lit(1.0)), "_limit": F.col("limit") * page_width})
    out = out.withColumn("advance", F.col("_ems") * F.col("reference"))
    out = out.withColumn("refused", F.when(F.col("text") == "", "empty text").when(~((F.col("box_width") > LEAST_BOX) & (F.col("box_height") > LEAST_BOX)), "box too small").when(F.col("advance") <= 0, "no width"))
    allowed = F.try_divide(F.col("_limit") - F.col("left"), 1 + RESERVE_EMS * F.try_divide("reference", "advance"))
    out = out.withColumn("limited", F.coalesce((allowed > 0) & (allowed < F.col("box_width")), F.lit(False)))
    sized = F.col("reference") * F.try_divide(F.when(F.col("limited"), allowed).otherwise(F.col("box_width")), F.col("advance"))
    out = out.withColumn("_size", F.least(F.greatest(sized, F.lit(LEAST_SIZE)), F.lit(MOST_SIZE)))
    out = out.withColumn("ideal_height", F.col("box_height") * HEIGHT_SHARE).withColumn("_wanted", F.least("ideal_height", "room"))
    out = out.withColumn("size", F.when(F.col("_wanted") / F.col("_size") < LEAST_VERTICAL, F.col("_wanted") / LEAST_VERTICAL).otherwise(F.col("_size")))
    out = out.withColumn("vertical", F.least(F.greatest(F.try_divide("_wanted", "size"), F.lit(LEAST_VERTICAL)), F.lit(MOST_VERTICAL)))
    placed = F.col("refused").isNull()
    shares = {
        "width_share": F.try_divide(F.col("advance") * F.col("size"), F.col("reference") * F.col("box_width")),
        "height_share": F.try_divide(F.col("size") * F.col("vertical"), F.col("ideal_height")),
        "room_share": F.when(F.col("limited"), F.try_divide(F.col("_limit") - F.col("left"), F.col("box_width"))),
    }
    out = out.withColumns(shares)
    values = ["size", "vertical", "left", "bottom", "box_width", "box_height", "advance", "limited", "width_share", "height_share", "room_share"]
    return out.select(*keys, "text", "refused", *(F.when(placed, F.col(v)).alias(v) for v in values))


def run_census(runs: DataFrame) -> DataFrame:
    """Counts of a document's runs: placed, refused, limited by a neighbour, slivers, crushed both ways, and the least shares."""
    placed = F.col("refused").isNull()
    share, height = F.col("width_share"), F.col("height_share")
    return runs.groupBy("doc").agg(
        F.countDistinct("page").alias("pages"), F.count_if(placed).alias("fragments"), F.count_if(~placed).alias("refused"), F.count_if(F.col("limited")).alias("limited"),
        F.count_if(share < 0.15).alias("sliver15"), F.count_if(share < 0.5).alias("sliver50"), F.count_if((share < 0.5) & (height < 0.5)).alias("crushed"),
        F.min("width_share").alias("least_share"), F.min("height_share").alias("least_height"),
    )


def worst_runs(runs: DataFrame, n: int) -> DataFrame:
    """The narrowest runs, by the share of their box that they span."""
    return runs.where("refused is null").orderBy("width_share", *PAGE, "pos").limit(n)


def map_point(x: Column, y: Column, matrix: Column, width: Column, height: Column) -> Column:
    """A point under an affine matrix (a, b, c, d, tx, ty), held inside the page."""
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    m = [F.get(matrix, i) for i in range(6)]
    return F.struct(inside(m[0] * x + m[2] * y + m[4], width).alias("x"), inside(m[1] * x + m[3] * y + m[5], height).alias("y"))


def map_axis(value: Column, vertical: Column, matrix: Column, width: Column, height: Column) -> Column:
    """Where a single coordinate lands: on the axis that it drives more, the other staying null."""
    point = map_point(F.when(vertical, 0.0).otherwise(value), F.when(vertical, value).otherwise(0.0), matrix, width, height)
    towards_x, towards_y = (F.abs(F.when(vertical, F.get(matrix, i)).otherwise(F.get(matrix, j))) for i, j in ((2, 0), (3, 1)))
    return F.struct(F.when(towards_y < towards_x, point["x"]).alias("left"), F.when(towards_y >= towards_x, point["y"]).alias("top"))


def crop_region(media: Column, crop: Column, matrix: Column) -> Column:
    """The crop box (x, y, width, height) on the published page, cut to it; the whole page if there is none to speak of."""
    sheet = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), media["width"].alias("width"), media["height"].alias("height"))
    m = [F.get(matrix, i) for i in range(6)]
    corner = lambda x, y: (m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5])
    (x0, y0), (x1, y1) = corner(crop["x"], crop["y"]), corner(crop["x"] + crop["width"], crop["y"] + crop["height"])
    left, right = F.greatest(F.least(x0, x1), F.lit(0.0)), F.least(F.greatest(x0, x1), media["width"])
    low, high = F.greatest(F.least(y0, y1), F.lit(0.0)), F.least(F.greatest(y0, y1), media["height"])
    cut = F.struct(left.alias("x"), low.alias("y"), (right - left).alias("width"), (high - low).alias("height"))
    bare = crop.eqNullSafe(media) | (crop["width"] <= 0) | (crop["height"] <= 0) | (right <= left) | (high <= low)
    return F.when(bare, sheet).otherwise(cut)


_MEMBER = "struct<x:double,pos:bigint,right:double,base:double,text:string>"


def visual_lines(lines: DataFrame, page_height: float = 792.0, taller: bool = False) -> DataFrame:
    """(doc, page, line, baseline, left, right, text, fragments): lines from the top down, each joined to the nearest open group
    whose first member stands on the same baseline, members then in order of x."""
    base, high = baseline(F.col("y"), F.col("height"), page_height), F.col("height") * page_height
    member = F.struct(F.col("x"), F.col("pos").cast("bigint").alias("pos"), (F.col("x") + F.col("width")).alias("right"), base.alias("base"), F.col("text"))
    boxes = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct((-base).alias("key"), F.col("pos"), high.alias("high"), member.alias("m")))).alias("boxes"))

    def put(groups: Column, b: Column) -> Column:
        near = lambda g: F.abs(g["base"] - b["m"]["base"])
        scale = F.greatest if taller else F.least
        fits = F.filter(F.transform(groups, lambda g, i: F.struct(near(g).alias("d"), i.alias("i"), (near(g) < SAME_LINE * scale(g["high"], b["high"])).alias("ok"))), lambda c: c["ok"])
        new = F.struct(b["m"]["base"].alias("base"), b["high"].alias("high"), F.array(b["m"]).alias("members"))
        more = lambda best: F.transform(groups, lambda g, i: F.when(i == best, F.struct(g["base"].alias("base"), g["high"].alias("high"), F.concat(g["members"], F.array(b["m"])).alias("members"))).otherwise(g))
        # a variable of a lambda, as the nearest group would else be looked for again at each group
        return F.get(F.transform(F.array(F.array_min(fits)["i"]), lambda best: F.when(best.isNull(), F.concat(groups, F.array(new))).otherwise(more(best))), F.lit(0))

    none = F.array().cast(f"array<struct<base:double,high:double,members:array<{_MEMBER}>>>")
    out = boxes.select(*PAGE, F.posexplode(F.aggregate("boxes", none, put)).alias("line", "g")).withColumn("m", F.array_sort("g.members"))
    return out.select(*PAGE, F.col("line").cast("long").alias("line"), F.get("m", F.lit(0))["base"].alias("baseline"), F.array_min("m.x").alias("left"), F.array_max("m.right").alias("right"), F.array_join("m.text", " ").alias("text"), F.col("m.text").alias("fragments"))


def occurrences(text: Column, part: Column) -> Column:
    """How often a part stands in a text, counted without overlap."""
    return F.when(F.length(part) > 0, F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part))).otherwise(0).cast("long")


def anchor(text: Column, page: Column) -> Column:
    """The longest of a line's words of four letters or more, of eight tried, that stands once in the page's text; null if none."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4)
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    # the page is searched for no word behind the first that fits
    return F.aggregate(F.slice(ranked, 1, 8), F.lit(None).cast("string"), lambda best, c: F.when(best.isNotNull(), best).when(occurrences(page, c["w"]) == 1, c["w"]))


def welds(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Of neighbouring fragments of visual lines (doc, page, fragments): pairs, and those that the page's text runs together."""
    at = F.sequence(F.lit(0), F.size("fragments") - 2)
    pairs = lines.where(F.size("fragments") > 1).select(*PAGE, "fragments", F.explode(at).alias("i"))
    left, right = F.trim(F.get("fragments", F.col("i"))), F.trim(F.get("fragments", F.col("i") + 1))
    pairs = pairs.select(*PAGE, left.alias("a"), right.alias("b")).where((F.length("a") >= 3) & (F.length("b") >= 3)).join(pages.select(*PAGE, F.col("text").alias("whole")), PAGE)
    return pairs.groupBy("doc").agg(F.count("*").alias("pairs"), F.count_if(F.col("whole").contains(F.concat(F.right("a", F.lit(6)), F.left("b", F.lit(6))))).alias("welded"))


def separation(lines: DataFrame, extracted: DataFrame) -> DataFrame:
    """Per document: pairs of visual lines, one below the other in a column, that extraction puts on one line.

    lines are those of visual_lines(); extracted (doc, page, at, text) the lines of the page as extracted. A visual line's
    home is the one extracted line that holds its anchor.
    """
    page = extracted.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("_e")).withColumn("_page", F.array_join("_e.text", "\n"))
    out = lines.join(page, PAGE).withColumn("_anchor", anchor(F.col("text"), F.col("_page")))
    homes = F.filter("_e", lambda e: e["text"].contains(F.col("_anchor")))
    out = out.withColumn("home", F.when(F.col("_anchor").isNotNull() & (F.size(homes) == 1), F.get(homes, F.lit(0))["at"]))
    down = Window.partitionBy(*PAGE).orderBy(F.desc("baseline"), "line")
    longest = F.max(F.length("text")).over(Window.partitionBy(*PAGE))
    out = out.withColumns({"_b": F.lead(F.struct("left", "right", "home")).over(down), "_longest": longest, "_first": F.row_number().over(down) == 1})
    # least() and greatest() pass over nulls: the lowest line has none below it
    column = F.col("_b").isNotNull() & (F.least("right", "_b.right") - F.greatest("left", "_b.left") > 0.02)
    known = F.col("home").isNotNull() & F.col("_b.home").isNotNull()
    chars = lambda keep: F.aggregate(F.filter("_e.text", keep), F.lit(0), lambda n, t: n + F.length(t))
    once = lambda c: F.sum(F.when(F.col("_first"), c).otherwise(0)).cast("long")
    return out.groupBy("doc").agg(
        F.count("*").alias("visual_lines"), F.count_if(column & known).alias("judged"), F.count_if(column & ~known).alias("skipped"), F.count_if(column & known & (F.col("home") == F.col("_b.home"))).alias("merged"),
        once(chars(lambda t: F.length(t) > F.col("_longest"))).alias("runaway_chars"), once(chars(lambda t: F.lit(True))).alias("total_chars"), F.max("_longest").cast("long").alias("longest_visual"),
    )


def tight_pairs(lines: DataFrame) -> DataFrame:
    """Of each page: neighbours from the top down that overlap in x, and those less than 0.6 of a height apart."""
    down = Window.partitionBy(*PAGE).orderBy("y", "pos")
    out = lines.withColumn("_b", F.lead(F.struct("x", "y", "width")).over(down))
    over = F.col("_b").isNotNull() & (F.least(F.col("x") + F.col("width"), F.col("_b.x") + F.col("_b.width")) - F.greatest("x", "_b.x") > 0.02)
    return out.groupBy(*PAGE).agg(F.count_if(over).alias("pairs"), F.count_if(over & (F.col("_b.y") - F.col("y") < 0.6 * F.col("height"))).alias("tight"))


def bands(lines: DataFrame, least_width: float = LEAST_BAND_WIDTH) -> DataFrame:
    """(doc, page, band, low, high): columns of a page, apart by gutters of LEAST_GUTTER_BINS bins; the last one ends at the edge."""
    bin_ = lambda c: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(c * BINS)))
    spans = lines.where(F.col("width") >= least_width).select(*PAGE, bin_(F.col("x")).alias("a"), bin_(F.col("x") + F.col("width")).alias("b"))
    order = Window.partitionBy(*PAGE).orderBy("a", "b")
    spans = spans.withColumn("_reach", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("_new", F.when(F.col("a") - F.col("_reach") - 1 >= LEAST_GUTTER_BINS, 1).otherwise(0))
    spans = spans.withColumn("band", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = spans.groupBy(*PAGE, "band").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    last = F.max("band").over(Window.partitionBy(*PAGE))
    return out.select(*PAGE, "band", (F.col("a") / BINS).alias("low"), F.when(F.col("band") == last, 1.0).otherwise((F.col("b") + 1) / BINS).alias("high"))


def banded(lines: DataFrame, columns: DataFrame) -> DataFrame:
    """lines with the first band that their centre falls in, null if none."""
    lists = columns.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("band", "low", "high"))).alias("_bands"))
    centre = F.col("x") + F.col("width") / 2
    hit = F.filter("_bands", lambda b: (centre >= b["low"]) & (centre <= b["high"]))
    return lines.join(lists, PAGE, "left").withColumn("band", F.get(hit, F.lit(0))["band"]).drop("_bands")


def interleaving(lines: DataFrame) -> DataFrame:
    """Of each page of several populated bands: switches between them over the least number, and steps upwards within one."""
    many = lines.join(lines.groupBy(*PAGE).count().where(F.col("count") >= LEAST_LINES), PAGE, "left_semi")
    out = banded(many, bands(many)).where("band is not null")
    held = out.groupBy(*PAGE, "band").count().where(F.col("count") >= LEAST_BAND_LINES).drop("count")
    several = held.groupBy(*PAGE).agg(F.count("*").alias("columns")).where("columns >= 2")
    order = Window.partitionBy(*PAGE).orderBy("pos")
    out = out.join(held, [*PAGE, "band"], "left_semi").join(several, PAGE)
    out = out.withColumns({"_band": F.lag("band").over(order), "_y": F.lag("y").over(order)})
    out = out.groupBy(*PAGE, "columns").agg(F.count_if(F.col("band") != F.col("_band")).alias("switches"), F.count_if((F.col("band") == F.col("_band")) & (F.col("y") < F.col("_y") - INVERSION)).alias("inversions"))
    return out.withColumn("ratio", F.col("switches") / F.greatest(F.col("columns") - 1, F.lit(1)))


def retention(truth: DataFrame, got: DataFrame) -> DataFrame:
    """(doc, matched, total): words of the truth that come back, each as often as both have it; both are (doc, text).

    Whole texts meet and are counted there, as their words one by one would be many times their size.
    """
    texts = truth.select("doc", F.lit(True).alias("true"), F.lower("text").alias("text")).union(got.select("doc", F.lit(False), F.lower("text")))
    texts = texts.where("text is not null").repartition("doc").sortWithinPartitions("doc")

    def count(batches):
        import pyarrow as pa

        def row():
            return (now, (words[True] & words[False]).total() if now is not None else 0, words[True].total())

        now, words, kind = None, None, None
        for batch in batches:
            out, kind = [], batch.schema.field("doc").type
            for doc, true, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "true", "text"))):
                if words is None or doc != now:
                    if words:
                        out.append(row())
                    now, words = doc, {True: Counter(), False: Counter()}
                words[true].update(text.encode("utf-8", "surrogatepass").split())  # bytes part at ASCII white space, as \s does
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (kind, pa.int64(), pa.int64()))], ["doc", "matched", "total"])
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(), (kind, pa.int64(), pa.int64()))], ["doc", "matched", "total"])

    schema = T.StructType([texts.schema["doc"], T.StructField("matched", T.LongType()), T.StructField("total", T.LongType())])
    return texts.mapInArrow(count, schema).where("total > 0")


def gutters(columns: DataFrame, width: int, share: float = 0.035, margin: float = 0.12) -> DataFrame:
    """(doc, page, low, high): runs of quiet pixel columns (doc, page, x, ink) wide enough, and off the margins, to part text.

    Quiet is a hundredth of the greatest ink. A run that no inky column ends is none.
    """
    page = Window.partitionBy(*PAGE).orderBy("x")  # one order for both, as the columns are many
    out = columns.withColumn("_peak", F.max("ink").over(page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("_peak > 0")
    loud = out.where(F.col("ink") > F.greatest(F.lit(1), F.floor(F.col("_peak") / 100)))
    out = loud.select(*PAGE, F.col("x").alias("high"), (F.coalesce(F.lag("x").over(page), F.lit(-1)) + 1).alias("low"))
    return out.where((F.col("high") - F.col("low") >= int(share * width)) & (F.col("low") < F.col("high")) & (F.col("low") > int(margin * width)) & (F.col("high") < width - int(margin * width))).select(*PAGE, "low", "high")


def crossings(lines: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """Lines that begin left of a gutter and end right of it."""
    lists = found.groupBy(*PAGE).agg(F.collect_list(F.struct("low", "high")).alias("_g"))
    left, right = F.col("x") * width, (F.col("x") + F.col("width")) * width
    return lines.join(lists, PAGE).where(F.exists("_g", lambda g: (left < g["low"]) & (right > g["high"]))).drop("_g")
