"""Trees and references of documents: outlines, page trees, annotation geometry and copies."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..intermediate import saved

MOST_DEPTH = 64


def _levels(level: DataFrame, step: Callable[[DataFrame], DataFrame], depth: int | None = None) -> DataFrame:
    """The rows of a first level and of those that ``step`` makes of the one before, until one is empty or ``depth`` is reached.

    Each level is written once. The joins are to be merges, so that nothing but counts comes to the driver.
    """
    found = saved(level, "level")
    last, n = found, 1
    while depth is None or n < depth:
        last, n = saved(step(last), "level"), n + 1
        if last.isEmpty():
            break
        found = found.union(last)
    return found


def outline(nodes: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """Outline nodes (doc, id, parent, at, title, page) in preorder, down to a depth.

    A node without a page and without children is left out. Gives number (from 1), level, parent's number, the next
    and previous sibling's and the first and last child's numbers, and how many nodes stand below.
    """
    kids = nodes.where("parent is not null").select("doc", F.col("parent").alias("id")).distinct()
    kept = nodes.join(kids, ["doc", "id"], "left_semi").unionByName(nodes.where("page is not null").join(kids, ["doc", "id"], "left_anti"))
    kept = saved(kept, "nodes")
    columns = ["doc", "id", "parent", "title", "page"]
    under = kept.select(*columns, F.struct("at", "id").alias("_here"))

    def below(level):
        above = level.select("doc", F.col("id").alias("parent"), "level", "path").hint("merge")
        return under.join(above, ["doc", "parent"]).select(*columns, (F.col("level") + 1).alias("level"), F.array_append("path", F.col("_here")).alias("path"))

    top = under.where("parent is null").select(*columns, F.lit(1).alias("level"), F.array("_here").alias("path"))
    paths = _levels(top, below, depth)
    out = paths.withColumn("number", F.row_number().over(Window.partitionBy("doc").orderBy("path")))
    above = out.select("doc", F.explode(F.slice("path.id", 1, F.size("path") - 1)).alias("id")).groupBy("doc", "id").agg(F.count("*").alias("below"))
    out = out.join(above, ["doc", "id"], "left").na.fill(0, ["below"])
    peers = Window.partitionBy("doc", "parent").orderBy("number")
    out = out.withColumns({"next": F.lead("number").over(peers), "previous": F.lag("number").over(peers)})
    ends = out.where("parent is not null").groupBy("doc", F.col("parent").alias("id")).agg(F.min("number").alias("first"), F.max("number").alias("last"))
    over = out.select("doc", F.col("id").alias("parent"), F.col("number").alias("parent_number"))
    return out.join(ends, ["doc", "id"], "left").join(over, ["doc", "parent"], "left").select("doc", "id", "number", "level", "title", "page", "parent_number", "next", "previous", "first", "last", "below")


def mapped_outline(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes whose page (doc, page, new_page) is taken to the output's; a page that it lacks becomes null."""
    return nodes.join(pages, ["doc", "page"], "left").drop("page").withColumnRenamed("new_page", "page")


def page_tree(nodes: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """Leaves of a page tree (id, parent, at, rotate, box, leaf) in order, rotation and box inherited from above, rotation modulo 360."""
    nodes = saved(nodes, "nodes")

    def below(level):
        above = level.selectExpr("id as parent", "rotate as _rotate", "box as _box", "path").hint("merge")
        return nodes.join(above, "parent").select("id", "leaf", F.coalesce("rotate", "_rotate").alias("rotate"), F.coalesce("box", "_box").alias("box"), F.array_append("path", F.struct("at", "id")).alias("path"))

    top = nodes.where("parent is null").select("id", "leaf", "rotate", "box", F.array(F.struct("at", "id")).alias("path"))
    paths = _levels(top, below, depth).where("leaf")
    return paths.select("id", F.pmod(F.coalesce("rotate", F.lit(0)), F.lit(360)).alias("rotate"), "box", (F.size("path") - 1).alias("depth"), "path")


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): what each root refers to, directly or not, each node once.

    Level by level, without the nodes that a root has already, so that paths are not told apart.
    """
    edges = saved(edges.where("to_node is not null").select(F.col("from_node").alias("node"), "to_node").distinct(), "edges")
    found = []

    def beyond(level):
        found.append(level)
        known = reduce(DataFrame.union, found).hint("merge")
        return level.join(edges.hint("merge"), "node").select("root", F.col("to_node").alias("node")).distinct().join(known, ["root", "node"], "left_anti")

    return _levels(roots.select(F.col("node").alias("root"), "node").distinct(), beyond)


def copied_ids(edges: DataFrame, roots: DataFrame, pages: DataFrame, first: int) -> DataFrame:
    """(root, node, new_id): objects that copying each root takes along, pages and what only they lead to left out, numbered from ``first``."""
    page = pages.select(F.col("node").alias("to_node"))
    found = closure(edges.join(page, "to_node", "left_anti"), roots)
    return found.withColumn("new_id", F.row_number().over(Window.partitionBy("root").orderBy("node")) + F.lit(first - 1))


def reference(value: Column) -> Column:
    """The object number of ``N G R``; null for anything else."""
    return F.regexp_extract(value, r"^(\d+) \d+ R$", 1).try_cast("bigint")


def resolved(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """Values of rows (id, value) with those of the objects (object, content) that they refer to in their place."""
    rows = rows.withColumn("_ref", reference(F.col("value")))
    # what refers to nothing would meet in one partition
    plain = rows.where("_ref is null").select("id", "value")
    return plain.union(rows.where("_ref is not null").join(objects, F.col("_ref") == F.col("object"), "left").select("id", F.col("content").alias("value")))


def moved(numbers: Column, dx: Column, dy: Column) -> Column:
    """Coordinates moved: those at even places by dx, at odd ones by dy; null if one is no number."""
    out = F.transform(numbers, lambda v, i: v + F.when(i % 2 == 0, dx).otherwise(dy))
    return F.when(~F.exists(numbers, lambda v: v.isNull()), out)


def moved_strokes(strokes: Column, dx: Column, dy: Column) -> Column:
    """Lists of coordinates moved; null if one of them cannot be."""
    out = F.transform(strokes, lambda s: moved(s, dx, dy))
    return F.when(~F.exists(out, lambda s: s.isNull()), out)


def appended(references: Column, new: Column) -> Column:
    """A page's annotations with new ones behind them."""
    return F.concat(F.coalesce(references, F.array().cast("array<string>")), new)


def transplanted(marks: DataFrame, pages: DataFrame, subtypes: tuple[str, ...]) -> DataFrame:
    """Marks (doc, page, subtype, rect) with ``refused``, or else the rectangle moved by the origin of its page (doc, page, rotate, x, y)."""
    out = marks.join(pages, ["doc", "page"], "left")
    refused = F.when(F.col("rotate").isNull(), "no page").when(~F.col("subtype").isin(*subtypes), "subtype").when(F.pmod("rotate", F.lit(360)) != 0, "rotated").when(moved(F.col("rect"), F.lit(0.0), F.lit(0.0)).isNull(), "geometry")
    return out.withColumn("refused", refused).select(*marks.columns, "refused", F.when(F.col("refused").isNull(), moved(F.col("rect"), -F.col("x"), -F.col("y"))).alias("moved"))


def object_numbers(pages: DataFrame) -> DataFrame:
    """The first object number of each page (doc, page, images): two objects and one for each image a page, after two for the document."""
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("first_object", (3 + F.coalesce(F.sum(F.col("images") + 2).over(before), F.lit(0))).cast("long"))


def offsets(objects: DataFrame, start: int) -> DataFrame:
    """The byte where each object (doc, number, bytes) begins, the first at ``start``."""
    before = Window.partitionBy("doc").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return objects.withColumn("at_byte", (start + F.coalesce(F.sum("bytes").over(before), F.lit(0))).cast("long"))
