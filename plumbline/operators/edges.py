"""Edges: normalisation of raw plan segments, widths, walls, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import geometry as g

PAGE_WIDTH, PAGE_HEIGHT, MARGIN = 1191.0, 842.0, 5.0


def visible(raw: DataFrame, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT) -> DataFrame:
    """Strokes that draw something on the page: no glyph outlines, no bare fills, no filled hairlines, within the margin."""
    glyph = (F.col("object_type") == "curve_edge") & ~F.col("stroke")
    bare_fill = F.col("fill") & ~F.col("stroke")
    hairline = F.col("fill") & (F.coalesce("linewidth", F.lit(0.0)) < 0.01)
    outside = (F.greatest("x0", "x1") < -MARGIN) | (F.least("x0", "x1") > width + MARGIN) | (F.greatest("y0", "y1") < -MARGIN) | (F.least("y0", "y1") > height + MARGIN)
    return raw.where(~glyph & ~bare_fill & ~hairline & ~outside)


def with_ends(raw: DataFrame) -> DataFrame:
    """raw(..., pts, bx0, by0, bx1, by1) with x0, y0, x1, y1: the first and last of two points or more, else the corners of the box."""
    many = F.coalesce(F.size("pts"), F.lit(0)) >= 2
    end = lambda at, c, box: F.when(many, F.element_at("pts", at)[c]).otherwise(F.col(box))
    return raw.withColumns({"x0": end(1, "x", "bx0"), "y0": end(1, "y", "by0"), "x1": end(-1, "x", "bx1"), "y1": end(-1, "y", "by1")})


def normalise(raw: DataFrame) -> DataFrame:
    """Edges with length, folded angle, axis and structural flags; short diagonal hatch strokes are left out; ids are dense by page."""
    out = visible(raw).withColumn("lw", F.coalesce("linewidth", F.lit(0.0)))
    out = out.withColumn("length", g.seg_length("x0", "y0", "x1", "y1")).withColumn("angle", g.seg_angle("x0", "y0", "x1", "y1"))
    out = out.where(~g.is_hatch(F.col("angle"), F.col("length")))
    axis = g.is_axis(F.col("angle"))
    dense = F.row_number().over(Window.partitionBy("page_id").orderBy("raw_id")) - 1
    return out.select(
        "page_id", dense.cast("long").alias("edge_id"), "raw_id", "x0", "y0", "x1", "y1", "lw", "color", F.col("fill").alias("filled"), F.col("object_type").alias("type"),
        "is_dashed", "length", "angle", axis.alias("axis"), (axis | (F.col("length") >= g.STRUCTURAL_LENGTH)).alias("structural"))


def width_histogram(edges: DataFrame) -> DataFrame:
    """Number of edges of each line width above zero, rounded half-even to two places."""
    return edges.where("lw > 0").groupBy("page_id", F.bround("lw", 2).alias("lw")).agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("seen"))


def wall_width(edges: DataFrame) -> DataFrame:
    """(page_id, wall_lw): the least width that over two per cent of a page's wide edges have, of 0.15 at least; else the greatest, else 0.15."""
    hist = width_histogram(edges).withColumn("total", F.sum("n").over(Window.partitionBy("page_id")))
    picked = hist.groupBy("page_id").agg(
        F.min(F.when((F.col("n") > 0.02 * F.col("total")) & (F.col("lw") >= 0.15), F.col("lw"))).alias("common"), F.max("lw").alias("greatest"))
    pages = edges.select("page_id").distinct()
    return pages.join(picked, "page_id", "left").select("page_id", F.coalesce("common", "greatest", F.lit(0.15)).alias("wall_lw"))


def walls(edges: DataFrame) -> DataFrame:
    """Horizontal and vertical wall strokes: wide enough, 25 points long, 2.5 times as long one way as the other.

    ``wall_width`` is taken here by windows over the page, so edges dealt by page_id are not dealt again for it.
    """
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    way = F.when(dx > dy * 2.5, "H").when(dy > dx * 2.5, "V")
    page, wide = Window.partitionBy("page_id"), F.col("lw") > 0
    out = edges.withColumn("lwk", F.bround("lw", 2)).withColumn("n", F.count_if(wide).over(Window.partitionBy("page_id", "lwk"))).withColumn("total", F.count_if(wide).over(page))
    common = F.min(F.when(wide & (F.col("n") > 0.02 * F.col("total")) & (F.col("lwk") >= 0.15), F.col("lwk"))).over(page)
    out = out.withColumn("wall_lw", F.coalesce(common, F.max(F.when(wide, F.col("lwk"))).over(page), F.lit(0.15)))
    out = out.where("lw >= wall_lw").withColumn("orient", way).where(F.col("orient").isNotNull() & (F.col("length") >= 25))
    flat = F.col("orient") == "H"
    return out.select(
        "page_id", "edge_id", "orient",
        F.when(flat, F.least("x0", "x1")).otherwise(F.least("y0", "y1")).alias("lo"), F.when(flat, F.greatest("x0", "x1")).otherwise(F.greatest("y0", "y1")).alias("hi"),
        F.when(flat, (F.col("y0") + F.col("y1")) / 2).otherwise((F.col("x0") + F.col("x1")) / 2).alias("perp"))


def grid_lines(edges: DataFrame, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT, share: float = 0.65) -> DataFrame:
    """(page_id, edge_id) of lines that span more than ``share`` of the page one way."""
    across, down = F.abs(F.col("x1") - F.col("x0")) > share * width, F.abs(F.col("y1") - F.col("y0")) > share * height
    return edges.where((F.col("type") == "line") & (across | down)).select("page_id", "edge_id")


def by_index(lists: DataFrame, edges: DataFrame) -> DataFrame:
    """lists(..., page_id, ids) exploded with the page's edges of those ids; ids that the page does not have are dropped."""
    wanted = lists.withColumn("edge_id", F.explode(F.array_distinct("ids"))).drop("ids")
    return wanted.join(edges.select("page_id", "edge_id", "length"), ["page_id", "edge_id"])


def svg_groups(selection: DataFrame, edges: DataFrame, *by: str) -> DataFrame:
    """A path for each line width (three places, half-even) of a selection, in edge order, with its drawn width, length and count."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    part = F.concat(F.lit("M"), two("x0"), F.lit(","), two("y0"), F.lit("L"), two("x1"), F.lit(","), two("y1"))
    keyed = selection.join(edges, ["page_id", "edge_id"]).withColumn("lwk", F.bround("lw", 3))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("edge_id"), part.alias("part"))))
    return keyed.groupBy(*by, "lwk").agg(
        F.array_join(F.transform(ordered, lambda s: s.part), " ").alias("d"), F.greatest(F.first("lwk"), F.lit(0.5)).alias("stroke_width"),
        F.round(F.sum("length"), 4).alias("total_length"), F.count(F.lit(1)).alias("n"))
