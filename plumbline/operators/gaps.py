"""Openings: gaps between collinear walls, their class, and the gap a click means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ALIGNED, LEAST, MOST = 4.0, 10.0, 160.0


def _opens(width: Column, least: float, most: float) -> Column:
    return (width > least) & (width < most)


def collinear_gaps(walls: DataFrame, *, aligned: float = ALIGNED, least: float = LEAST, most: float = MOST) -> DataFrame:
    """Gaps between walls of one direction: perpendicular offset at most ``aligned``, gap strictly between ``least`` and ``most``.

    Walls are dealt to their bucket of the perpendicular position and the two beside it, and a bucket's walls, the band of
    one line of a page, are paired where they are gathered: walls dealt by page_id are not dealt again.
    """
    bucket = F.floor(F.col("perp") / aligned)
    near = walls.withColumn("d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    wall = F.struct(F.col("edge_id").alias("i"), "lo", "hi", "perp", (F.col("d") == 0).alias("own"))
    lines = near.groupBy("page_id", "orient", (bucket + F.col("d")).alias("b")).agg(F.collect_list(wall).alias("walls"))

    def side(a: Column, b: Column) -> Column:
        first = _opens(b.lo - a.hi, least, most)
        return F.struct(
            a.i.alias("ia"), b.i.alias("ib"), F.when(first, b.lo - a.hi).otherwise(a.lo - b.hi).alias("width"), F.when(first, a.hi).otherwise(b.hi).alias("g0"),
            F.when(first, b.lo).otherwise(a.lo).alias("g1"), ((a.perp + b.perp) / 2).alias("perp"))

    faces = lambda a, b: (a.i < b.i) & (F.abs(a.perp - b.perp) <= aligned) & (_opens(b.lo - a.hi, least, most) | _opens(a.lo - b.hi, least, most))
    pairs = F.flatten(F.transform(F.filter("walls", lambda a: a.own), lambda a: F.transform(F.filter("walls", lambda b: faces(a, b)), lambda b: side(a, b))))
    sides = lines.select("page_id", "orient", F.inline(pairs))
    mid = (F.col("g0") + F.col("g1")) / 2
    flat = F.col("orient") == "H"
    return sides.select("page_id", "orient", "ia", "ib", "width", "g0", "g1", "perp", F.when(flat, mid).otherwise(F.col("perp")).alias("mx"), F.when(flat, F.col("perp")).otherwise(mid).alias("my"))


def dedup_gaps(gaps: DataFrame) -> DataFrame:
    """The narrowest gap of each ten-point bucket of midpoints (half-even); ties by direction and edges. Adds gap_id by page."""
    window = Window.partitionBy("page_id", F.bround(F.col("mx") / 10), F.bround(F.col("my") / 10)).orderBy("width", "orient", "ia", "ib")
    kept = gaps.withColumn("r", F.row_number().over(window)).where("r = 1").drop("r")
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("orient", "ia", "ib")) - 1
    return kept.withColumn("gap_id", number.cast("long"))


def near_points(gaps: DataFrame, points: DataFrame, reach: float | Column, cell: float):
    """Gaps with the points in the cells within ``reach``: an equi-join on cells, the exact distance left to the caller."""
    k = F.sequence(F.floor((F.col("mx") - reach) / cell), F.floor((F.col("mx") + reach) / cell))
    wide = gaps.withColumn("gx", F.explode(k))
    wide = wide.withColumn("gy", F.explode(F.sequence(F.floor((F.col("my") - reach) / cell), F.floor((F.col("my") + reach) / cell))))
    return wide.join(points.withColumn("gx", F.floor(F.col("px") / cell)).withColumn("gy", F.floor(F.col("py") / cell)), ["page_id", "gx", "gy"])


def nearest_text(gaps: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """(page_id, gap_id, text): for each of gaps(page_id, gap_id, mx, my) the nearest of points(page_id, px, py, text) strictly within
    ``reach``, the smallest text of equally near ones; null without one. Gaps and points are one relation, dealt once by page."""
    gap, point = F.struct("gap_id", "mx", "my"), F.struct("px", "py", "text")
    no_gap, no_point = (F.lit(None).cast(df.select(c).schema[0].dataType) for df, c in ((gaps, gap), (points, point)))
    own = gaps.select("page_id", gap.alias("gap"), no_point.alias("point"))
    together = own.unionAll(points.select("page_id", no_gap.alias("gap"), point.alias("point"))).repartition("page_id")
    around = F.when(F.col("gap").isNotNull(), reach).otherwise(0.0)
    cover = lambda m, p: F.explode(F.sequence(F.floor((F.coalesce(m, p) - around) / (2 * reach)), F.floor((F.coalesce(m, p) + around) / (2 * reach))))
    cells = together.withColumn("gx", cover("gap.mx", "point.px")).withColumn("gy", cover("gap.my", "point.py")).groupBy("page_id", "gx", "gy").agg(F.collect_list("gap").alias("gaps"), F.collect_list("point").alias("points"))

    def beside(p: Column) -> Column:
        g = F.col("gap")
        return F.struct(F.sqrt((p.px - g.mx) * (p.px - g.mx) + (p.py - g.my) * (p.py - g.my)).alias("d"), p.text.alias("text"))

    met = cells.select("page_id", "points", F.explode("gaps").alias("gap")).select("page_id", "gap.gap_id", F.array_min(F.filter(F.transform("points", beside), lambda z: z.d < reach)).alias("best"))
    return met.groupBy("page_id", "gap_id").agg(F.min("best").alias("best")).select("page_id", "gap_id", "best.text")


def with_arcs(gaps: DataFrame, curves: DataFrame) -> DataFrame:
    """(page_id, gap_id) of gaps near an arc: four points or more, 8 to 4 widths large, centre within 1.8 widths."""
    arcs = curves.where("n_pts >= 4 and size >= 8").select("page_id", F.col("cx").alias("px"), F.col("cy").alias("py"), "size")
    met = near_points(gaps, arcs, F.col("width") * 1.8, MOST).where(F.expr("size <= 4 * width and sqrt((px - mx) * (px - mx) + (py - my) * (py - my)) < 1.8 * width"))
    return met.select("page_id", "gap_id").distinct()


def parallel_lines(gaps: DataFrame, edges: DataFrame) -> DataFrame:
    """(page_id, gap_id, n) for gaps with edges whose middle lies within 0.8 widths and length strictly within 0.5 to 1.5 widths."""
    lines = edges.select("page_id", ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"), "length")
    met = near_points(gaps, lines, F.col("width") * 0.8, MOST / 2).where(F.expr("length > 0.5 * width and length < 1.5 * width and sqrt((px - mx) * (px - mx) + (py - my) * (py - my)) < 0.8 * width"))
    return met.groupBy("page_id", "gap_id").agg(F.count(F.lit(1)).alias("n"))


def classify(gaps: DataFrame, curves: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds type: door where an arc is near, else window with three parallel lines or more, else opening."""
    # Gaps, arcs and lines are one relation, dealt once by page; a cell's gaps count the points gathered with them.
    gap, point = F.struct(*[c for c in gaps.columns if c != "page_id"]), lambda x, y, extent: F.struct(x.alias("px"), y.alias("py"), F.col(extent).alias("extent"))
    no_gap, no_point = (F.lit(None).cast(t) for t in (gaps.select(gap).schema[0].dataType, "struct<px:double,py:double,extent:double>"))
    arcs = curves.where("n_pts >= 4 and size >= 8").select("page_id", F.lit(True).alias("arc"), no_gap.alias("gap"), point(F.col("cx"), F.col("cy"), "size").alias("point"))
    lines = edges.select("page_id", F.lit(False).alias("arc"), no_gap.alias("gap"), point((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, "length").alias("point"))
    own = gaps.select("page_id", F.lit(None).cast("boolean").alias("arc"), gap.alias("gap"), no_point.alias("point"))
    together = own.unionAll(lines).unionAll(arcs).repartition("page_id").withColumn("arc", F.explode(F.when(F.col("arc").isNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array("arc"))))
    cell = F.when(F.col("arc"), MOST).otherwise(MOST / 2)
    reach = F.coalesce(F.col("gap.width") * F.when(F.col("arc"), 1.8).otherwise(0.8), F.lit(0.0))
    cover = lambda m, p: F.explode(F.sequence(F.floor((F.coalesce(m, p) - reach) / cell), F.floor((F.coalesce(m, p) + reach) / cell)))
    dealt = together.withColumn("gx", cover("gap.mx", "point.px")).withColumn("gy", cover("gap.my", "point.py"))
    cells = dealt.groupBy("page_id", "arc", "gx", "gy").agg(F.collect_list("gap").alias("gaps"), F.collect_list("point").alias("points"))

    def beside(p: Column) -> Column:
        g, width = F.col("gap"), F.col("gap.width")
        far = F.sqrt((p.px - g.mx) * (p.px - g.mx) + (p.py - g.my) * (p.py - g.my))
        return F.when(F.col("arc"), (p.extent <= 4 * width) & (far < 1.8 * width)).otherwise((p.extent > 0.5 * width) & (p.extent < 1.5 * width) & (far < 0.8 * width))

    met = cells.select("page_id", "arc", "points", F.explode("gaps").alias("gap")).select("page_id", "arc", "gap.*", F.size(F.filter("points", beside)).cast("long").alias("met"))
    counted = met.groupBy(*gaps.columns).agg(F.sum(F.when(F.col("arc"), F.col("met")).otherwise(0)).alias("arcs"), F.sum(F.when(F.col("arc"), 0).otherwise(F.col("met"))).alias("n_lines"))
    kind = F.when(F.col("arcs") > 0, "door").when(F.col("n_lines") >= 3, "window").otherwise("opening")
    return counted.withColumn("type", kind).select(*gaps.columns, "type", "n_lines")


def pick(clicks: DataFrame, gaps: DataFrame, first: str | None, *, reach: float = 80.0) -> DataFrame:
    """(click_id, page_id, gap_id, type, dist): the nearest gap strictly within ``reach``.

    With ``first`` only that type and openings count, and that type goes before openings. Ties go to the smaller gap_id.
    """
    # Clicks are fewer and narrower than gaps, so they are dealt to the cells within reach, four of twice its size.
    cell = lambda c: F.floor(F.col(c) / (2 * reach))
    around = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / (2 * reach)), F.floor((F.col(c) + reach) / (2 * reach))))
    points = clicks.select("click_id", "page_id", F.col("x").alias("px"), F.col("y").alias("py")).withColumn("gx", around("px")).withColumn("gy", around("py"))
    known = gaps if first is None else gaps.where(F.col("type").isin(first, "opening"))
    met = known.select("page_id", "gap_id", "type", "mx", "my").withColumn("gx", cell("mx")).withColumn("gy", cell("my")).join(points, ["page_id", "gx", "gy"])
    dist = F.sqrt((F.col("px") - F.col("mx")) * (F.col("px") - F.col("mx")) + (F.col("py") - F.col("my")) * (F.col("py") - F.col("my")))
    met = met.withColumn("dist", dist).where(F.col("dist") < reach)
    order = F.struct(F.when(F.col("type") == first, 0).otherwise(1), "dist", "gap_id") if first else F.struct("dist", "gap_id")
    best = met.groupBy("click_id", "page_id").agg(F.min_by(F.struct("gap_id", "type", "dist"), order).alias("b"))
    return best.select("click_id", "page_id", "b.gap_id", "b.type", F.round("b.dist", 4).alias("dist"))
