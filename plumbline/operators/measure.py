"""Measurement and report queries over masks and rooms of projects; results are rounded to ``places``, two in reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def real(value: Column, scale: Column, power: int = 1) -> Column:
    """Points to units; null where the scale is null or zero."""
    return F.try_divide(value, F.pow(scale, F.lit(power)) if power > 1 else scale)


def real_from_pixels(value: Column, scale: Column, power: int = 1, *, dpi: float = 200.0, compat: bool = False) -> Column:
    """Pixels of a page drawn at ``dpi`` to units, by way of points, in which projects are calibrated.

    With ``compat`` pixels are taken for points, as the engine's older reports have it.
    """
    return real(value if compat else value * (72.0 / dpi) ** power, scale, power)


def wall_area(masks: DataFrame, wall_height: float, places: int = 2) -> DataFrame:
    """Gross wall area by project: wall lengths times height, and what is above doors and windows."""
    length, height = F.coalesce("real_length", F.lit(0.0)), F.coalesce("height", F.lit(0.0))
    above = F.greatest(F.lit(0.0), F.lit(wall_height) - height)
    area = F.when(F.col("category") == "Walls", length * wall_height).when(F.col("category").isin("Doors", "Windows"), length * above).otherwise(0.0)
    return masks.groupBy("project_id").agg(F.round(F.sum(area), places).alias("wall_area"))


def category_area(masks: DataFrame, places: int = 2) -> DataFrame:
    """Area of doors and of windows by project: length times height."""
    area = F.coalesce("real_length", F.lit(0.0)) * F.coalesce("height", F.lit(0.0))
    return masks.where(F.col("category").isin("Doors", "Windows")).groupBy("project_id", "category").agg(F.round(F.sum(area), places).alias("area"))


def counts(masks: DataFrame) -> DataFrame:
    """Number of elements by project and category; a mask without a count, or with zero, is one."""
    return masks.groupBy("project_id", "category").agg(F.sum(F.coalesce(F.nullif("cnt", F.lit(0)), F.lit(1))).cast("long").alias("n"))


def openings(masks: DataFrame) -> DataFrame:
    area = F.coalesce("real_length", F.lit(0.0)) * F.coalesce("height", F.lit(0.0))
    return masks.where(F.col("category").isin("Doors", "Windows")).groupBy("project_id").agg(F.sum(area).alias("openings"))


def ceiling_area(rooms: DataFrame, places: int = 2) -> DataFrame:
    return rooms.groupBy("project_id").agg(F.round(F.sum(F.coalesce("real_area", F.lit(0.0))), places).alias("ceiling_area"))


def net_wall_area(rooms: DataFrame, masks: DataFrame, wall_height: float, places: int = 2) -> DataFrame:
    """Perimeters times height less openings, by project with rooms or openings."""
    gross = rooms.groupBy("project_id").agg(F.sum(F.coalesce("real_perimeter", F.lit(0.0)) * wall_height).alias("gross"))
    both = gross.join(openings(masks), "project_id", "full")
    return both.select("project_id", F.round(F.coalesce("gross", F.lit(0.0)) - F.coalesce("openings", F.lit(0.0)), places).alias("net_area"))


def room_wall_area(rooms: DataFrame, masks: DataFrame, wall_height: float, places: int = 2) -> DataFrame:
    """Each room's wall area, openings allotted evenly to the rooms of a project."""
    n = F.count(F.lit(1)).over(Window.partitionBy("project_id"))
    out = rooms.withColumn("n", n).join(openings(masks), "project_id", "left")
    area = F.coalesce("real_perimeter", F.lit(0.0)) * wall_height - F.coalesce("openings", F.lit(0.0)) / F.col("n")
    return out.select("project_id", "room_seq", "name", "real_area", "real_perimeter", F.round(area, places).alias("net_area"))


def export_rows(rooms: DataFrame, masks: DataFrame, wall_height: float, places: int = 2) -> DataFrame:
    """The report's row for each room."""
    out = room_wall_area(rooms, masks, wall_height, places)
    return out.select(
        "project_id", F.concat(F.lit("R"), F.col("room_seq").cast("string")).alias("room_no"), F.coalesce("name", F.concat(F.lit("R"), F.col("room_seq").cast("string"))).alias("room_name"),
        F.col("net_area").alias("inner_wall_area"), F.round(F.coalesce("real_area", F.lit(0.0)), places).alias("ceiling_area"), F.round(F.coalesce("real_perimeter", F.lit(0.0)), places).alias("inner_perimeter"))


def export_summary(rooms: DataFrame, masks: DataFrame, wall_height: float, places: int = 2) -> DataFrame:
    """Seven metrics of each project with rooms, one a row."""
    base = rooms.groupBy("project_id").agg(
        F.sum(F.coalesce("real_perimeter", F.lit(0.0)) * wall_height).alias("gross"), F.sum(F.coalesce("real_area", F.lit(0.0))).alias("ceiling"), F.count(F.lit(1)).alias("rooms"))
    area = F.coalesce("real_length", F.lit(0.0)) * F.coalesce("height", F.lit(0.0))
    one = F.coalesce(F.nullif("cnt", F.lit(0)), F.lit(1))
    of = lambda c, v: F.sum(F.when(F.col("category") == c, v).otherwise(0))
    extra = masks.groupBy("project_id").agg(of("Doors", area).alias("da"), of("Windows", area).alias("wa"), of("Doors", one).alias("dn"), of("Windows", one).alias("wn"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double")
    wide = base.join(extra, "project_id", "left").select(
        "project_id", F.round(F.col("gross") - zero("da") - zero("wa"), places).alias("Total Wall Area"), F.round("ceiling", places).alias("Total Ceiling Area"), F.round(zero("da"), places).alias("Total Door Area"),
        F.round(zero("wa"), places).alias("Total Window Area"), F.col("rooms").cast("double").alias("Total Rooms"), zero("dn").alias("Total Doors"), zero("wn").alias("Total Windows"))
    return wide.unpivot(["project_id"], [c for c in wide.columns if c != "project_id"], "metric", "value")


def detected_masks(detected: DataFrame) -> DataFrame:
    """Masks of an automatic detection (project_id, wall_length, doors, windows): walls if they have a length, doors and windows if any."""
    walls = detected.where("wall_length is not null and wall_length <> 0").selectExpr("project_id", "'Walls' as category", "wall_length as real_length", "0D as height", "cast(null as bigint) as cnt")
    doors = detected.where("doors > 0").selectExpr("project_id", "'Doors' as category", "0.9D * doors as real_length", "2.1D as height", "doors as cnt")
    windows = detected.where("windows > 0").selectExpr("project_id", "'Windows' as category", "1.2D * windows as real_length", "1.2D as height", "windows as cnt")
    return walls.unionByName(doors).unionByName(windows)


# Heights that prompts propose for doors and windows, and for walls without one of their own.
DOOR_HEIGHT, WINDOW_HEIGHT, WALL_HEIGHT = 2.1, 1.2, 2.4


def default_height(category: str = "category", height: str = "height") -> Column:
    """The height that a prompt proposes: fixed for doors and windows, else the mask's own unless it is null or 0."""
    own = F.when(F.col(height) != 0, F.col(height))
    return F.when(F.col(category) == "Doors", DOOR_HEIGHT).when(F.col(category) == "Windows", WINDOW_HEIGHT).otherwise(F.coalesce(own, F.lit(WALL_HEIGHT)))


def drawn_lengths(lines: DataFrame, least: float) -> DataFrame:
    """Drawn lines (..., x0, y0, x1, y1) longer than ``least`` points, with ``px``, their length; shorter ones are slips of the pointer."""
    length = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")))
    return lines.withColumn("px", length).where(F.col("px") > least)


def screen_to_points(position: Column, offset: float, zoom: Column, fit: float) -> Column:
    """A place on the screen in points of the page; the zoom is held between half and twice the fitting one."""
    return (position - offset) / (fit * F.greatest(F.lit(0.5), F.least(F.lit(2.0), zoom)))
