"""Project state as keyed tables: partial updates, calibration, renames, undo. Each is a join, never a loop over keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import geometry as g


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of both; a value that changes has and is not null replaces the current one. Adds status: inserted, updated or no_change."""
    columns = [c for c in current.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") if c in changes.columns else F.lit(None).alias(f"new_{c}") for c in columns], F.lit(True).alias("has"))
    old = current.withColumn("had", F.lit(True))
    both = old.join(new, key, "full")
    touched = F.greatest(*[F.col(f"new_{c}").isNotNull() for c in columns]) if len(columns) > 1 else F.col(f"new_{columns[0]}").isNotNull()
    status = F.when(F.col("had").isNull(), "inserted").when(F.coalesce("has", F.lit(False)) & touched, "updated").otherwise("no_change")
    return both.select(key, *[F.coalesce(f"new_{c}", c).alias(c) for c in columns], status.alias("status"))


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def calibrate(projects: DataFrame, strokes: DataFrame) -> DataFrame:
    """Scale factors from strokes(project_id, x0, y0, x1, y1, real_length) longer than five points; others leave a project as it is."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    drawn = strokes.withColumn("len", F.sqrt(dx * dx + dy * dy)).where("len > 5").select("project_id", F.try_divide("len", "real_length").alias("new_scale"))
    out = projects.join(drawn, "project_id", "left")
    return out.select("project_id", F.round(F.coalesce("new_scale", "scale_factor"), 6).alias("scale_factor"), F.col("new_scale").isNotNull().alias("calibrated"))


def rename_rooms(rooms: DataFrame, renames: DataFrame) -> DataFrame:
    """Only the first room (by room_seq) with a renamed id gets the new name; renames without a room change nothing."""
    first = rooms.groupBy("project_id", "room_id").agg(F.min("room_seq").alias("room_seq"))
    target = first.join(renames, ["project_id", "room_id"]).select("project_id", "room_seq", "new_name")
    return rooms.join(target, ["project_id", "room_seq"], "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")


def missing_renames(rooms: DataFrame, renames: DataFrame) -> DataFrame:
    return renames.join(rooms.select("project_id", "room_id").distinct(), ["project_id", "room_id"], "left_anti")


def undo(masks: DataFrame) -> DataFrame:
    """All masks of a project but the last."""
    last = Window.partitionBy("project_id").orderBy(F.col("mask_seq").desc())
    return masks.withColumn("r", F.row_number().over(last)).where("r > 1").drop("r")


def routed(masks: DataFrame) -> DataFrame:
    """masks(..., category, edge_ids, polyline_points, mask_b64, src) with route and kind, by which a mask bounds rooms.

    Edge ids come first, then a drawn polyline, then a picture (base64 in mask_b64 or behind "base64," in src). A polyline
    of fewer than two points, or with a coordinate that is no number, bounds nothing ("none"), even beside a picture.
    kind is wall for walls and masks without a category, else opening.
    """
    points = g.parse_polyline(F.col("polyline_points"))
    picture = (F.coalesce("mask_b64", F.lit("")) != "") | F.coalesce(F.length(F.substring_index("src", "base64,", -1)) > 0, F.lit(False)) & F.coalesce(F.contains("src", F.lit("base64,")), F.lit(False))
    drawn = F.coalesce("polyline_points", F.lit("")) != ""
    route = F.when(F.coalesce(F.size("edge_ids"), F.lit(0)) > 0, "edges").when(drawn, F.when(F.size(points) >= 2, "polyline").otherwise("none")).when(picture, "raster").otherwise("none")
    kind = F.when(F.coalesce("category", F.lit("Walls")) == "Walls", "wall").otherwise("opening")
    return masks.withColumn("route", route).withColumn("kind", kind)


def engine_choice(routes: DataFrame) -> DataFrame:
    """(project_id, engine): vector for projects with wall edges or a polyline, else raster."""
    lines = ((F.col("route") == "edges") & (F.col("kind") == "wall")) | (F.col("route") == "polyline")
    return routes.groupBy("project_id").agg(F.when(F.bool_or(lines), "vector").otherwise("raster").alias("engine"))


def drawn_as(masks: DataFrame) -> DataFrame:
    """masks with drawn: what of a mask is shown, a polyline before the paths of its edges before a picture; null for none."""
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return masks.withColumn("drawn", F.when(full("polyline_points"), "polyline").when(F.coalesce(F.size("edge_ids"), F.lit(0)) > 0, "svg").when(full("mask_b64") | full("src"), "image"))


def replaced(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``rows`` with all of a key's rows replaced by those that ``new`` has for it; keys that ``new`` lacks keep theirs."""
    return rows.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)
