"""Detection results from class maps: rooms by class, outer contours of components, and a page's summary.

All steps are plans on pixel relations but one: a contour is followed in a task that gets a component's border pixels, not
its area.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import raster as r

# Class names of the two channel groups, the classes that are rooms, and the least pixels of a class and of a room.
ROOM_CLASSES = ["Background", "Outdoor", "Wall", "Kitchen", "Living Room", "Bedroom", "Bathroom", "Hallway", "Storage", "Garage", "Undefined", "Railing"]
ICON_CLASSES = ["Background", "Window", "Door", "Closet", "Toilet", "Sink", "Sauna", "Fireplace", "Bathtub", "Chimney", "Undefined"]
FIRST_ROOM, LAST_ROOM, LEAST_CLASS, LEAST_ROOM = 3, 11, 200, 500
#: Contours of more than so many square pixels count as doors and windows.
LEAST_CONTOUR = 100


def class_name(number: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), number + 1)


def borders(labelled: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The pixels of each component of which one of the four neighbours is not in it."""
    key = [*by, "label_y", "label_x"]
    votes = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.lit(dy == dx == 0).alias("own")) for dy, dx in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))]))
    spread = labelled.select(*key, votes.alias("v")).groupBy(*key, "v.y", "v.x").agg(F.max("v.own").alias("own"), F.count(F.lit(1)).alias("n"))
    return spread.where("own and n < 5").select(*key, "y", "x")


def contours(labelled: DataFrame, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(by, label_y, label_x, perimeter, contour_area): length of each component's outer contour through the centres of its pixels, and the area inside."""
    key = [*by, "label_y", "label_x"]

    def follow(frame: pd.DataFrame) -> pd.DataFrame:
        y, x = frame["y"].to_numpy(np.int64), frame["x"].to_numpy(np.int64)
        mask = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
        mask[y - y.min(), x - x.min()] = True
        ring = r.contour(mask)
        return frame[key].iloc[:1].assign(perimeter=r.perimeter(ring), contour_area=r.area(ring))

    edge = borders(labelled, by)
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edge.select(*key).schema.fields)
    return edge.groupBy(*key).applyInPandas(follow, f"{keys}, perimeter double, contour_area double")


def class_rooms(classes: DataFrame, height: int, width: int) -> DataFrame:
    """(page_id, room_seq, room_cls, class_name, area, perimeter, cx, cy): rooms of class maps (page_id, y, x, room_cls).

    A page's class of at least 200 pixels is opened by a square of five; its components, pixels touching at corners
    included, of at least 500 pixels are rooms, numbered by class and first pixel. The centre is cut to whole pixels.
    """
    layer = ("page_id", "room_cls")
    inside = classes.where(F.col("room_cls").between(FIRST_ROOM, LAST_ROOM)).select(*layer, "y", "x")
    many = inside.groupBy(*layer).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_CLASS)
    opened = r.open_(inside.join(many, list(layer), "left_semi"), 2, 2, height, width, layer)
    labelled = r.components(opened, eight=True, by=layer)
    key = [*layer, "label_y", "label_x"]
    large = labelled.groupBy(*key).agg(F.count(F.lit(1)).alias("area"), F.floor(F.avg("x")).alias("cx"), F.floor(F.avg("y")).alias("cy")).where(F.col("area") >= LEAST_ROOM)
    outlined = contours(labelled.join(large.select(*key), key, "left_semi"), layer)
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("room_cls", "label_y", "label_x"))
    return large.join(outlined, key).select("page_id", place.alias("room_seq"), "room_cls", class_name(F.col("room_cls"), ROOM_CLASSES).alias("class_name"), "area", "perimeter", "cx", "cy")


def mask_contours(masks: DataFrame) -> DataFrame:
    """(class, page_id, perimeter, contour_area) of each component of class masks (class, page_id, y, x)."""
    layer = ("class", "page_id")
    return contours(r.components(masks, eight=True, by=layer), layer).select(*layer, "perimeter", "contour_area")


def summary(pages: DataFrame, masks: DataFrame, rooms: DataFrame) -> DataFrame:
    """A row for each of pages(page_id, scale_factor): the walls' length (half their contours), doors and windows (contours of more than
    100 square pixels), rooms and their area, in pixels and in real units; no real units without a scale."""
    found = mask_contours(masks).groupBy("page_id").agg(
        (F.sum(F.when(F.col("class") == "wall", F.col("perimeter"))) / 2).alias("wall_length"),
        *[F.count_if((F.col("class") == kind) & (F.col("contour_area") > LEAST_CONTOUR)).alias(f"{kind}s") for kind in ("door", "window")])
    inside = rooms.groupBy("page_id").agg(F.count(F.lit(1)).alias("rooms"), F.sum("area").alias("room_area"))
    joined = pages.select("page_id", "scale_factor").join(found, "page_id", "left").join(inside, "page_id", "left")
    joined = joined.na.fill(0, ["wall_length", "doors", "windows", "rooms", "room_area"])
    scale = F.when(F.col("scale_factor") != 0, F.col("scale_factor"))
    return joined.select("page_id", "wall_length", "doors", "windows", "rooms", "room_area", (F.col("wall_length") / scale).alias("real_length"), (F.col("room_area") / (scale * scale)).alias("real_area"))
