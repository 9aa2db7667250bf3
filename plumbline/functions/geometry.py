"""Geometry as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXIS_TOLERANCE, HATCH_LENGTH, STRUCTURAL_LENGTH = 10.0, 20.0, 12.0


def seg_length(x0, y0, x1, y1) -> Column:
    """Length of a segment."""
    dx, dy = F.col(x1) - F.col(x0), F.col(y1) - F.col(y0)
    return F.sqrt(dx * dx + dy * dy)


def seg_angle(x0, y0, x1, y1) -> Column:
    """Folded direction in degrees, in [0, 180); it depends on the direction of drawing."""
    return F.abs(F.degrees(F.atan2(F.col(y1) - F.col(y0), F.col(x1) - F.col(x0)))) % 180


def is_axis(angle: Column) -> Column:
    """Within ten degrees of horizontal or vertical."""
    t = AXIS_TOLERANCE
    return (angle < t) | (angle > 180 - t) | (F.abs(angle - 90) < t)


def is_hatch(angle: Column, length: Column) -> Column:
    """A short diagonal stroke."""
    return (((angle > 20) & (angle < 70)) | ((angle > 110) & (angle < 160))) & (length < HATCH_LENGTH)


def orientations_compatible(a: Column, b: Column) -> Column:
    """Two strokes that may belong to one wall: axis with axis, or diagonals within fifteen degrees."""
    both, none = is_axis(a) & is_axis(b), ~is_axis(a) & ~is_axis(b)
    return both | (none & ((F.abs(a - b) < 15) | (F.abs(F.abs(a - b) - 180) < 15)))


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment; a segment without length is a point."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(square < 1e-12, F.lit(1.0)).otherwise(square)))
    t = F.when(square < 1e-12, F.lit(0.0)).otherwise(t)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def width_matches(a: Column, b: Column) -> Column:
    """Both unknown, or within half a point."""
    near = F.abs(a - b) <= F.greatest(F.lit(0.5), 1e-9 * F.greatest(a, b))
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(near)


def flat_to_points(path: Column) -> Column:
    """x, y, x, y, ... to points; an odd last value is left out."""
    n = F.floor(F.size(path) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.get(path, 2 * i).alias("x"), F.get(path, 2 * i + 1).alias("y")))


def parse_polyline(text: Column) -> Column:
    """Points of "x,y x,y"; parts without two coordinates are skipped, and a coordinate that is no number voids the whole."""
    pairs = F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda p: F.split(p, ",")), lambda p: F.size(p) == 2)
    points = F.transform(pairs, lambda p: F.struct(F.get(p, 0).try_cast("double").alias("x"), F.get(p, 1).try_cast("double").alias("y")))
    return F.when(~F.exists(points, lambda p: p.x.isNull() | p.y.isNull()), points)


def segment_lengths(points: Column) -> Column:
    """Lengths of successive segments; none below two points."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), lambda a, b: F.sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)))


def polyline_length(points: Column) -> Column:
    """Sum of the lengths of successive segments; null below two points."""
    return F.when(F.size(points) >= 2, F.aggregate(segment_lengths(points), F.lit(0.0), lambda acc, d: acc + d))


def shoelace(points: Column) -> Column:
    """Area of a polygon."""
    n = F.size(points)
    shifted = F.concat(F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.abs(F.aggregate(F.zip_with(points, shifted, lambda a, b: a.x * b.y - b.x * a.y), F.lit(0.0), lambda acc, d: acc + d)) / 2
