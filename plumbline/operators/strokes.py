"""Brush strokes: openings and polylines drawn with a round brush, a drawing a row.

A drawing's pixels are those whose centre lies within half the brush of one of its lines, so ends and joins are round. Each is
painted in the box around it, clipped to the canvas, in the task that has its row; rows are dealt to tasks evenly before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import raster as r
from plumbline.operators.steps import dealt

# The brush in pixels, the canvas of openings, the least area of a contour that counts and its tolerance.
BRUSH, CANVAS, LEAST_AREA, TOLERANCE = 12.0, 2000, 5, 0.002
#: Shapes of openings that a task remembers.
SHAPES = 20_000
COLOURS = {"Walls": (29, 78, 216, 160), "Doors": (21, 128, 61, 160), "Windows": (194, 65, 12, 160)}


def paint(points: np.ndarray, brush: float, height: int, width: int) -> tuple[int, int, np.ndarray]:
    """Top, left side and pixels of a polyline's box on the canvas; a polyline of one point has none, as nothing is drawn."""
    reach = brush / 2
    if len(points) < 2 or not np.isfinite(points).all():
        return 0, 0, np.zeros((0, 0), bool)
    side, top = np.maximum(np.ceil(np.clip(points.min(axis=0) - reach, 0, [width, height])), 0).astype(int)
    right, bottom = np.minimum(np.floor(np.clip(points.max(axis=0) + reach, -1, [width, height])), [width - 1, height - 1]).astype(int)
    out = np.zeros((max(0, bottom - top + 1), max(0, right - side + 1)), bool)
    for (x0, y0), (x1, y1) in zip(points[:-1], points[1:], strict=True):
        # Of the box only the part that this line reaches.
        a, b = max(top, int(np.ceil(max(min(y0, y1) - reach, -1)))), min(bottom, int(np.floor(min(max(y0, y1) + reach, height))))
        c, d = max(side, int(np.ceil(max(min(x0, x1) - reach, -1)))), min(right, int(np.floor(min(max(x0, x1) + reach, width))))
        if a > b or c > d:
            continue
        y, x = np.arange(a, b + 1)[:, None], np.arange(c, d + 1)[None, :]
        dx, dy = x1 - x0, y1 - y0
        n = dx * dx + dy * dy
        t = np.clip(((x - x0) * dx + (y - y0) * dy) / n, 0, 1) if n else np.zeros((1, 1))
        out[a - top : b - top + 1, c - side : d - side + 1] |= (x - x0 - t * dx) ** 2 + (y - y0 - t * dy) ** 2 <= reach * reach + 1e-9
    return top, side, out


def precise_area(mask: np.ndarray) -> float:
    """Area inside the simplified outer contours of a mask, those of less than five square pixels left out."""
    label, total = r.label_array(mask, eight=True), 0.0
    for k in np.unique(label[label > 0]):
        ring = r.contour(label == k)
        if r.area(ring) >= LEAST_AREA:
            total += r.area(r.simplify(ring, TOLERANCE * r.perimeter(ring)))
    return total


def _points(paths: pa.ListArray) -> list[np.ndarray]:
    """Points of each path as an array; none for a null path, NaN for a null coordinate."""
    flat = paths.flatten()
    at = np.stack([flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1)
    return np.split(at, np.cumsum(paths.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[:-1])


def _rows(drawings: DataFrame, key: list[str], row, more: str) -> DataFrame:
    """A plan that gives, for each drawing (key, points), the rows that ``row(points)`` lists."""
    named = [part.strip().split(" ") for part in more.split(", ")]
    names, kinds = [n for n, _ in named], [{"int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[k] for _, k in named]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                made = [row(p) for p in _points(some.column("points"))]
                of = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]))
                flat = [x for m in made for x in m]
                out = [pa.array([x[k] for x in flat], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(some.column(k).take(of) for k in key), *out], names=[*key, *names])

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in drawings.select(*key).schema.fields)
    return dealt(drawings.select(*key, "points")).mapInArrow(run, f"{keys}, {more}")


def brush_runs(drawings: DataFrame, key: list[str], *, height: int, width: int, brush: float = BRUSH) -> DataFrame:
    """(key, y, x0, x1): the runs of pixels of each drawing (key, points); one of less than two points has none."""

    def row(points: np.ndarray) -> list[tuple]:
        top, side, mask = paint(points, brush, height, width)
        edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        y, x0 = np.nonzero(edge == 1)
        return list(zip((y + top).tolist(), (x0 + side).tolist(), (np.nonzero(edge == -1)[1] - 1 + side).tolist(), strict=True))

    return _rows(drawings, key, row, "y int, x0 int, x1 int")


def brush_png(drawings: DataFrame, key: list[str], *, height: int, width: int, brush: float = BRUSH, colour: tuple[int, int, int, int] = COLOURS["Walls"]) -> DataFrame:
    """(key, png): each drawing's mask in one colour on a clear canvas."""

    def row(points: np.ndarray) -> list[tuple]:
        top, side, mask = paint(points, brush, height, width)
        image = np.zeros((height, width, 4), np.uint8)
        image[top : top + mask.shape[0], side : side + mask.shape[1]][mask] = colour
        return [(r.png(image),)]

    return _rows(drawings, key, row, "png binary")


def openings(lines: DataFrame, key: list[str], *, canvas: int = CANVAS, brush: float = BRUSH) -> DataFrame:
    """(key, pixels, area, length, real_area, real_length) of each drawn opening (key, x0, y0, x1, y1, scale_factor).

    Coordinates are cut to whole pixels for drawing, not for the length. Without a scale the real area is null and the real length 0.
    Lines that differ only by where they lie, away from the canvas's border, have the same pixels, so a task measures each
    shape once, ``SHAPES`` of them at most at a time.
    """
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

    known: dict[tuple, tuple[int, float]] = {}

    def row(points: np.ndarray) -> list[tuple]:
        points = np.trunc(points)
        # Away from both borders of a side the place along it does not matter.
        inner = (points.min(axis=0, initial=canvas) >= brush) & (points.max(axis=0, initial=0) <= canvas - 1 - brush)
        shape = tuple((points - np.where(inner, points.min(axis=0, initial=canvas) - np.ceil(brush), 0)).ravel().tolist())
        if shape not in known:
            _, _, mask = paint(np.array(shape, float).reshape(-1, 2), brush, canvas, canvas)
            if len(known) >= SHAPES:
                known.clear()
            known[shape] = int(mask.sum()), precise_area(np.pad(mask, 1))
        return [known[shape]]

    length = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")))
    drawn = lines.select(*key, F.array(point("x0", "y0"), point("x1", "y1")).alias("points"), F.struct(length.alias("length"), "scale_factor").alias("__more"))
    painted = _rows(drawn.select(F.struct(*key, "__more").alias("__row"), "points"), ["__row"], row, "pixels int, area double")
    scale = F.when(F.col("scale_factor") != 0, F.col("scale_factor"))
    flat = painted.select("__row.*", "pixels", "area").select(*key, "pixels", "area", "__more.length", "__more.scale_factor")
    return flat.select(*key, "pixels", "area", "length", (F.col("area") / (scale * scale)).alias("real_area"), F.coalesce(F.col("length") / scale, F.lit(0.0)).alias("real_length"))
