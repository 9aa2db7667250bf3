"""Composites on rasters: room splits, wall tracing, magic wand, detection summaries.

Each works on pages of bounded resolution, one page an Arrow group; joins and rankings before and after are DataFrame plans.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import raster as r
from plumbline.operators.labels import number_names
from plumbline.operators.spatial import ring_search
from plumbline.operators.steps import dealt

SPOT = ["page_id", "cy", "cx"]
# How a stroke was found: by horizontal, vertical or all runs, or as the ink around the click.
DIRECTIONS = ("H", "V", "COMBINED", "LOCAL")
STROKES = "page_id long, direction string, ys array<int>, xs array<int>, spots array<struct<cy:int,cx:int>>"
ROOMS = "page_id long, room_seq int, wall_count int, area double, perimeter double, cx double, cy double, mask binary"


def to_array(frame: pd.DataFrame, height: int, width: int) -> np.ndarray:
    out = np.zeros((height, width), bool)
    y, x = frame["y"].to_numpy(np.int64), frame["x"].to_numpy(np.int64)
    ok = (y >= 0) & (x >= 0) & (y < height) & (x < width)
    out[y[ok], x[ok]] = True
    return out


def grow(mask: np.ndarray, n: int) -> np.ndarray:
    """Dilation by a square reaching n pixels."""
    out = mask.copy()
    for side in (out, out.T):
        base = side.copy()
        for k in range(1, n + 1):
            side[k:] |= base[:-k]
            side[:-k] |= base[k:]
    return out


def wall_count(points: np.ndarray) -> int:
    """Sides of a polygon that are at least five per cent of the mean, three at least; of three corners or fewer, the corners."""
    n = len(points)
    if n <= 3:
        return n
    length = np.hypot(*(np.roll(points, -1, axis=0) - points).T.astype(float))
    return max(3, int((length >= 0.05 * length.mean()).sum()))


def split_array(barrier: np.ndarray, *, close: int, min_share: float = 0.0005, eps: float = 0.005, barrier_may_be_largest: bool = False, masks: bool = True) -> list[dict]:
    """Rooms between barriers: the free space after widening them, without its largest part, which is the outside.

    With ``barrier_may_be_largest`` the widened barriers compete for largest, as a component of their own.
    """
    closed = grow(barrier, close)
    label = r.label_array(~closed)
    place = np.flatnonzero(label)
    place = place[np.argsort(label.ravel()[place], kind="stable")]
    ids, starts, sizes = np.unique(label.ravel()[place], return_index=True, return_counts=True)
    if not len(ids):
        return []
    outside = ids[sizes.argmax()]
    if barrier_may_be_largest and closed.sum() > sizes.max():
        outside = 0
    out = []
    for k, start, size in zip(ids.tolist(), starts.tolist(), sizes.tolist(), strict=True):
        if k == outside or size < min_share * barrier.size:
            continue
        ys, xs = np.divmod(place[start : start + size], barrier.shape[1])
        # Only the part of the page that the room reaches is followed.
        top, side = max(0, ys[0] - 3), max(0, xs.min() - 3)
        ring = r.contour(grow(label[top : ys[-1] + 4, side : xs.max() + 4] == k, 2)) + np.array([side, top])
        points = r.simplify(ring, eps * r.perimeter(ring))
        mask = None if not masks else r.fill_polygon(points, *barrier.shape) if len(points) > 2 else label == k
        out.append({"wall_count": wall_count(points), "area": r.area(points), "perimeter": r.perimeter(points), "cx": float(xs.mean()), "cy": float(ys.mean()), "mask": mask, "ys": ys, "xs": xs})
    return out


def _runs(ys: np.ndarray, xs: np.ndarray) -> list[dict[str, int]]:
    """Pixels in order as runs of a row."""
    new = np.append(True, (np.diff(ys) != 0) | (np.diff(xs) != 1))
    return [{"y": a, "x0": b, "x1": c} for a, b, c in zip(ys[new].tolist(), xs[new].tolist(), xs[np.append(new[1:], True)].tolist(), strict=True)]


def split_rooms(barriers: DataFrame, height: int, width: int, *, scale: float = 1.0, close: int = 1, min_share: float = 0.0005, compat: bool = False) -> DataFrame:
    """Rooms of each page from barrier pixels (page_id, y, x); areas, perimeters and centres in points, masks as PNG.

    A page without free space beside the outside has no rooms.
    """

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for n, room in enumerate(split_array(to_array(frame, height, width), close=close, min_share=min_share, barrier_may_be_largest=compat), 1):
            rgba = np.zeros((height, width, 4), np.uint8)
            rgba[room["mask"]] = (100 + (37 * n) % 156, 100 + (91 * n) % 156, 100 + (53 * n) % 156, 140)
            rows.append((key[0], n, room["wall_count"], room["area"] / scale**2, room["perimeter"] / scale, room["cx"] / scale, room["cy"] / scale, r.png(rgba)))
        return pd.DataFrame(rows, columns=["page_id", "room_seq", "wall_count", "area", "perimeter", "cx", "cy", "mask"])

    return barriers.select("page_id", "y", "x").groupBy("page_id").applyInPandas(run, ROOMS)


def room_function(height: int, width: int, *, close: int = 1, min_share: float = 0.0005):
    """A table function that reads a page's barrier pixels (page_id, y, x) row by row into its bitmap and gives its rooms at the end.

    Called with a table that is partitioned by page, as ``room_function(...)(pixels.asTable().partitionBy("page_id"))`` or, once
    registered, as ``FROM rooms(TABLE(...) PARTITION BY page_id)``. Pixels off the page do not count.
    """

    class Rooms:
        def __init__(self):
            self.page, self.barrier = None, np.zeros((height, width), bool)

        def eval(self, row):
            self.page = row["page_id"]
            if 0 <= row["y"] < height and 0 <= row["x"] < width:
                self.barrier[row["y"], row["x"]] = True

        def terminate(self):
            if self.page is not None:
                for n, x in enumerate(split_array(self.barrier, close=close, min_share=min_share, masks=False), 1):
                    yield self.page, n, x["wall_count"], x["area"], x["perimeter"], x["cx"], x["cy"]

    return F.udtf(Rooms, returnType=ROOMS.removesuffix(", mask binary"))


def draw(lines: pd.DataFrame, height: int, width: int) -> np.ndarray:
    """Boolean array of lines (x0, y0, x1, y1, thick) in pixels: one step along the longer way a pixel, reaching half the thickness."""
    out = np.zeros((height, width), bool)
    for thick, some in lines.groupby("thick"):
        a, b = some[["x0", "y0"]].to_numpy(float), some[["x1", "y1"]].to_numpy(float)
        n = np.abs(b - a).max(axis=1).astype(int)
        of = np.repeat(np.arange(len(n)), n + 1)
        part = (np.arange(len(of)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)) / np.maximum(n, 1)[of]
        at = np.floor(a[of] + (b - a)[of] * part[:, None] + 0.5).astype(np.int64)
        reach = int(thick) // 2
        wide = to_array(pd.DataFrame({"y": at[:, 1] + reach, "x": at[:, 0] + reach}), height + 2 * reach, width + 2 * reach)
        out |= grow(wide, reach)[reach : reach + height, reach : reach + width]
    return out


def split_lines(lines: DataFrame, height: int, width: int, *, scale: float, close: int, min_share: float = 0.0005) -> DataFrame:
    """Rooms of each page, as ``split_rooms`` has them but with runs of pixels for masks, from barrier lines (page_id, x0, y0, x1, y1, thick) in pixels."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        found = split_array(draw(frame, height, width), close=close, min_share=min_share, masks=False)
        rows = [(key[0], n, x["wall_count"], x["area"] / scale**2, x["perimeter"] / scale, x["cx"] / scale, x["cy"] / scale, _runs(x["ys"], x["xs"])) for n, x in enumerate(found, 1)]
        return pd.DataFrame(rows, columns=["page_id", "room_seq", "wall_count", "area", "perimeter", "cx", "cy", "runs"])

    return dealt(lines, "page_id").groupBy("page_id").applyInPandas(run, ROOMS.replace("mask binary", "runs array<struct<y:int,x0:int,x1:int>>"))


def name_rooms(rooms: DataFrame, labels: DataFrame, *, reach: float, scale: float | None = None) -> DataFrame:
    """The room label whose pixel lies in the room (if ``scale`` is given and rooms have runs), the nearest to its centre of
    several; else the nearest within ``reach`` of the centre; else "Room n". Names that occur again are numbered."""
    if scale is not None:
        at = lambda c: F.floor(F.col(c) * scale).cast("int")
        rows = rooms.select("page_id", "room_seq", "cx", "cy", F.explode("runs").alias("run")).select("page_id", "room_seq", "cx", "cy", "run.y", "run.x0", "run.x1")
        placed = labels.where("is_room_label").select("page_id", "text", F.col("x").alias("lx"), F.col("y").alias("ly"), at("y").alias("y"), at("x").alias("px"))
        inside = rows.join(placed, ["page_id", "y"]).where("px between x0 and x1")
        off = F.sqrt((F.col("lx") - F.col("cx")) * (F.col("lx") - F.col("cx")) + (F.col("ly") - F.col("cy")) * (F.col("ly") - F.col("cy")))
        held = inside.groupBy("page_id", "room_seq").agg(F.min_by("text", F.struct(off, "text")).alias("inner"))
        rooms = rooms.drop("runs")
    near = rooms.join(labels.where("is_room_label").select("page_id", "text", "x", "y"), "page_id", "left")
    dist = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    best = near.withColumn("d", dist).where(F.col("d") < reach).groupBy("page_id", "room_seq").agg(F.min_by("text", F.struct("d", "text")).alias("text"))
    named = rooms.join(best, ["page_id", "room_seq"], "left")
    if scale is not None:
        named = named.join(held, ["page_id", "room_seq"], "left").withColumn("text", F.coalesce("inner", "text")).drop("inner")
    named = named.withColumn("name", F.coalesce("text", F.concat(F.lit("Room "), F.col("room_seq").cast("string")))).drop("text")
    return number_names(named, "page_id", "room_seq").withColumn("id", F.concat(F.lit("R"), F.col("room_seq").cast("string")))


def named_rooms(lines: DataFrame, labels: DataFrame, height: int, width: int, *, scale: float, close: int, reach: float, min_share: float = 0.0005) -> DataFrame:
    """Rooms of each page as ``split_lines`` has them, without masks, and named as ``name_rooms`` does.

    A page's room labels are an Arrow group with its lines, so that neither runs of rooms nor pairs of rooms and labels leave it.
    """

    def nearest(at: np.ndarray, texts: list[str], d: np.ndarray) -> str | None:
        return min(((float(d[k]), texts[k]) for k in np.flatnonzero(at)), default=(0.0, None))[1]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = split_array(draw(left, height, width), close=close, min_share=min_share, masks=False) if len(left) else []
        texts, lx, ly = right["text"].tolist(), *(right[c].to_numpy(float) for c in ("lx", "ly"))
        py, px = np.floor(ly * scale).astype(np.int64), np.floor(lx * scale).astype(np.int64)
        room = np.zeros((height, width), np.int32)
        for n, x in enumerate(found, 1):
            room[x["ys"], x["xs"]] = n
        ok = (py >= 0) & (px >= 0) & (py < height) & (px < width)
        inside = np.where(ok, room[np.where(ok, py, 0), np.where(ok, px, 0)], 0)
        rows = []
        for n, x in enumerate(found, 1):
            cx, cy = x["cx"] / scale, x["cy"] / scale
            d = np.sqrt((lx - cx) * (lx - cx) + (ly - cy) * (ly - cy))
            name = next(t for t in (nearest(inside == n, texts, d), nearest(d < reach, texts, d), f"Room {n}") if t is not None)
            rows.append((key[0], n, x["wall_count"], x["area"] / scale**2, x["perimeter"] / scale, cx, cy, name))
        return pd.DataFrame(rows, columns=["page_id", "room_seq", "wall_count", "area", "perimeter", "cx", "cy", "name"])

    placed = labels.where("is_room_label").select(F.col("page_id").alias("page"), "text", F.col("x").alias("lx"), F.col("y").alias("ly"))  # other names than those of the lines
    found = dealt(lines, "page_id").groupBy("page_id").cogroup(dealt(placed, "page").groupBy("page")).applyInPandas(run, ROOMS.replace("mask binary", "name string"))
    return number_names(found, "page_id", "room_seq").withColumn("id", F.concat(F.lit("R"), F.col("room_seq").cast("string")))


def trace_walls(ink: DataFrame, clicks: DataFrame, height: int, width: int, **options: float) -> DataFrame:
    """(click_id, y, x): the wall stroke a click means, as ``trace_spots`` has it for the click's pixel."""
    return clicks.join(trace_spots(ink, clicks, height, width, **options), SPOT).select("click_id", "y", "x")


def _nearest(mask: np.ndarray, cy: int, cx: int, reach: int, depth: np.ndarray | None = None) -> tuple[int, int] | None:
    """The set pixel of the nearest square ring within reach: the deepest of the ring, if depth is given, then by row and column."""
    # Most are found in the rings close by, which are looked at alone first.
    for near in (min(3, reach), reach):
        top, side = max(0, cy - near), max(0, cx - near)
        ys, xs = np.nonzero(mask[top : max(0, cy + near + 1), side : max(0, cx + near + 1)])
        if len(ys):
            ys, xs = ys + top, xs + side
            deep = np.zeros(len(ys)) if depth is None else -depth[ys, xs]
            k = np.lexsort((xs, ys, deep, np.maximum(abs(ys - cy), abs(xs - cx))))[0]
            return int(ys[k]), int(xs[k])
    return None


def _odd(n: float, least: int) -> int:
    n = max(least, int(n))
    return n + 1 - n % 2


def local_part(mask: np.ndarray, cy: int, cx: int, box: int) -> np.ndarray | None:
    """The component of ink nearest to a click (within 14 pixels) in a box around it, widened by two pixels; None without one."""
    top, side = max(0, cy - box), max(0, cx - box)
    part = r.label_array(mask[top : max(0, cy + box), side : max(0, cx + box)], eight=True)
    at = _nearest(part > 0, cy - top, cx - side, 14)
    if at is None:
        return None
    out = np.zeros_like(mask)
    out[top : top + part.shape[0], side : side + part.shape[1]] = part == part[at]
    return grow(out, 2)


class _Tracer:
    """Strokes of one page by thickness: runs along both axes, cut where they cross."""

    def __init__(self, mask: np.ndarray, per_point: float, least: int):
        self.mask, self.depth, self.least = mask, r.distance_transform(mask), least
        self.run, self.junction = max(8, int(8 * per_point)), 4 * (max(5, int(3 * per_point)) // 2)
        self.padded, self.by_depth, self.wide = grow(mask, 4), {}, {}

    def _parts(self, d: float) -> list[np.ndarray]:
        """Labels of horizontal, vertical and all runs of ink of like depth, without the zones around crossings."""
        if d not in self.by_depth:
            band = self.mask & (self.depth >= max(0.3, 0.3 * d)) & (self.depth <= 4 * d)
            flat, upright = _long_runs(band, self.run, 1), _long_runs(band, self.run, 0)
            clear = ~grow(flat & upright, self.junction)
            self.by_depth[d] = [r.label_array(runs & clear, eight=True) for runs in (flat, upright, flat | upright)]
        return self.by_depth[d]

    def at(self, y: int, x: int) -> tuple[tuple, np.ndarray, str] | None:
        """The smallest stroke at a pixel of ink: its name, its pixels in full width, and its direction; curves and slants only by all runs together."""
        d, found = self.depth[y, x], []
        *straight, every = self._parts(d)
        for k, part in enumerate((*straight, every)):
            if k == 2 and found and d < 2:
                break
            at = _nearest(part > 0, y, x, 20) if np.count_nonzero(part) >= 5 else None
            if at is not None:
                name = (d, k, int(part[at]))
                if name not in self.wide:
                    wide = grow(grow(part == part[at], _odd(3 * d, 3) // 2) & self.padded, 2)
                    self.wide[name] = int(wide.sum()), wide
                if self.wide[name][0] > self.least:
                    found.append(name)
        if not found:
            return None
        name = min(found, key=lambda f: self.wide[f][0])
        return name, self.wide[name][1], DIRECTIONS[name[1]]


def trace_spots(ink: DataFrame, clicks: DataFrame, height: int, width: int, **options: float) -> DataFrame:
    """(page_id, cy, cx, y, x, direction): the pixels of ``traced_strokes`` for each distinct clicked pixel."""
    each = traced_strokes(ink, clicks, height, width, **options).withColumn("at", F.explode("spots")).select("page_id", "at.cy", "at.cx", F.explode(F.arrays_zip("ys", "xs")).alias("p"), "direction")
    return each.select(*SPOT, F.col("p.ys").alias("y"), F.col("p.xs").alias("x"), "direction")


def _strokes(ink: DataFrame, clicks: DataFrame, height: int, width: int, find: Callable[[np.ndarray], Callable[[int, int], tuple | None]]) -> DataFrame:
    """(page_id, direction, ys, xs, spots): each stroke's pixels once, with the clicked pixels that mean it, whatever the number of clicks on them.

    find(ink) gives a function of a clicked pixel to a stroke's name, its direction and its pixels; None where there is none.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: dict = {}
        if len(left) and len(right):
            at = find(to_array(left, height, width))
            for cy, cx in right[["cy", "cx"]].itertuples(index=False):
                got = at(cy, cx)
                if got is not None:
                    found.setdefault(got[0], (key[0], *got[1:], []))[-1].append({"cy": cy, "cx": cx})
        rows = [(page, way, *(a.astype(np.int32) for a in pixels), spots) for page, way, pixels, spots in found.values()]
        return pd.DataFrame(rows, columns=["page_id", "direction", "ys", "xs", "spots"])

    return dealt(ink, "page_id").groupBy("page_id").cogroup(dealt(clicks.select(*SPOT).distinct(), "page_id").groupBy("page_id")).applyInPandas(run, STROKES)


def traced_strokes(ink: DataFrame, clicks: DataFrame, height: int, width: int, *, radius: int = 25, per_point: float = 1.0, least: int = 20) -> DataFrame:
    """STROKES: the wall stroke that each distinct clicked pixel means.

    The nearest ink within ``radius`` gives the local thickness; ink of like distance to the border is opened into
    horizontal and vertical runs, which are cut at junctions. The smallest of the horizontal, the vertical and, where
    neither is found or ink is thick, the combined part at the click that is of more than ``least`` pixels in its full
    width is taken; without one, the component of ink at the click in a box around it. No ink near, no row.
    """
    box = int(max(60, 40 * per_point))

    def find(mask: np.ndarray):
        tracer, traced = _Tracer(mask, per_point, least), {}

        def at(cy: int, cx: int) -> tuple | None:
            spot = _nearest(mask, cy, cx, radius, tracer.depth)
            if spot is not None and spot not in traced:
                name, best, way = tracer.at(*spot) or (spot, local_part(mask, *spot, box), DIRECTIONS[3])
                traced[spot] = name, way, np.nonzero(best)
            return traced.get(spot)

        return at

    return _strokes(ink, clicks, height, width, find)


def component_strokes(ink: DataFrame, clicks: DataFrame, height: int, width: int, *, radius: int = 20) -> DataFrame:
    """STROKES: the component of ink, by corners too, nearest to each distinct clicked pixel within ``radius``."""

    def find(mask: np.ndarray):
        parts, pixels = r.label_array(mask, eight=True), {}

        def at(cy: int, cx: int) -> tuple | None:
            spot = _nearest(mask, cy, cx, radius)
            if spot is None:
                return None
            part = int(parts[spot])
            if part not in pixels:
                pixels[part] = np.nonzero(parts == part)
            return part, DIRECTIONS[3], pixels[part]

        return at

    return _strokes(ink, clicks, height, width, find)


def local_spots(ink: DataFrame, clicks: DataFrame, height: int, width: int, *, box: int = 60) -> DataFrame:
    """(page_id, cy, cx, area): size of ``local_part`` for each distinct clicked pixel that has one."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            mask = to_array(left, height, width)
            for cy, cx in right[["cy", "cx"]].itertuples(index=False):
                part = local_part(mask, cy, cx, box)
                if part is not None:
                    rows.append((key[0], cy, cx, int(part.sum())))
        return pd.DataFrame(rows, columns=[*SPOT, "area"])

    return ink.groupBy("page_id").cogroup(clicks.select(*SPOT).distinct().groupBy("page_id")).applyInPandas(run, "page_id long, cy int, cx int, area long")


def _long_runs(mask: np.ndarray, n: int, along: int) -> np.ndarray:
    """Opening by a line of n pixels along an axis."""
    a = mask if along else mask.T
    kept = a.copy()
    for k in range(1, n):
        kept[:, : a.shape[1] - k] &= a[:, k:]
        kept[:, a.shape[1] - k :] = False
    out = kept.copy()
    for k in range(1, n):
        out[:, k:] |= kept[:, : a.shape[1] - k]
    return out if along else out.T


def wand(ink: DataFrame, clicks: DataFrame, height: int, width: int, *, most: float = 0.1) -> DataFrame:
    """(click_id, area, length, filled): the stroke component at a click, or the enclosed space around it if that is under ``most`` of the page.

    length is half the outline.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(right):
            mask = to_array(left, height, width) if len(left) else np.zeros((height, width), bool)
            strokes, spaces = r.label_array(mask, eight=True), r.label_array(~mask)
            lengths = {}
            for cy, cx in right[["cy", "cx"]].itertuples(index=False):
                if not (0 <= cy < height and 0 <= cx < width):
                    continue
                filled = not strokes[cy, cx]
                got = (spaces == spaces[cy, cx]) if filled else (strokes == strokes[cy, cx])
                if filled and got.sum() >= most * mask.size:
                    window = strokes[max(0, cy - 10) : cy + 11, max(0, cx - 10) : cx + 11]
                    ids, n = np.unique(window[window > 0], return_counts=True)
                    if not len(ids):
                        continue
                    got, filled = strokes == ids[n.argmax()], False
                part = (filled, int(got.argmax()))
                if part not in lengths:
                    lengths[part] = r.perimeter(r.contour(got)) / 2
                rows.append((key[0], cy, cx, float(got.sum()), lengths[part], bool(filled)))
        return pd.DataFrame(rows, columns=[*SPOT, "area", "length", "filled"])

    found = ink.groupBy("page_id").cogroup(clicks.select(*SPOT).distinct().groupBy("page_id")).applyInPandas(run, "page_id long, cy int, cx int, area double, length double, filled boolean")
    return clicks.join(found, SPOT).select("click_id", "area", "length", "filled")


def outlines(labelled: DataFrame, *, eps: float = 0.002, least: float = 5.0) -> DataFrame:
    """(page_id, label_y, label_x, corners, area, perimeter, points): simplified outer contour of each component, with at least ``least`` pixels."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        y, x = frame["y"].to_numpy(np.int64), frame["x"].to_numpy(np.int64)
        if len(y) < least:
            return pd.DataFrame([], columns=["page_id", "label_y", "label_x", "corners", "area", "perimeter", "points"])
        mask = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
        mask[y - y.min(), x - x.min()] = True
        ring = r.contour(mask)
        points = r.simplify(ring, eps * r.perimeter(ring)) + np.array([x.min(), y.min()])
        text = " ".join(f"{a},{b}" for a, b in points.tolist())
        return pd.DataFrame([(*key, len(points), r.area(points), r.perimeter(points), text)], columns=["page_id", "label_y", "label_x", "corners", "area", "perimeter", "points"])

    return labelled.groupBy("page_id", "label_y", "label_x").applyInPandas(run, "page_id long, label_y int, label_x int, corners int, area double, perimeter double, points string")


def detection_summary(outlined: DataFrame, by: str = "page_id") -> DataFrame:
    """Total length (half the outlines), area, and number of outlines over a hundred pixels, of each page."""
    return outlined.groupBy(by).agg(
        F.round(F.sum("perimeter") / 2, 4).alias("length"), F.round(F.sum("area"), 4).alias("area"), F.count_if(F.col("area") > 100).alias("large"), F.count(F.lit(1)).alias("n"))


def auto_crop(raster: DataFrame, height: int, width: int) -> DataFrame:
    """(page_id, x0, y0, x1, y1): box of the largest closed ink component, or the 2 to 98 % ink box where that is under a tenth of the page; padded by 5 %."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        mask = to_array(frame, height, width)
        closed = ~grow(~grow(mask, 7), 7) | mask
        label = r.label_array(closed, eight=True)
        ids, sizes = np.unique(label[label > 0], return_counts=True)
        ys, xs = np.nonzero(label == ids[sizes.argmax()])
        if sizes.max() < 0.1 * mask.size and mask.sum() > 100:
            yy, xx = np.nonzero(mask)
            box = [np.percentile(xx, 2), np.percentile(yy, 2), np.percentile(xx, 98), np.percentile(yy, 98)]
        else:
            box = [xs.min(), ys.min(), xs.max(), ys.max()]
        px, py = 0.05 * (box[2] - box[0]), 0.05 * (box[3] - box[1])
        box = [max(0, int(box[0] - px)), max(0, int(box[1] - py)), min(width - 1, int(box[2] + px)), min(height - 1, int(box[3] + py))]
        return pd.DataFrame([(key[0], *box)], columns=["page_id", "x0", "y0", "x1", "y1"])

    return r.ink(raster).groupBy("page_id").applyInPandas(run, "page_id long, x0 int, y0 int, x1 int, y1 int")


def depth(ink: DataFrame, height: int, width: int) -> DataFrame:
    """(page_id, y, x, d): exact distance of each ink pixel from the nearest free one."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        mask = to_array(frame, height, width)
        d = r.distance_transform(mask)
        y, x = np.nonzero(mask)
        return pd.DataFrame({"page_id": key[0], "y": y.astype(np.int32), "x": x.astype(np.int32), "d": d[y, x]})

    return ink.groupBy("page_id").applyInPandas(run, "page_id long, y int, x int, d double")


def distance_bands(ink: DataFrame, clicks: DataFrame, height: int, width: int, *, radius: int = 25) -> DataFrame:
    """(click_id, d, n): the half thickness d of the ink at each click and how many pixels of the page are in its band.

    d is that of the deepest pixel of the nearest ring with ink within ``radius``; the band is ink between the larger of
    0.3 and 0.3 d, and 4 d. Bands are counted from a page's histogram of distances, not from its pixels.
    """
    deep = depth(ink, height, width)
    at = clicks.select("click_id", "page_id").join(ring_search(clicks, deep, radius, "d", highest="d").select("click_id", "d"), "click_id")
    hist = deep.groupBy("page_id", F.col("d").alias("of")).agg(F.count(F.lit(1)).alias("m"))
    inside = (F.col("of") >= F.greatest(F.lit(0.3), 0.3 * F.col("d"))) & (F.col("of") <= 4 * F.col("d"))
    bands = at.select("page_id", "d").distinct().toDF("page", "deep")
    bands = bands.join(hist, F.col("page") == F.col("page_id")).withColumn("d", F.col("deep")).where(inside).groupBy("page", "deep").agg(F.sum("m").alias("n"))
    return at.join(bands, (F.col("page_id") == F.col("page")) & (F.col("d") == F.col("deep"))).select("click_id", "d", "n")
