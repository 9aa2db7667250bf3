"""Raster operators: pixel relations (page_id, y, x) for set algebra and morphology, and array kernels.

A pixel relation stays distributed whatever a page's size; components are labelled in tiles and joined across their
borders. Kernels that follow a shape take one page or component an Arrow group, which a page's resolution bounds.
"""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.steps import contract, saved

#: Rows and columns of a tile in which pixels are labelled by one task.
TILE = 1024


def to_gray(rgb: DataFrame) -> DataFrame:
    """0.299 R + 0.587 G + 0.114 B, rounded."""
    return rgb.select("page_id", "y", "x", F.round(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).cast("int").alias("gray"))


def otsu(raster: DataFrame) -> DataFrame:
    """(page_id, threshold): the gray value up to which pixels form the lower class of greatest between-class variance; the least of ties."""
    hist = raster.groupBy("page_id", "gray").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("page_id").orderBy("gray").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("page_id")
    run = hist.select("page_id", "gray", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("gray")).over(up).alias("s0"), F.sum("n").over(every).alias("w"), F.sum(F.col("n") * F.col("gray")).over(every).alias("s"))
    diff = F.col("s0") * F.col("w") - F.col("s") * F.col("w0")
    between = F.try_divide(diff.cast("double") * diff.cast("double"), (F.col("w0") * (F.col("w") - F.col("w0"))).cast("double"))
    return run.withColumn("v", F.coalesce(between, F.lit(0.0))).groupBy("page_id").agg(F.max_by("gray", F.struct(F.round("v", 0), -F.col("gray"))).alias("threshold"))


def ink(raster: DataFrame) -> DataFrame:
    """Pixels at or below the page's threshold."""
    return raster.join(otsu(raster), "page_id").where("gray <= threshold").select("page_id", "y", "x")


def dilate(pixels: DataFrame, ry: int, rx: int, height: int, width: int, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Pixels within ry rows and rx columns of a set one, clipped to the page; each layer that ``by`` names is widened by itself."""
    pixels = pixels.where(F.col("y").between(-ry, height - 1 + ry) & F.col("x").between(-rx, width - 1 + rx))
    dy = F.explode(F.sequence(F.greatest(F.lit(0), F.col("y") - ry), F.least(F.lit(height - 1), F.col("y") + ry)))
    dx = F.explode(F.sequence(F.greatest(F.lit(0), F.col("x") - rx), F.least(F.lit(width - 1), F.col("x") + rx)))
    rows = pixels.select(*by, "x", dy.alias("y")).distinct()
    return rows.select(*by, "y", dx.alias("x")).distinct()


def erode(pixels: DataFrame, ry: int, rx: int, height: int, width: int, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Pixels all of whose neighbours on the page are set; beyond the border nothing is missing, and no pixel counts."""
    pixels = pixels.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    need = (F.least(F.lit(height - 1), F.col("y") + ry) - F.greatest(F.lit(0), F.col("y") - ry) + 1) * (F.least(F.lit(width - 1), F.col("x") + rx) - F.greatest(F.lit(0), F.col("x") - rx) + 1)
    dy = F.explode(F.sequence(F.greatest(F.lit(0), F.col("y") - ry), F.least(F.lit(height - 1), F.col("y") + ry)))
    dx = F.explode(F.sequence(F.greatest(F.lit(0), F.col("x") - rx), F.least(F.lit(width - 1), F.col("x") + rx)))
    votes = pixels.select(*by, "x", dy.alias("y")).select(*by, "y", dx.alias("x")).groupBy(*by, "y", "x").agg(F.count(F.lit(1)).alias("n"))
    return votes.where(F.col("n") == need).select(*by, "y", "x")


def close(pixels: DataFrame, ry: int, rx: int, height: int, width: int, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return erode(dilate(pixels, ry, rx, height, width, by), ry, rx, height, width, by)


def open_(pixels: DataFrame, ry: int, rx: int, height: int, width: int, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return dilate(erode(pixels, ry, rx, height, width, by), ry, rx, height, width, by)


def runs_at_least(pixels: DataFrame, n: int, along: str = "x") -> DataFrame:
    """Opening by a line of n pixels: pixels in runs of n or more, as gaps and islands."""
    across = "y" if along == "x" else "x"
    island = F.col(along) - F.row_number().over(Window.partitionBy("page_id", across).orderBy(along))
    size = F.count(F.lit(1)).over(Window.partitionBy("page_id", across, "g"))
    return pixels.withColumn("g", island).withColumn("n", size).where(F.col("n") >= n).select("page_id", "y", "x")


def complement(raster: DataFrame, pixels: DataFrame) -> DataFrame:
    return raster.select("page_id", "y", "x").join(pixels, ["page_id", "y", "x"], "left_anti")


# Gray below which a pixel is ink, and clean gray above which it was noise; half the opening's square, and the thin lines' margin.
DARK, CLEAN, THICK_REACH, THIN_MARGIN = 200, 240, 2, 1


# Means and deviations of the channels that the network was trained with, and what its input's sides are multiples of.
MEANS, DEVIATIONS, MULTIPLE = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), 64


def normalise(rgb: DataFrame) -> DataFrame:
    """(page_id, y, x, r, g, b): channels of 0 to 255 as the network takes them."""
    scaled = [((F.col(c) / 255.0 - m) / s).alias(c) for c, m, s in zip("rgb", MEANS, DEVIATIONS, strict=True)]
    return rgb.select("page_id", "y", "x", *scaled)


def model_side(side: Column, scale: Column) -> Column:
    """Pixels of a side of the network's input: the scaled side, up to the next multiple of 64."""
    return (F.ceil(side * scale / float(MULTIPLE)) * MULTIPLE).cast("int")


def kernel_size(base: float, ratio: Column) -> Column:
    """A kernel's side scaled by the page: whole, odd and at least three."""
    n = (F.lit(float(base)) * ratio).cast("int")
    return F.greatest(F.lit(3), n + 1 - F.pmod(n, F.lit(2)))


def recover_width(stroke: DataFrame, ink: DataFrame, reach: int, height: int, width: int) -> DataFrame:
    """The ink within ``reach`` rows and columns of a stroke, so that what thinning took comes back."""
    return ink.select("page_id", "y", "x").distinct().join(dilate(stroke, reach, reach, height, width), ["page_id", "y", "x"], "left_semi")


def thin_lines(raster: DataFrame, height: int, width: int) -> DataFrame:
    """Ink that an opening by a square of five removes, widened by a pixel all around."""
    dark = saved(ink(raster))
    thin = dark.join(open_(dark, THICK_REACH, THICK_REACH, height, width).hint("merge"), ["page_id", "y", "x"], "left_anti")
    return dilate(thin, THIN_MARGIN, THIN_MARGIN, height, width)


def clean_annotations(raster: DataFrame, height: int, width: int, clean: DataFrame | None = None) -> DataFrame:
    """The raster with annotations in white: pixels darker than 200 whose value in ``clean`` (page_id, y, x, gray) is above
    240; without a cleaned raster, thin lines. Pixels that ``clean`` lacks stay as they are."""
    at = ["page_id", "y", "x"]
    if clean is None:
        noise = thin_lines(raster, height, width)
    else:
        noise = raster.where(F.col("gray") < DARK).join(clean.where(F.col("gray") > CLEAN), at, "left_semi").select(*at)
    marked = raster.join(noise.withColumn("noise", F.lit(True)).hint("merge"), at, "left")  # pixels are too many to broadcast
    return marked.select(*at, F.when(F.col("noise"), 255).otherwise(F.col("gray")).alias("gray"))


def resize(pixels: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """A relation of pixels (page_id, y, x, ...) of height x width resized by nearest index: pixel (y, x) of the result is (y * height // to_height, x * width // to_width)."""
    span = lambda c, n, m: F.explode(F.sequence(F.ceil(F.col(c) * m / n).cast("int"), F.ceil((F.col(c) + 1) * m / n).cast("int") - 1))
    kept = [c for c in pixels.columns if c not in ("page_id", "y", "x")]
    reached = pixels.where(f"y between 0 and {height - 1} and x between 0 and {width - 1} and ceil(y * {to_height} / {height}) < ceil((y + 1) * {to_height} / {height}) and ceil(x * {to_width} / {width}) < ceil((x + 1) * {to_width} / {width})")
    rows = reached.select("page_id", span("y", height, to_height).alias("y"), "x", *kept)
    return rows.select("page_id", "y", span("x", width, to_width).alias("x"), *kept)


# Classes kept as masks, with their channel group and number, the closing's reach and the least component.
CLASS_MASKS = [("wall", "room_cls", 2, 2, 500), ("door", "icon_cls", 2, 1, 200), ("window", "icon_cls", 1, 1, 200)]


def class_masks(classes: DataFrame, height: int, width: int) -> DataFrame:
    """(class, page_id, y, x): walls, doors and windows of class maps, small gaps closed and small components dropped."""
    layer, out = ("class", "page_id"), None
    for name, group, number, reach, least in CLASS_MASKS:
        own = classes.where(F.col(group) == number).select(F.lit(name).alias("class"), "page_id", "y", "x", F.lit(least).alias("least"))
        closed = close(own, reach, reach, height, width, layer).withColumn("least", F.lit(least))
        out = closed if out is None else out.unionAll(closed)
    labelled = components(out, eight=True, by=(*layer, "least"))
    key = [*layer, "label_y", "label_x"]
    large = labelled.groupBy(*key, "least").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.col("least"))
    return labelled.join(large, key, "left_semi").select(*layer, "y", "x")


def label_array(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """Components of a boolean array, numbered by their smallest pixel (row-major index + 1); 0 outside.

    Runs of a row are joined to those that they touch in the next; with ``eight``, by a corner too.
    """
    h, w = mask.shape
    edge = np.zeros((h, w + 1), bool)
    edge[:, :w] = mask
    edge[:, 1:] ^= mask
    turns = np.flatnonzero(edge)  # a run begins, ends, the next one begins
    row, start = np.divmod(turns[::2], w + 1)
    end = turns[1::2] - row * (w + 1)
    below = (row + 1) * (w + 1)
    lo = np.searchsorted(row * (w + 1) + end, below + start, "left" if eight else "right")
    n = np.maximum(np.searchsorted(row * (w + 1) + start, below + end, "right" if eight else "left") - lo, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[a]
    first = np.arange(len(row))
    while (first[a] != first[b]).any():
        least = np.minimum(first[a], first[b])
        np.minimum.at(first, first[a], least)
        np.minimum.at(first, first[b], least)
        while (first != first[first]).any():
            first = first[first]
    out = np.zeros(h * w, np.int64)
    out[mask.ravel()] = np.repeat((row * w + start + 1)[first], end - start)
    return out.reshape(h, w)


def components(pixels: DataFrame, *, eight: bool = False, by: tuple[str, ...] = ("page_id",), tile: int = TILE) -> DataFrame:
    """(by, y, x, label_y, label_x): the label is the smallest of a component's pixels in row-major order.

    Pixels join only inside one layer, which ``by`` names (page_id, or page_id and a class). Each tile is labelled by itself; where
    pixels touch across a tile's border their labels are linked, and the links are contracted to the smallest label. So no
    task holds more than a tile, whatever a page's size or a component's.
    """
    by_ = list(by)
    place = [F.floor(F.col(c) / tile).cast("int").alias(f"tile_{c}") for c in "yx"]
    dealt = pixels.select(*by_, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *place)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        top, side = int(frame["tile_y"].iloc[0]) * tile, int(frame["tile_x"].iloc[0]) * tile
        y, x = frame["y"].to_numpy(np.int64) - top, frame["x"].to_numpy(np.int64) - side
        mask = np.zeros((y.max() + 1, x.max() + 1), bool)
        mask[y, x] = True
        first_y, first_x = np.divmod(label_array(mask, eight)[y, x] - 1, mask.shape[1])
        return frame[[*by_, "y", "x"]].assign(label_y=(first_y + top).astype(np.int32), label_x=(first_x + side).astype(np.int32))

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.select(*by_).schema.fields)
    labelled = saved(dealt.groupBy(*by_, "tile_y", "tile_x").applyInPandas(run, f"{keys}, y int, x int, label_y int, label_x int"))
    # A pixel of a tile's last row or column looks at its neighbours beyond; each pair of touching pixels is met once.
    beyond = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in beyond])
    named = F.struct("label_y", "label_x")
    own = labelled.where(F.expr(f"pmod(y, {tile}) = {tile - 1} or pmod(x, {tile}) in (0, {tile - 1})")).select(*by_, "y", "x", named.alias("u"), F.explode(steps).alias("s"))
    own = own.select(*by_, "u", (F.col("y") + F.col("s.dy")).alias("ny"), (F.col("x") + F.col("s.dx")).alias("nx"), "y", "x")
    own = own.where(F.expr(f"floor(ny / {tile}) <> floor(y / {tile}) or floor(nx / {tile}) <> floor(x / {tile})")).select(*by_, "u", F.col("ny").alias("y"), F.col("nx").alias("x"))
    edge = labelled.where(F.expr(f"pmod(y, {tile}) = 0 or pmod(x, {tile}) in (0, {tile - 1})")).select(*by_, "y", "x", named.alias("v"))
    roots = contract(own.join(edge, [*by_, "y", "x"]).select(*by_, "u", "v"), by_)
    rooted = labelled.withColumn("node", named).join(roots, [*by_, "node"], "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.select(*by_, "y", "x", F.col("root.label_y").alias("label_y"), F.col("root.label_x").alias("label_x"))


def component_stats(labelled: DataFrame, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Area, bounding box and centroid of each component."""
    return labelled.groupBy(*by, "label_y", "label_x").agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
        F.round(F.avg("x"), 4).alias("cx"), F.round(F.avg("y"), 4).alias("cy"))


def rasterise(segments: DataFrame, thickness: int = 1) -> DataFrame:
    """Pixels of segments (page_id, x0, y0, x1, y1): one step along the longer way a pixel, then widened."""
    steps = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))).cast("int")
    t = segments.withColumn("n", steps).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    part = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("k") / F.col("n"))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * part + 0.5).cast("int")
    pixels = t.select("page_id", at("y0", "y1").alias("y"), at("x0", "x1").alias("x")).distinct()
    r = thickness // 2
    return dilate(pixels, r, r, 1 << 20, 1 << 20) if r else pixels


def fill_boxes(boxes: DataFrame, pad: int = 0) -> DataFrame:
    """Pixels of boxes (page_id, x0, y0, x1, y1), widened by ``pad``."""
    span = lambda a, b: F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col(a)).cast("int") - pad), F.ceil(F.col(b)).cast("int") + pad))
    return boxes.withColumn("y", span("y0", "y1")).withColumn("x", span("x0", "x1")).select("page_id", "y", "x").distinct()


def fill_polygon(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """Boolean array of a polygon's inside by even-odd scan lines through pixel centres, its border included."""
    out = np.zeros((height, width), bool)
    a, b = points, np.roll(points, -1, axis=0)
    for y in range(max(0, int(points[:, 1].min())), min(height - 1, int(points[:, 1].max())) + 1):
        cross = (a[:, 1] <= y) != (b[:, 1] <= y)
        xs = np.sort(a[cross, 0] + (y - a[cross, 1]) * (b[cross, 0] - a[cross, 0]) / (b[cross, 1] - a[cross, 1]))
        for lo, hi in zip(xs[::2], xs[1::2], strict=False):
            out[y, max(0, int(np.ceil(lo))) : min(width - 1, int(np.floor(hi))) + 1] = True
    for (x0, y0), (x1, y1) in zip(a, b, strict=True):
        n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
        xs, ys = np.rint(np.linspace(x0, x1, n)).astype(int), np.rint(np.linspace(y0, y1, n)).astype(int)
        ok = (xs >= 0) & (ys >= 0) & (xs < width) & (ys < height)
        out[ys[ok], xs[ok]] = True
    return out


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each set pixel from the nearest unset one, exactly: column distances, then the least over a row.

    Rows are searched, a few at a time, only as far as the greatest distance found in them, so thin strokes take few passes.
    """
    h, w = mask.shape
    far = h + w
    g = np.where(mask, far, 0).astype(np.int32)
    for y in range(1, h):
        g[y] = np.minimum(g[y], g[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        g[y] = np.minimum(g[y], g[y + 1] + 1)
    g *= g
    out = g.copy()
    for top in range(0, h, 16):
        near, own = out[top : top + 16], g[top : top + 16]
        for k in range(1, w):
            if k * k >= near.max(initial=0):
                break
            np.minimum(near[:, k:], own[:, :-k] + k * k, out=near[:, k:])
            np.minimum(near[:, :-k], own[:, k:] + k * k, out=near[:, :-k])
    return np.sqrt(out.astype(float))


#: The eight ways from a pixel, clockwise as (x, y), and for each set of neighbours the way that is taken when facing one; -1 for a single pixel.
_WAYS = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
_TURNS = [[next((k for k in ((facing + 6 + turn) % 8 for turn in range(8)) if around >> k & 1), -1) for facing in range(8)] for around in range(256)]


def contour(mask: np.ndarray) -> np.ndarray:
    """Outer border of the component with the first set pixel, clockwise as (x, y), by following its edge until it leaves the
    first pixel as it did at first; a pixel that parts meet at is passed each time."""
    h, w = mask.shape
    first = int(mask.argmax()) if mask.size else 0
    if not mask.size or not mask.ravel()[first]:
        return np.zeros((0, 2), int)
    # A frame of unset pixels around the mask; of each pixel which of its neighbours are set, a bit for each way.
    wide = np.pad(mask, 1)
    around = np.zeros((h + 2, w + 2), np.uint8)
    for k, (dx, dy) in enumerate(_WAYS):
        around[1:-1, 1:-1] |= wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w].astype(np.uint8) << k
    around, steps = around.tobytes(), [dy * (w + 2) + dx for dx, dy in _WAYS]
    start = here = (first // w + 1) * (w + 2) + first % w + 1
    facing, out = 0, [start]
    for _ in range(4 * h * w):
        facing = _TURNS[around[here]][facing]
        if facing < 0:
            break
        last, here = here, here + steps[facing]
        if last == start and len(out) > 2 and here == out[1]:
            out.pop()
            break
        out.append(here)
    y, x = np.divmod(np.array(out), w + 2)
    return np.stack([x - 1, y - 1], axis=1)


def simplify(points: np.ndarray, eps: float) -> np.ndarray:
    """Fewest-corner polyline within ``eps`` by recursive farthest points; a closed one is split at its two farthest points."""
    if len(points) < 3:
        return points

    def keep(lo: int, hi: int, marked: np.ndarray) -> None:
        todo = [(lo, hi)]
        while todo:
            i, j = todo.pop()
            if j - i < 2:
                continue
            px, py = x[i + 1 : j] - x[i], y[i + 1 : j] - y[i]
            dx, dy = x[j] - x[i], y[j] - y[i]
            n = np.hypot(dx, dy)
            dist = np.abs(dx * py - dy * px) / n if n else np.hypot(px, py)
            k = int(dist.argmax())
            if dist[k] > eps:
                marked[i + 1 + k] = True
                todo += [(i, i + 1 + k), (i + 1 + k, j)]

    far = int(np.hypot(*(points - points[0]).T.astype(float)).argmax())
    ring = np.vstack((points, points[:1]))
    x, y = np.ascontiguousarray(ring.T, float)
    marked = np.zeros(len(ring), bool)
    marked[[0, far]] = True
    keep(0, far, marked)
    keep(far, len(ring) - 1, marked)
    return ring[:-1][marked[:-1]]


def perimeter(points: np.ndarray) -> float:
    return float(np.hypot(*(np.concatenate((points[1:], points[:1])) - points).T.astype(float)).sum()) if len(points) > 1 else 0.0


def area(points: np.ndarray) -> float:
    x, y = points.T.astype(float) if len(points) else (np.zeros(0), np.zeros(0))
    return float(abs(np.dot(x, np.append(y[1:], y[:1])) - np.dot(y, np.append(x[1:], x[:1]))) / 2)


def png(image: np.ndarray) -> bytes:
    """An array of gray, gray and alpha, RGB or RGBA as a PNG file."""
    h, w, channels = image.shape
    kind_of = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.hstack((np.zeros((h, 1), np.uint8), image.reshape(h, w * channels).astype(np.uint8)))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind_of, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def unpng(data: bytes) -> np.ndarray:
    """Array of an eight-bit PNG without interlacing: gray, gray and alpha, RGB or RGBA."""
    at, body, head = 8, b"", None
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        kind = data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + n])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    w, h, depth, color, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[color]
    if depth != 8 or interlace:
        raise ValueError("only eight-bit images without interlacing are supported")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    kind, line = raw[:, 0], raw[:, 1:].reshape(h, w, channels).astype(np.int16)
    if not kind.any():
        return raw[:, 1:].reshape(h, w, channels).copy()
    # A pixel needs those to its left, above and in the corner between, so all of one diagonal are taken at once.
    out = np.zeros((h + 1, w + 1, channels), np.int16)
    for t in range(h + w - 1):
        y = np.arange(max(0, t - w + 1), min(h, t + 1))
        x = t - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.choose(kind[y][:, None], (np.zeros_like(left), left, up, (left + up) // 2, nearest))
        out[y + 1, x + 1] = (line[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def mask_of(image: np.ndarray, alpha_over: int = 10, gray_over: int = 10) -> np.ndarray:
    """Set pixels of a decoded mask: by alpha where there is one, else by gray."""
    if image.shape[2] in (2, 4):
        return image[:, :, -1] > alpha_over
    gray = image[:, :, 0] if image.shape[2] == 1 else np.rint(image[:, :, :3] @ np.array([0.299, 0.587, 0.114]))
    return gray > gray_over


def decoded(masks: DataFrame, height: int, width: int, *, alpha_over: int = 10, gray_over: int = 10) -> DataFrame:
    """(page_id, y, x0, x1): runs of set pixels of masks(page_id, mask_b64), resized to a page of height x width by nearest index.

    A mask is a PNG in base64, with or without a data-URL prefix: by alpha where it has one, else by gray. What cannot be
    decoded is left out, and so are nulls; several masks of a page give the runs of each.
    """

    def run(batches):
        for batch in batches:
            out = []
            for page, text in zip(batch["page_id"].tolist(), batch["mask_b64"].tolist(), strict=True):
                try:
                    mask = resize_nearest(mask_of(unpng(base64.b64decode(text.split(",")[-1], validate=True)), alpha_over, gray_over), height, width)
                except Exception:  # whatever is wrong with it, it is no mask
                    continue
                edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                (y, x0), x1 = np.nonzero(edge == 1), np.nonzero(edge == -1)[1] - 1
                out.append(pd.DataFrame({"page_id": page, "y": y.astype(np.int32), "x0": x0.astype(np.int32), "x1": x1.astype(np.int32)}))
            if out:
                yield pd.concat(out)

    return masks.where("mask_b64 is not null").select("page_id", "mask_b64").mapInPandas(run, "page_id long, y int, x0 int, x1 int")


def resize_nearest(a: np.ndarray, height: int, width: int) -> np.ndarray:
    ys, xs = np.arange(height) * a.shape[0] // height, np.arange(width) * a.shape[1] // width
    return a[ys][:, xs]
