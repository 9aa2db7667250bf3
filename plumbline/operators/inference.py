"""Model-backed steps: weights found and shipped once, a loader called once a worker process, applied to pages batch by batch.

No trained network comes with the library. A loader gets the path of the weights on its worker and returns an object with
``predict(image) -> array`` for pixel classes, or ``set_image(image)`` and ``predict(points, labels, box) -> (masks, scores)`` for
prompts; ``available`` says which loaders can run here, so that a plan can fall back to the relational path.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.steps import dealt

# Back ends for interactive masks in order of preference, and what each needs; sizes by a part of a checkpoint's name.
BACKENDS = [("sam2", "sam2"), ("sam1", "segment_anything"), ("mobile", "mobile_sam")]
SIZES = ["tiny", "small", "base_plus", "large"]


def available() -> list[str]:
    """Back ends whose library is installed."""
    return [name for name, module in BACKENDS if importlib.util.find_spec(module)]


def size_of(checkpoint):
    """The first size named in a checkpoint's file name, tiny by default."""
    out = F.lit("tiny")
    for size in reversed(SIZES):
        out = F.when(F.contains(F.lower(checkpoint), F.lit(size)), size).otherwise(out)
    return out


_loaded: dict[tuple, object] = {}


def discover(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of the paths, on any file system that the cluster names, at which there is a file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in candidates:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(conf).exists(where):
            return path
    return None


class Shipped:
    """A loader with its weights: the file goes to every executor once, and a worker process loads it once, when first asked."""

    def __init__(self, spark: SparkSession, weights: str, load: Callable[[str], object]):
        spark.sparkContext.addFile(weights)
        self.name, self.load = weights.rsplit("/", 1)[-1], load

    def __call__(self) -> object:
        key = (self.name, self.load.__module__, self.load.__qualname__)
        if key not in _loaded:
            _loaded[key] = self.load(SparkFiles.get(self.name))
        return _loaded[key]


def best_masks(images: DataFrame, prompts: DataFrame, loader: Callable[[], object]) -> DataFrame:
    """(key, best, score, runs) for prompts(key, page_id, points, box) over images(page_id, height, width, gray binary).

    A page's image is set once for all its prompts, and equal prompts of a page are asked once. points are structs (x, y, label), label 1 for what is meant and 0 for what is
    not; box is (x0, y0, x1, y1) or null. Of the masks that the model offers the one of the highest score is taken, the first
    of equal ones, as runs of pixels of a row. Prompts without points and box, or on pages without an image, have no row.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and left["gray"].iloc[0] is not None:
            model = loader()
            page = left.iloc[0]
            model.set_image(np.frombuffer(page["gray"], np.uint8).reshape(page["height"], page["width"]))
            for asked, box in right[["points", "box"]].itertuples(index=False):
                points = [] if asked is None else list(asked)
                if not points and box is None:
                    continue
                masks, scores = model.predict(np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2), np.array([p["label"] for p in points], int), None if box is None else np.array(box, float))
                k = int(np.argmax(scores))
                edge = np.diff(np.pad(masks[k], ((0, 0), (1, 1))).astype(np.int8), axis=1)
                (y, x0), x1 = np.nonzero(edge == 1), np.nonzero(edge == -1)[1] - 1
                rows.append((page["page_id"], asked, box, k, float(scores[k]), [{"y": a, "x0": b, "x1": c} for a, b, c in zip(y.tolist(), x0.tolist(), x1.tolist(), strict=True)]))
        return pd.DataFrame(rows, columns=["of", "asked", "within", "best", "score", "runs"])

    pages = dealt(images.select("page_id", "height", "width", "gray"), "page_id").groupBy("page_id")
    distinct = prompts.select("page_id", "points", "box").distinct()
    kinds = {f.name: f.dataType.simpleString() for f in distinct.schema.fields}
    masks = pages.cogroup(dealt(distinct, "page_id").groupBy("page_id")).applyInPandas(
        run, f"of {kinds['page_id']}, asked {kinds['points']}, within {kinds['box']}, best int, score double, runs array<struct<y:int,x0:int,x1:int>>")
    same = (F.col("page_id") == F.col("of")) & F.col("points").eqNullSafe(F.col("asked")) & F.col("box").eqNullSafe(F.col("within"))
    return prompts.select("page_id", "key", "points", "box").join(masks, same).select(F.col("key").cast("long").alias("key"), "best", "score", "runs")


def page_images(raster: DataFrame, height: int, width: int) -> DataFrame:
    """(page_id, height, width, gray) of raster(page_id, y, x, gray), a byte a pixel; pixels that it lacks are white."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        image = np.full((height, width), 255, np.uint8)
        image[frame["y"], frame["x"]] = frame["gray"]
        return pd.DataFrame({"page_id": [frame["page_id"].iloc[0]], "height": height, "width": width, "gray": [image.tobytes()]})

    on_page = raster.where(f"y between 0 and {height - 1} and x between 0 and {width - 1}")
    return on_page.groupBy("page_id").applyInPandas(run, "page_id long, height int, width int, gray binary")


def classified(images: DataFrame) -> DataFrame:
    """(page_id, y, x, room_cls, icon_cls): the classes of ``classify_pixels``, a row a pixel."""
    cell = F.explode(F.expr("sequence(0, height * width - 1)"))
    at = lambda c: F.conv(F.hex(F.substring(F.col(c), F.col("i") + 1, F.lit(1))), 16, 10).cast("int").alias(c)
    rows = images.select("page_id", "width", "room_cls", "icon_cls", cell.alias("i"))
    return rows.select("page_id", F.expr("cast(i div width as int)").alias("y"), F.expr("i % width").alias("x"), at("room_cls"), at("icon_cls"))


def classify_pixels(images: DataFrame, loader: Callable[[], object]) -> DataFrame:
    """(page_id, height, width, room_cls, icon_cls) from images(page_id, height, width, gray binary).

    The model gives an array (channels, height, width): twelve room channels from 21, eleven icon channels from 33;
    the classes are the arg max of each group, one byte a pixel. Rows whose image is null are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loader()
        for batch in batches:
            rows = []
            for page, h, w, gray in batch[["page_id", "height", "width", "gray"]].itertuples(index=False):
                if gray is None:
                    continue
                scores = model.predict(np.frombuffer(gray, np.uint8).reshape(h, w))
                rows.append((page, h, w, scores[21:33].argmax(axis=0).astype(np.uint8).tobytes(), scores[33:44].argmax(axis=0).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["page_id", "height", "width", "room_cls", "icon_cls"])

    return images.select("page_id", "height", "width", "gray").mapInPandas(run, "page_id long, height int, width int, room_cls binary, icon_cls binary")


def class_of(channels: str, first: int, n: int):
    """Which of ``n`` channels from ``first``, counted from 0, is the highest in an array column; the first of equal ones."""
    some = F.slice(F.col(channels), first + 1, n)
    return (F.array_position(some, F.array_max(some)) - 1).cast("int")
