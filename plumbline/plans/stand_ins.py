"""Deterministic models in place of trained ones, so that the model-backed steps run and can be held against SQL."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import SparkSession

from plumbline.operators.inference import Shipped, discover

#: What the stand-ins have for weights: reaches of the masks offered, and the factor of a channel's score.
RADII, PRIME = (3, 5, 8), 101


class Classes:
    """Forty-four channels, each a fixed rule of a pixel's gray."""

    def __init__(self, path: str):
        with open(path) as file:
            self.prime = json.load(file)["prime"]

    def predict(self, image: np.ndarray) -> np.ndarray:
        return np.stack([(image.astype(int) * (c + 3)) % self.prime for c in range(44)])


class Squares:
    """Squares of three sizes around the points that are meant, without smaller ones around those that are not, inside the box; the
    score is the share of dark pixels."""

    def __init__(self, path: str):
        with open(path) as file:
            self.radii = json.load(file)["radii"]
        self.image = None

    def set_image(self, image: np.ndarray) -> None:
        self.image = image

    def predict(self, points: np.ndarray, labels: np.ndarray, box: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        y, x = np.indices(self.image.shape)
        near = lambda p, r: (abs(x - p[0]) <= r) & (abs(y - p[1]) <= r)
        inside = np.ones(self.image.shape, bool) if box is None else (x >= box[0]) & (y >= box[1]) & (x <= box[2]) & (y <= box[3])
        masks = []
        for r in self.radii:
            mask = np.zeros(self.image.shape, bool)
            for p in points[labels == 1]:
                mask |= near(p, r)
            for p in points[labels == 0]:
                mask &= ~near(p, r // 2)
            masks.append(mask & inside)
        return np.stack(masks), np.array([np.mean(self.image[m] < 128) if m.any() else 0.0 for m in masks])


def shipped(spark: SparkSession, folder: str, kind: type) -> Shipped:
    """A stand-in with weights in ``folder``, looked for where they may lie."""
    path = f"{folder.rstrip('/')}/stand-in-{uuid.uuid4().hex[:8]}"
    spark.createDataFrame([(json.dumps({"radii": RADII, "prime": PRIME}),)], "value string").coalesce(1).write.text(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    parts = [str(f.getPath()) for f in where.getFileSystem(conf).listStatus(where) if f.getPath().getName().startswith("part-")]
    return Shipped(spark, discover(spark, [f"{folder.rstrip('/')}/no-such-weights", *parts]), kind)
