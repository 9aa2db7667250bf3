"""Intermediate tables in the shared folder that the cluster names.

Iterative operators cut their lineage by writing Parquet below ``spark.checkpoint.dir``, so a
lost executor costs the recomputation of one step and never the whole loop.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one of our own only where that is unset, on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    own = getattr(spark, "_plumbline_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark._plumbline_shared = own
    return own


class Scratch:
    """Names, writes and drops the tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/plumbline-{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._plumbline_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_plumbline_path", None)
        if path:
            self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; the folder's owner cleans up
            pass
