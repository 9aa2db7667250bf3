"""Live state: last-writer-wins snapshots in micro-batches, and windowed counts of clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.state import latest


def snapshot_writer(spark: SparkSession, path: str, key: str, order: str):
    """A foreachBatch function that keeps, below ``path``, a version for each batch: the last row of each key so far.

    A batch reads the version before it and writes its own, so a batch that runs again writes the same rows; versions
    before that are removed, as no batch reads them any more.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        now = latest(batch, key, order)
        if batch_id:
            try:
                past = spark.read.parquet(f"{path}/v={batch_id - 1}")
                now = latest(past.unionByName(now.select(*past.columns)), key, order)
            except Exception as missing:
                if "PATH_NOT_FOUND" not in str(missing):
                    raise
        now.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v={batch_id - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return merge


def autosave(changes: DataFrame, path: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Starts the snapshot stream over all that is available, a micro-batch at a time."""
    writer = snapshot_writer(changes.sparkSession, path, key, order)
    return changes.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clicks_per_window(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Clicks by category and window; with a stream, windows end when the watermark has passed them."""
    held = events.withWatermark(time, late) if events.isStreaming else events
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return held.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, *, time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with no gap of ``gap`` or more."""
    held = events.withWatermark(time, late) if events.isStreaming else events
    return held.groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
