"""Versioned supports that are drawn anew as data arrives, and the views a consumer sees meanwhile."""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.session import shared_dir


def refresh_epochs(epochs: int, every: int, skip_last: bool = False) -> list[int]:
    """Epochs at which a new version is due: every k-th, not the first, and not so late that no interval is left."""
    due = [e for e in range(1, epochs) if e % every == 0]
    return [e for e in due if e + every <= epochs] if skip_last else due


def version_of(epochs: DataFrame, refreshes: DataFrame) -> DataFrame:
    """``(epoch, version)``: the last refresh at or before each epoch, -1 before the first."""
    both = epochs.select("epoch", F.lit(None).cast("long").alias("version"), F.lit(1).alias("o")).unionByName(refreshes.select("epoch", F.col("version").cast("long"), F.lit(0).alias("o")))
    w = Window.orderBy("epoch", "o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("version", F.coalesce(F.last("version", True).over(w), F.lit(-1))).where("o = 1").select("epoch", "version")


def mixed_backbone(edges: DataFrame, version: int, every: int = 3, seed: int = 0) -> DataFrame:
    """The backbone of a version: every k-th is the forest of largest weight, others are hashed forests of their own."""
    from edgeloom.operators.forest import random_forest, spanning_forest

    return spanning_forest(edges, [F.col("w").desc()]) if version % every == 0 else random_forest(edges, seed + version)


class Refresher:
    """Builds the next version in the background; until it is ready ``poll`` returns nothing and the old one stays."""

    def __init__(self, build):
        self.build, self.pool, self.waiting = build, ThreadPoolExecutor(1), None
        self.current: DataFrame | None = None

    def launch(self, version: int) -> bool:
        """Start a build unless one is unfinished or unapplied."""
        if self.waiting is not None:
            return False
        self.waiting: Future | None = self.pool.submit(self.build, version)
        return True

    def poll(self, wait: bool = False) -> DataFrame | None:
        """The new version if it is ready (or with ``wait`` when it is)."""
        if self.waiting is None or not (wait or self.waiting.done()):
            return None
        done, self.waiting = self.waiting, None
        self.current = done.result()
        return self.current


def edge_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events as a stream of directed pairs: each user and the value's whole part."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return s.select("ts", F.col("user_id").alias("src"), F.floor("value").cast("long").alias("dst"), "event_type")


def windowed_degrees(stream: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Degrees per window of event time, with a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "src").agg(F.count("*").alias("deg"))


def run_refresh(stream: DataFrame, select, every: int = 1, name: str = "supports") -> str:
    """Each k-th micro-batch writes a new version of ``select(batch, version)``; returns the folder of versions.

    A batch writes its own folder by its id, so a batch that is run again writes the same version.
    """
    folder = f"{shared_dir(stream.sparkSession)}/{name}"

    def each(batch: DataFrame, i: int) -> None:
        if i % every == 0:
            select(batch, i).write.mode("overwrite").parquet(f"{folder}/version={i}")

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return folder
