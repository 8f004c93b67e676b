"""Scans that follow a stream: new manifests as they land, and a cache kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import utf8
from ..operators.graphs import upsert_cache
from ..sources import manifests

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def manifest_stream(spark: SparkSession, folder: str, watermark: str = "1 hour") -> DataFrame:
    """A stream of dependency rows of the files that appear under folder; a path is read once within the watermark."""
    raw = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).load(folder)
    fresh = raw.where(F.col("path").rlike(manifests.ANY_MANIFEST)).withWatermark("modificationTime", watermark).dropDuplicatesWithinWatermark(["path"])
    return manifests.extract(fresh.select("path", utf8(F.col("content")).alias("text")))


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per key and window of a stream, rows later than `late` left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def cache_sink(path: str):
    """A function for foreachBatch that folds batches of cache rows into tables path/epoch=N, the latest row per key.

    Each call reads the last complete table and writes the next one, under the batch's number or a later one.  So a stream
    that starts over (its numbers begin at 0 again) goes on from what is held, and a batch that runs twice adds nothing.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        last = last_epoch(batch.sparkSession, path)
        held = batch.limit(0) if last is None else batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/epoch={last}")
        at = epoch if last is None else max(epoch, last + 1)
        upsert_cache(held, batch).write.mode("overwrite").parquet(f"{path}/epoch={at}")

    return write


def last_epoch(spark: SparkSession, path: str) -> int | None:
    """The number of the last table below path whose write was finished; None without one."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(top):
        return None
    names = [s.getPath().getName() for s in store.listStatus(top)]
    done = [int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=") and n.removeprefix("epoch=").isdigit() and store.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max(done, default=None)
