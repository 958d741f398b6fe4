"""Files as a stream, and windows over events. These go beyond the batch operators.

New sheets are read once each; every micro-batch writes its cells, and a batch that is
tried again after a failure writes the same part again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_files(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(folder)


def write_cells(spark: SparkSession, folder: str, out: str, checkpoint: str, profile: str = "classifier"):
    """Starts a query that reads each new file into cells under ``out``, one folder a batch."""
    from ..sources.files import sheets

    def batch(frame: DataFrame, number: int) -> None:
        paths = [r["path"] for r in frame.select("path").distinct().collect()]
        if paths:
            sheets(spark, paths, profile=profile).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return new_files(spark, folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def windowed(events: DataFrame, wide: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): counts and sums of events by window; batch or stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    x = events.withWatermark("ts", late) if events.isStreaming else events
    by = F.window("ts", wide, slide) if slide else F.window("ts", wide)
    return x.groupBy(by.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): a user's events with less than ``gap`` between them."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
