"""Structured Streaming forms of ingest: new files as they appear, and running counts per reader.

Files that fail become rows with `error` and can be set aside; the batch sink writes each batch
under its number, so a batch that runs again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.books import nodes


def new_files(spark: SparkSession, path: str, pattern: str = "*.{fb2,zip}", per_batch: int = 1000) -> DataFrame:
    """path and content of files as they appear below a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(path).select("path", "content")


def ingest(spark: SparkSession, path: str, to: str, checkpoint: str) -> StreamingQuery:
    """Write nodes of new books below `to`, those that failed below `to`/failed. Ends when all files present are done."""

    def batch(df: DataFrame, n: int) -> None:
        rows = nodes(df).persist()
        rows.where("error IS NULL").write.mode("overwrite").parquet(f"{to}/nodes/batch={n}")
        rows.where("error IS NOT NULL").select("book_id", "error").write.mode("overwrite").parquet(f"{to}/failed/batch={n}")
        rows.unpersist()

    return new_files(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and values by type in tumbling windows of event time; events later than `late` are let go. For tables and streams alike."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    t = t.withWatermark("ts", late) if events.isStreaming else t
    t = t.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return t.select(F.col("w.start").alias("start"), "event_type", "n", "total")
