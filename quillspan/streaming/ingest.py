"""Incremental ingest: new document files become chunks once, whatever is restarted; late events in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import chunking

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, target_tokens: int = 120) -> None:
    """Take all files that are new in source, write their chunks to target, and stop. The checkpoint knows what is done."""
    new = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", 64).parquet(source)
    chunks = chunking.chunks(new, target_tokens)
    chunks.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latency_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and means by window and type of (ts, event_type, value), batch or stream; late rows count until the watermark."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = seen.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "mean")
