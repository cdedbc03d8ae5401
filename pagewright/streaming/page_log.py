"""Streaming forms: failure counts per window, and a translation memory that is upserted by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import memory as M


def failures(attempts: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Attempts and failures by tumbling window of ts; works on a stream or a table."""
    at = F.window("ts", window)
    return attempts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(at).agg(F.count("*").alias("attempts"), F.count_if("failed").alias("failures")).select(F.col("window.start").alias("start"), "attempts", "failures")


def upsert_memory(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes to its own folder, so that a repeated batch overwrites itself; `current` reads the newest rows."""
    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("age", F.lit(-number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(saved: DataFrame) -> DataFrame:
    """The newest row of each key."""
    newest = F.max_by(F.struct("src_text", "translated_text"), F.struct(-F.col("age"), F.col("translated_text"))).alias("row")
    return saved.groupBy(*M.KEY).agg(newest).select(*M.KEY, "row.*")
