"""Streams: tone by quarter as documents arrive, and the newest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.sources.sinks import upsert_table


def arriving(spark: SparkSession, path: str, schema, files: int = 4) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(events: DataFrame, time: str, group: str, value: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Count and sum by window and group; rows later than the watermark are dropped."""
    stream = events.withColumn("t", F.col(time).cast("timestamp")).withWatermark("t", late)
    return stream.groupBy(F.window("t", window).alias("w"), group).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), group, "n", "total")


def quarter_tone(scored: DataFrame, time: str, late: str = "30 days") -> DataFrame:
    """Running word-weighted tone of each company and quarter, from chunks joined with their scores."""
    s = scored.withColumn("t", F.col(time).cast("timestamp")).withWatermark("t", late).dropDuplicatesWithinWatermark(["chunk_id"])
    w = F.col("words")
    return s.groupBy("ticker", "quarter", "year").agg((F.sum((F.col("positive") - F.col("negative")) * w) / F.sum(w)).alias("net_sentiment_score"), F.count("*").alias("chunk_count"))


def keep_newest(stream: DataFrame, path: str, key: str, checkpoint: str, order: str, partition: str | None = None):
    """Upserts every micro-batch into a table; the row of each key with the greatest order stays, so a late one doesn't replace a newer one.

    With a partition column only the partitions that a batch touches are rewritten.
    """

    def write(batch: DataFrame, _: int) -> None:
        upsert_table(batch.sparkSession, path, batch, key, order, partition)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
