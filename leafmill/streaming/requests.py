"""Streams: new chunks into the table, and the log of requests.

The log arrives late and with repeats. A watermark bounds what is remembered; rows that come after it are dropped by
design of the window, and the batch query over the whole log stays exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

REQUEST_SCHEMA = "request_id bigint, query string, top_k int, search_type string, author string, `group` string, book_title string, requested_at timestamp_ntz, received_at timestamp_ntz"


def request_stream(spark: SparkSession, directory: str, glob: str = "requests*.parquet", schema: str = REQUEST_SCHEMA) -> DataFrame:
    """The request log as a stream of files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(directory)


def deduplicated(requests: DataFrame, delay: str = "3 days") -> DataFrame:
    """Retried rows once, as long as they come within the delay."""
    stamped = requests.withColumn("event_time", F.col("requested_at").cast("timestamp"))
    return stamped.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["request_id"])


def hourly_counts(requests: DataFrame, delay: str = "3 days") -> DataFrame:
    """Requests by hour and type; a window is final when the watermark has passed it."""
    counted = deduplicated(requests, delay).groupBy(F.window("event_time", "1 hour"), "search_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("hour"), "search_type", "n")


def hourly_totals(requests: DataFrame) -> DataFrame:
    """Requests by hour and type over the whole log, for mode 'complete': repeats are dropped and counts kept however late a row
    comes, with one without a time as well. What is remembered grows with the log, so this is for backfills."""
    once = requests.select("request_id", "search_type", "requested_at").dropDuplicates()
    return once.groupBy(F.date_trunc("hour", "requested_at").cast("timestamp_ntz").alias("hour"), "search_type").agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, target: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Everything that is there now, written to the Parquet table ``target`` and read back; for tests and backfills.

    In mode 'append' micro-batches are appended; in 'complete' each one replaces the table, so the last one stands.
    """
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or target + "-checkpoint")
    if mode == "append":
        query = writer.format("parquet").option("path", target).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target)).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def append_chunks(stream: DataFrame, target: str, checkpoint: str):
    """New chunks into the Parquet table, each micro-batch once. Returns the running query."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
