"""Telemetry message sources: one envelope (topic, payload, arrival_seq, arrival_ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetgauge.sources.schemas import MESSAGES

# Fixed value: the subscription; one free level, which may be empty, between
# the two fixed parts.
TOPIC_PATTERN = r"\Awaste/bins/[^/]*/sensors\z"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Landed message envelopes (JSON lines) as a batch."""
    return spark.read.schema(MESSAGES).json(path)


def stream_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same folder as a stream of new files."""
    reader = spark.readStream.schema(MESSAGES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def from_kafka(records: DataFrame, partitions: int) -> DataFrame:
    """Envelopes from Kafka source columns; the record key carries the device topic.

    ``arrival_seq`` is a unique number made of the offset and the partition, with
    ``partitions`` the topic's fixed partition count. It orders messages within a partition
    only; over all of them arrival order is (``arrival_ts``, ``arrival_seq``).
    """
    return records.select(
        F.col("key").cast("string").alias("topic"),
        F.col("value").cast("string").alias("payload"),
        (F.col("offset") * F.lit(partitions) + F.col("partition")).cast("long").alias("arrival_seq"),
        F.col("timestamp").cast("timestamp_ntz").alias("arrival_ts"))


def subscribed(messages: DataFrame, pattern: str = TOPIC_PATTERN) -> DataFrame:
    """Messages on the subscribed topics; others are never delivered."""
    return messages.filter(F.col("topic").rlike(pattern))


def topic_level(topic: Column) -> Column:
    """The free level of a subscribed topic."""
    return F.regexp_extract(topic, r"\Awaste/bins/([^/]*)/sensors\z", 1)


def without_resends(stream: DataFrame, key: list[str], delay: str,
                    time_column: str = "arrival_ts") -> DataFrame:
    """Optional: drop repeats of ``key`` that arrive within ``delay`` of each other.

    Off by default in the jobs, since repeated deliveries are kept as rows.
    """
    marked = stream.withColumn("_event_time", F.col(time_column).cast("timestamp"))
    return (marked.withWatermark("_event_time", delay)
            .dropDuplicatesWithinWatermark(key).drop("_event_time"))
