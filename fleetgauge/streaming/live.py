"""Live views over a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetgauge.functions.measures import mean
from fleetgauge.operators.status import latest_readings
from fleetgauge.operators.timeline import hourly_fill
from fleetgauge.streaming import snapshots

LATEST_SCHEMA = ("bin_id int, fill_level decimal(5,2), weight_kg decimal(8,2), "
                 "temperature_c decimal(5,2), battery_level decimal(5,2), signal_strength int, "
                 "last_reading timestamp_ntz")
HOURLY_SCHEMA = "hour timestamp_ntz, avg_fill_level double, reading_count long"


def _start(stream: DataFrame, path: str, checkpoint: str, schema: str, key: str,
           trigger: dict) -> StreamingQuery:
    snapshots.create(stream.sparkSession.createDataFrame([], schema), path)

    def write(batch: DataFrame, batch_id: int) -> None:
        snapshots.upsert(batch, path, [key], batch_id)

    writer = stream.writeStream.outputMode("update").foreachBatch(write)
    return (writer.option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "15 seconds"})).start())


def start_latest(readings: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the newest reading of every bin; the state is one row per bin."""
    return _start(latest_readings(readings), path, checkpoint, LATEST_SCHEMA, "bin_id", trigger)


def start_hourly(readings: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the hourly timeline.

    The state is one row per hour and no hour is ever closed, so however late a reading
    comes, the table equals the batch timeline.
    """
    return _start(hourly_fill(readings), path, checkpoint, HOURLY_SCHEMA, "hour", trigger)


def hourly_appended(readings: DataFrame, watermark: str = "24 hours") -> DataFrame:
    """The hourly timeline for append sinks: an hour comes out once, when it is over.

    Readings later than the watermark are not counted. Needs a UTC session, since a
    watermark wants a zoned timestamp.
    """
    timed = (readings.withColumn("event_time", F.col("timestamp").cast("timestamp"))
             .withWatermark("event_time", watermark))
    return (timed.groupBy(F.window("event_time", "1 hour").alias("_w"))
            .agg(mean("fill_level").alias("avg_fill_level"),
                 F.count(F.lit(1)).alias("reading_count"))
            .select(F.col("_w.start").cast("timestamp_ntz").alias("hour"),
                    "avg_fill_level", "reading_count"))
