"""Hourly partial sums kept by a stream, so that timelines and weights rescan no readings.

A micro-batch adds one row per date, hour and bin that it touches: sums, counts and the
greatest time, all of which merge by adding up, so an hour is never closed and a reading
that comes days late is one more row. Nothing is held in streaming state. Batch N writes
``delta=N``; every few batches the dates touched since then are merged into ``base=N``, and
only those, so the work of merging follows the dates that changed. The partials of a date are
those of its newest base and of the deltas behind the newest base of all.

A replayed batch replaces its own folders. Only folders with a ``_SUCCESS`` file count.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetgauge.functions.measures import total
from fleetgauge.functions.times import DATE_COLUMN, in_range, ntz
from fleetgauge.streaming import snapshots

#: Batches between two bases.
COMPACT_EVERY = 20
PARTIAL_SCHEMA = ("hour timestamp_ntz, bin_id int, reading_count long, fill_sum decimal(18,2), "
                  "fill_count long, weight_sum decimal(18,2), weighing_count long, "
                  f"last_weighing timestamp_ntz, {DATE_COLUMN} date")

PARTIAL_COLUMNS = [c.split(" ")[0] for c in PARTIAL_SCHEMA.split(", ")]


def hourly_partials(readings: DataFrame) -> DataFrame:
    """One row per hour and bin of the readings that have a time."""
    weighed = F.col("weight_kg") > 0
    weights = readings.withColumn("_weight", F.when(weighed, F.col("weight_kg")))
    return (weights.groupBy(F.window("timestamp", "1 hour").alias("_w"), "bin_id").agg(
        F.count(F.lit(1)).alias("reading_count"), total("fill_level").alias("fill_sum"),
        F.count("fill_level").alias("fill_count"), total("_weight").alias("weight_sum"),
        F.count(F.when(weighed, F.col("reading_id"))).alias("weighing_count"),
        F.max(F.when(weighed, F.col("timestamp"))).alias("last_weighing"))
        .select(F.col("_w.start").alias("hour"), "bin_id", "reading_count", "fill_sum", "fill_count",
                "weight_sum", "weighing_count", "last_weighing",
                F.col("_w.start").cast("date").alias(DATE_COLUMN)))


def merged(partials: DataFrame) -> DataFrame:
    """Partials of one hour and bin added up."""
    return partials.groupBy(DATE_COLUMN, "hour", "bin_id").agg(
        F.sum("reading_count").alias("reading_count"),
        F.sum("fill_sum").cast("decimal(18,2)").alias("fill_sum"),
        F.sum("fill_count").alias("fill_count"),
        F.sum("weight_sum").cast("decimal(18,2)").alias("weight_sum"),
        F.sum("weighing_count").alias("weighing_count"),
        F.max("last_weighing").alias("last_weighing"))


def _written(partials: DataFrame, path: str) -> None:
    (partials.hint("rebalance", DATE_COLUMN).write.mode("overwrite").partitionBy(DATE_COLUMN)
     .parquet(path))


def add(readings: DataFrame, path: str, batch_id: int, compact_every: int = COMPACT_EVERY) -> None:
    """Add a batch's readings. Run again, a batch replaces what it wrote."""
    spark = readings.sparkSession
    _written(hourly_partials(readings), f"{path}/delta={batch_id}")
    if (batch_id + 1) % compact_every == 0:
        # A base of this batch may be there from an attempt that is running again.
        bases = [n for n in snapshots.numbers(spark, path, "base") if n < batch_id]
        deltas = [n for n in snapshots.numbers(spark, path, "delta")
                  if (bases[-1] if bases else -1) < n <= batch_id]
        changed = _dates(spark, path, [f"delta={n}" for n in deltas])
        kept = [f for f in _base_folders(spark, path, bases) if f.rpartition("=")[2] in changed]
        whole = _read(spark, path, [*kept, *(f"delta={n}" for n in deltas)])
        _written(merged(whole), f"{path}/base={batch_id}")


def _dates(spark: SparkSession, path: str, folders: list[str]) -> set[str]:
    """The dates that the folders hold; a listing of files, not a scan."""
    files = _read(spark, path, folders).inputFiles() if folders else []
    return {m.group(1) for m in (re.search(rf"/{DATE_COLUMN}=([^/]+)/", f) for f in files) if m}


def _base_folders(spark: SparkSession, path: str, bases: list[int]) -> list[str]:
    """For each date the folder of the newest base that holds it."""
    newest: dict[str, int] = {}
    for n in bases:
        newest |= dict.fromkeys(_dates(spark, path, [f"base={n}"]), n)
    return [f"base={n}/{DATE_COLUMN}={date}" for date, n in sorted(newest.items())]


def _read(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """The partials of base and delta folders, which are partitioned by different columns."""
    found = spark.createDataFrame([], PARTIAL_SCHEMA)
    for kind in ("base", "delta"):
        own = [f"{path}/{f}" for f in folders if f.startswith(kind)]
        if own:
            found = found.unionByName(spark.read.schema(PARTIAL_SCHEMA).option("basePath", path)
                                      .parquet(*own).select(*PARTIAL_COLUMNS))
    return found


def stored(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The partials as of batch ``upto``, or of the newest complete batch, not added up yet.

    A filter on the date opens only that date's folders.
    """
    reach = float("inf") if upto is None else upto
    bases = [n for n in snapshots.numbers(spark, path, "base") if n <= reach]
    deltas = [n for n in snapshots.numbers(spark, path, "delta")
              if (bases[-1] if bases else -1) < n <= reach]
    return _read(spark, path, [*_base_folders(spark, path, bases), *(f"delta={n}" for n in deltas)])


def start(readings: DataFrame, path: str, checkpoint: str, compact_every: int = COMPACT_EVERY,
          **trigger) -> StreamingQuery:
    """Keep the partials of a stream of readings, without any streaming state."""
    def write(batch: DataFrame, batch_id: int) -> None:
        add(batch, path, batch_id, compact_every)

    writer = readings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "15 seconds"})).start()


def since(partials: DataFrame, readings: DataFrame, lower: datetime) -> DataFrame:
    """Partials of all readings at or after a time.

    Whole hours come from the stored partials. The hour that the time cuts, if it does, comes
    from the readings, of which only that hour's date is opened.
    """
    first = lower.replace(minute=0, second=0, microsecond=0)
    if first != lower:
        first += timedelta(hours=1)
    whole = in_range(partials, ntz(first), column="hour").select(*PARTIAL_COLUMNS)
    if first == lower:
        return whole
    cut = in_range(readings, ntz(lower), ntz(first)).filter(F.col("timestamp") < ntz(first))
    return whole.unionByName(hourly_partials(cut))
