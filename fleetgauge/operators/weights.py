"""Weights of the last 24 hours and weighing history."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window, functions as F

from fleetgauge.functions.labels import KILOGRAMS, fixed_text
from fleetgauge.functions.measures import total
from fleetgauge.functions.times import hours_before, in_range, moment
from fleetgauge.operators.status import recent_readings
from fleetgauge.streaming.partials import since


def weighings(readings: DataFrame) -> DataFrame:
    """Readings with a positive weight."""
    return readings.filter(F.col("weight_kg") > 0)


def daily_weight(bins: DataFrame, readings: DataFrame, as_of) -> DataFrame:
    """Per active bin: weight, weighings and last weighing of the rolling last 24 hours.

    Bins without a weighing stay, with zero.
    """
    recent = weighings(in_range(readings, hours_before(as_of, 24)))
    return _of_active_bins(bins, recent.groupBy("bin_id").agg(
        total("weight_kg").alias("total_weight_today"),
        F.count("reading_id").alias("reading_count_today"),
        F.max("timestamp").alias("last_reading_today")))


def daily_weight_of_partials(bins: DataFrame, partials: DataFrame, readings: DataFrame,
                             as_of) -> DataFrame:
    """``daily_weight`` from stored hourly partials; of the readings only the cut hour is read."""
    recent = since(partials, readings, moment(as_of) - timedelta(hours=24))
    return _of_active_bins(bins, recent.groupBy("bin_id").agg(
        F.sum("weight_sum").alias("total_weight_today"),
        F.sum("weighing_count").alias("reading_count_today"),
        F.max("last_weighing").alias("last_reading_today")))


def _of_active_bins(bins: DataFrame, per_bin: DataFrame) -> DataFrame:
    return (bins.filter(F.col("status") == "active").select("bin_id", "bin_code", "location")
            .join(per_bin, "bin_id", "left")
            .withColumn("total_weight_today",
                        F.coalesce("total_weight_today", F.lit(0)).cast("decimal(18,2)"))
            .withColumn("reading_count_today",
                        F.coalesce("reading_count_today", F.lit(0).cast("long"))))


def daily_weight_total(daily: DataFrame) -> DataFrame:
    """The sum over the fleet, with room for any number of bins."""
    fleet_sum = F.sum(F.col("total_weight_today").cast("decimal(28,2)"))
    return daily.agg(F.coalesce(fleet_sum, F.lit(0)).cast("decimal(38,2)").alias("total_weight_today"))


def weighing_history(readings: DataFrame, n: int = 10, bin_id: int | None = None) -> DataFrame:
    """Weighings among the newest ``n`` readings of each bin, the newest one marked."""
    kept = weighings(recent_readings(readings, n, bin_id))
    newest = F.row_number().over(Window.partitionBy("bin_id").orderBy("rank")) == 1
    return kept.select("bin_id", "reading_id", "rank", "timestamp", "weight_kg",
                       F.concat(fixed_text(F.col("weight_kg"), 3), F.lit(KILOGRAMS))
                       .alias("weight_text"),
                       newest.alias("is_newest"))
