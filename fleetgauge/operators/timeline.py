"""Hourly timelines."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from fleetgauge.functions.levels import fill_band
from fleetgauge.functions.measures import mean
from fleetgauge.functions.times import (DEFAULT_LOOKBACK_HOURS, check_lookback, hours_before,
                                        in_range, moment)
from fleetgauge.streaming.partials import since


def by_hour(df: DataFrame, column: str, *keys: str):
    """Rows grouped by the hour of a naive timestamp, free of the session zone."""
    return df.groupBy(F.window(column, "1 hour").alias("_w"), *keys)


def hourly_fill(readings: DataFrame) -> DataFrame:
    """Mean fill and number of readings per hour; hours without readings are absent."""
    return by_hour(readings, "timestamp").agg(
        mean("fill_level").alias("avg_fill_level"),
        F.count(F.lit(1)).alias("reading_count")).select(
            F.col("_w.start").alias("hour"), "avg_fill_level", "reading_count")


def fill_timeline(readings: DataFrame, as_of, hours: int = DEFAULT_LOOKBACK_HOURS) -> DataFrame:
    recent = in_range(readings, hours_before(as_of, check_lookback(hours)))
    return hourly_fill(recent).orderBy("hour")


def hourly_fill_of_partials(partials: DataFrame) -> DataFrame:
    """The timeline of ``hourly_fill`` from hourly partial sums."""
    sums = partials.groupBy("hour").agg(
        F.sum("fill_sum").alias("_sum"), F.sum("fill_count").alias("_count"),
        F.sum("reading_count").alias("reading_count"))
    average = F.round(F.try_divide(F.col("_sum").cast("double"), F.col("_count")), 6)
    return sums.select("hour", average.alias("avg_fill_level"), "reading_count")


def fill_timeline_of_partials(partials: DataFrame, readings: DataFrame, as_of,
                              hours: int = DEFAULT_LOOKBACK_HOURS) -> DataFrame:
    """``fill_timeline`` from stored partials; of the readings only the cut hour is read."""
    lower = moment(as_of) - timedelta(hours=check_lookback(hours))
    return hourly_fill_of_partials(since(partials, readings, lower)).orderBy("hour")


def alert_timeline(alerts: DataFrame, as_of, hours: int = DEFAULT_LOOKBACK_HOURS) -> DataFrame:
    """Alerts per hour and severity."""
    recent = in_range(alerts, hours_before(as_of, check_lookback(hours)),
                      column="triggered_at", date_column="triggered_date")
    return (by_hour(recent, "triggered_at", "severity").agg(F.count(F.lit(1)).alias("alert_count"))
            .select(F.col("_w.start").alias("hour"), "severity", "alert_count")
            .orderBy("hour", "severity"))


def fill_band_counts(readings: DataFrame) -> DataFrame:
    """Readings per traffic-light band."""
    return (readings.groupBy(fill_band(F.col("fill_level")).alias("band"))
            .agg(F.count(F.lit(1)).alias("reading_count")))
