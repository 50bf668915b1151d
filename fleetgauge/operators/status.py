"""Current status per bin and fleet statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetgauge.functions.levels import NEARLY_FULL, fill_status
from fleetgauge.functions.measures import exact_mean
from fleetgauge.operators.collections import recent_collection_count, recent_collections
from fleetgauge.plans.keyed import latest_per_key, single_row, top_n_per_key

MEASURES = ["fill_level", "weight_kg", "temperature_c", "battery_level", "signal_strength"]
STATUS_COLUMNS = ["bin_id", "bin_code", "location", "latitude", "longitude", "capacity",
                  "bin_type", "bin_status", *MEASURES, "last_reading", "fill_status",
                  "open_alerts"]


def latest_readings(readings: DataFrame) -> DataFrame:
    """The newest reading of each bin; of equal times the greater reading_id."""
    timed = readings.filter(F.col("timestamp").isNotNull())
    return (latest_per_key(timed, ["bin_id"], [*MEASURES, "timestamp"],
                           ["timestamp", "reading_id"])
            .withColumnRenamed("timestamp", "last_reading"))


def open_alert_counts(alerts: DataFrame) -> DataFrame:
    return (alerts.filter(F.col("status") == "open").groupBy("bin_id")
            .agg(F.count(F.lit(1)).alias("open_alerts")))


def status_view(bins: DataFrame, latest: DataFrame, alerts: DataFrame) -> DataFrame:
    """The status columns from bins, their latest readings and the alerts."""
    return (bins.withColumnRenamed("status", "bin_status")
            .join(latest, "bin_id", "left")
            .join(open_alert_counts(alerts), "bin_id", "left")
            .withColumn("fill_status", fill_status(F.col("fill_level")))
            .withColumn("open_alerts", F.coalesce("open_alerts", F.lit(0).cast("long")))
            .select(*STATUS_COLUMNS))


def current_status(bins: DataFrame, readings: DataFrame, alerts: DataFrame) -> DataFrame:
    """Every bin with its newest reading, fill class and number of open alerts."""
    return status_view(bins, latest_readings(readings), alerts)


def active_bins(status: DataFrame, bin_status: str | None = None) -> DataFrame:
    """Active bins. A further status is and-ed, so any value but 'active' gives no rows."""
    kept = status.filter(F.col("bin_status") == "active")
    if bin_status:
        kept = kept.filter(F.col("bin_status") == bin_status)
    return kept


def of_bin(df: DataFrame, bin_id: int | None) -> DataFrame:
    """Point filter; None means no filter."""
    return df if bin_id is None else df.filter(F.col("bin_id") == bin_id)


def recent_readings(readings: DataFrame, n: int = 10, bin_id: int | None = None) -> DataFrame:
    """The newest ``n`` readings of each bin."""
    return top_n_per_key(of_bin(readings, bin_id), "bin_id",
                         [F.desc("timestamp"), F.desc("reading_id")], n)


def bin_detail(status: DataFrame, readings: DataFrame, collections: DataFrame,
               bin_id: int | None = None) -> dict[str, DataFrame]:
    """Status row, 10 newest readings and 5 newest collections, each keyed by bin.

    An unknown bin gives no status row.
    """
    return {"bin_info": of_bin(status, bin_id),
            "recent_readings": recent_readings(readings, 10, bin_id),
            "collections": recent_collections(collections, 5, bin_id)}


def bin_detail_rows(status: DataFrame, readings: DataFrame, collections: DataFrame) -> DataFrame:
    """The detail of every bin in one long frame: section, rank, time, fill, weight."""
    detail = bin_detail(status, readings, collections)
    info = detail["bin_info"].select(
        "bin_id", F.lit("status").alias("section"), F.lit(0).cast("long").alias("rank"),
        F.col("last_reading").alias("at"), "fill_level", "weight_kg")
    known = status.select("bin_id")
    rows = detail["recent_readings"].select(
        "bin_id", F.lit("reading").alias("section"), "rank", F.col("timestamp").alias("at"),
        "fill_level", "weight_kg")
    pickups = detail["collections"].select(
        "bin_id", F.lit("collection").alias("section"), "rank",
        F.col("collection_time").alias("at"), F.col("fill_level_before").alias("fill_level"),
        F.col("weight_collected").alias("weight_kg"))
    return info.unionByName(rows.unionByName(pickups).join(known, "bin_id", "left_semi"))


def fill_status_distribution(status: DataFrame) -> DataFrame:
    """Bins per fill class, over all bins."""
    return status.groupBy("fill_status").agg(F.count(F.lit(1)).alias("bin_count"))


def fleet_stats(status: DataFrame, alerts: DataFrame, collections: DataFrame,
                collections_as_of) -> DataFrame:
    """The key figures as one row; the status is evaluated once."""
    figures = status.agg(
        F.count_if(F.col("bin_status") == "active").alias("total_bins"),
        F.round(F.coalesce(exact_mean("fill_level"), F.lit(0.0)), 2).alias("avg_fill_level"),
        F.count_if(F.col("fill_level") >= NEARLY_FULL).alias("bins_need_attention"))
    return single_row(figures, open_alert_total(alerts),
                      recent_collection_count(collections, collections_as_of))


def open_alert_total(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(F.col("status") == "open").alias("active_alerts"))
