"""Collections of bins: statistics, newest, inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetgauge.functions.measures import mean, total
from fleetgauge.functions.times import days_before, in_range
from fleetgauge.plans.keyed import top_n_per_key, with_previous

# A fill above the first, then at most the second, means it was emptied.
FULL_BEFORE = 85
EMPTY_AFTER = 10


def collection_stats(bins: DataFrame, collections: DataFrame) -> DataFrame:
    """Count, mean fill before, weight, last time and mean duration per bin."""
    per_bin = collections.groupBy("bin_id").agg(
        F.count("collection_id").alias("total_collections"),
        mean("fill_level_before").alias("avg_fill_before_collection"),
        total("weight_collected").alias("total_weight_collected"),
        F.max("collection_time").alias("last_collection_time"),
        mean("duration_minutes", kind="long").alias("avg_collection_duration"))
    return (bins.select("bin_id", "bin_code", "location").join(per_bin, "bin_id", "left")
            .withColumn("total_collections",
                        F.coalesce("total_collections", F.lit(0).cast("long"))))


def recent_collections(collections: DataFrame, n: int = 5, bin_id: int | None = None,
                       ties: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    """The newest ``n`` collections of each bin; equal times go by ``ties``, greatest first."""
    kept = collections if bin_id is None else collections.filter(F.col("bin_id") == bin_id)
    return top_n_per_key(kept, "bin_id", [F.desc(c) for c in ("collection_time", *ties)], n)


def recent_collection_count(collections: DataFrame, as_of, days: int = 7) -> DataFrame:
    recent = in_range(collections, days_before(as_of, days), column="collection_time",
                      date_column="collection_date")
    return recent.agg(F.count(F.lit(1)).alias("recent_collections"))


def infer_collections(readings: DataFrame) -> DataFrame:
    """Readings at which a bin was found emptied: nearly full before, nearly empty now."""
    keep = (F.col("previous") > FULL_BEFORE) & (F.col("fill_level") <= EMPTY_AFTER)
    rows = readings.filter("timestamp IS NOT NULL").select(
        "bin_id", "reading_id", "timestamp", "fill_level")
    return (with_previous(rows, "bin_id", "fill_level", ["timestamp", "reading_id"],
                          "timestamp", keep)
            .select("bin_id", "reading_id", F.col("timestamp").alias("collected_at"),
                    F.col("previous").alias("fill_before"), F.col("fill_level").alias("fill_after")))
