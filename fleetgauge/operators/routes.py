"""Route manifests and sensor geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def route_manifest(routes: DataFrame, route_bins: DataFrame, status: DataFrame) -> DataFrame:
    """The stops of each route in order, with the current status of their bins.

    The route's minutes are summed apart from the stops and joined back, so a long
    route is added up before any exchange.
    """
    minutes = route_bins.groupBy("route_id").agg(
        F.sum("estimated_time_minutes").alias("route_minutes"),
        F.count(F.lit(1)).alias("route_stops"))
    now = status.select("bin_id", "bin_code", "location", "fill_level", "fill_status", "bin_status")
    return (route_bins.join(routes.select("route_id", "route_name"), "route_id")
            .join(minutes, "route_id").join(now, "bin_id", "left")
            .select("route_id", "route_name", "sequence_order", "bin_id", "bin_code", "location",
                    "bin_status", "fill_level", "fill_status", "estimated_time_minutes",
                    "route_minutes", "route_stops"))


def expected_distance(capacity: Column, fill: Column) -> Column:
    """Sensor to content: height is capacity / 10 * 0.8 cm, less the filled part."""
    # In units of 1/10000 cm everything is whole: capacity * 0.08 * (100 - fill) / 100.
    return (capacity.cast("decimal(10,0)") * F.lit("0.0008").cast("decimal(6,4)")
            * (F.lit(100).cast("decimal(5,2)") - fill)).cast("decimal(18,6)")


def geometry_check(readings: DataFrame, bins: DataFrame, tolerance_cm: float = 5.0) -> DataFrame:
    """Readings whose distance disagrees with their fill level by more than the tolerance."""
    sized = (readings.filter(F.col("distance_cm").isNotNull() & F.col("fill_level").isNotNull())
             .select("reading_id", "bin_id", "fill_level", "distance_cm")
             .join(bins.select("bin_id", "capacity"), "bin_id"))
    expected = expected_distance(F.col("capacity"), F.col("fill_level"))
    gap = F.abs(F.col("distance_cm") - F.col("expected_cm")).cast("decimal(18,6)")
    limit = F.lit(str(tolerance_cm)).cast("decimal(18,6)")
    return (sized.withColumn("expected_cm", expected).withColumn("gap_cm", gap)
            .filter(F.col("gap_cm") > limit)
            .select("reading_id", "bin_id", "fill_level", "distance_cm", "expected_cm", "gap_cm"))
