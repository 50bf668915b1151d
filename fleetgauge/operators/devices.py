"""Device lists and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetgauge.functions.identity import canonical_mac
from fleetgauge.functions.labels import fixed_text, relative_label
from fleetgauge.functions.levels import is_online, relative_count, relative_unit


def sensors_with_bins(sensors: DataFrame, bins: DataFrame) -> DataFrame:
    """All sensors with the code and location of their bin."""
    return (sensors.join(bins.select("bin_id", "bin_code", "location"), "bin_id", "left")
            .select(*sensors.columns, "bin_code", "location").orderBy("sensor_id"))


def last_seen(readings: DataFrame) -> DataFrame:
    return readings.groupBy("sensor_id").agg(F.max("timestamp").alias("last_seen"))


def device_list(sensors: DataFrame, bins: DataFrame, readings: DataFrame) -> DataFrame:
    """Every device with its bin and the time of its last reading.

    Readings are reduced to one row per sensor before any join.
    """
    return (sensors.withColumnRenamed("manufacturer", "device_name")
            .join(bins.select("bin_id", "bin_code", "location"), "bin_id", "left")
            .join(last_seen(readings), "sensor_id", "left")
            .select("sensor_id", "sensor_code", "mac_address", "device_name", "weight_offset",
                    "status", "bin_id", "bin_code", "location", "last_seen")
            .orderBy("sensor_id"))


def registered_only(devices: DataFrame) -> DataFrame:
    """Devices with a MAC."""
    return devices.filter(F.col("mac_address").isNotNull() & (F.col("mac_address") != ""))


def device_report(devices: DataFrame, as_of) -> DataFrame:
    """Registered devices with online flag, relative last seen and offset text."""
    unit, count = relative_unit(F.col("last_seen"), as_of), relative_count(F.col("last_seen"), as_of)
    name = F.coalesce(F.nullif("device_name", F.lit("")), F.nullif("sensor_code", F.lit("")),
                      F.lit("—"))
    return registered_only(devices).select(
        "sensor_id", "mac_address", name.alias("device_name"),
        F.coalesce(F.nullif("bin_code", F.lit("")), F.lit("—")).alias("bin_code"),
        F.coalesce(fixed_text(F.col("weight_offset"), 2), F.lit("0.00")).alias("offset_text"),
        unit.alias("seen_unit"), count.alias("seen_count"),
        F.coalesce(relative_label(unit, count), F.lit("—")).alias("seen_text"),
        is_online(F.col("last_seen"), as_of).alias("online"))


def device_lookup(macs: DataFrame, sensors: DataFrame, bins: DataFrame) -> DataFrame:
    """Where each asked MAC belongs; one row per asked row.

    ``macs`` has a ``mac_address`` column as typed by the device. Only active sensors with
    an existing bin answer, the lowest sensor_id where several share a MAC; a miss has
    ``registered`` false.
    """
    places = bins.select("bin_id", "bin_code", "location")
    answers = (sensors.filter((F.col("status") == "active") & F.col("mac_address").isNotNull())
               .join(places, "bin_id")
               .groupBy(F.col("mac_address").alias("mac"))
               .agg(F.min_by(F.struct("sensor_id", "sensor_code", "bin_id", "bin_code",
                                      "location", "weight_offset"), "sensor_id").alias("s"))
               .select("mac", "s.*"))
    asked = macs.withColumn("mac", canonical_mac(F.col("mac_address"))).drop("mac_address")
    hit = F.col("sensor_id").isNotNull()
    return asked.join(answers, "mac", "left").select(
        *asked.columns, hit.alias("registered"), "sensor_id", "sensor_code",
        F.col("bin_id").cast("string").alias("bin_id"), "bin_code", "location",
        F.when(hit, F.coalesce("weight_offset", F.lit(0.0))).alias("weight_offset"))
