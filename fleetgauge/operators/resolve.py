"""Messages to devices: registry lookup, calibration, referential checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetgauge.functions.measures import calibrated
from fleetgauge.operators.decode import GATED, LENIENT, decode_messages
from fleetgauge.plans.asof import holders_over_time, looked_up
from fleetgauge.plans.keyed import rehashed, spread_null

READING_COLUMNS = ["reading_id", "sensor_id", "bin_id", "fill_level", "distance_cm", "weight_kg",
                   "temperature_c", "humidity", "gas_level", "battery_level", "signal_strength",
                   "timestamp", "created_at"]


def registry_by(sensors: DataFrame, key: str, name: str, prefix: str) -> DataFrame:
    """One registry row per value of a column: that of the lowest sensor_id.

    Made of the registry alone, so that its planned size is that of the registry and a small
    one is broadcast.
    """
    return (sensors.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(name))
            .agg(F.min_by(F.struct("sensor_id", "bin_id", "weight_offset"), "sensor_id").alias("s"))
            .select(rehashed(F.col(name)).alias(name), F.col("s.sensor_id").alias(f"{prefix}_sensor_id"),
                    F.col("s.bin_id").alias(f"{prefix}_bin_id"),
                    F.col("s.weight_offset").alias(f"{prefix}_offset")))


#: In a registry with this column, rows are states of a device or bin from that time on.
SINCE = "valid_from"
#: True in a state from which on the device or bin is gone.
REMOVED = "removed"


def is_history(registry: DataFrame) -> bool:
    return SINCE in registry.columns


def _found(frame: DataFrame, registry: DataFrame, column: str, name: str, prefix: str) -> DataFrame:
    """``frame`` with the device whose ``column`` equals its ``name``, now or at arrival."""
    found = [f"{prefix}_sensor_id", f"{prefix}_bin_id", f"{prefix}_offset"]
    if not is_history(registry):
        return frame.join(registry_by(registry, column, name, prefix), name, "left")
    held = holders_over_time(registry, column, "sensor_id", SINCE, REMOVED, ["bin_id", "weight_offset"])
    return looked_up(frame, held.toDF(name, SINCE, *found), name, "arrival_ts", SINCE, found)


def _known_bins(frame: DataFrame, bins: DataFrame, name: str, flag: str) -> DataFrame:
    """``frame`` with ``flag`` true where a bin ``name`` exists, now or at arrival."""
    if not is_history(bins):
        known = bins.select(F.col("bin_id").cast("string").alias(name), F.lit(True).alias(flag))
        return frame.join(known, name, "left")
    there = F.when(~F.coalesce(F.col(REMOVED), F.lit(False)), F.lit(True))
    known = bins.select(F.col("bin_id").cast("string").alias(name), SINCE, there.alias(flag))
    return looked_up(frame, known, name, "arrival_ts", SINCE, [flag])


def classify_messages(messages: DataFrame, sensors: DataFrame, bins: DataFrame) -> DataFrame:
    """Every subscribed message with its reading, or with the reason it gives none.

    The registry is asked by MAC first, and then its bin replaces the payload's; else by
    sensor code, and the payload's bin counts. Sensor status plays no part. The lookups
    carry no broadcast hint: Spark broadcasts a registry below its size limit and
    otherwise joins by key, splitting hot devices at run time.

    A registry with ``valid_from`` is a history: a message meets the states of its
    arrival, so a backfill resolves as the live stream did. ``sensors`` and ``bins`` may
    be histories each by itself; their rows with ``removed`` end a device or bin.
    """
    # A rejected message needs no device; its lookup keys are spread like missing ones.
    keyed = decode_messages(messages).withColumn("mac", spread_null(
        F.expr("CASE WHEN reason IS NULL THEN nullif(mac, '') END"), F.col("arrival_seq")))
    by_mac = _found(keyed, sensors, "mac_address", "mac", "m")

    coded = by_mac.withColumn("_code", spread_null(
        F.expr("CASE WHEN reason IS NULL AND m_sensor_id IS NULL THEN sensor_code END"),
        F.col("arrival_seq")))
    by_code = _found(coded, sensors, "sensor_code", "_code", "c").drop("c_bin_id")

    resolved = _known_bins(by_code.withColumn("_bin", spread_null(
        F.expr("CASE WHEN reason IS NULL THEN CAST(payload_bin_id AS string) END"),
        F.col("arrival_seq"))), bins, "_bin", "payload_has_bin")
    # The bin of a device found by MAC, by the plain table of bins again.
    resolved = _known_bins(resolved.withColumn("_device_bin", spread_null(
        F.expr("CAST(m_bin_id AS string)"), F.col("arrival_seq"))), bins, "_device_bin", "m_has_bin")

    offset = F.expr("CASE WHEN m_sensor_id IS NOT NULL THEN m_offset ELSE c_offset END")
    placed = resolved.select(
        "*", F.expr("coalesce(m_sensor_id, c_sensor_id)").alias("sensor_id"),
        F.expr("CASE WHEN m_sensor_id IS NOT NULL THEN m_bin_id ELSE payload_bin_id END")
        .alias("bin_id"),
        F.expr("CASE WHEN m_sensor_id IS NOT NULL THEN m_has_bin ELSE payload_has_bin END")
        .alias("_has_bin"),
        F.coalesce(offset, F.lit(0.0)).alias("_offset"),
        calibrated(F.col("raw_weight_kg"), offset).alias("weight_kg"))
    # A boolean passes as a weight only where the offset turns it into a number.
    final_reason = F.expr("""CASE WHEN reason IS NOT NULL THEN reason
        WHEN sensor_id IS NULL THEN 'unknown_device'
        WHEN bin_id IS NULL THEN 'bad_bin'
        WHEN _has_bin IS NULL THEN 'unknown_bin'
        WHEN (raw_weight_kg IS NOT NULL AND weight_kg IS NULL)
             OR (weight_is_boolean AND _offset = 0) THEN 'bad_value' END""")
    return placed.select(
        *messages.columns, F.col("arrival_seq").alias("reading_id"), "sensor_id", "bin_id",
        *GATED, *LENIENT, "weight_kg", "signal_strength", "timestamp",
        F.col("arrival_ts").alias("created_at"), "bin_code", "payload_bin_id",
        F.expr("coalesce(payload_has_bin, false)").alias("payload_has_bin"),
        *[f"raw_{n}" for n in GATED], final_reason.alias("reason"))


def accepted_readings(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("reason").isNull()).select(*READING_COLUMNS)


def rejected_messages(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("reason").isNotNull()).select(
        "arrival_seq", "arrival_ts", "topic", "payload", "reason")


def split_by_registry(readings: DataFrame, sensors: DataFrame,
                      bins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings whose sensor and bin exist, and those that a foreign key would refuse."""
    known_sensors = sensors.select("sensor_id", F.lit(True).alias("_sensor"))
    known_bins = bins.select("bin_id", F.lit(True).alias("_bin"))
    marked = (readings.join(known_sensors, "sensor_id", "left")
              .join(known_bins, "bin_id", "left"))
    # A NULL reference is allowed by a foreign key.
    fits = ((F.col("_sensor").isNotNull() | F.col("sensor_id").isNull())
            & (F.col("_bin").isNotNull() | F.col("bin_id").isNull()))
    kept = marked.filter(fits).select(*readings.columns)
    refused = marked.filter(~fits).select(*readings.columns)
    return kept, refused
