"""Declared schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_NTZ = T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _dec(precision: int, scale: int) -> T.DecimalType:
    return T.DecimalType(precision, scale)


WASTE_BINS = _struct(
    bin_id=T.IntegerType(), bin_code=T.StringType(), location=T.StringType(),
    latitude=_dec(10, 8), longitude=_dec(11, 8), capacity=T.IntegerType(),
    bin_type=T.StringType(), status=T.StringType(), installed_date=_NTZ,
    last_maintenance=_NTZ, created_at=_NTZ, updated_at=_NTZ)

SENSORS = _struct(
    sensor_id=T.IntegerType(), sensor_code=T.StringType(), bin_id=T.IntegerType(),
    sensor_type=T.StringType(), manufacturer=T.StringType(), model=T.StringType(),
    firmware_version=T.StringType(), status=T.StringType(), installed_date=_NTZ,
    last_calibration=_NTZ, created_at=_NTZ, updated_at=_NTZ,
    mac_address=T.StringType(), weight_offset=T.DoubleType())

SENSOR_READINGS = _struct(
    reading_id=T.LongType(), sensor_id=T.IntegerType(), bin_id=T.IntegerType(),
    fill_level=_dec(5, 2), distance_cm=_dec(6, 2), weight_kg=_dec(8, 2),
    temperature_c=_dec(5, 2), humidity=_dec(5, 2), gas_level=_dec(5, 2),
    battery_level=_dec(5, 2), signal_strength=T.IntegerType(), timestamp=_NTZ,
    created_at=_NTZ)

COLLECTIONS = _struct(
    collection_id=T.LongType(), bin_id=T.IntegerType(), collected_by=T.StringType(),
    vehicle_id=T.StringType(), collection_time=_NTZ, fill_level_before=_dec(5, 2),
    weight_collected=_dec(8, 2), duration_minutes=T.IntegerType(), notes=T.StringType(),
    created_at=_NTZ)

ALERTS = _struct(
    alert_id=T.LongType(), bin_id=T.IntegerType(), alert_type=T.StringType(),
    severity=T.StringType(), message=T.StringType(), triggered_at=_NTZ,
    resolved_at=_NTZ, resolved_by=T.StringType(), status=T.StringType(),
    created_at=_NTZ, updated_at=_NTZ)

COLLECTION_ROUTES = _struct(
    route_id=T.IntegerType(), route_name=T.StringType(), description=T.StringType(),
    estimated_duration_minutes=T.IntegerType(), status=T.StringType(), created_at=_NTZ,
    updated_at=_NTZ)

ROUTE_BINS = _struct(
    route_bin_id=T.IntegerType(), route_id=T.IntegerType(), bin_id=T.IntegerType(),
    sequence_order=T.IntegerType(), estimated_time_minutes=T.IntegerType(), created_at=_NTZ)

# One telemetry message: where it came from, its raw text, its place in arrival order.
MESSAGES = _struct(topic=T.StringType(), payload=T.StringType(), arrival_seq=T.LongType(),
                   arrival_ts=_NTZ)

DEVICE_ITEMS = _struct(item_seq=T.IntegerType(), mac_address=T.StringType(),
                       device_name=T.StringType(), bin_id=T.IntegerType(),
                       weight_offset=T.DoubleType())

TABLES = {
    "waste_bins": WASTE_BINS, "sensors": SENSORS, "sensor_readings": SENSOR_READINGS,
    "collections": COLLECTIONS, "alerts": ALERTS, "collection_routes": COLLECTION_ROUTES,
    "route_bins": ROUTE_BINS,
}

# Column defaults applied where a writer leaves a value out: a literal, or the time of
# the write ("now").
DEFAULTS = {
    "waste_bins": {"status": "active", "installed_date": "now", "created_at": "now",
                   "updated_at": "now"},
    "sensors": {"status": "active", "installed_date": "now", "created_at": "now",
                "updated_at": "now"},
    "sensor_readings": {"timestamp": "now", "created_at": "now"},
    "collections": {"collection_time": "now", "created_at": "now"},
    "alerts": {"status": "open", "triggered_at": "now", "created_at": "now",
               "updated_at": "now"},
    "collection_routes": {"status": "active", "created_at": "now", "updated_at": "now"},
    "route_bins": {"created_at": "now"},
}
