"""Registry changes as set-based batches: each gives outcome rows and a new snapshot.

Parquet tables have no MERGE; the snapshot is written to a new version folder by the
caller, never over the folder being read. Items that fail become error rows and the
rest of the batch goes on.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from fleetgauge.functions.identity import (canonical_mac, device_code, is_mac, mac_from_hex,
                                           name_or_mac, stripped, suffixed_code)
from fleetgauge.functions.times import ntz
from fleetgauge.plans.keyed import stacked
from fleetgauge.plans.settle import claimed_codes, sequenced_updates, written
from fleetgauge.sources.schemas import DEFAULTS

# What the registry calls devices it creates.
SENSOR_TYPE = "weight_scale"
NEW_STATUS = "active"


class RegistryChange(NamedTuple):
    results: DataFrame
    errors: DataFrame
    snapshot: DataFrame


class CascadeResult(NamedTuple):
    kept: dict[str, DataFrame]
    counts: DataFrame


def form_rows(rows: DataFrame) -> DataFrame:
    """Registration form rows with what is wrong with them.

    The MAC is formatted from the hex digits typed. A row needs a full MAC and a bin; a
    blank name becomes the MAC, a blank offset zero.
    """
    mac = mac_from_hex(F.coalesce("mac_address", F.lit("")))
    return rows.select(
        "item_seq", mac.alias("mac_address"),
        name_or_mac(F.coalesce("device_name", F.lit("")), mac).alias("device_name"),
        F.coalesce("bin_id", F.lit(0)).alias("bin_id"),
        F.coalesce("weight_offset", F.lit(0.0)).alias("weight_offset"),
        is_mac(mac).alias("mac_ok"), (F.coalesce("bin_id", F.lit(0)) != 0).alias("bin_ok"))


def register_devices(items: DataFrame, sensors: DataFrame, bins: DataFrame, as_of,
                     model: str | None = None) -> RegistryChange:
    """Upsert devices by MAC, as if items came one by one in order.

    The first item of a new MAC that finds a free code, plain or suffixed, creates the
    device; one that finds none is an error and leaves the MAC to later items. Items of a
    MAC that exists by then are updates, and the last good one decides bin, name and offset.
    """
    mac = canonical_mac(F.coalesce("mac_address", F.lit("")))
    # A batch may come in one file; its items are checked in all tasks.
    asked = items.repartition(F.col("item_seq")).select(
                         "item_seq", mac.alias("mac"),
                         name_or_mac(F.coalesce("device_name", F.lit("")), mac).alias("name"),
                         "bin_id", F.coalesce("weight_offset", F.lit(0.0)).alias("weight_offset"))
    open_bins = bins.filter(F.col("status") == "active").select("bin_id", "bin_code")
    known = (sensors.filter(F.col("mac_address").isNotNull())
             .groupBy(F.col("mac_address").alias("mac"))
             .agg(F.min("sensor_id").alias("known_id")))
    checked = written(asked.join(open_bins, "bin_id", "left").join(known, "mac", "left")
                      .withColumn("error", F.when(~is_mac(F.col("mac")), "invalid_mac")
                                  .when(F.col("bin_code").isNull(), "unknown_bin")), "register-items")
    good = checked.filter(F.col("error").isNull())

    base = device_code(F.col("name"), F.col("mac"))
    attempts = good.filter(F.col("known_id").isNull()).select(
        "mac", "item_seq", base.alias("base_code"), suffixed_code(base, F.col("mac")).alias("suffix_code"))
    created = claimed_codes(attempts, sensors.select(F.col("sensor_code").alias("code")))
    codes = created.select("mac", F.col("item_seq").alias("first_seq"), F.col("code").alias("sensor_code"))

    # Results, errors and rows are read from it, instead of joining again for each.
    outcome = written(good.join(codes, "mac", "left"), "register-outcome")
    is_first = F.coalesce(F.col("item_seq") == F.col("first_seq"), F.lit(False))
    no_code = F.col("known_id").isNull() & (F.col("first_seq").isNull()
                                            | (F.col("item_seq") < F.col("first_seq")))
    results = outcome.filter(~no_code).select(
        "item_seq", "mac", "bin_code",
        F.when(is_first, F.col("sensor_code")).alias("sensor_code"),
        F.when(is_first, "created").otherwise("updated").alias("action"))
    errors = (checked.filter(F.col("error").isNotNull()).select("item_seq", "mac", "error")
              .unionByName(outcome.filter(no_code).select(
                  "item_seq", "mac", F.lit("sensor_code_taken").alias("error"))))

    per_mac = outcome.filter(~no_code).groupBy("mac").agg(
        F.max_by(F.struct("bin_id", "name", "weight_offset"), "item_seq").alias("final"),
        F.max("first_seq").alias("first_seq"), F.max("sensor_code").alias("sensor_code"))
    final = per_mac.select(F.col("mac").alias("mac_address"),
                           F.col("final.bin_id").alias("new_bin_id"),
                           F.col("final.name").alias("new_name"),
                           F.col("final.weight_offset").alias("new_offset"))
    stamped = _with_column(sensors, "updated_at", "timestamp_ntz")
    changed = F.col("new_name").isNotNull()
    updated = _changed(stamped.join(final, "mac_address", "left"), changed, {
        "bin_id": F.col("new_bin_id"), "manufacturer": F.col("new_name"),
        "weight_offset": F.col("new_offset"), "updated_at": ntz(as_of)}, stamped.columns)

    last_id = sensors.agg(F.coalesce(F.max("sensor_id"), F.lit(0))).scalar()
    new = (per_mac.filter(F.col("first_seq").isNotNull())
           .select((last_id + F.col("first_seq")).cast("int").alias("sensor_id"), "sensor_code",
                   F.col("final.bin_id").alias("bin_id"),
                   F.lit(SENSOR_TYPE).alias("sensor_type"),
                   F.col("final.name").alias("manufacturer"), F.lit(model).cast("string").alias("model"),
                   F.lit(NEW_STATUS).alias("status"), F.col("mac").alias("mac_address"),
                   F.col("final.weight_offset").alias("weight_offset"),
                   *[ntz(as_of).alias(c) for c, value in DEFAULTS["sensors"].items()
                     if value == "now" and c in stamped.columns]))
    if "model" not in updated.columns:
        new = new.drop("model")
    return RegistryChange(results, errors, updated.unionByName(new, allowMissingColumns=True))


def _with_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def _changed(df: DataFrame, where: Column, values: dict[str, Column],
             columns: list[str]) -> DataFrame:
    """``columns`` of ``df`` with new values in the rows where ``where`` holds."""
    return df.select(*[F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values
                       else F.col(c) for c in columns])


def update_devices(updates: DataFrame, sensors: DataFrame, bins: DataFrame,
                   as_of) -> RegistryChange:
    """Change MAC, bin, name and offset of single devices, as if items came one by one.

    Checks run in this order: MAC form, device exists, MAC held by another device at that
    point, bin exists. Every item that passes is 'updated'; the last of a device counts.
    """
    asked = updates.select("item_seq", "sensor_id", canonical_mac(F.col("mac_address")).alias("mac"),
                           stripped(F.col("device_name")).alias("name"), "bin_id",
                           F.coalesce("weight_offset", F.lit(0.0)).alias("weight_offset"))
    ids = sensors.select("sensor_id", F.lit(True).alias("_exists"))
    places = bins.select("bin_id", F.lit(True).alias("_bin"))
    checked = written(asked.join(ids, "sensor_id", "left").join(places, "bin_id", "left")
                      .withColumn("bin_ok", F.col("_bin").isNotNull())
                      .withColumn("error", F.when(~is_mac(F.col("mac")), "invalid_mac")
                                  .when(F.col("_exists").isNull(), "not_found"))
                      .drop("_exists", "_bin"), "update-items")
    sound = checked.filter(F.col("error").isNull()).drop("error")
    decided = sequenced_updates(sound, sensors.select("sensor_id", F.col("mac_address").alias("mac")))

    passed = decided.filter(F.col("error").isNull())
    results = passed.select("item_seq", "sensor_id", "mac", F.lit("updated").alias("action"))
    shape = ["item_seq", "sensor_id", "mac", "error"]
    errors = checked.filter(F.col("error").isNotNull()).select(*shape).unionByName(
        decided.filter(F.col("error").isNotNull()).select(*shape))
    applied = passed.groupBy("sensor_id").agg(F.max_by(
        F.struct("mac", "bin_id", "name", "weight_offset"), "item_seq").alias("a")).select(
            "sensor_id", "a.*")

    stamped = _with_column(sensors, "updated_at", "timestamp_ntz")
    new = applied.select("sensor_id", F.col("mac").alias("new_mac"),
                         F.col("bin_id").alias("new_bin_id"), F.col("name").alias("new_name"),
                         F.col("weight_offset").alias("new_offset"))
    snapshot = _changed(stamped.join(new, "sensor_id", "left"), F.col("new_mac").isNotNull(), {
        "mac_address": F.col("new_mac"), "bin_id": F.col("new_bin_id"),
        "manufacturer": F.col("new_name"), "weight_offset": F.col("new_offset"),
        "updated_at": ntz(as_of)}, stamped.columns)
    return RegistryChange(results, errors, snapshot)


def readings_per_sensor(readings: DataFrame) -> DataFrame:
    return readings.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("reading_count"))


def delete_devices(ids: DataFrame, sensors: DataFrame, readings: DataFrame, as_of) -> RegistryChange:
    """Unregister devices: with readings only the MAC is cleared, without the row goes.

    ``ids`` has ``sensor_id``; repeats count once. Ids, devices and readings meet in one sum
    per device, which input partitions start, so that no reading is exchanged or sorted.
    """
    def seen(rows: DataFrame, where: str) -> DataFrame:
        return rows.select("sensor_id", *[F.lit(name == where).alias(name) for name in ("_asked", "_exists", "_read")])

    named = F.col("sensor_id").isNotNull()
    asked = (stacked([seen(ids, "_asked"), seen(sensors.filter(named), "_exists"),
                      seen(readings.filter(named), "_read")])
             .groupBy("sensor_id").agg(*[F.bool_or(c).alias(c) for c in ("_asked", "_exists", "_read")])
             .filter("_asked"))
    outcome = asked.select(
        F.col("sensor_id").cast(ids.schema["sensor_id"].dataType).alias("sensor_id"),
        F.when(~F.col("_exists"), "not_found").when(F.col("_read"), "cleared").otherwise("deleted").alias("action"))
    stamped = _with_column(sensors, "updated_at", "timestamp_ntz")
    marked = stamped.join(outcome, "sensor_id", "left")
    kept = marked.filter(F.coalesce(F.col("action") != "deleted", F.lit(True)))
    snapshot = _changed(kept, F.col("action") == "cleared", {
        "mac_address": F.lit(None).cast("string"), "updated_at": ntz(as_of)}, stamped.columns)
    missing = F.col("action") == "not_found"
    return RegistryChange(outcome.filter(~missing),
                          outcome.filter(missing).select("sensor_id", F.col("action").alias("error")),
                          snapshot)


BIN_CHILDREN = ("sensors", "sensor_readings", "collections", "alerts", "route_bins")


def delete_bins(tables: dict[str, DataFrame], ids: DataFrame) -> CascadeResult:
    """Delete bins and all rows that refer to them, directly or through their sensors.

    ``tables`` maps table names to frames; the result holds the rows that stay, and how
    many rows each table had and keeps.
    """
    gone = ids.select("bin_id").distinct()
    kept = {name: df.join(gone, "bin_id", "left_anti") if name in ("waste_bins", *BIN_CHILDREN)
            else df for name, df in tables.items()}
    if "sensors" in tables and "sensor_readings" in tables:
        gone_sensors = tables["sensors"].join(gone, "bin_id", "left_semi").select("sensor_id")
        kept["sensor_readings"] = kept["sensor_readings"].join(gone_sensors, "sensor_id", "left_anti")
    return CascadeResult(kept, _cascade_counts(tables, gone))


def _cascade_counts(tables: dict[str, DataFrame], gone: DataFrame) -> DataFrame:
    """Rows before and after per table, from per-key counts rather than from the rows."""
    gone_bins = gone.select("bin_id", F.lit(True).alias("_gone"))
    parts = []
    for name, df in tables.items():
        if name not in ("waste_bins", *BIN_CHILDREN):
            continue
        keys = ["bin_id"]
        if name == "sensor_readings" and "sensors" in tables:
            keys = ["bin_id", "sensor_id"]
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(gone_bins, "bin_id", "left")
        if len(keys) == 2:
            gone_sensors = (tables["sensors"].join(gone, "bin_id", "left_semi")
                            .select("sensor_id", F.lit(True).alias("_gone_sensor")))
            per_key = per_key.join(gone_sensors, "sensor_id", "left").withColumn(
                "_gone", F.coalesce("_gone", "_gone_sensor"))
        stays = F.col("_gone").isNull()
        zero = F.lit(0).cast("long")
        parts.append(per_key.agg(
            F.coalesce(F.sum("n"), zero).alias("rows_before"),
            F.coalesce(F.sum(F.when(stays, F.col("n"))), zero).alias("rows_kept"))
            .select(F.lit(name).alias("table_name"), "rows_before", "rows_kept"))
    return stacked(parts)


def delete_sensors(sensors: DataFrame, readings: DataFrame,
                   ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete sensors together with their readings."""
    gone = ids.select("sensor_id").distinct()
    return (sensors.join(gone, "sensor_id", "left_anti"),
            readings.join(gone, "sensor_id", "left_anti"))


def registry_states(before: DataFrame, after: DataFrame, key: str, at) -> DataFrame:
    """The states to add to a registry's history when ``after`` replaces ``before``.

    Rows that are new or differ in any column come with ``valid_from``; rows that ``after``
    lacks come once more as ``removed``. Columns are those of ``after``.
    """
    columns = after.columns
    old = before.select(*[F.col(c) if c in before.columns else F.lit(None).cast(after.schema[c].dataType).alias(c)
                          for c in columns])
    changed = after.exceptAll(old).withColumn("removed", F.lit(False))
    gone = old.join(after.select(key), key, "left_anti").select(*columns).withColumn("removed", F.lit(True))
    return changed.unionByName(gone).withColumn("valid_from", ntz(at))
