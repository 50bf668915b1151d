"""Every registered query, by name, over a folder of test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetgauge.operators import (alerts, collections, compliance, devices, export, integrity,
                                  readings, registry, resolve, routes, status, timeline, weights)
from fleetgauge.plans.keyed import stacked
from fleetgauge.session import shared_dir
from fleetgauge.sources import tables, versions
from fleetcheck.domain import (ALERTS_AS_OF, COLLECTIONS_AS_OF, READINGS_AS_OF,
                                       SOURCE_TABLES, Fleet)
from fleetgauge.sources.messages import without_resends
from fleetgauge.streaming import ingest, live, partials, snapshots

Query = Callable[[SparkSession, str], DataFrame]
LOOKBACK_HOURS = 168
# Since when the devices of the test tables are registered.
FIRST_STATE = "2023-01-01 00:00:00"
# Collections of the test tables can share an id; these settle their order.
COLLECTION_TIES = ("collection_id", "tie_part", "tie_price")
# A bin with readings in every size of the test tables.
DETAIL_BIN = 5
# Borders of the blocks of messages that come in one micro-batch each, and what closes alerts.
MESSAGE_BLOCKS = ("2000-01-01", "2024-01-11", "2024-01-21", "2100-01-01")
CLOSING_STATUS = ("acknowledged", "resolved", "false_alarm")
# Two months, more than the 720 hours that a shorter report spans at most.
LONG_EXPORT = export.interval("2023-12-01", "2024-01-30")
EXPORT_START, EXPORT_END = export.interval("2024-01-01", "2024-01-30")


def _over(build: Callable[[Fleet], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(Fleet(spark, sf_dir))


def _status(f: Fleet) -> DataFrame:
    return status.current_status(f.bins, f.readings, f.alerts)


def _active(f: Fleet) -> DataFrame:
    # The active filter goes below the joins: inactive bins meet no readings.
    return status.active_bins(_status(f))


def _daily(f: Fleet) -> DataFrame:
    return weights.daily_weight(f.bins, f.readings, READINGS_AS_OF)


def _devices(f: Fleet) -> DataFrame:
    return devices.device_list(f.sensors, f.bins, f.readings)


def _classified(f: Fleet) -> DataFrame:
    return resolve.classify_messages(f.messages, f.sensors, f.bins)


def _candidates(f: Fleet) -> DataFrame:
    return alerts.alert_candidates(_classified(f))


def _register(f: Fleet):
    return registry.register_devices(f.device_items, f.sensors, f.bins, READINGS_AS_OF)


def _published(f: Fleet) -> str:
    """The registration batch published over version 0 of the sensors. Another writer comes
    first, with an unchanged copy, so the batch is made a second time and is version 2."""
    path = shared_dir(f.spark, "sensors")
    versions.create(f.sensors, path, "sensor_id", FIRST_STATE)

    def make(sensors: DataFrame) -> registry.RegistryChange:
        if versions.versions(f.spark, path) == [0]:
            versions.publish({"rows": sensors, "states": registry.registry_states(
                sensors, sensors, "sensor_id", FIRST_STATE)}, path, 0)
        return registry.register_devices(f.device_items, sensors, f.bins, READINGS_AS_OF)

    versions.change(f.spark, path, "sensor_id", READINGS_AS_OF, make)
    return path


def _registry_history(f: Fleet) -> DataFrame:
    states = versions.history(f.spark, _published(f))
    return states.select("sensor_id", "sensor_code", "mac_address", "bin_id", "weight_offset", "removed", "valid_from")


def _update(f: Fleet):
    return registry.update_devices(f.device_updates, f.sensors, f.bins, READINGS_AS_OF)


def _delete(f: Fleet):
    # Every device id that bins suggest: some exist, some do not.
    ids = f.bins.select(F.col("bin_id").alias("sensor_id"))
    return registry.delete_devices(ids, f.sensors, f.readings, READINGS_AS_OF)


def _fleet_tables(f: Fleet) -> dict[str, DataFrame]:
    return {"waste_bins": f.bins, "sensors": f.sensors, "sensor_readings": f.readings,
            "collections": f.collections, "alerts": f.alerts, "collection_routes": f.routes,
            "route_bins": f.route_bins}


def _cascade_result(f: Fleet) -> registry.CascadeResult:
    retired = f.bins.filter(F.col("status") == "inactive")
    return registry.delete_bins(_fleet_tables(f), retired)


def _cascade(f: Fleet) -> DataFrame:
    return _cascade_result(f).counts


def _outcomes(change) -> DataFrame:
    """Results and errors of an update batch in one frame."""
    shape = ["item_seq", "sensor_id", "mac", "outcome"]
    return (change.results.withColumnRenamed("action", "outcome").select(*shape)
            .unionByName(change.errors.withColumnRenamed("error", "outcome").select(*shape)))


def _export(f: Fleet) -> DataFrame:
    return export.export_report(f.readings, f.bins, EXPORT_START, EXPORT_END)


def _export_csv(f: Fleet) -> DataFrame:
    path = shared_dir(f.spark, "report")
    export.write_csv(_export(f), path)
    return export.read_csv(f.spark, path)


def _report_named(f: Fleet) -> DataFrame:
    """The report under the name users get, read back by the name of its folder."""
    path = f"{shared_dir(f.spark, 'report')}/{export.report_name('2024-01-01', '2024-01-30')}"
    export.write_csv(_export(f), path)
    found = export.read_csv(f.spark, path).select(F.input_file_name().alias("file"), "bin_code")
    folder = F.element_at(F.split("file", "/"), -2)
    return found.groupBy(folder.alias("report")).agg(F.count(F.lit(1)).alias("rows"))


def _report_lines(f: Fleet) -> DataFrame:
    """The written lines, read as text; a reader of text drops the byte-order mark."""
    path = shared_dir(f.spark, "report-lines")
    export.write_report_lines(_export(f), path)
    return f.spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line")


def _status_json(f: Fleet) -> DataFrame:
    """JSON rows with times of both kinds, timestamps and texts, carrying the zone."""
    path = shared_dir(f.spark, "json")
    texts = F.replace(F.col("last_reading").cast("string"), F.lit(" "), F.lit("T"))
    export.write_json(_status(f).select("bin_id", "last_reading", texts.alias("updated_at"),
                                        "fill_status"), path)
    return f.spark.read.schema("bin_id int, last_reading string, updated_at string, fill_status string").json(path)


def _stream_without_resends(f: Fleet) -> DataFrame:
    """Messages whose number came before are dropped; here every message comes once."""
    root = shared_dir(f.spark, "resends")
    once = without_resends(f.message_stream().select("arrival_seq", "arrival_ts", "topic"),
                           ["arrival_seq"], "1 hour")
    (once.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
     .trigger(availableNow=True).start(f"{root}/out").awaitTermination())
    return f.spark.read.schema("arrival_seq long, arrival_ts timestamp_ntz, topic string").parquet(f"{root}/out")


def _stream_ingest(f: Fleet) -> str:
    root = shared_dir(f.spark, "ingest")
    job = ingest.start_ingest(
        f.message_stream(), lambda spark: (Fleet(spark, f.sf_dir).sensors, Fleet(spark, f.sf_dir).bins),
        f"{root}/out", f"{root}/checkpoint", known_alerts=f.alerts, availableNow=True)
    job.awaitTermination()
    return f"{root}/out"


def _stream_readings(f: Fleet) -> DataFrame:
    return ingest.written_readings(f.spark, _stream_ingest(f)).drop("reading_date", "batch_id")


def _stream_alerts(f: Fleet) -> DataFrame:
    stored = ingest.alert_table(f.spark, _stream_ingest(f))
    return stored.filter(F.col("batch_id") >= 0).drop("batch_id", "arrival_seq")


def _stream_alerts_reopened(f: Fleet) -> DataFrame:
    """Three micro-batches of ten days each; before the second and the third, the alerts so far
    of every third bin are closed, so that the next alert of such a bin opens."""
    root = shared_dir(f.spark, "reopened")
    # The stream numbers its alerts by message; ids from before must not meet those.
    known = f.alerts.withColumn("alert_id", -F.col("alert_id") - 1)

    def closings(spark: SparkSession, batch_id: int) -> DataFrame:
        stored = ingest.stored_alerts(spark, f"{root}/out/alerts", batch_id)
        return stored.filter(F.lit(batch_id > 0) & (F.col("bin_id") % 3 == batch_id)).select(
            "alert_id", "bin_id", "alert_type",
            F.lit(CLOSING_STATUS[batch_id % len(CLOSING_STATUS)]).alias("status"),
            F.lit(MESSAGE_BLOCKS[batch_id]).cast("timestamp_ntz").alias("changed_at"))

    for first, behind in zip(MESSAGE_BLOCKS, MESSAGE_BLOCKS[1:]):
        own = f.messages.filter((F.col("arrival_ts") >= F.lit(first).cast("timestamp_ntz"))
                                & (F.col("arrival_ts") < F.lit(behind).cast("timestamp_ntz")))
        own.write.mode("append").parquet(f"{root}/in")
        stream = f.spark.readStream.schema(f.messages.schema).parquet(f"{root}/in")
        ingest.start_ingest(stream, lambda spark: (Fleet(spark, f.sf_dir).sensors, Fleet(spark, f.sf_dir).bins),
                            f"{root}/out", f"{root}/checkpoint", known_alerts=known,
                            status_changes=closings, availableNow=True).awaitTermination()
    return ingest.current_alerts(f.spark, f"{root}/out").filter("batch_id >= 0").drop("arrival_seq")


def _stream_latest(f: Fleet) -> DataFrame:
    root = shared_dir(f.spark, "latest")
    live.start_latest(f.reading_stream(), f"{root}/out", f"{root}/checkpoint",
                      availableNow=True).awaitTermination()
    return snapshots.current(f.spark, f"{root}/out", ["bin_id"])


def _stream_hourly(f: Fleet) -> DataFrame:
    root = shared_dir(f.spark, "hourly")
    live.start_hourly(f.reading_stream(), f"{root}/out", f"{root}/checkpoint",
                      availableNow=True).awaitTermination()
    return snapshots.current(f.spark, f"{root}/out", ["hour"])


def _stored_partials(f: Fleet) -> DataFrame:
    """Partials of the readings in four batches, each with readings of every day of the month,
    so that all but the first come late; two bases are merged on the way."""
    path = f"{shared_dir(f.spark, 'partials')}/hourly"
    for batch in range(4):
        partials.add(f.readings.filter(F.col("reading_id") % 4 == batch), path, batch, compact_every=2)
    return partials.stored(f.spark, path)


def _stream_hourly_partials(f: Fleet) -> DataFrame:
    root = shared_dir(f.spark, "hourly-partials")
    partials.start(f.reading_stream(), f"{root}/out", f"{root}/checkpoint",
                   availableNow=True).awaitTermination()
    return timeline.hourly_fill_of_partials(partials.stored(f.spark, f"{root}/out"))


def _row_counts(f: Fleet) -> DataFrame:
    return tables.row_counts({name: f.source(name) for name in SOURCE_TABLES})


def _classified_as_of(f: Fleet) -> DataFrame:
    return resolve.classify_messages(f.messages, f.sensor_states, f.bin_states)


def _accepted(f: Fleet) -> DataFrame:
    return resolve.accepted_readings(_classified(f))


_BUILDERS: dict[str, Callable[[Fleet], DataFrame]] = {
    # Status and statistics
    "bin_current_status": _status,
    "active_bins": _active,
    # A further status is and-ed to 'active': with any other there are no rows.
    "active_bins_of_status": lambda f: stacked([
        status.active_bins(_status(f), wanted).select(
            F.lit(wanted).alias("asked"), "bin_id", "bin_status", "fill_status")
        for wanted in ("active", "inactive")]),
    "bin_detail_of_one": lambda f: status.bin_detail_rows(
        status.of_bin(_status(f), DETAIL_BIN), status.of_bin(f.readings, DETAIL_BIN),
        status.of_bin(f.collections, DETAIL_BIN)),
    "fleet_stats": lambda f: status.fleet_stats(_status(f), f.alerts, f.collections,
                                                COLLECTIONS_AS_OF),
    "fill_status_distribution": lambda f: status.fill_status_distribution(_status(f)),
    "bin_recent_readings": lambda f: status.recent_readings(f.readings).select(
        "bin_id", "rank", "reading_id", "timestamp", "fill_level", "weight_kg"),
    "bin_recent_collections": lambda f: collections.recent_collections(f.collections, ties=COLLECTION_TIES).select(
        "bin_id", "rank", "collection_id", "collection_time", "weight_collected"),
    "bin_detail": lambda f: status.bin_detail_rows(_status(f), f.readings, f.collections),
    "fill_bands": lambda f: timeline.fill_band_counts(f.readings),
    # Lists
    "readings_lookback": lambda f: readings.readings_lookback(
        f.readings, f.bins, READINGS_AS_OF, LOOKBACK_HOURS),
    "readings_lookback_bin": lambda f: readings.readings_lookback(
        f.readings, f.bins, READINGS_AS_OF, LOOKBACK_HOURS, limit=None),
    "latest_readings": lambda f: tables.newest_rows(f.readings),
    "alerts_by_status": lambda f: alerts.alerts_by_status(f.alerts, f.bins),
    "alert_feed": lambda f: alerts.alert_feed(f.alerts, f.bins),
    "sensors_with_bins": lambda f: devices.sensors_with_bins(f.sensors, f.bins),
    # Timelines, weights, collections
    "hourly_fill_timeline": lambda f: timeline.fill_timeline(
        f.readings, READINGS_AS_OF, LOOKBACK_HOURS),
    "hourly_fill_of_partials": lambda f: timeline.fill_timeline_of_partials(
        _stored_partials(f), f.readings, READINGS_AS_OF, LOOKBACK_HOURS),
    "daily_weight_of_partials": lambda f: weights.daily_weight_of_partials(
        f.bins, _stored_partials(f), f.readings, READINGS_AS_OF),
    "hourly_alerts_by_severity": lambda f: timeline.alert_timeline(
        f.alerts, ALERTS_AS_OF, LOOKBACK_HOURS),
    "daily_weight": _daily,
    "daily_weight_total": lambda f: weights.daily_weight_total(_daily(f)),
    "weighing_history": lambda f: weights.weighing_history(f.readings),
    "weighing_summary": lambda f: compliance.weighing_summary(_active(f), _daily(f),
                                                              READINGS_AS_OF),
    "collection_stats": lambda f: collections.collection_stats(f.bins, f.collections),
    "recent_collections": lambda f: collections.recent_collection_count(
        f.collections, COLLECTIONS_AS_OF),
    "collection_inference": lambda f: collections.infer_collections(f.readings),
    # Compliance
    "compliance_cards": lambda f: compliance.department_cards(_active(f), _daily(f),
                                                              READINGS_AS_OF),
    "compliance_offline": lambda f: compliance.department_cards(_active(f), _daily(f),
                                                                READINGS_AS_OF, "offline"),
    "compliance_distribution": lambda f: compliance.compliance_distribution(
        _active(f), READINGS_AS_OF),
    "active_weighing": lambda f: compliance.active_weighing(_active(f), READINGS_AS_OF),
    "weight_bars": lambda f: compliance.weight_bars(_active(f), _daily(f), READINGS_AS_OF),
    # Devices
    "device_list": _devices,
    "device_report": lambda f: devices.device_report(_devices(f), READINGS_AS_OF),
    "device_lookup": lambda f: devices.device_lookup(
        f.device_items.select("item_seq", "mac_address"), f.sensors, f.bins),
    "readings_per_sensor": lambda f: registry.readings_per_sensor(f.readings),
    # Ingest
    "ingest_accepted": _accepted,
    "ingest_rejected": lambda f: resolve.rejected_messages(_classified(f)),
    "ingest_as_of": lambda f: resolve.accepted_readings(_classified_as_of(f)),
    "ingest_as_of_rejected": lambda f: resolve.rejected_messages(_classified_as_of(f)).select(
        "arrival_seq", "reason"),
    "alert_candidates": lambda f: _candidates(f).drop("arrival_seq"),
    "alerts_deduped": lambda f: alerts.new_open_alerts(_candidates(f), f.alerts).drop("arrival_seq"),
    "readings_refused": lambda f: resolve.split_by_registry(f.readings, f.sensors, f.bins)[1].select(
        "reading_id", "sensor_id", "bin_id"),
    # Reports
    "export_report": _export,
    "export_long": lambda f: export.export_report(f.readings, f.bins, *LONG_EXPORT),
    "export_csv": _export_csv,
    "report_csv_named": _report_named,
    "report_lines": _report_lines,
    "status_json": _status_json,
    "readings_zoned": lambda f: export.zoned_rows(f.readings.select("reading_id", "timestamp")),
    # Registry
    "registration_form": lambda f: registry.form_rows(f.device_items),
    "register_devices": lambda f: _register(f).results,
    "register_errors": lambda f: _register(f).errors,
    "register_snapshot": lambda f: _register(f).snapshot,
    "register_published": lambda f: versions.read(f.spark, _published(f), 2),
    "registry_history": _registry_history,
    "update_devices": lambda f: _outcomes(_update(f)),
    "update_snapshot": lambda f: _update(f).snapshot,
    "delete_devices": lambda f: _delete(f).results.unionByName(
        _delete(f).errors.withColumnRenamed("error", "action")),
    "delete_snapshot": lambda f: _delete(f).snapshot,
    "seed_insert": lambda f: tables.append_new(
        f.seed_sensors, f.sensors, "sensors", "sensor_code", "sensor_id", READINGS_AS_OF).select(
            "sensor_id", "sensor_code", "bin_id", "sensor_type", "manufacturer", "status",
            "created_at"),
    # Integrity
    "cascade_delete_counts": _cascade,
    "cascade_kept_readings": lambda f: _cascade_result(f).kept["sensor_readings"].select(
        "reading_id", "sensor_id", "bin_id"),
    "unique_violations": lambda f: integrity.unique_violations(_fleet_tables(f)),
    "orphan_rows": lambda f: integrity.orphan_rows(_fleet_tables(f)),
    "row_counts": _row_counts,
    # Routes and geometry
    "route_manifest": lambda f: routes.route_manifest(f.routes, f.route_bins, _status(f)),
    "geometry_check": lambda f: routes.geometry_check(f.readings, f.bins),
    # Streams
    "stream_ingest": _stream_readings,
    "stream_alerts": _stream_alerts,
    "stream_alerts_reopened": _stream_alerts_reopened,
    "stream_latest": _stream_latest,
    "stream_hourly": _stream_hourly,
    "stream_hourly_partials": _stream_hourly_partials,
    "stream_status": lambda f: status.status_view(f.bins, _stream_latest(f), f.alerts),
    "stream_without_resends": _stream_without_resends,
}


def queries() -> dict[str, Query]:
    return {name: _over(build) for name, build in _BUILDERS.items()}
