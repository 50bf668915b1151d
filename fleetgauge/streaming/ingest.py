"""Continuous ingest: messages to readings, rejects and alerts, batch by batch.

The same functions serve a single batch and every micro-batch of a stream.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from fleetgauge.functions.times import DATE_COLUMN
from fleetgauge.operators.alerts import (CANDIDATE_COLUMNS, AlertRules, alert_candidates,
                                         new_open_alerts)
from fleetgauge.operators.resolve import (accepted_readings, classify_messages,
                                          rejected_messages)
from fleetgauge.sources.schemas import SENSOR_READINGS
from fleetgauge.sources.tables import write_batch, write_readings
from fleetgauge.streaming import partials, snapshots

Registry = Callable[[SparkSession], tuple[DataFrame, DataFrame]]

ALERT_FIELDS = {"alert_id": "long", "bin_id": "int", "alert_type": "string",
                "severity": "string", "message": "string", "triggered_at": "timestamp_ntz",
                "status": "string", "arrival_seq": "long"}
OPEN_ALERT = ["alert_id", "bin_id", "alert_type"]
#: A change of an alert's status. Only 'open' blocks the next alert of its bin and type.
CHANGE_SCHEMA = ("alert_id long, bin_id int, alert_type string, status string, "
                 "changed_at timestamp_ntz")
ALERT_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in ALERT_FIELDS.items())


class IngestResult(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame
    alerts: DataFrame


def ingest_batch(messages: DataFrame, sensors: DataFrame, bins: DataFrame, alerts: DataFrame,
                 rules: AlertRules = AlertRules(), alert_bin: str = "payload") -> IngestResult:
    """One batch of messages against the registry and the alerts so far."""
    classified = classify_messages(messages, sensors, bins)
    return _results(classified, alerts, rules, alert_bin)


def _results(classified: DataFrame, alerts: DataFrame, rules: AlertRules,
             alert_bin: str) -> IngestResult:
    candidates = alert_candidates(classified, rules, alert_bin)
    return IngestResult(accepted_readings(classified), rejected_messages(classified),
                        new_open_alerts(candidates, alerts))


def stored_alerts(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Alerts written by the stream; ``before`` leaves out that batch and later ones."""
    alerts = spark.read.schema(f"{ALERT_SCHEMA}, batch_id long").parquet(path)
    return alerts if before is None else alerts.filter(F.col("batch_id") < before)


def last_changes(changes: DataFrame) -> DataFrame:
    """The newest change of each alert; of equal times, one that leaves it open counts."""
    newest = F.max_by(F.struct("bin_id", "alert_type", "status", "changed_at"),
                      F.struct("changed_at", F.col("status") == "open", "status")).alias("c")
    return changes.groupBy("alert_id").agg(newest).select("alert_id", "c.*")


def _laid_over(open_alerts: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The open alerts after the changes, those that a change opened again, and those it closed."""
    left = open_alerts.join(changes, "alert_id", "left_anti")
    again = changes.filter("status = 'open'").select(*OPEN_ALERT)
    closed = open_alerts.join(changes.filter("status <> 'open'"), "alert_id", "left_semi")
    return left.unionByName(again), again, closed


def stored_changes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{CHANGE_SCHEMA}, batch_id long").parquet(f"{root}/status_changes")


def start_ingest(messages: DataFrame, registry: Registry, root: str, checkpoint: str,
                 known_alerts: DataFrame | None = None,
                 alerts_so_far: Callable[[SparkSession, int], DataFrame] | None = None,
                 status_changes: Callable[[SparkSession, int], DataFrame] | None = None,
                 rules: AlertRules = AlertRules(), alert_bin: str = "payload",
                 hourly_partials: bool = False, **trigger) -> StreamingQuery:
    """Start the ingest stream; folders ``readings``, ``rejected`` and ``alerts`` under ``root``.

    ``registry`` is called per micro-batch, so a device registered a moment ago is known
    to the next batch. The open alerts, those of ``known_alerts`` at first, are kept in a
    small table under ``open_keys``, so a batch reads no alert history.

    ``status_changes`` is called per micro-batch for the changes of alerts since the batch
    before (``CHANGE_SCHEMA``; of several of one alert the newest counts). They are stored
    once under ``status_changes``, so a replay sees the changes of its first run, and take
    effect before the batch's messages: an alert that is acknowledged, resolved or a false
    alarm lets the next one of its bin and type open, unless another of them is open. Ids of
    ``known_alerts`` must not be those of new ones (see ``alert_candidates``). A
    change names its alert, so one that comes late closes no later alert. A caller with an
    alert table of its own passes ``alerts_so_far`` instead.

    With ``hourly_partials`` the partial sums of each batch's readings go to ``partials``, from
    which timelines and daily weights come without a scan of the readings.

    Each batch replaces its own folders and reads only alerts of earlier batches, so a
    batch that runs again after a failure gives the same rows once.
    """
    spark = messages.sparkSession
    alerts_path = f"{root}/alerts"
    start = known_alerts
    if start is None:
        start = spark.createDataFrame([], ALERT_SCHEMA)
    held = start.filter("status = 'open'").select(*[
        (F.col(name) if name in start.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in ALERT_FIELDS.items()])
    # Alerts from before the stream are batch -1; a restart finds them in place, and writes
    # them again if the first start was lost while it did.
    snapshots.write_once(held, f"{alerts_path}/batch_id=-1")
    keys_path = f"{root}/open_keys"
    snapshots.create(held.select(*OPEN_ALERT).distinct(), keys_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        sensors, bins = registry(session)
        # A batch may come in one file or row group; its payloads are parsed in all tasks.
        spread = batch.repartition(F.col("arrival_seq"))
        classified = classify_messages(spread, sensors, bins).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            again = closed = None
            if alerts_so_far:
                earlier = alerts_so_far(session, batch_id)
            else:
                earlier = snapshots.current(session, keys_path, OPEN_ALERT, batch_id - 1)
                if status_changes:
                    changes_path = f"{root}/status_changes/batch_id={batch_id}"
                    snapshots.write_once(last_changes(status_changes(session, batch_id)), changes_path)
                    changes = session.read.schema(CHANGE_SCHEMA).parquet(changes_path)
                    earlier, again, closed = _laid_over(earlier, changes)
                earlier = earlier.withColumn("status", F.lit("open"))
            out = _results(classified, earlier, rules, alert_bin)
            write_readings(out.accepted, f"{root}/readings", batch_id)
            if hourly_partials:
                own = session.read.schema(SENSOR_READINGS).parquet(f"{root}/readings/batch_id={batch_id}")
                partials.add(own, f"{root}/partials", batch_id)
            # Few files again: a batch has as many parts as the session's shuffles.
            write_batch(out.rejected.hint("rebalance"), f"{root}/rejected", batch_id)
            write_batch(out.alerts, alerts_path, batch_id)
            if not alerts_so_far:
                written = session.read.schema(ALERT_SCHEMA).parquet(f"{alerts_path}/batch_id={batch_id}")
                opened = written.select(*OPEN_ALERT)
                opened = opened if again is None else opened.unionByName(again)
                snapshots.upsert(opened, keys_path, OPEN_ALERT, batch_id, gone=closed)
        finally:
            classified.unpersist()

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "15 seconds"})).start()


def written_readings(spark: SparkSession, root: str) -> DataFrame:
    """The readings the stream has stored, with their date and batch columns."""
    schema = T.StructType([*SENSOR_READINGS.fields, T.StructField(DATE_COLUMN, T.DateType()),
                           T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(f"{root}/readings")


def alert_table(spark: SparkSession, root: str) -> DataFrame:
    return stored_alerts(spark, f"{root}/alerts").select(*CANDIDATE_COLUMNS, "batch_id")


def current_alerts(spark: SparkSession, root: str) -> DataFrame:
    """Every stored alert with its status after the changes that the stream was given."""
    changes = last_changes(stored_changes(spark, root)).select(
        "alert_id", F.col("status").alias("_changed"))
    return (alert_table(spark, root).join(changes, "alert_id", "left")
            .withColumn("status", F.coalesce("_changed", "status")).drop("_changed"))
