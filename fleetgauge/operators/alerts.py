"""Alert rules, one open alert per bin and type, and alert lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fleetgauge.functions.labels import alert_type_label
from fleetgauge.functions.measures import one_decimal

FEED_ROWS = 100
CANDIDATE_COLUMNS = ["alert_id", "bin_id", "alert_type", "severity", "message", "triggered_at",
                     "status", "arrival_seq"]


@dataclass(frozen=True)
class AlertRules:
    """Thresholds. The defaults are fixed values."""

    fill_critical: float = 90
    fill_high: float = 75
    battery_low: float = 20
    temperature_high: float = 45
    # What a missing key counts as.
    missing_fill: float = 0
    missing_battery: float = 100
    missing_temperature: float = 25


def _rule(number: int, alert_type: str, severity: Column, message: Column, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(number).alias("rule"), F.lit(alert_type).alias("alert_type"),
                                 severity.alias("severity"), message.alias("message")))


def alert_candidates(classified: DataFrame, rules: AlertRules = AlertRules(),
                     alert_bin: str = "payload") -> DataFrame:
    """All rule hits of accepted messages, in one pass.

    Rules look at the payload's own numbers, not at the stored, rounded measures. The
    alert names the bin of the payload (``alert_bin='resolved'``: the registry's); a
    payload bin that is absent or unknown raises nothing. ``alert_id`` follows from the
    arrival number and the rule, so it is unique and grows with arrival.
    """
    accepted = classified.filter(F.col("reason").isNull())
    if alert_bin == "payload":
        accepted = accepted.filter(F.col("payload_has_bin"))
        bin_id = F.col("payload_bin_id")
    elif alert_bin == "resolved":
        bin_id = F.col("bin_id")
    else:
        raise ValueError(f"alert_bin must be 'payload' or 'resolved', got {alert_bin!r}")
    fill = F.coalesce("raw_fill_level", F.lit(float(rules.missing_fill)))
    battery = F.coalesce("raw_battery_level", F.lit(float(rules.missing_battery)))
    heat = F.coalesce("raw_temperature_c", F.lit(float(rules.missing_temperature)))
    code = F.coalesce("bin_code", F.lit("None"))
    critical = fill >= rules.fill_critical
    # The message texts.
    full_text = F.concat(F.lit("Bin "), code, F.lit(" is "), one_decimal(fill), F.when(
        critical, "% full - requires immediate collection").otherwise("% full - collection needed soon"))
    battery_text = F.concat(F.lit("Low battery warning for "), code, F.lit(": "),
                            one_decimal(battery), F.lit("%"))
    heat_text = F.concat(F.lit("High temperature detected in "), code, F.lit(": "),
                         one_decimal(heat), F.lit("°C"))
    hits = F.array_compact(F.array(
        _rule(0, "bin_full", F.when(critical, "critical").otherwise("high"), full_text,
              fill >= rules.fill_high),
        _rule(1, "sensor_fault", F.lit("medium"), battery_text, battery < rules.battery_low),
        _rule(2, "unusual_activity", F.lit("high"), heat_text, heat > rules.temperature_high)))
    return (accepted.select("arrival_seq", "arrival_ts", bin_id.alias("bin_id"),
                            F.explode(hits).alias("hit"))
            .select((F.col("arrival_seq") * 4 + F.col("hit.rule")).alias("alert_id"), "bin_id",
                    "hit.alert_type", "hit.severity", "hit.message",
                    F.col("arrival_ts").alias("triggered_at"), F.lit("open").alias("status"),
                    "arrival_seq"))


def open_keys(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("status") == "open").select("bin_id", "alert_type")


def new_open_alerts(candidates: DataFrame, alerts: DataFrame) -> DataFrame:
    """The alerts to insert: the first by arrival (time, then number) for each bin and
    type that has none open.

    The first hit per key is found before the exchange, so a bin that alarms all the time
    sends one row per input partition.
    """
    keys = ["bin_id", "alert_type"]
    rest = [c for c in CANDIDATE_COLUMNS if c not in keys]
    first = (candidates.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("triggered_at", "arrival_seq")).alias("a"))
             .select(*keys, "a.*"))
    return first.join(open_keys(alerts), keys, "left_anti").select(*CANDIDATE_COLUMNS)


def alerts_by_status(alerts: DataFrame, bins: DataFrame, status: str = "open",
                     n: int = FEED_ROWS) -> DataFrame:
    """The newest alerts of a status with bin code and location."""
    newest = [F.desc("triggered_at"), F.desc("alert_id")]
    listed = alerts.filter(F.col("status") == status).orderBy(*newest).limit(n)
    places = bins.select("bin_id", "bin_code", "location")
    return listed.join(places, "bin_id", "left").orderBy(*newest)


def alert_feed(alerts: DataFrame, bins: DataFrame) -> DataFrame:
    """Open alerts as shown: title, message, severity, time."""
    listed = alerts_by_status(alerts, bins)
    title = F.concat(alert_type_label(F.col("alert_type")), F.lit(" · "),
                     F.coalesce("bin_code", F.lit("")))
    severity = F.coalesce(F.nullif("severity", F.lit("")), F.lit("low"))
    return listed.select("alert_id", "bin_id", title.alias("title"), "message",
                         severity.alias("severity"), F.upper(severity).alias("severity_label"), "triggered_at")
