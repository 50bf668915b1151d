"""Compliance classes by age of the last reading, and the reports built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetgauge.functions.labels import (NO_VALUE, card_sub_text, chart_label, compliance_label,
                                         fixed_text)
from fleetgauge.functions.levels import COMPLIANCE_CLASSES, compliance_class


def with_compliance(status: DataFrame, as_of) -> DataFrame:
    return status.withColumn("card_status", compliance_class(F.col("last_reading"), as_of))


def of_class(cards: DataFrame, card_status: str = "all") -> DataFrame:
    if card_status == "all":
        return cards
    if card_status not in COMPLIANCE_CLASSES:
        raise ValueError(f"unknown class {card_status!r}")
    return cards.filter(F.col("card_status") == card_status)


def _with_daily(active_status: DataFrame, daily: DataFrame) -> DataFrame:
    totals = daily.select("bin_id", "total_weight_today", "reading_count_today")
    return active_status.join(totals, "bin_id", "left")


def department_cards(active_status: DataFrame, daily: DataFrame, as_of,
                     card_status: str = "all") -> DataFrame:
    """A card per active bin: class, its label, and the weight text below the name."""
    cards = of_class(with_compliance(active_status, as_of), card_status)
    cls = F.col("card_status")
    return _with_daily(cards, daily).select(
        "bin_id", "bin_code", "location", "card_status",
        compliance_label(cls).alias("card_label"),
        card_sub_text(cls, F.col("weight_kg"), F.col("total_weight_today")).alias("sub_text"))


def compliance_distribution(active_status: DataFrame, as_of) -> DataFrame:
    """Active bins per class, with a row for every class."""
    cls = compliance_class(F.col("last_reading"), as_of)
    counts = active_status.agg(*[F.count_if(cls == c).alias(c) for c in COMPLIANCE_CLASSES])
    return counts.unpivot([], list(COMPLIANCE_CLASSES), "card_status", "bin_count")


def active_weighing(active_status: DataFrame, as_of) -> DataFrame:
    """Bins being weighed now, out of all active bins."""
    cls = compliance_class(F.col("last_reading"), as_of)
    return active_status.agg(F.count_if(cls == "good").alias("weighing"),
                             F.count(F.lit(1)).alias("total_bins"))


def weight_bars(active_status: DataFrame, daily: DataFrame, as_of) -> DataFrame:
    """Chart rows by bin: short label, weight of the last 24 hours, class."""
    weight = F.coalesce(F.col("total_weight_today"), F.lit(0)).cast("decimal(18,2)")
    return (_with_daily(with_compliance(active_status, as_of), daily)
            .select("bin_id",
                    chart_label(F.col("location"), F.col("bin_code")).alias("label"),
                    weight.alias("weight"), "card_status")
            .orderBy("bin_id"))


def weighing_summary(active_status: DataFrame, daily: DataFrame, as_of) -> DataFrame:
    """The head of a bin's weighing history: 24 h total and count, battery, signal, class."""
    cards = _with_daily(with_compliance(active_status, as_of), daily)
    return cards.select(
        "bin_id", "bin_code",
        fixed_text(F.coalesce(F.col("total_weight_today"), F.lit(0)), 3).alias("total_text"),
        F.coalesce("reading_count_today", F.lit(0).cast("long")).alias("weighings"),
        F.coalesce(F.concat(fixed_text(F.col("battery_level"), 0), F.lit("%")),
                   F.lit(NO_VALUE)).alias("battery_text"),
        F.coalesce(F.concat(F.col("signal_strength").cast("string"), F.lit(" dBm")),
                   F.lit(NO_VALUE)).alias("signal_text"),
        "card_status", compliance_label(F.col("card_status")).alias("card_label"))
