"""Threshold and age classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetgauge.functions.times import age, age_minutes

# Class names and their limits.
FILL_LEVELS = ("low", "medium", "high", "critical")
COMPLIANCE_CLASSES = ("good", "medium", "high", "offline", "none")
FULL = 90
NEARLY_FULL = 75
HALF = 50


def fill_status(fill: Column) -> Column:
    """Fill class; an unknown fill counts as low."""
    return (F.when(fill >= FULL, "critical").when(fill >= NEARLY_FULL, "high")
            .when(fill >= HALF, "medium").otherwise("low"))


def fill_band(fill: Column) -> Column:
    """Traffic-light band; a missing fill counts as zero."""
    level = F.coalesce(fill, F.lit(0))
    return F.when(level < HALF, "green").when(level < NEARLY_FULL, "yellow").otherwise("red")


def compliance_class(last_reading: Column, as_of) -> Column:
    """Class by age of the last reading; a reading from the future is good."""
    span = age(last_reading, as_of)
    return (F.when(last_reading.isNull(), "none")
            .when(span < F.expr("INTERVAL '2' MINUTE"), "good")
            .when(span < F.expr("INTERVAL '24' HOUR"), "medium")
            .when(span < F.expr("INTERVAL '48' HOUR"), "high")
            .otherwise("offline"))


def is_online(last_seen: Column, as_of) -> Column:
    """Seen less than five minutes ago; never seen is offline."""
    return F.coalesce(age(last_seen, as_of) < F.expr("INTERVAL '5' MINUTE"), F.lit(False))


def relative_unit(ts: Column, as_of) -> Column:
    minutes = age_minutes(ts, as_of)
    return (F.when(ts.isNull(), F.lit(None).cast("string"))
            .when(minutes < 1, "now").when(minutes < 60, "minute")
            .when(minutes < 1440, "hour").otherwise("day"))


def relative_count(ts: Column, as_of) -> Column:
    minutes = age_minutes(ts, as_of)
    return (F.when(minutes < 1, F.lit(0).cast("long")).when(minutes < 60, minutes)
            .when(minutes < 1440, F.floor(minutes / 60)).otherwise(F.floor(minutes / 1440)))
