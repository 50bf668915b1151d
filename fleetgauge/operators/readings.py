"""Reading lists over a lookback."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetgauge.functions.times import (DEFAULT_LOOKBACK_HOURS, MAX_LOOKBACK_HOURS, check_lookback,
                                        hours_before, in_range)

MAX_ROWS = 1000


def readings_lookback(readings: DataFrame, bins: DataFrame, as_of,
                      hours: int = DEFAULT_LOOKBACK_HOURS,
                      bin_id: int | None = None, limit: int | None = MAX_ROWS,
                      max_hours: int | None = MAX_LOOKBACK_HOURS) -> DataFrame:
    """Readings of the last ``hours`` with their bin code, newest first.

    Over the fleet the newest ``limit`` are listed; for one bin the list is whole, and with
    ``limit=None`` so are the lists of all bins, in no order. ``hours`` beyond
    ``max_hours`` are refused; None refuses none.
    """
    recent = in_range(readings, hours_before(as_of, check_lookback(hours, max_hours)))
    newest = [F.desc("timestamp"), F.desc("reading_id")]
    if bin_id is not None:
        recent = recent.filter(F.col("bin_id") == bin_id)
    elif limit is not None:
        # The limit comes before the lookup: the join cannot add or drop rows.
        recent = recent.orderBy(*newest).limit(limit)
    joined = recent.join(bins.select("bin_id", "bin_code"), "bin_id", "left")
    return joined if bin_id is None and limit is None else joined.orderBy(*newest)
