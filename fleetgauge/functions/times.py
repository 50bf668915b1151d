"""Wall-clock time: every operator takes ``as_of`` instead of reading a clock.

Timestamps are TIMESTAMP_NTZ. Ages are differences of two NTZ values, so they are
exact to the microsecond and do not depend on the session time zone.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

MIN_LOOKBACK_HOURS = 1
MAX_LOOKBACK_HOURS = 168
DEFAULT_LOOKBACK_HOURS = 24
DATE_COLUMN = "reading_date"


def ntz(value: str | datetime | Column) -> Column:
    """A TIMESTAMP_NTZ literal (or cast)."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    return F.lit(str(value)).cast("timestamp_ntz")


def moment(as_of: str | datetime) -> datetime:
    """The naive time of a literal."""
    return as_of if isinstance(as_of, datetime) else datetime.fromisoformat(as_of)


def hours_before(as_of, hours: int) -> Column:
    return ntz(as_of) - F.expr(f"INTERVAL '{int(hours)}' HOUR")


def days_before(as_of, days: int) -> Column:
    return ntz(as_of) - F.expr(f"INTERVAL '{int(days)}' DAY")


def check_lookback(hours: int, most: int | None = MAX_LOOKBACK_HOURS) -> int:
    """The hours, if they lie between one and ``most``; without ``most`` there is no upper end."""
    if hours < MIN_LOOKBACK_HOURS or (most is not None and hours > most):
        raise ValueError(f"hours must be {MIN_LOOKBACK_HOURS}..{most}, got {hours}")
    return hours


def in_range(df: DataFrame, lower: Column, upper: Column | None = None,
             column: str = "timestamp", date_column: str = DATE_COLUMN) -> DataFrame:
    """Rows with ``column`` at or after ``lower`` (and at or before ``upper``).

    On a table partitioned by date the same bounds go to the partition column, so
    whole folders are skipped before the row-group statistics are looked at.
    """
    ts = F.col(column)
    kept = df.filter(ts >= lower)
    if upper is not None:
        kept = kept.filter(ts <= upper)
    if date_column in df.columns:
        kept = kept.filter(F.col(date_column) >= lower.cast("date"))
        if upper is not None:
            kept = kept.filter(F.col(date_column) <= upper.cast("date"))
    return kept


def age(ts: Column, as_of) -> Column:
    """``as_of - ts`` as a day-time interval."""
    return ntz(as_of) - ts


def age_minutes(ts: Column, as_of) -> Column:
    """Whole minutes of a non-negative age."""
    span = age(ts, as_of)
    return (F.extract(F.lit("DAY"), span).cast("long") * 1440
            + F.extract(F.lit("HOUR"), span).cast("long") * 60
            + F.extract(F.lit("MINUTE"), span).cast("long"))


def zoned_text(ts: Column, offset: str = "+07:00") -> Column:
    """A naive timestamp as ISO text with a fixed zone suffix.

    The fraction is printed only when there is one, always with six digits.
    """
    text = F.replace(ts.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))
    full = F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)
    return F.concat(full, F.lit(offset))


def zoned_string(text: Column, offset: str = "+07:00") -> Column:
    """The same suffix for ISO strings that carry no zone yet; other text is unchanged."""
    naive = ((F.length(text) >= 19) & (F.substring(text, 11, 1) == "T")
             & ~text.contains("+") & ~text.endswith("Z"))
    return F.when(naive, F.concat(text, F.lit(offset))).otherwise(text)
