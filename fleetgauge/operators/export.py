"""Interval export, CSV and JSON outputs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetgauge.functions.labels import EXPORT_HEADERS, place_name
from fleetgauge.functions.times import in_range, ntz, zoned_string, zoned_text

EXPORT_COLUMNS = list(EXPORT_HEADERS)
REPORT_SCHEMA = ("timestamp timestamp_ntz, bin_code string, department string, "
                 "weight_kg decimal(8,2), battery_level decimal(5,2), signal_strength int, "
                 "temperature_c decimal(5,2)")
# Fixed value: the columns whose naive times get a zone in JSON rows.
ZONED_COLUMNS = ("timestamp", "last_reading", "triggered_at", "resolved_at", "last_login",
                 "created_at", "updated_at", "installed_date", "last_reading_today",
                 "collection_time")


def interval(start_date: str, end_date: str, start_time: str = "00:00",
             end_time: str = "23:59") -> tuple[str, str]:
    """Both ends as texts; the end must come after the start."""
    start = datetime.fromisoformat(f"{start_date}T{start_time or '00:00'}")
    end = datetime.fromisoformat(f"{end_date}T{end_time or '23:59'}")
    if end <= start:
        raise ValueError("the end must be after the start")
    return str(start), str(end)


def report_name(start_date: str, end_date: str) -> str:
    """The folder name of a report. The prefix is a fixed value."""
    return f"infectious_waste_{start_date}_{end_date}"


def export_hours(start: str, end: str) -> int:
    """Hours an interval spans, rounded up, at least 1."""
    seconds = (datetime.fromisoformat(end) - datetime.fromisoformat(start)).total_seconds()
    return max(1, -int(-seconds // 3600))


def export_report(readings: DataFrame, bins: DataFrame, start: str, end: str) -> DataFrame:
    """Readings of an interval, both ends included, with the department they belong to.

    The department is the location of an active bin, else the bin code.
    """
    wanted = in_range(readings, ntz(start), ntz(end))
    places = bins.select(
        "bin_id", "bin_code",
        F.when(F.col("status") == "active", F.col("location")).alias("_location"))
    return (wanted.join(places, "bin_id", "left")
            .withColumn("department", place_name(F.col("_location"), F.col("bin_code")))
            .select("reading_id", *EXPORT_COLUMNS,
                    F.lit(export_hours(start, end)).alias("lookback_hours")))


def csv_rows(report: DataFrame) -> DataFrame:
    """The seven report columns under their printed headers, times as naive ISO text."""
    printed = report.withColumn("timestamp", zoned_text(F.col("timestamp"), ""))
    return printed.select(*[F.col(c).alias(EXPORT_HEADERS[c]) for c in EXPORT_COLUMNS])


def write_csv(report: DataFrame, path: str) -> None:
    """A folder of CSV parts, each with the header row; NULL is empty, quotes are doubled."""
    (csv_rows(report).write.mode("errorifexists")
     .option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "")
     .option("encoding", "UTF-8")
     .csv(path))


# What a report file begins with, and the zone that its times carry.
BYTE_ORDER_MARK = "\ufeff"
REPORT_ZONE = "+07:00"


def _field(name: str, kind: str, offset: str) -> Column:
    """A value as report lines print it: numbers without closing zeros, NULL as nothing, a text in
    quotes if it holds a comma, and whatever else it holds as it is."""
    value = F.col(name)
    if kind.startswith("timestamp"):
        text = zoned_text(value, offset)
    elif kind.startswith("decimal"):
        text = F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1")
        text = F.rtrim(text, F.lit("."))
    elif kind == "string":
        text = F.when(F.contains(value, F.lit(",")), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def report_lines(report: DataFrame, offset: str = REPORT_ZONE) -> DataFrame:
    """The lines of a report file in order, the header with its byte-order mark first, then
    the newest reading: (line, first, timestamp, reading_id)."""
    kinds = dict(report.dtypes)
    line = F.concat_ws(",", *[_field(c, kinds[c], offset) for c in EXPORT_COLUMNS])
    lines = report.select(line.alias("line"), F.lit(False).alias("first"), "timestamp", "reading_id")
    header = report.sparkSession.range(1).select(
        F.lit(BYTE_ORDER_MARK + ",".join(EXPORT_HEADERS[c] for c in EXPORT_COLUMNS)).alias("line"),
        F.lit(True).alias("first"), F.lit(None).cast("timestamp_ntz").alias("timestamp"),
        F.lit(None).cast("long").alias("reading_id"))
    return header.unionByName(lines).orderBy(F.desc("first"), F.desc("timestamp"), F.desc("reading_id"))


def write_report_lines(report: DataFrame, path: str, offset: str = REPORT_ZONE) -> None:
    """A folder of text parts that one after another are the report file. Every line ends with
    a line feed, the last one too."""
    report_lines(report, offset).select("line").write.mode("errorifexists").option(
        "lineSep", "\n").text(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A written report back as typed columns under their plain names."""
    return (spark.read.schema(REPORT_SCHEMA).option("header", True).option("escape", '"')
            .option("enforceSchema", True).csv(path))


def zoned_rows(df: DataFrame, offset: str = "+07:00") -> DataFrame:
    """Known time columns as ISO text with a fixed zone: timestamps, and texts without one."""
    def shown(name: str, kind: str):
        if name in ZONED_COLUMNS and kind.startswith("timestamp"):
            return zoned_text(F.col(name), offset).alias(name)
        if name in ZONED_COLUMNS and kind == "string":
            return zoned_string(F.col(name), offset).alias(name)
        return F.col(name)

    return df.select(*[shown(name, kind) for name, kind in df.dtypes])


def write_json(df: DataFrame, path: str, offset: str = "+07:00") -> None:
    zoned_rows(df, offset).write.mode("errorifexists").json(path)
