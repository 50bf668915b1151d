"""Table scans and sinks on Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetgauge.functions.times import DATE_COLUMN, ntz
from fleetgauge.sources.schemas import DEFAULTS, TABLES


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Scan a table by its declared schema; partition folders add their own columns."""
    return spark.read.schema(TABLES[name]).option("mergeSchema", "false").parquet(path)


def with_defaults(df: DataFrame, name: str, now: Column) -> DataFrame:
    """Shape rows to a table: missing columns become NULL, then defaults fill in."""
    defaults = DEFAULTS.get(name, {})
    columns = []
    for field in TABLES[name]:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in defaults:
            default = defaults[field.name]
            default = now if default == "now" else F.lit(default)
            value = F.coalesce(value, default.cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(*columns)


#: Row groups of readings hold about so many bytes and pages so many rows, so that few of
#: either lie in the range of one bin. A large date has many; a small one costs no more.
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 4096


def write_readings(readings: DataFrame, path: str, batch_id: int | None = None,
                   row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Append readings, in folders by date, laid out for one bin as well as for a time.

    Rows are rebalanced on the date, and a date too large for one file is split
    again at run time, so a busy day does not become one task. Inside a file rows lie by bin
    and time: the statistics of row groups and pages leave a reader of one bin those of its
    range, and a Bloom filter per row group those that hold the bin at all.

    With ``batch_id`` the date folders lie in a folder of the batch, and writing the batch
    again replaces that folder: a replay after a lost driver leaves no duplicates. Reading such
    folders and appending them without ``batch_id`` compacts them.
    """
    out = (readings.withColumn(DATE_COLUMN, F.col("timestamp").cast("date"))
           .hint("rebalance", DATE_COLUMN).sortWithinPartitions(DATE_COLUMN, "bin_id", "timestamp"))
    writer = out.write.partitionBy(DATE_COLUMN).options(**{
        "parquet.block.size": str(row_group_bytes), "parquet.page.row.count.limit": str(page_rows),
        "parquet.bloom.filter.enabled#bin_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"})
    if batch_id is None:
        writer.mode("append").parquet(path)
    else:
        writer.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch to a folder of its own; a replay replaces that folder."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def append_new(incoming: DataFrame, existing: DataFrame, name: str, key: str,
               id_column: str, now) -> DataFrame:
    """Rows to insert with "skip rows whose key exists".

    Of incoming rows with one key the lowest ``item_seq`` is taken. New ids follow the
    highest existing id in ``item_seq`` order; skipped rows leave gaps, as a sequence
    does.
    """
    first = (incoming.groupBy(key)
             .agg(F.min_by(F.struct(*[c for c in incoming.columns if c != key]), "item_seq")
                  .alias("row"))
             .select(key, "row.*"))
    fresh = first.join(existing.select(key), key, "left_anti")
    last_id = existing.agg(F.coalesce(F.max(id_column), F.lit(0))).scalar()
    fresh = fresh.withColumn(id_column, (last_id + F.col("item_seq")).cast("int"))
    return with_defaults(fresh, name, ntz(now))


def newest_rows(readings: DataFrame, n: int = 10) -> DataFrame:
    """The newest rows over all bins."""
    return readings.orderBy(F.desc("timestamp"), F.desc("reading_id")).limit(n)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
