"""Audits of keys and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetgauge.plans.keyed import stacked

# Table -> column sets that must be unique.
UNIQUE_KEYS = {
    "waste_bins": [("bin_id",), ("bin_code",)],
    "sensors": [("sensor_id",), ("sensor_code",), ("mac_address",)],
    "sensor_readings": [("reading_id",)],
    "collections": [("collection_id",)],
    "alerts": [("alert_id",)],
    "collection_routes": [("route_id",)],
    "route_bins": [("route_id", "bin_id")],
}
# Table -> (column, parent table) references.
REFERENCES = {
    "sensors": [("bin_id", "waste_bins")],
    "sensor_readings": [("sensor_id", "sensors"), ("bin_id", "waste_bins")],
    "collections": [("bin_id", "waste_bins")],
    "alerts": [("bin_id", "waste_bins")],
    "route_bins": [("route_id", "collection_routes"), ("bin_id", "waste_bins")],
}


def _repeated(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


# A bitmap per 32768 ids pays while at least one in so many ids is in use.
MOST_IDS_PER_ROW = 64


def _extent(df: DataFrame, column: str) -> DataFrame:
    """One row: how far the ids reach, and how many there are."""
    value = F.col(column).cast("decimal(20,0)")
    return df.agg((F.max(value) - F.min(value) + 1).alias("span"), F.count(column).alias("rows"))


def _is_dense(extent) -> bool:
    return bool(extent.rows) and extent.span <= MOST_IDS_PER_ROW * extent.rows


def repeated_ids(df: DataFrame, column: str, dense: bool | None = None) -> DataFrame:
    """Repeated values of an id: by bitmaps where the ids lie close together, which their
    least, greatest and number tell unless the caller does, else by counting each. The rows
    are the same."""
    if dense is None:
        dense = _is_dense(_extent(df, column).first())
    if dense:
        return repeated_dense_ids(df, column)
    return _repeated(df.dropna(subset=[column]), (column,))


def repeated_dense_ids(df: DataFrame, column: str) -> DataFrame:
    """Repeated values of an id that runs with arrival, without an exchange of all ids.

    Each bucket of 32768 ids is first reduced to a bitmap and a count, which shrink to
    almost nothing before their exchange. Only ids of buckets that hold more rows than
    distinct ids are then counted one by one.
    """
    value = F.col(column)
    bucket = F.bitmap_bucket_number(value)
    ids = df.select(column).filter(value.isNotNull())
    crowded = (ids.groupBy(bucket.alias("_bucket"))
               .agg(F.count(F.lit(1)).alias("held"),
                    F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(value)))
                    .alias("distinct"))
               .filter("held > distinct").select("_bucket"))
    suspects = ids.withColumn("_bucket", bucket).join(crowded, "_bucket", "left_semi")
    return _repeated(suspects, (column,))


def unique_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys that occur more than once; NULL keys do not collide.

    The extents of all id columns are taken in one job, side by side, and decide how each
    is counted.
    """
    keys = [(name, key) for name, found in UNIQUE_KEYS.items() if name in tables for key in found]
    ids = [(name, key[0]) for name, key in keys
           if len(key) == 1 and dict(tables[name].dtypes)[key[0]] in ("int", "bigint")]
    extents = stacked([_extent(tables[name], column).withColumn("at", F.lit(at))
                       for at, (name, column) in enumerate(ids)]).collect() if ids else []
    dense = {ids[r["at"]]: _is_dense(r) for r in extents}
    parts = []
    for name, key in keys:
        text = F.concat_ws(",", *[F.col(c).cast("string") for c in key])
        if (name, key[0]) in dense and len(key) == 1:
            found = repeated_ids(tables[name], key[0], dense[name, key[0]])
        else:
            found = _repeated(tables[name].dropna(subset=list(key), how="any"), key)
        parts.append(found.select(F.lit(name).alias("table_name"),
                                  F.lit(",".join(key)).alias("key_columns"),
                                  text.alias("key_value"), "occurrences"))
    return stacked(parts)


def orphan_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """References without a parent, with the number of rows that hold them.

    Child rows are counted per reference first, so the anti join meets one row per
    distinct value and not the readings themselves.
    """
    parts = []
    for name, references in REFERENCES.items():
        for column, parent in references:
            if name not in tables or parent not in tables:
                continue
            key = {"waste_bins": "bin_id", "sensors": "sensor_id",
                   "collection_routes": "route_id"}[parent]
            held = (tables[name].filter(F.col(column).isNotNull())
                    .groupBy(F.col(column).alias("reference"))
                    .agg(F.count(F.lit(1)).alias("row_count")))
            parents = tables[parent].select(F.col(key).alias("reference"))
            parts.append(held.join(parents, "reference", "left_anti").select(
                F.lit(name).alias("table_name"), F.lit(column).alias("column_name"),
                F.col("reference").cast("long").alias("reference"), "row_count"))
    return stacked(parts)
