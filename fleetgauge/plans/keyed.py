"""Per-key plan shapes that hold when one key owns a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_key(df: DataFrame, keys: list[str], values: list[str],
                   order: list[str]) -> DataFrame:
    """The last row of each key by ``order``.

    One scan and no join: an input partition is reduced to one row per key before the
    exchange, whatever the number of keys. Rows are brought together by key inside their
    partition only. Rows with a NULL order are left out by the caller.
    """
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
            .select(*keys, "_last.*"))


def top_n_per_key(df: DataFrame, key: str, order: list[Column], n: int,
                  rank: str = "rank", salts: int = 32) -> DataFrame:
    """The first ``n`` rows of each key with their rank.

    A rank filter becomes a group limit on both sides of its exchange. The first pass
    ranks within the key and a salt that all rows of an input partition share: at most
    ``n`` rows of a key leave a partition, and those of a busy key go to ``salts`` tasks.
    The second pass ranks the at most ``n * salts`` rows left of each key.
    """
    salted = Window.partitionBy(key, "_salt").orderBy(*order)
    few = (df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
           .withColumn("_rank", F.row_number().over(salted))
           .filter(F.col("_rank") <= n).drop("_rank", "_salt"))
    window = Window.partitionBy(key).orderBy(*order)
    return (few.withColumn(rank, F.row_number().over(window))
            .filter(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("long")))


def spread_null(key: Column, by: Column) -> Column:
    """A lookup key whose NULLs hash apart instead of meeting in one partition.

    The stand-in starts with U+0000, which no stored text holds, so it never matches.
    """
    return F.coalesce(key, F.concat(F.lit("\u0000"), by.cast("string")))


def rehashed(key: Column) -> Column:
    """The same text as a new expression.

    A join would reuse the partitioning that grouping by the key has left, and run-time
    re-planning splits hot keys only between two exchanges of the join's own. For the small
    side of a join whose other side has hot keys.
    """
    return F.concat(key, F.lit(""))


def with_previous(df: DataFrame, key: str, value: str, order: list[str], time: str,
                  keep: Column, slice_length: str = "10 minutes") -> DataFrame:
    """Rows for which ``keep`` holds, where ``keep`` may read ``previous``: the value of
    the row before, in order, of the same key.

    A window over the key alone would sort all rows of a busy key in one task. Here the
    first window is over (key, time slice); only the first and last row of each slice, and
    the rows already known to be kept, go on to the window over the key. Their number per
    key is bounded by the number of slices, not by the number of rows.
    """
    ordering = [F.col(c) for c in order]
    within = Window.partitionBy(key, "_slice").orderBy(*ordering)
    inner = (df.withColumn("_slice", F.window(time, slice_length).start)
             .withColumn("_first", F.row_number().over(within) == 1)
             .withColumn("_last", F.lead(F.lit(1)).over(within).isNull())
             .withColumn("previous", F.lag(value).over(within)))
    inner = (inner.withColumn("_keep", ~F.col("_first") & F.coalesce(keep, F.lit(False)))
             .filter("_first OR _last OR _keep"))
    across = Window.partitionBy(key).orderBy(*ordering)
    return (inner.withColumn("_before", F.lag(value).over(across))
            .withColumn("previous", F.when(F.col("_first"), F.col("_before"))
                        .otherwise(F.col("previous")))
            .filter(F.when(F.col("_first"), keep).otherwise(F.col("_keep")))
            .drop("_slice", "_first", "_last", "_keep", "_before"))


def single_row(*parts: DataFrame) -> DataFrame:
    """One row out of several one-row frames with different columns, without a join."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are worked out once per row.

    They are computed in a projection, which shares common subexpressions, and then pass
    through a one-row generator. Filters and projections above it read the results; over
    the projection alone the optimizer would copy the expressions into each of them, and
    a payload would be parsed many times.
    """
    staged = df.select("*", *[value.alias(f"_once_{name}") for name, value in columns.items()])
    fields = ", ".join(f"'{name}', _once_{name}" for name in columns)
    return staged.select(*df.columns, F.expr(f"inline(array(named_struct({fields})))"))
