"""A keyed table kept current by a stream, as small deltas over a base.

Batch N writes its changed rows to ``delta=N``; every few batches all rows are written
together as ``base=N``. The table is the newest base with the later deltas laid over it, so
the work of a batch follows its own rows and at most ``COMPACT_EVERY`` deltas. A row that goes
is a marker in its delta, which hides the key's earlier rows and falls away at the next base.
Only folders with a ``_SUCCESS`` file count: one that a lost driver left half-written is as if
it were not there, and the batch that runs again writes it anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fleetgauge.sources.files import Files

#: Batches between two bases.
COMPACT_EVERY = 20
#: True in a delta where a key's row is gone.
GONE = "_gone"


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder was committed."""
    return Files(spark).exists(f"{path}/_SUCCESS")


def write_once(frame: DataFrame, path: str) -> None:
    """Write the folder unless it is complete; what a lost driver left is replaced."""
    if not is_complete(frame.sparkSession, path):
        frame.write.mode("overwrite").parquet(path)


def numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The batches whose folder of this kind is complete, in order."""
    names = Files(spark).names(path)
    found = [int(name.partition("=")[2]) for name in names if name.startswith(f"{kind}=")]
    return sorted(n for n in found if is_complete(spark, f"{path}/{kind}={n}"))


def create(empty: DataFrame, path: str) -> None:
    """The base before the first batch; left alone on a restart if it is complete."""
    write_once(empty, f"{path}/base=-1")


def upsert(changed: DataFrame, path: str, keys: list[str], batch_id: int,
           compact_every: int = COMPACT_EVERY, gone: DataFrame | None = None) -> None:
    """Lay the changed rows over the table as batch ``batch_id``; the keys in ``gone`` go.

    A key that is changed and gone in one batch stays, as changed. A batch that runs again
    replaces its own folders and reads only those of earlier batches. Nothing is deleted, so
    readers keep what they have opened; see ``expire``.
    """
    delta = changed
    if gone is not None:
        delta = changed.withColumn(GONE, F.lit(False)).unionByName(
            gone.select(*keys).withColumn(GONE, F.lit(True)), allowMissingColumns=True)
    delta.write.mode("overwrite").parquet(f"{path}/delta={batch_id}")
    if (batch_id + 1) % compact_every == 0:
        # A base of this batch may be there from an attempt that is running again.
        whole = _as_of(changed.sparkSession, path, keys, batch_id, batch_id - 1)
        whole.write.mode("overwrite").parquet(f"{path}/base={batch_id}")


def current(spark: SparkSession, path: str, keys: list[str], upto: int | None = None) -> DataFrame:
    """The table as of batch ``upto``, or of the newest complete batch."""
    reach = float("inf") if upto is None else upto
    return _as_of(spark, path, keys, reach, reach)


def _as_of(spark: SparkSession, path: str, keys: list[str], reach: float, base_reach: float) -> DataFrame:
    bases = [n for n in numbers(spark, path, "base") if n <= base_reach]
    if not bases:
        raise FileNotFoundError(f"no complete base in {path}")
    base = bases[-1]
    deltas = [n for n in numbers(spark, path, "delta") if base < n <= reach]
    before = spark.read.parquet(f"{path}/base={base}")
    if not deltas:
        return before
    marked = T.StructType([*before.schema.fields, T.StructField(GONE, T.BooleanType())])
    parts = before.withColumn(GONE, F.lit(False)).withColumn("_batch", F.lit(base))
    for n in deltas:
        # Deltas without a marker column hold changed rows alone.
        parts = parts.unionByName(spark.read.schema(marked).parquet(f"{path}/delta={n}")
                                  .withColumn(GONE, F.coalesce(GONE, F.lit(False)))
                                  .withColumn("_batch", F.lit(n)))
    rest = [c for c in before.columns if c not in keys]
    return (parts.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest, GONE), F.struct("_batch", ~F.col(GONE))).alias("_last"))
            .filter(f"NOT _last.{GONE}").select(*keys, "_last.*").select(*before.columns))


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete what is older than the ``keep`` newest bases. For the owner to call, at a time
    when no reader can still be at work on them."""
    bases = numbers(spark, path, "base")
    if len(bases) <= keep:
        return
    oldest = bases[-keep]
    gone = [f"base={n}" for n in bases if n < oldest] + [
        f"delta={n}" for n in numbers(spark, path, "delta") if n <= oldest]
    for name in gone:
        Files(spark).delete(f"{path}/{name}")
