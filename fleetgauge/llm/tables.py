"""Reading inputs, written intermediate tables, and joins against small sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.session import shared_dir

#: A side is broadcast only after it was counted and holds no more rows than this
#: (a few fixed-width columns each); beyond it the join is by key.
BROADCAST_ROWS = 200_000

#: The columns of ``documents``, in order; stages return just these.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, with no lineage,
    and still there when executors are lost."""
    path = shared_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the (written) frame was counted as small, else no hint."""
    return F.broadcast(frame) if frame.count() <= rows else frame


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
