"""A registry as numbered versions, each published once as a whole.

A version is a folder with the rows, and with what came of the batch that made it: results,
errors, and the states that it added to the registry's history. All are written to a folder
of the writer's own, which then takes the name of the next version, unless another writer has
taken it. So of two batches made from one version only one becomes the next; the other is made
again from what the first left. A writer that is lost leaves a folder that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.operators.registry import RegistryChange, registry_states
from fleetgauge.sources.files import Files

#: How often a batch is made anew because another one came first.
ATTEMPTS = 8


class LostRace(RuntimeError):
    """Other writers kept publishing first."""


class Published(NamedTuple):
    version: int
    results: DataFrame
    errors: DataFrame


def _folder(path: str, version: int) -> str:
    return f"{path}/version={version}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, in order."""
    found = [n.partition("=")[2] for n in Files(spark).names(path) if n.startswith("version=")]
    return sorted(map(int, found))


def read(spark: SparkSession, path: str, version: int | None = None, part: str = "rows") -> DataFrame:
    """A part of a version, of the newest one by default: rows, results, errors or states."""
    if version is None:
        version = versions(spark, path)[-1]
    return spark.read.parquet(f"{_folder(path, version)}/{part}")


def history(spark: SparkSession, path: str) -> DataFrame:
    """The states of all versions, as the lookups of messages by their arrival take them."""
    return spark.read.option("mergeSchema", "true").parquet(*[f"{_folder(path, n)}/states" for n in versions(spark, path)])


def publish(parts: dict[str, DataFrame | Callable[[DataFrame], DataFrame]], path: str, base: int) -> bool:
    """Write the parts as the version after ``base``; false, and nothing is left, if that
    version is there already. A part may be a function of the rows, as they were written."""
    spark = parts["rows"].sparkSession
    files, own = Files(spark), f"{path}/unpublished-{uuid.uuid4().hex}"
    parts["rows"].write.parquet(f"{own}/rows")
    rows = spark.read.schema(parts["rows"].schema).parquet(f"{own}/rows")
    for name, part in parts.items():
        if name != "rows":
            (part(rows) if callable(part) else part).write.parquet(f"{own}/{name}")
    if files.take_name(own, _folder(path, base + 1)):
        return True
    files.delete(own)
    return False


def create(rows: DataFrame, path: str, key: str, at) -> None:
    """Version 0, unless there is one."""
    if not versions(rows.sparkSession, path):
        publish({"rows": rows, "states": registry_states(rows.limit(0), rows, key, at)}, path, -1)


def change(spark: SparkSession, path: str, key: str, at,
           make: Callable[[DataFrame], RegistryChange], attempts: int = ATTEMPTS) -> Published:
    """Publish the batch that ``make`` makes from the newest rows.

    Where another batch is published meanwhile, it is made again from that one's rows. The
    batch is worked out once for each attempt: results, errors, rows and states come from
    what was written.
    """
    for _ in range(attempts):
        base = versions(spark, path)[-1]
        rows = read(spark, path, base)
        made = make(rows)
        parts = {"results": made.results, "errors": made.errors, "rows": made.snapshot,
                 "states": lambda after, before=rows: registry_states(before, after, key, at)}
        if publish(parts, path, base):
            return Published(base + 1, read(spark, path, base + 1, "results"),
                             read(spark, path, base + 1, "errors"))
    raise LostRace(f"{attempts} batches were published first in {path}")


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete the rows of all but the ``keep`` newest versions, and folders of lost writers.
    Their states stay. For the owner to call, when nobody reads or writes them."""
    files = Files(spark)
    for n in versions(spark, path)[:-keep]:
        files.delete(f"{_folder(path, n)}/rows")
    for name in files.names(path):
        if name.startswith("unpublished-"):
            files.delete(f"{path}/{name}")
