"""Which grams of a corpus occur elsewhere, asked once for all texts.

Texts are cut into grams in runs; each run sends its grams' hashes, 4 bytes each, to the
parts of the hash range, and gets back one bit for each gram: whether it met an indexed
gram at another place. A false yes (two grams with one hash) is possible and harmless,
since callers compare what was met; a false no is not.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm import packs, scan
from fleetgauge.llm.tables import small, written

_HOME = "home struct<ids: array<long>, marks: array<long>, counts: binary>"


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, mark, text): the mark is a 64-bit hash by which equal texts are found."""
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("mark"),
                       F.col(text).alias("text"))


def originals(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all, first, texts): every (id, mark); for each mark the least id, null before all
    others; and the rows that hold those, one per mark."""
    every = written(rows.select("id", "mark"), "ids")
    shape = every.groupBy("mark").agg(
        F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("f"),
        F.count("*").alias("rows"))
    first = written(shape.select("mark", F.col("f.id").alias("first_id"), "rows"), "first-ids")
    later = every.join(first.filter("rows > 1"), "mark").filter(
        ~F.col("id").eqNullSafe(F.col("first_id"))).select("id", "mark").distinct()
    later = written(later, "later-copies").select(F.col("id").alias("id2"), F.col("mark").alias("mark2"))
    texts = rows.join(small(later), (F.col("mark") == F.col("mark2"))
                      & F.col("id").eqNullSafe(F.col("id2")), "left_anti")
    if not every.join(first.filter("rows > 1"), "mark").filter(
            F.col("id").eqNullSafe(F.col("first_id"))).groupBy("mark").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["mark"])  # rows that repeat both id and text
    return every, first, texts


def met(texts: DataFrame, grams: Callable, parts: int) -> DataFrame:
    """(id, mark, bits): for each text with a gram that was met, a bit for each gram.

    ``grams(bytes, offsets)`` gives, for a run of texts, the text and the 64-bit hash of each
    gram, in order, and whether it is indexed. Bits are ordered by part, then place; see
    ``met_flags``.
    """
    def deal(batches):
        for batch in batches:
            raw, offsets = scan.texts(batch.column(2))
            for a, b in scan.runs(offsets):
                text, hashes, indexed = grams(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                part = (hashes % np.uint64(parts)).astype(np.int64)
                counts = np.bincount(text * parts + part, minlength=(b - a) * parts)
                ids, marks = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                run = marks[0].as_py()
                used, columns = packs.dealt(part, parts, (hashes // np.uint64(parts)).astype(np.uint32),
                                            indexed.astype(np.uint8))
                rows = len(used)
                home = [{"ids": ids.to_pylist(), "marks": marks.to_pylist(),
                         "counts": packs.pack(counts.astype(np.uint32))}]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([used, pa.array([run % parts], pa.int32())]),
                     pa.array([run] * (rows + 1), pa.int64()),
                     pa.concat_arrays([columns[0], pa.nulls(1, pa.binary())]),
                     pa.concat_arrays([columns[1], pa.nulls(1, pa.binary())]),
                     pa.array([None] * rows + home, kind)],
                    names=["part", "run", "tokens", "indexed", "home"])

    def answer(table):
        asked = table.filter(pa.compute.is_valid(table.column("tokens")))
        sizes = np.array([len(x) for x in asked.column("indexed").to_pylist()], np.int64)
        token = packs.unpacked(asked.column("tokens"), np.uint32)
        indexed = packs.unpacked(asked.column("indexed"), np.uint8).astype(bool)
        _, group = np.unique(token, return_inverse=True)
        several = np.bincount(group) > 1
        known = np.bincount(group, weights=indexed) > 0
        bits = (several & known)[group] if len(token) else np.zeros(0, bool)
        homes = table.filter(pa.compute.is_null(table.column("tokens")))
        n, edges = len(asked), np.append(0, np.cumsum(sizes))
        return pa.Table.from_arrays(
            [pa.chunked_array([*asked.column("run").chunks, *homes.column("run").chunks], pa.int64()),
             pa.chunked_array([*asked.column("part").chunks, *homes.column("part").chunks], pa.int32()),
             pa.array([*(packs.pack(bits[x:y]) for x, y in zip(edges[:-1], edges[1:])),
                       *[None] * len(homes)], pa.binary()),
             pa.chunked_array([pa.nulls(n, kind), *homes.column("home").chunks], kind)],
            names=["run", "part", "bits", "home"])

    def gather(table):
        home_rows = table.filter(pa.compute.is_valid(table.column("home"))).column("home").to_pylist()
        rows = table.filter(pa.compute.is_null(table.column("home"))).sort_by("part")
        bits = packs.unpacked(rows.column("bits"), np.uint8).astype(bool)
        if len(home_rows) > 1:
            raise ValueError("runs are told apart by the mark of their first text")
        home = home_rows[0]
        n = len(home["ids"])
        counts = np.frombuffer(home["counts"], np.uint32).reshape(n, parts).astype(np.int64)
        text = np.repeat(np.tile(np.arange(n), parts), counts.T.reshape(-1))
        order = np.argsort(text, kind="stable")
        text, bits = text[order], bits[order]
        edges = np.searchsorted(text, np.arange(n + 1))
        sums = np.concatenate([[0], np.cumsum(bits)])
        some = np.flatnonzero(sums[edges[1:]] > sums[edges[:-1]])
        return pa.table({
            "id": pa.array([home["ids"][i] for i in some], pa.int64()),
            "mark": pa.array([home["marks"][i] for i in some], pa.int64()),
            "bits": pa.array([packs.pack(np.packbits(bits[edges[i]:edges[i + 1]])) for i in some],
                             pa.binary())})

    kind = pa.struct([("ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())),
                      ("counts", pa.binary())])
    asked = texts.select("id", "mark", "text").mapInArrow(
        deal, f"part int, run long, tokens binary, indexed binary, {_HOME}")
    answered = asked.groupBy("part").applyInArrow(answer, f"run long, part int, bits binary, {_HOME}")
    return answered.groupBy("run").applyInArrow(gather, "id long, mark long, bits binary")


def met_flags(text: np.ndarray, hashes: np.ndarray, parts: int, bits: list[bytes]) -> np.ndarray:
    """The bits of a run's texts in the order of its grams."""
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(text * parts + part, kind="stable")
    sizes = np.bincount(text, minlength=len(bits))
    flags = np.zeros(len(text), bool)
    flags[order] = np.concatenate(
        [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(bits, sizes.tolist())]
    ).astype(bool) if len(text) else flags
    return flags


def with_texts(texts: DataFrame, side: DataFrame) -> DataFrame:
    """The rows of ``side`` (by mark) with their ids and texts; ``side`` has one row a mark."""
    side = side.withColumnRenamed("mark", "mark2")
    wanted = written(side.select("mark2"), "wanted")
    near = texts.join(small(wanted), F.col("mark") == F.col("mark2"), "left_semi")
    return near.join(side.drop("id"), F.col("mark") == F.col("mark2")).drop("mark2")
