"""Vectors compressed to short codes, one codebook entry a part.

Components become integers, vectors are cut into equal parts, and each part is replaced by
the nearest entry of that part's codebook. The search for the nearest entry slices and
intersects: per dimension the entries' coordinates are sorted, and each place carries the
bitmask of the entries before it. A radius around a component selects a range of places; the
masks at its two ends give the entries inside by one exclusive or. The masks of all
dimensions ANDed leave every entry that can lie within the radius, and distances are taken to
those alone. Where none lies within the radius, the search goes on with a larger one, so the
entry found is the nearest for sure.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.tables import small, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors searched at once; bounds a task's memory.
BLOCK = 512
#: Vectors of a batch whose nearest distance sets the first radius.
PROBES = 32
#: Beyond this no squared distance over a vector of up to 1,024 components is sure to fit.
LARGEST = 1 << 25


def whole_numbers(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, width, components): floor(1024 x) packed as 32-bit integers, of the
    vectors without null or non-finite components."""
    schema = T.StructType([
        T.StructField("vec_id", vectors.schema[key].dataType),
        T.StructField("label", vectors.schema[label].dataType),
        T.StructField("width", T.IntegerType()), T.StructField("components", T.BinaryType())])

    def convert(batches):
        for batch in batches:
            column = batch.column(2)
            width = np.asarray(column.value_lengths().fill_null(0), np.int64)
            flat = column.flatten()  # the components of null vectors are left out
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: not a number
            ends = np.cumsum(width)
            # A vector without components has nothing non-finite in it.
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            fit = np.asarray(column.is_valid()) & (wrong[ends] == wrong[ends - width])
            scaled = np.floor(np.where(np.isfinite(values), values, 0.0) * SCALE)
            large = np.concatenate([[0], np.cumsum(np.abs(scaled) > LARGEST)])
            if (fit & (large[ends] != large[ends - width])).any():
                raise ValueError(f"a component beyond {LARGEST // SCALE}: errors would not fit 64 bits")
            ints = np.clip(scaled, -LARGEST, LARGEST).astype(np.int32)
            rows = np.flatnonzero(fit)
            packed = [ints[a:b].tobytes() for a, b in zip(ends[rows] - width[rows], ends[rows])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                 pa.array(width[rows].astype(np.int32)), pa.array(packed, pa.binary())],
                names=schema.names)

    return vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"),
                          F.col(vector).alias("vector")).mapInArrow(convert, schema)


class Slices:
    """One part's codebook, ready for slice-and-intersect searches."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        count, width = entries.shape
        self.words = -(-count // 64)
        order = np.argsort(self.entries, axis=0, kind="stable").T
        self.coordinates = np.take_along_axis(self.entries.T, order, axis=1)
        bits = np.zeros((width, count + 1, self.words), np.uint64)
        place = np.arange(count)
        for dim in range(width):
            bits[dim, place + 1, order[dim] // 64] = np.uint64(1) << (order[dim] % 64).astype(np.uint64)
        self.prefix = np.bitwise_or.accumulate(bits, axis=1)

    def inside(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that are within the radius in every dimension."""
        masks = np.full((len(points), self.words), np.iinfo(np.uint64).max, np.uint64)
        for dim, (coordinates, prefix) in enumerate(zip(self.coordinates, self.prefix)):
            low = np.searchsorted(coordinates, points[:, dim] - radius, side="left")
            high = np.searchsorted(coordinates, points[:, dim] + radius, side="right")
            masks &= prefix[high] ^ prefix[low]
        return masks

    def distances(self, points, point, entry) -> np.ndarray:
        total = np.zeros(len(point), np.int64)
        for dim in range(points.shape[1]):
            gap = points[point, dim] - self.entries[entry, dim]
            total += gap * gap
        return total

    def first_radius(self, points: np.ndarray) -> int:
        """The middle nearest distance of a few points, rounded up."""
        some = points[:: max(1, len(points) // PROBES)]
        gaps = ((some[:, None, :] - self.entries[None]) ** 2).sum(2).min(1)
        return int(np.ceil(np.sqrt(np.median(gaps)))) + 1

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point, the lower of equal ones, and its squared distance."""
        points = points.astype(np.int64)
        best, least = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        first = self.first_radius(points) if len(points) else 0
        for start in range(0, len(points), BLOCK):
            open_ones = np.arange(start, min(start + BLOCK, len(points)))
            radius = np.full(len(open_ones), first, np.int64)
            while len(open_ones):
                own = points[open_ones]
                bits = np.unpackbits(self.inside(own, radius).view(np.uint8), axis=1, bitorder="little")
                point, entry = np.nonzero(bits)
                gap = self.distances(own, point, entry)
                heads = np.flatnonzero(np.concatenate([[True], point[1:] != point[:-1]])) if len(point) else point
                seen = point[heads]
                nearest = np.minimum.reduceat(gap, heads) if len(heads) else gap
                shortest = np.full(len(own), np.iinfo(np.int64).max)
                shortest[seen] = nearest
                at = np.flatnonzero(gap == shortest[point])  # entries ascend: the first is the lower
                winner = np.zeros(len(own), np.int64)
                winner[point[at][::-1]] = entry[at][::-1]
                # Every entry as near as the radius was met, so a nearest within it is final.
                done = shortest <= radius * radius
                best[open_ones[done]], least[open_ones[done]] = winner[done], shortest[done]
                found = shortest < np.iinfo(np.int64).max
                reach = np.ceil(np.sqrt(np.where(found, shortest, 0).astype(np.float64))).astype(np.int64) + 1
                radius = np.where(found, reach, 2 * radius)[~done]
                open_ones = open_ones[~done]
        return best, least


def _points(batch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("components").to_pylist()), np.int32).reshape(-1, width)


def _sums(numbers: DataFrame, books: np.ndarray) -> DataFrame:
    """(slot, place, total): per entry the sums of its parts' components, and their count
    at place -1. A task sends one row per entry and component."""
    parts, entries, width = books.shape
    shared = numbers.sparkSession.sparkContext.broadcast(books)

    def add(batches):
        slices = [Slices(book) for book in shared.value]
        totals = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            points = _points(batch, parts * width).reshape(-1, parts, width)
            for part in range(parts):
                slot = part * entries + slices[part].nearest(points[:, part])[0]
                order = np.argsort(slot, kind="stable")
                heads = np.flatnonzero(np.concatenate([[True], np.diff(slot[order]) != 0]))
                if len(slot):
                    own = points[order, part].astype(np.int64)
                    totals[slot[order][heads], 1:] += np.add.reduceat(own, heads)
                    totals[:, 0] += np.bincount(slot, minlength=len(totals))
        used, place = np.nonzero(totals[:, :1] + np.zeros_like(totals))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array((place - 1).astype(np.int32)),
             pa.array(totals[used, place])], names=["slot", "place", "total"])

    return (numbers.select("components").mapInArrow(add, "slot int, place int, total long")
            .groupBy("slot", "place").agg(F.sum("total").alias("total")))


def _moved(books: np.ndarray, sums: list) -> np.ndarray:
    """Each used entry becomes the floor of its parts' mean."""
    parts, entries, width = books.shape
    moved = books.reshape(parts * entries, width).copy()
    counts = {r.slot: r.total for r in sums if r.place < 0}
    for r in sums:
        if r.place >= 0:
            moved[r.slot, r.place] = r.total // counts[r.slot]
    return moved.reshape(books.shape)


def learn(numbers: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, components of a part) of the written whole numbers.

    They start as the vectors of the least ids (null ids last, equal ids by their packed
    components); every round reads all vectors. The driver holds the codebooks alone.
    """
    first = numbers.orderBy(F.col("vec_id").asc_nulls_last(), "components").limit(entries).collect()
    width = first[0].width // parts if first else 0
    start = np.array([np.frombuffer(r.components, np.int32) for r in first], np.int64)
    books = start.reshape(len(first), parts, width).swapaxes(0, 1).copy()
    for _ in range(rounds if len(first) else 0):
        books = _moved(books, _sums(numbers, books).collect())
    return books


def fingerprint(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def assign(numbers: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    parts, entries, width = books.shape
    shared = numbers.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([*numbers.select("vec_id", "label").schema, T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])

    def encode(batches):
        slices = [Slices(book) for book in shared.value]
        for batch in batches:
            points = _points(batch, parts * width).reshape(-1, parts, width)
            codes, error = np.zeros((len(points), parts), np.uint8), np.zeros(len(points), np.int64)
            for part in range(parts):
                codes[:, part], gap = slices[part].nearest(points[:, part])
                error += gap
            hexed = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"),
                 pa.array([hexed[i:i + 2 * parts] for i in range(0, len(hexed), 2 * parts)], pa.string()),
                 pa.array(error)], names=schema.names)

    return numbers.select("vec_id", "label", "components").mapInArrow(encode, schema)


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of all vectors but those that are
    null or hold null or non-finite components.

    Vectors are compared with the one of the least id: those of another number of components,
    and all where that number is nought or no multiple of ``parts``, have null code and error and
    take no part in the codebooks. Fewer than 256 vectors give as many entries. Repeated ids
    and vectors count as often as they come, a null id is after all others, null labels are one
    label, an empty table gives no rows, other columns are not read. Components beyond
    32,768 are refused, as their errors need not fit 64 bits.
    """
    numbers = written(whole_numbers(vectors, key, vector, label), "whole-numbers")
    first = numbers.orderBy(F.col("vec_id").asc_nulls_last(), "components").limit(1).collect()
    width = first[0].width if first and first[0].width % parts == 0 else 0
    alike = numbers.filter((F.col("width") == width) & (F.col("width") > 0))
    books = learn(alike, parts, ENTRIES, rounds)
    coded = written(assign(alike, books), "codes")
    others = numbers.filter((F.col("width") != width) | (F.col("width") == 0)).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    totals = small(totals.withColumnRenamed("label", "of"))
    return (coded.unionByName(others).join(totals, F.col("label").eqNullSafe(F.col("of")), "left")
            .select("vec_id", "code", "error", "label_error",
                    F.lit(fingerprint(books)).alias("codebooks_sha256")))
