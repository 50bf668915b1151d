"""Benchmark decontamination by winnowing.

Both sides are cut into words and hashed in grams of ``gram`` words. Of every ``window``
consecutive grams the one with the least hash is kept as a fingerprint, so that any
span of ``gram + window - 1`` shared words has a kept fingerprint in common, at the same
place of the span on both sides. Fingerprints of documents pass a bitmap of the
benchmark's hashes while the text is scanned; what passes is joined with the benchmark by
hash and extended word by word to the left and right. Only extensions of at least
``span`` words count. Items with fewer words are matched as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from fleetgauge.llm import scan
from fleetgauge.llm.tables import written

#: Words that a shared passage needs, and the grams that are hashed in it.
SPAN = 13
GRAM = 7
#: The bitmap has this many bits (1 MB) whatever the benchmark's size; a fuller one lets more
#: candidates through to the join, and changes no result.
BITMAP_BITS = 1 << 23


def _schema(frame: DataFrame, key: str) -> T.StructType:
    return T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", frame.schema[key].dataType),
        T.StructField("n_words", T.LongType()), T.StructField("place", T.IntegerType()),
        T.StructField("size", T.IntegerType()), T.StructField("print", T.LongType()),
        T.StructField("before", T.ArrayType(T.StringType())),
        T.StructField("after", T.ArrayType(T.StringType()))])


def _least(hashes: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Places kept by winnowing: the first least hash of each run of ``window`` grams."""
    filled = np.where(valid, hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
    count = len(filled) - window + 1
    if count <= 0:
        return np.flatnonzero(valid)
    best, place = filled[:count].copy(), np.arange(count)
    for i in range(1, window):
        less = filled[i:i + count] < best
        best[less] = filled[i:i + count][less]
        place[less] = np.arange(i, i + count)[less]
    kept = np.zeros(len(filled), bool)
    kept[place] = True
    return np.flatnonzero(kept & valid)


def _scan(frame: DataFrame, key: str, text: str, span: int, gram: int, lengths: list[int],
          bitmap: np.ndarray | None) -> DataFrame:
    """A row per text (place null) and one per fingerprint that the bitmap lets through.

    Without a bitmap the texts are benchmark items, and a text of fewer than ``span`` words
    gives the print of its whole word sequence. With one, prints of all word sequences of
    ``lengths`` words come besides the winnowed ones. ``size`` is 0 for winnowed prints.
    ``before`` and ``after`` hold the words around, as many as an extension may need.
    """
    shared = frame.sparkSession.sparkContext.broadcast(bitmap)
    reach, items, schema = span - gram, bitmap is None, _schema(frame, key)

    def candidates(hashes, text, counts):
        """(size, places, prints) of each kind."""
        for size in [0, *lengths]:
            grams = scan.gram_hashes(hashes, size or gram)
            owner = text[:len(grams)]
            inside = text[len(text) - len(grams):] == owner
            if items:
                inside = inside & ((counts[owner] == size) if size else (counts[owner] >= span))
            at = np.flatnonzero(inside) if size else _least(grams, inside, reach + 1)
            yield size, at, grams[at] ^ np.uint64(size)

    def prints(batches):
        table, low, bits = scan.lexical_words(), scan.lowered(), shared.value
        for batch in batches:
            raw, offsets = scan.texts(batch.column(2))
            for a, b in scan.runs(offsets):
                own = offsets[a:b + 1] - offsets[a]
                folded = low[raw[offsets[a]:offsets[b]]]
                starts, ends, heads = scan.words(folded, own, table)
                counts = np.diff(heads)
                rows, ids = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                none = pa.nulls(b - a, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [rows, ids, pa.array(counts.astype(np.int64)), pa.nulls(b - a, pa.int32()),
                     pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.int64()), none, none],
                    names=schema.names)
                hashes = scan.span_hashes(scan.prefix_sums(folded), starts, ends)
                text = np.repeat(np.arange(b - a), counts)
                for size, at, found in candidates(hashes, text, counts):
                    if bits is not None:
                        slot = (found & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
                        hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                        at, found = at[hit], found[hit]
                    if not len(at):
                        continue
                    owner, side = text[at], 0 if size else reach
                    first = np.maximum(at - side, heads[owner])
                    last = np.minimum(at + (size or gram) + side, heads[owner + 1])
                    yield pa.RecordBatch.from_arrays(
                        [rows.take(pa.array(owner)), ids.take(pa.array(owner)),
                         pa.nulls(len(at), pa.int64()),
                         pa.array((at - heads[owner]).astype(np.int32)),
                         pa.array(np.full(len(at), size, np.int32)), pa.array(found.view(np.int64)),
                         _word_lists(folded, starts, ends, first, at, True),
                         _word_lists(folded, starts, ends, at, last, False)], names=schema.names)

    numbered = frame.select(F.monotonically_increasing_id().alias("row"),
                            F.col(key).alias("id"), F.col(text).alias("text"))
    return numbered.mapInArrow(prints, schema)


def _word_lists(raw, starts, ends, first, last, backwards: bool) -> pa.Array:
    """Lists of the words from first up to last of each row."""
    sizes = last - first
    base = np.repeat(last - 1 if backwards else first, sizes)
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    index = base - step if backwards else base + step
    whole = raw.tobytes()
    values = [whole[s:e].decode() for s, e in zip(starts[index].tolist(), ends[index].tolist())]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.string()))


def _bitmap(prints: DataFrame) -> np.ndarray:
    """One bit per slot that a benchmark hash falls in; at most BITMAP_BITS / 64 rows reach
    the driver, 1 MB of bits."""
    slot = F.col("print").bitwiseAND(F.lit(BITMAP_BITS - 1))
    cells = (prints.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("cell"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).collect())
    bits = np.zeros(BITMAP_BITS // 64, np.int64)
    for r in cells:
        bits[r.cell] = r.bits
    return bits.view(np.uint8)


def _same(mine: str, theirs: str):
    """How many leading words of two lists are the same, one after another."""
    different = F.expr(
        f"array_position(zip_with({mine}, {theirs}, (x, y) -> coalesce(x = y, false)), false)")
    return F.when(different > 0, different - 1).otherwise(F.size(mine)).cast("int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", span: int = SPAN,
                  gram: int = GRAM, share: float = 0.05) -> DataFrame:
    """One row per document row: id, n_words, n_hit, spans, items, contaminated.

    ``spans`` are the hit stretches as (first, last) word numbers, last exclusive, in order
    and without overlaps; ``items`` the ids, as sorted strings, of benchmark rows with a
    matched window. A document is contaminated if it has a hit word and at least ``share``
    of its words are hit.

    Null and empty texts have no words and no hits; items without words match nothing. An
    item with a null id hits words and is not listed. Rows with the same id are judged
    one by one, and so are equal rows. Either side may be empty. Other columns are not read.
    """
    items = written(_scan(benchmark, item_key, item_text, span, gram, list(range(1, span)), None),
                    "benchmark-prints").filter("place is not null")
    # At most span - 1 lengths and one bitmap come to the driver, however large the benchmark.
    lengths = sorted(r["size"] for r in items.filter("size > 0").select("size").distinct().collect())
    scanned = written(_scan(docs, key, text, span, gram, lengths, _bitmap(items)), "document-prints")
    theirs = items.select("print", "size", F.col("id").cast("string").alias("item"),
                          F.col("before").alias("before2"), F.col("after").alias("after2"))
    met = (scanned.filter("place is not null").select("row", "place", "size", "print", "before", "after")
           .join(theirs, ["print", "size"])
           .select("row", "place", "size", "item", _same("before", "before2").alias("left"),
                   _same("after", "after2").alias("right")))
    whole = F.when(F.col("size") > 0, F.col("right") == F.col("size")).otherwise(
        (F.col("right") >= gram) & (F.col("left") + F.col("right") >= span))
    hits = met.filter(whole).select(
        "row", "item", (F.col("place") - F.when(F.col("size") > 0, 0).otherwise(F.col("left")))
        .alias("first"), (F.col("place") + F.col("right")).alias("last"))
    hits = written(hits.distinct(), "benchmark-hits")
    before = Window.partitionBy("row").orderBy("first", "last")
    reached = F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1))
    spans = (hits.groupBy("row", "first").agg(F.max("last").alias("last"))
             .withColumn("starts", F.coalesce(F.col("first") > reached, F.lit(True)).cast("int"))
             .withColumn("run", F.sum("starts").over(before.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("row", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
             .groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("n_hit"),
                                 F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")))
    found = hits.select("row", "item").distinct().groupBy("row").agg(
        F.sort_array(F.collect_list("item")).alias("items"))
    return (scanned.filter("place is null").select("row", "id", "n_words")
            .join(spans, "row", "left").join(found, "row", "left")
            .select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("spans", F.expr("cast(array() as array<struct<first: int, last: int>>)"))
                    .alias("spans"),
                    F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
            .withColumn("contaminated", (F.col("n_hit") > 0)
                        & (F.col("n_hit") >= F.col("n_words") * F.lit(share))))
