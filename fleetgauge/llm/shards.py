"""Sharding over fixed virtual slots, with DataFrame functions only.

A record is hashed into one of a few thousand slots by its id and text. Bytes are
summed per slot, and a slot-to-shard map is made from those sums alone and written as
a numbered version. Rebalancing edits the map, so that only the records of the slots it
moves change their shard. Slots, not records, are balanced, so everything after the
per-slot sums has at most ``slots`` rows however large the corpus is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from fleetgauge.llm.tables import written
from fleetgauge.session import shared_dir

SLOTS = 4096
#: Bytes that a record costs besides its text.
RECORD_OVERHEAD = 16

MAP_SCHEMA = T.StructType([T.StructField("slot", T.IntegerType()),
                           T.StructField("shard", T.IntegerType()),
                           T.StructField("bytes", T.LongType())])


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and the overhead of a record."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_OVERHEAD).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("long")


def slot_of(key: Column, crc: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: eight hex digits of an MD5 of its id and text checksum.

    A null id counts as an empty one, so records without an id are spread by text.
    """
    name = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), crc.cast("string"))
    digits = F.conv(F.substring(F.md5(F.encode(name, "UTF-8")), 1, 8), 16, 10)
    return F.pmod(digits.cast("long"), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, also of those without records: (slot, bytes, rows)."""
    sums = records.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(sums, "slot", "left").fillna(0, ["bytes", "rows"])


def _dealt(loads: str, shards: int) -> Column:
    """Greedy deal of ``heavy``, an array of (bytes, slot) by falling bytes: each goes to
    the shard with the least load so far, the first of equals."""
    return F.expr(f"""
      aggregate(heavy,
        named_struct('load', {loads}, 'picks', cast(array() as array<int>)),
        (a, x) -> transform(array(cast(array_position(a.load, array_min(a.load)) as int)),
          k -> named_struct(
            'load', transform(a.load, (v, i) -> if(i = k - 1, v + x.bytes, v)),
            'picks', concat(a.picks, array(k - 1))))[0],
        a -> a.picks)""")


def initial_map(sums: DataFrame, shards: int) -> DataFrame:
    """The first map: heaviest slot first, always to the lightest shard.

    One row of at most ``slots`` entries is handled at once; no record is in it. Slots
    without records are dealt by their number, so that every slot has a shard.
    """
    empty = sums.filter("bytes = 0").select(
        "slot", F.pmod("slot", F.lit(shards)).alias("shard"), F.col("bytes").cast("long").alias("bytes"))
    return _heavy_map(sums.filter("bytes > 0"), shards).unionByName(empty)


def _heavy_map(sums: DataFrame, shards: int) -> DataFrame:
    loads = f"array_repeat(0L, {shards})"
    heavy = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("low"), "slot")))
    return (sums.agg(heavy.alias("sorted"))
            .select(F.expr("transform(sorted, x -> named_struct('bytes', -x.low, 'slot', x.slot))")
                    .alias("heavy"))
            .select(F.arrays_zip(F.col("heavy"), _dealt(loads, shards).alias("picks"))
                    .alias("zipped"))
            .select(F.explode("zipped").alias("z"))
            .select(F.col("z.heavy.slot").alias("slot"), F.col("z.picks").alias("shard"),
                    F.col("z.heavy.bytes").alias("bytes")))


def grown_map(current: DataFrame, shards: int) -> DataFrame:
    """The map with one more shard, number ``shards``: slots move only into it.

    From every old shard the smallest slots with records go while their bytes, summed up, are
    at most the share that the shard has to give; of slots without records, those whose
    number's hash falls to the new shard.
    """
    give = (current.groupBy("shard").agg(F.sum("bytes").alias("load"))
            .select("shard", (F.col("load") - F.sum("load").over(Window.partitionBy())
                              / (shards + 1)).alias("give")))
    order = Window.partitionBy("shard").orderBy("bytes", "slot")
    return (current.join(F.broadcast(give), "shard")
            .withColumn("so_far", F.sum("bytes").over(order))
            .select("slot", F.when(F.when(F.col("bytes") > 0, F.col("so_far") <= F.col("give"))
                                   .otherwise(F.pmod(F.xxhash64("slot"), F.lit(shards + 1)) == 0), F.lit(shards))
                    .otherwise(F.col("shard")).cast("int").alias("shard"), "bytes"))


def store_map(mapping: DataFrame, root: str, version: int) -> DataFrame:
    """Write a version of the map; a version that exists is an error, never replaced."""
    path = f"{root}/version={version}"
    mapping.select("slot", "shard", "bytes").coalesce(1).write.parquet(path)
    return mapping.sparkSession.read.schema(MAP_SCHEMA).parquet(path)


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, map_root: str | None = None,
          key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its virtual slot, its shard and its place in the shard.

    Gives the key column as ``record_id``, then size, text_crc32, virtual_slot, shard and
    place. Places of a shard run from 0 without gaps, by virtual slot, then id and
    checksum. Null texts have size 16; null ids come first; equal rows get places of
    their own; no rows give no rows. Other columns are not read, whatever their names.
    The map is written below ``map_root`` as version 1.
    """
    records = docs.select(F.col(key).alias("record_id"), record_size(F.col(text)).alias("size"),
                          text_crc32(F.col(text)).alias("text_crc32"))
    records = written(records.withColumn("slot", slot_of(F.col("record_id"), F.col("text_crc32"),
                                                         slots)), "shard-records")
    sums = slot_bytes(records, slots)
    root = map_root or shared_dir(docs.sparkSession, "slot-map")
    mapping = store_map(initial_map(sums, shards), root, 1)
    # At most ``slots`` rows on this side, whatever the corpus.
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = mapping.join(sums.select("slot", "rows"), "slot").select(
        "slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("slot").orderBy("record_id", "text_crc32", "size")
    return (records.withColumn("rank", F.row_number().over(inside))
            .join(F.broadcast(placed), "slot")
            .select("record_id", "size", "text_crc32", F.col("slot").alias("virtual_slot"),
                    "shard", (F.col("offset") + F.col("rank") - 1).alias("place")))
