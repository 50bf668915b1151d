"""Sequential batches settled in rounds: an item is decided as soon as no undecided earlier
item touches the same keys. Each round is one fixed plan over a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetgauge.session import shared_dir


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a Parquet table under the shared root: computed once, without lineage."""
    path = shared_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def claimed_codes(attempts: DataFrame, used: DataFrame) -> DataFrame:
    """(mac, item_seq, code) of each device created, as if items came one by one.

    ``attempts`` (mac, item_seq, base_code, suffix_code) may each create the device of their
    MAC: under the base code, else under the suffixed one, if no earlier item and no code in
    ``used`` has it. The first that finds a free code creates it. A round decides every
    item that is the first undecided one of its MAC and of the code it would get; it ends
    when no item can get a code any more.
    """
    taken = written(used.select("code").distinct(), "codes-taken")
    waiting = written(attempts, "codes-waiting")
    created = waiting.select("mac", "item_seq", F.col("base_code").alias("code")).limit(0)
    while True:
        base = taken.select(F.col("code").alias("base_code"), F.lit(True).alias("base_used"))
        suffix = taken.select(F.col("code").alias("suffix_code"), F.lit(True).alias("suffix_used"))
        open_items = written(
            waiting.join(base, "base_code", "left").join(suffix, "suffix_code", "left")
            .filter("base_used IS NULL OR suffix_used IS NULL")
            .withColumn("code", F.when(F.col("base_used").isNull(), F.col("base_code"))
                        .otherwise(F.col("suffix_code"))), "codes-open")
        # What an item may still ask for, first or as a way out.
        asked = open_items.select("item_seq", F.explode(F.array_compact(F.array(
            F.when(F.col("base_used").isNull(), F.col("base_code")),
            F.when(F.col("suffix_used").isNull(), F.col("suffix_code"))))).alias("code"))
        first = asked.groupBy("code").agg(F.min("item_seq").alias("first"))
        own = open_items.groupBy("mac").agg(F.min("item_seq").alias("item_seq"))
        won = written(open_items.join(own, ["mac", "item_seq"], "left_semi").join(first, "code")
                      .filter("first = item_seq").select("mac", "item_seq", "code"), "codes-won")
        if won.isEmpty():
            return created
        created = created.union(won)
        taken = taken.union(won.select("code"))
        waiting = written(open_items.select("mac", "item_seq", "base_code", "suffix_code")
                          .join(won.select("mac"), "mac", "left_anti"), "codes-waiting")


def sequenced_updates(items: DataFrame, holders: DataFrame) -> DataFrame:
    """``items`` (item_seq, sensor_id, mac, bin_ok, ...) with an ``error``, null where the item
    changes its device, as if they came one by one.

    A MAC that another device holds at that point is refused, then a missing bin.
    ``holders`` (sensor_id, mac) are the devices before the batch; only those that an item
    names or whose MAC it asks for are looked at. An item touches its device, the MAC it
    asks for and the MAC its device holds; it is decided when it is the first undecided one
    for all three.
    """
    asked = items.select("sensor_id").distinct(), items.select("mac").distinct()
    state = written(holders.join(asked[0], "sensor_id", "left_semi").union(
        holders.join(asked[1], "mac", "left_semi").select("sensor_id", "mac")).distinct(), "macs-held")
    waiting, decided = written(items, "updates-waiting"), None
    while not waiting.isEmpty():
        held = state.select("sensor_id", F.col("mac").alias("held"))
        touched = waiting.join(held, "sensor_id", "left").select("item_seq", F.explode(
            F.array_compact(F.array(F.concat(F.lit("device "), F.col("sensor_id").cast("string")),
                                    F.col("mac"), F.col("held")))).alias("touch"))
        first = touched.groupBy("touch").agg(F.min("item_seq").alias("first"))
        ready = (touched.join(first, "touch").groupBy("item_seq")
                 .agg(F.bool_and(F.col("first") == F.col("item_seq")).alias("ready")).filter("ready"))
        by_mac = state.filter("mac IS NOT NULL").groupBy("mac").agg(
            F.min("sensor_id").alias("low"), F.max("sensor_id").alias("high"))
        other = (F.col("low") != F.col("sensor_id")) | (F.col("high") != F.col("sensor_id"))
        done = written(waiting.join(ready.select("item_seq"), "item_seq", "left_semi")
                       .join(by_mac, "mac", "left")
                       .withColumn("error", F.when(F.coalesce(other, F.lit(False)), "mac_in_use")
                                   .when(~F.col("bin_ok"), "unknown_bin"))
                       .select(*items.columns, "error"), "updates-decided")
        decided = done if decided is None else decided.union(done)
        new = done.filter("error IS NULL").select("sensor_id", F.col("mac").alias("new"))
        state = written(state.join(new, "sensor_id", "left").select(
            "sensor_id", F.coalesce("new", "mac").alias("mac")), "macs-held")
        waiting = written(waiting.join(done.select("item_seq"), "item_seq", "left_anti"), "updates-waiting")
    return decided if decided is not None else items.withColumn("error", F.lit(None).cast("string"))
