"""Facts that held at the time of a row: histories of keys, looked up as of a moment."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from fleetgauge.plans.keyed import rehashed


def holders_over_time(versions: DataFrame, key: str, holder: str, since: str, removed: str,
                      values: list[str]) -> DataFrame:
    """Who holds each value of ``key`` from when on: (key, since, holder, values).

    ``versions`` has a row for each state of a holder, which lasts until its next one. Where
    several hold one value at a time, the lowest holder counts; a row with a null holder says
    that nobody does from then on. States without a time or a holder hold nothing. The states lie
    by key and time and are swept once, whatever the number of keys or of holders of one value;
    only the holders of one key at one time are kept.
    """
    after = F.lead(since).over(Window.partitionBy(holder).orderBy(since))
    spans = (versions.select(holder, since, removed, key, *values).withColumn("_until", after)
             .filter(~F.coalesce(F.col(removed), F.lit(False)) & F.col(key).isNotNull()
                     & F.col(since).isNotNull() & F.col(holder).isNotNull()
                     & (F.col("_until").isNull() | (F.col(since) < F.col("_until"))))
             .select(key, since, holder, *values, "_until"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in spans.schema.fields[:-1]])

    def sweep(batches):
        kinds, count = None, 0
        own, moment, last = None, None, None  # the key, the start being read, who holds the key
        active, out = [], []  # a heap of (holder, place, until, row); rows to hand on

        def settle(now):
            """Who holds the key from a moment on, all starts until then being known."""
            nonlocal last
            while active and active[0][2] is not None and active[0][2] <= now:
                heapq.heappop(active)
            top = active[0] if active else None
            if top is not last:
                out.append((own, now, *(top[3] if top else (None,) * (1 + len(values)))))
                last = top

        def pass_on(before):
            """The ends of holders before a moment, or all."""
            if moment is not None:
                settle(moment)
            while active and active[0][2] is not None and (before is None or active[0][2] < before):
                settle(active[0][2])

        def found():
            rows, out[:] = list(zip(*out)), []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], schema.names)

        for batch in batches:
            kinds = batch.schema.types[:-1]
            for place, row in enumerate(zip(*(c.to_pylist() for c in batch.columns)), count):
                if row[0] != own:
                    pass_on(None)
                    own, moment, last = row[0], row[1], None
                    active.clear()
                elif row[1] != moment:
                    pass_on(row[1])
                    moment = row[1]
                heapq.heappush(active, (row[2], place, row[-1], row[2:-1]))
            count += batch.num_rows
            if out:
                yield found()
        pass_on(None)
        if out:
            yield found()

    # In order, many keys pass one task: a group each would cost more than its few states.
    return spans.repartition(F.col(key)).sortWithinPartitions(key, since, holder).mapInArrow(sweep, schema)


def looked_up(frame: DataFrame, history: DataFrame, key: str, time: str, since: str,
              values: list[str]) -> DataFrame:
    """Every row of ``frame`` with the values that its (text) key had at its time.

    Those are the values of the key's newest history row at or before the time, NULL where
    there is none or the time is NULL. A history of a key is one array, so a row meets its
    key once and in one join by key alone: Spark broadcasts a small history, and of a large one
    splits a hot key's rows at run time. Of history rows with one key and time any counts.
    """
    facts = (history.filter(F.col(key).isNotNull() & F.col(since).isNotNull()).groupBy(key)
             .agg(F.sort_array(F.collect_list(F.struct(F.col(since).alias("_since"), *values))).alias("_facts"))
             .withColumn(key, rehashed(F.col(key))))
    known = F.filter("_facts", lambda fact: fact["_since"] <= F.col(time))
    return (frame.join(facts, key, "left").withColumn("_fact", F.try_element_at(known, F.lit(-1)))
            .select(*frame.columns, *[F.col(f"_fact.{v}").alias(v) for v in values]))
