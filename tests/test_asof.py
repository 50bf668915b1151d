"""Lookups as of the arrival: against plain walks, and a backfill against the live batches."""

import json
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetcheck.domain import Fleet
from fleetgauge.operators import resolve
from fleetgauge.operators.registry import registry_states
from fleetgauge.plans.asof import holders_over_time, looked_up
from fleetgauge.streaming import ingest
from tests.helpers import rows, table, ts

START = ts("2024-01-01 00:00:00")
STATES = "holder int, name string, value int, since timestamp_ntz, gone boolean"


def minute(n):
    return START + timedelta(minutes=n)


def random_states(rng, holders=6, names=3, per_holder=7):
    states = []
    for holder in range(holders):
        for at in rng.sample(range(60), per_holder):
            states.append((holder, rng.choice([None, *"abc"[:names]]), rng.randrange(100), minute(at), rng.random() < 0.2))
    return states


def held_at(states, name, at):
    """The lowest holder whose state at the time has the name, with its value."""
    best = None
    for holder in sorted({s[0] for s in states}):
        now = max((s for s in states if s[0] == holder and s[3] <= at), key=lambda s: s[3], default=None)
        if now and not now[4] and now[1] == name and best is None:
            best = (holder, now[2])
    return best or (None, None)


@pytest.mark.parametrize("seed", range(3))
def test_lookups_equal_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    states = random_states(rng)
    asked = [(i, rng.choice([None, "a", "b", "c", "z"]), rng.choice([None, *map(minute, range(-2, 64))])) for i in range(300)]
    history = holders_over_time(spark.createDataFrame(states, STATES), "name", "holder", "since", "gone", ["value"])
    frame = spark.createDataFrame(asked, "i int, name string, at timestamp_ntz").repartition(3)
    got = rows(looked_up(frame, history, "name", "at", "since", ["holder", "value"]), "i", "holder", "value")
    want = [(i, *((None, None) if None in (at, name) else held_at(states, name, at))) for i, name, at in asked]
    assert got == sorted(want, key=repr)


def test_many_holders_of_one_name_are_swept_once(spark):
    n = 3000
    states = [(i, "x", i, minute(n - i), False) for i in range(n)] + [(i, "x", i, minute(2 * n - i), True) for i in range(n)]
    history = holders_over_time(spark.createDataFrame(states, STATES), "name", "holder", "since", "gone", ["value"])
    found = history.orderBy("since").collect()
    # Ever lower holders come and go again, the highest first.
    assert [r.holder for r in found][:3] == [n - 1, n - 2, n - 3]
    assert len(found) == n + 1 and found[-1].holder is None and found[-2].holder == 0


def test_many_names_are_swept_in_one_pass(spark):
    states = spark.range(20_000).selectExpr(
        "CAST(id % 10000 AS int) AS holder", "concat('n', id % 10000 DIV 2) AS name", "CAST(id AS int) AS value",
        "timestampadd(MINUTE, CAST(id DIV 10000 AS int), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS since",
        "id >= 10000 AND id % 4 = 0 AS gone")
    history = holders_over_time(states, "name", "holder", "since", "gone", ["value"])
    assert "FlatMapGroups" not in history._jdf.queryExecution().toString()  # no call for each name
    found = rows(history, "name", "since", "holder", "value")
    want = []
    for n in range(5000):
        first = 2 * n + (n % 2 == 0)  # of an even name's two holders the lower one goes after a minute
        want += [(f"n{n}", START, 2 * n, 2 * n), (f"n{n}", minute(1), first, 10_000 + first)]
    assert found == sorted(want, key=repr)


def test_states_without_a_time_or_a_holder_hold_nothing(spark):
    states = [(None, "x", 1, minute(0), False), (3, "x", 3, None, False), (4, "x", 4, minute(2), False)]
    history = holders_over_time(spark.createDataFrame(states, STATES), "name", "holder", "since", "gone", ["value"])
    assert rows(history, "since", "holder", "value") == [(minute(2), 4, 4)]


def test_no_states(spark):
    history = holders_over_time(spark.createDataFrame([], STATES), "name", "holder", "since", "gone", ["value"])
    frame = spark.createDataFrame([(1, "a", minute(1))], "i int, name string, at timestamp_ntz")
    assert rows(looked_up(frame, history, "name", "at", "since", ["holder"]), "i", "holder") == [(1, None)]


def message(seq, at, **payload):
    return {"topic": "waste/bins/b/sensors", "arrival_seq": seq, "arrival_ts": at, "payload": json.dumps(payload)}


REGISTRIES = [
    # A device by MAC moves to another bin and offset, then its MAC goes to another device, then
    # that device goes.
    [{"sensor_id": 5, "sensor_code": "S5", "mac_address": "AA:BB:CC:00:00:01", "bin_id": 1, "weight_offset": 1.0}],
    [{"sensor_id": 5, "sensor_code": "S5", "mac_address": "AA:BB:CC:00:00:01", "bin_id": 2, "weight_offset": 2.0}],
    [{"sensor_id": 5, "sensor_code": "S5", "bin_id": 2, "weight_offset": 2.0},
     {"sensor_id": 3, "sensor_code": "S3", "mac_address": "AA:BB:CC:00:00:01", "bin_id": 3, "weight_offset": 0.5}],
    [{"sensor_id": 5, "sensor_code": "S5", "bin_id": 2, "weight_offset": 2.0}],
]
BINS = [[1, 2, 3], [1, 2, 3], [1, 3], [1, 2, 3]]


def test_a_backfill_equals_the_live_batches(spark):
    live, history, bin_history, messages = [], None, None, []
    before = before_bins = None
    for k, (devices, places) in enumerate(zip(REGISTRIES, BINS)):
        sensors = table(spark, "sensors", *devices)
        bins = table(spark, "waste_bins", *[{"bin_id": b, "bin_code": f"B{b}", "status": "active"} for b in places])
        at = minute(10 * k)
        states = registry_states(before if before is not None else sensors.limit(0), sensors, "sensor_id", at)
        bin_states = registry_states(before_bins if before_bins is not None else bins.limit(0), bins, "bin_id", at)
        history = states if history is None else history.unionByName(states)
        bin_history = bin_states if bin_history is None else bin_history.unionByName(bin_states)
        before, before_bins = sensors, bins
        own = [message(10 * k + i, at + timedelta(minutes=m), fill_level=50, weight_kg=10, **who)
               for i, (m, who) in enumerate([
                   (0, {"mac_address": "aa:bb:cc:00:00:01"}), (3, {"mac_address": "aa:bb:cc:00:00:01"}),
                   (4, {"sensor_code": "S5", "bin_id": "2"}), (5, {"sensor_code": "S3", "bin_id": "1"}),
                   (9, {"sensor_code": "nobody", "bin_id": "1"})])]
        messages += own
        live.append(resolve.classify_messages(table(spark, "MESSAGES", *own), sensors, bins))
    columns = ["arrival_seq", "sensor_id", "bin_id", "weight_kg", "reason"]
    at_once = resolve.classify_messages(table(spark, "MESSAGES", *messages).repartition(3), history, bin_history)
    want = sorted((r for part in live for r in rows(part, *columns)), key=repr)
    assert rows(at_once, *columns) == want
    assert len({r[1:4] for r in want if r[4] is None}) >= 5                # the states differ
    # Today's registry gives the same only for its own messages.
    today = rows(resolve.classify_messages(table(spark, "MESSAGES", *messages), before, before_bins), *columns)
    assert today != want
    # Histories and plain tables mix.
    mixed = rows(resolve.classify_messages(table(spark, "MESSAGES", *messages), history, before_bins), *columns)
    assert [r for r in mixed if r[0] >= 30] == [r for r in want if r[0] >= 30]
    # A batch of the stream takes histories too.
    alerts = spark.createDataFrame([], ingest.ALERT_SCHEMA)
    out = ingest.ingest_batch(table(spark, "MESSAGES", *messages), history, bin_history, alerts)
    assert out.accepted.count() == sum(r[4] is None for r in want)


def test_states_of_the_test_tables_change_the_result(spark, sf_dir):
    fleet = Fleet(spark, sf_dir)
    then = resolve.accepted_readings(resolve.classify_messages(fleet.messages, fleet.sensor_states, fleet.bin_states))
    now = resolve.accepted_readings(resolve.classify_messages(fleet.messages, fleet.sensors, fleet.bins))
    columns = ["reading_id", "sensor_id", "bin_id", "weight_kg"]
    assert len(set(rows(then, *columns)) ^ set(rows(now, *columns))) > 20


def test_a_hot_device_is_split_and_a_small_history_needs_no_exchange(spark):
    hot = (spark.range(0, 120_000, 1, 12).selectExpr("id AS i", "IF(id % 3 = 0, 'hot', CAST(id % 5000 AS string)) AS name",
                                                     "TIMESTAMP_NTZ'2024-01-01' AS at", "sha2(CAST(id AS string), 512) AS payload"))
    history = spark.range(5000).selectExpr("CAST(id AS string) AS name", "TIMESTAMP_NTZ'2023-01-01' AS since", "id AS value").unionByName(
        spark.sql("SELECT 'hot' AS name, TIMESTAMP_NTZ'2023-01-01' AS since, CAST(-1 AS BIGINT) AS value"))
    saved = {k: spark.conf.get(k, None) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.enabled",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.shuffle.partitions")}
    try:
        found = looked_up(hot, history, "name", "at", "since", ["value"])
        assert "hashpartitioning(name" not in found.filter("value < 0")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
        for key, value in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
                           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "24",
                           "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}.items():
            spark.conf.set(key, value)
        joined = looked_up(hot, history, "name", "at", "since", ["value"])
        per_task = joined.groupBy(F.spark_partition_id().alias("p")).agg(
            F.count_if(F.col("value") == -1).alias("count"), F.max("payload")).collect()
        assert sum(r["count"] for r in per_task) == 40_000 and max(r["count"] for r in per_task) < 20_000
    finally:
        for key, value in saved.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
