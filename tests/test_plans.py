"""Plan shapes: pushed filters, pruned columns and folders, few exchanges, no cross joins."""

import random
import re

import pytest
from pyspark.sql import Window, functions as F

from fleetcheck import catalog
from fleetgauge.operators import collections, readings, status, weights
from fleetgauge.plans.keyed import latest_per_key, spread_null, top_n_per_key, with_previous
from fleetgauge.sources.tables import read_table, write_readings
from tests.helpers import dec, rows, table, ts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def reading_rows(n, seed=0):
    """A third of all readings belong to bin 1; times repeat."""
    rng = random.Random(seed)
    return [{"reading_id": i, "sensor_id": 1, "bin_id": 1 if rng.random() < .34 else rng.randint(2, 9),
             "fill_level": rng.choice([None, *map(dec, ("0", "5.00", "10.00", "50.00", "85.00", "86.00", "99.00"))]),
             "weight_kg": rng.choice([None, dec("0.00"), dec("1.25")]),
             "timestamp": ts(f"2024-01-{rng.randint(1, 3):02d} {rng.randint(0, 23):02d}:{rng.choice((0, 0, 30)):02d}:00")}
            for i in range(n)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "readings")
    write_readings(table(spark, "sensor_readings", *reading_rows(400)), path)
    bins = str(tmp_path_factory.mktemp("tables") / "bins")
    table(spark, "waste_bins", *[{"bin_id": i, "bin_code": f"B{i}", "status": "active"}
                                 for i in range(1, 12)]).write.parquet(bins)
    schema_path = path
    frame = spark.read.parquet(schema_path)
    return frame, read_table(spark, bins, "waste_bins")


def test_lookback_prunes_folders_and_row_groups(stored):
    frame, bins = stored
    text = plan(weights.daily_weight(bins, frame, "2024-01-03 12:00:00"))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "weight_kg" in line)
    assert re.search(r"PartitionFilters: \[[^\]]*reading_date#\d+ >= 2024-01-02", scan)
    assert "GreaterThanOrEqual(timestamp,2024-01-02T12:00)" in scan
    assert "GreaterThan(weight_kg,0.00)" in scan
    assert "fill_level" not in scan and "battery_level" not in scan
    kept = readings.readings_lookback(frame, bins, "2024-01-03 12:00:00", 24)
    assert kept.count() == frame.filter("timestamp >= TIMESTAMP_NTZ '2024-01-02 12:00:00'").count()


def test_limits_come_before_the_lookup(stored):
    frame, bins = stored
    text = plan(readings.readings_lookback(frame, bins, "2024-01-03 12:00:00", 24))
    assert text.index("Join") < text.index("TakeOrderedAndProject")


def test_status_reads_the_readings_once(stored, spark):
    frame, bins = stored
    text = plan(status.current_status(bins, frame, table(spark, "alerts")))
    assert sum("FileScan" in line and "reading_id" in line for line in text.splitlines()) == 1
    assert "partial_max_by" in text


def _no_broadcasts(spark, make):
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan(make())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)


def test_latest_readings_are_one_scan_reduced_before_the_exchange(stored, spark):
    frame, bins = stored
    text = _no_broadcasts(spark, lambda: status.latest_readings(frame))
    lines = text.splitlines()
    assert sum("FileScan" in line for line in lines) == 1
    assert "Join" not in text and text.count("Exchange") == 1
    exchange = next(i for i, line in enumerate(lines) if "Exchange" in line)
    assert "partial_max_by" in lines[exchange + 1]                # one row per bin and partition
    whole = _no_broadcasts(spark, lambda: status.current_status(bins, frame, table(spark, "alerts")))
    assert sum("FileScan" in line for line in whole.splitlines()) == 2    # bins and readings


def test_latest_rows_with_equal_times_and_null_ids(spark):
    data = [(1, ts("2024-01-01"), None, "a"), (1, ts("2024-01-01"), -5, "b"), (1, ts("2023-12-31"), 9, "c"),
            (None, ts("2024-01-01"), 1, "d"), (2, ts("2024-01-01"), None, None)]
    frame = spark.createDataFrame(data, "k int, t timestamp_ntz, id long, v string").repartition(3)
    assert rows(latest_per_key(frame, ["k"], ["v"], ["t", "id"]), "k", "v") == [(1, "b"), (2, None), (None, "d")]


def test_group_limit_on_both_sides_of_the_exchange(stored):
    frame, _ = stored
    text = plan(status.recent_readings(frame))
    assert text.count("WindowGroupLimit") == 4


@pytest.mark.parametrize("name", [n for n in catalog.queries() if not n.startswith("stream_")])
def test_no_query_crosses_or_calls_python(spark, sf_dir, name):
    text = plan(catalog.queries()[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in text


def test_payload_is_parsed_once(spark, sf_dir):
    for name in ("ingest_accepted", "alerts_deduped"):
        text = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("from_json(") == 1


def test_inferred_collections_match_a_plain_lag(spark):
    for seed in (1, 2):
        frame = table(spark, "sensor_readings", *reading_rows(600, seed)).repartition(5)
        order = Window.partitionBy("bin_id").orderBy("timestamp", "reading_id")
        expected = (frame.withColumn("p", F.lag("fill_level").over(order))
                    .filter("p > 85 AND fill_level <= 10")
                    .select("bin_id", "reading_id", "p", "fill_level"))
        got = collections.infer_collections(frame)
        assert rows(got, "bin_id", "reading_id", "fill_before", "fill_after") == rows(
            expected, "bin_id", "reading_id", "p", "fill_level")
        assert got.count() > 0


def test_only_slice_borders_reach_the_window_over_the_key(spark):
    # Rows between the borders of a slice are gone before the window over the bin.
    frame = spark.range(3600).select(
        F.lit(1).alias("bin_id"), F.col("id").alias("reading_id"),
        (F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.expr("make_dt_interval(0, 0, 0, id * 2)")).alias("timestamp"),
        F.lit(50).cast("decimal(5,2)").alias("fill_level"))
    plan_text = plan(with_previous(frame, "bin_id", "fill_level", ["timestamp", "reading_id"],
                                   "timestamp", F.col("previous") > 200))
    # The filter on hour borders sits between the two windows.
    lines = plan_text.splitlines()
    across, inner = [i for i, line in enumerate(lines) if "Window [" in line]
    assert "_slice" not in lines[across] and "_slice" in lines[inner]
    assert any("Filter" in line and " OR " in line for line in lines[across:inner])


def test_latest_ties_go_to_the_greater_id(spark):
    same = ts("2024-01-01 00:00:00")
    frame = table(spark, "sensor_readings",
                  {"reading_id": 1, "bin_id": 1, "timestamp": same, "fill_level": dec("1.00")},
                  {"reading_id": 3, "bin_id": 1, "timestamp": same, "fill_level": dec("3.00")},
                  {"reading_id": 2, "bin_id": 1, "timestamp": same, "fill_level": None},
                  {"reading_id": 9, "bin_id": 2, "timestamp": None, "fill_level": dec("9.00")})
    assert rows(status.latest_readings(frame), "bin_id", "fill_level", "last_reading") == [(1, dec("3.00"), same)]
    last = latest_per_key(frame.filter("timestamp IS NOT NULL"), ["bin_id"], ["reading_id"], ["timestamp", "reading_id"])
    assert rows(last, "bin_id", "reading_id") == [(1, 3)]


def test_top_n_matches_brute_force(spark):
    data = reading_rows(500, 7)
    got = top_n_per_key(table(spark, "sensor_readings", *data).repartition(6), "bin_id",
                        [F.desc("timestamp"), F.desc("reading_id")], 10)
    expected = set()
    for b in {r["bin_id"] for r in data}:
        mine = sorted((r for r in data if r["bin_id"] == b), key=lambda r: (r["timestamp"], r["reading_id"]), reverse=True)
        expected |= {(b, i + 1, r["reading_id"]) for i, r in enumerate(mine[:10])}
    assert set(rows(got, "bin_id", "rank", "reading_id")) == expected


def test_null_keys_hash_apart(spark):
    df = spark.range(1000).select(spread_null(F.lit(None).cast("string"), F.col("id")).alias("k"))
    assert df.select(F.pmod(F.hash("k"), F.lit(8))).distinct().count() == 8


def test_repeated_dense_ids_match_a_plain_count(spark):
    rng = random.Random(3)
    ids = [rng.choice((rng.randint(-5, 40000), rng.randint(10**12, 10**12 + 70000))) for _ in range(3000)]
    frame = spark.createDataFrame([(i,) for i in ids] + [(None,), (None,)], "reading_id long").repartition(5)
    from fleetgauge.operators.integrity import repeated_dense_ids
    expected = sorted((i, ids.count(i)) for i in set(ids) if ids.count(i) > 1)
    got = sorted(tuple(r) for r in repeated_dense_ids(frame, "reading_id").collect())
    assert expected and got == expected


def _final(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_registries_do_not_move_the_large_side(spark, sf_dir):
    """Readings and messages meet a small registry where they are read."""
    for name in ("export_report", "readings_lookback_bin", "readings_refused", "geometry_check", "ingest_accepted"):
        text = _final(catalog.queries()[name](spark, sf_dir)).split("Initial Plan")[0]
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text, name
        # The only exchanges are those that reduce the registry to a row per MAC and code.
        keys = re.findall(r"Exchange hashpartitioning\((\w+)#", text)
        assert set(keys) <= ({"mac_address", "sensor_code"} if name == "ingest_accepted" else set()), (name, keys)


def test_latest_rows_sort_only_inside_input_partitions(spark, stored):
    frame, _ = stored
    text = plan(latest_per_key(frame, ["bin_id"], ["fill_level", "timestamp"], ["timestamp", "reading_id"]))
    # By key alone, below the exchange; what crosses it is one row per key and partition.
    below = text[text.index("Exchange"):]
    assert below.count("Sort [") == 1 and "Sort [bin_id" in below and "Join" not in text
