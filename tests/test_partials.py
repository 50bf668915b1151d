"""Timelines and weights from hourly partial sums equal the scans and read no closed date."""

import random
import shutil
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetcheck.domain import Fleet
from fleetgauge.operators.timeline import (fill_timeline, fill_timeline_of_partials, hourly_fill,
                                           hourly_fill_of_partials)
from fleetgauge.operators.weights import daily_weight, daily_weight_of_partials
from fleetgauge.sources.schemas import SENSOR_READINGS
from fleetgauge.sources.tables import write_readings
from fleetgauge.streaming import ingest, partials, snapshots
from tests.helpers import dec, rows, table, ts

HOURLY = ["hour", "avg_fill_level", "reading_count"]
DAILY = ["bin_id", "total_weight_today", "reading_count_today", "last_reading_today"]
START = ts("2024-01-01 00:00:00")


def made(n, seed=0, days=5):
    """Readings over some days, with gaps, empty measures, no time and no bin here and there."""
    rng = random.Random(seed)
    return [{"reading_id": i, "sensor_id": 1, "bin_id": rng.choice([None, 1, 1, 2, 3]),
             "fill_level": rng.choice([None, dec("0.00"), dec("33.33"), dec("99.99")]),
             "weight_kg": rng.choice([None, dec("0.00"), dec("-1.00"), dec("2.25")]),
             "timestamp": None if rng.random() < .02 else START + timedelta(seconds=rng.randrange(days * 86_400))}
            for i in range(n)]


@pytest.fixture(scope="module")
def fleet_bins(spark):
    return table(spark, "waste_bins", *[{"bin_id": i, "bin_code": f"B{i}", "status": "active"} for i in range(1, 5)])


def in_batches(spark, frame, path, batches=5, compact_every=2):
    for n in range(batches):
        partials.add(frame.filter(F.col("reading_id") % batches == n), path, n, compact_every)
    return partials.stored(spark, path)


@pytest.mark.parametrize("as_of", ["2024-01-05 10:20:30.5", "2024-01-05 10:00:00", "2024-01-01 00:30:00", "2024-02-01 00:00:00"])
@pytest.mark.parametrize("compact_every", [1, 2, 100])
def test_partials_equal_the_scans(spark, fleet_bins, tmp_path, as_of, compact_every):
    frame = table(spark, "sensor_readings", *made(600))
    found = in_batches(spark, frame, str(tmp_path / "p"), compact_every=compact_every)
    for hours in (1, 24, 168):
        assert rows(fill_timeline_of_partials(found, frame, as_of, hours), *HOURLY) == rows(
            fill_timeline(frame, as_of, hours), *HOURLY)
    assert rows(daily_weight_of_partials(fleet_bins, found, frame, as_of), *DAILY) == rows(
        daily_weight(fleet_bins, frame, as_of), *DAILY)


def test_no_closed_date_is_read(spark, fleet_bins, tmp_path):
    frame, as_of = table(spark, "sensor_readings", *made(600, 1)), "2024-01-05 10:20:30"
    found = in_batches(spark, frame, str(tmp_path / "p"))
    write_readings(frame, str(tmp_path / "r"))
    expected = rows(fill_timeline(frame, as_of, 72), *HOURLY)
    weights = rows(daily_weight(fleet_bins, frame, as_of), *DAILY)
    # Only the dates of the cut hours are left: the 2nd for 72 hours, the 4th for 24.
    for day in (1, 3, 5):
        shutil.rmtree(tmp_path / "r" / f"reading_date=2024-01-0{day}")
    left = spark.read.schema(SENSOR_READINGS).parquet(str(tmp_path / "r"))
    dated = spark.read.parquet(str(tmp_path / "r"))
    assert left.count() < frame.count()
    assert rows(fill_timeline_of_partials(found, dated, as_of, 72), *HOURLY) == expected
    assert rows(daily_weight_of_partials(fleet_bins, found, dated, as_of), *DAILY) == weights
    text = fill_timeline_of_partials(found, dated, as_of, 72)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in text.splitlines() if "FileScan" in line and "fill_level" in line)
    assert "reading_date#" in scan and ">= 2024-01-02" in scan and "<= 2024-01-02" in scan
    # On a whole hour no reading is opened at all.
    text = fill_timeline_of_partials(found, dated, "2024-01-05 10:00:00", 72)._jdf.queryExecution().executedPlan().toString()
    assert not any("FileScan" in line and "fill_level" in line for line in text.splitlines())


def test_late_rows_and_replays_count_once(spark, tmp_path):
    path, data = str(tmp_path / "p"), made(300, 2)
    frame = table(spark, "sensor_readings", *data)
    late = [dict(r, reading_id=1000 + r["reading_id"]) for r in data[:50]]       # days late
    late_frame = table(spark, "sensor_readings", *late)
    partials.add(frame, path, 0, 2)
    partials.add(late_frame, path, 1, 2)
    (tmp_path / "p" / "base=1" / "_SUCCESS").unlink()                            # lost while merging
    whole = rows(hourly_fill(frame.unionByName(late_frame)), *HOURLY)
    assert rows(hourly_fill_of_partials(partials.stored(spark, path)), *HOURLY) == whole
    for _ in range(2):
        partials.add(late_frame, path, 1, 2)                                     # the batch runs again
        assert rows(hourly_fill_of_partials(partials.stored(spark, path)), *HOURLY) == whole
    assert rows(hourly_fill_of_partials(partials.stored(spark, path, 0)), *HOURLY) == rows(hourly_fill(frame), *HOURLY)


def test_merging_rewrites_only_dates_that_changed(spark, tmp_path):
    path = str(tmp_path / "p")
    everything = table(spark, "sensor_readings", *made(400, 3))
    today = everything.filter("timestamp >= TIMESTAMP_NTZ '2024-01-05 00:00:00'")
    partials.add(everything, path, 0, 2)
    partials.add(today, path, 1, 2)
    partials.add(today, path, 2, 2)
    partials.add(today, path, 3, 2)
    assert sorted(f.name for f in (tmp_path / "p" / "base=1").glob("reading_date=*")) == [
        f"reading_date=2024-01-0{d}" for d in range(1, 6)]
    assert [f.name for f in (tmp_path / "p" / "base=3").glob("reading_date=*")] == ["reading_date=2024-01-05"]
    whole = everything.unionByName(today).unionByName(today).unionByName(today)
    found = partials.stored(spark, path)
    assert rows(hourly_fill_of_partials(found), *HOURLY) == rows(hourly_fill(whole), *HOURLY)
    # One row per hour and bin is left, whatever the number of batches.
    assert found.count() == partials.hourly_partials(whole).count()


def test_no_readings(spark, fleet_bins, tmp_path):
    none = table(spark, "sensor_readings")
    partials.add(none, str(tmp_path / "p"), 0)
    found = partials.stored(spark, str(tmp_path / "p"))
    assert found.count() == 0 and fill_timeline_of_partials(found, none, "2024-01-05 10:20:30").count() == 0
    assert {r.total_weight_today for r in daily_weight_of_partials(fleet_bins, found, none, "2024-01-05 10:20:30").collect()} == {dec("0.00")}


def test_a_stream_days_late_keeps_no_state(spark, sf_dir, tmp_path):
    readings = Fleet(spark, sf_dir).readings.withColumns({c: F.lit(None).cast(SENSOR_READINGS[c].dataType) for c in ("humidity", "gas_level", "created_at")})
    source = tmp_path / "in"
    # Three files, the oldest ten days last.
    for i, (lower, upper) in enumerate([("2024-01-21", "2100-01-01"), ("2024-01-11", "2024-01-21"), ("2000-01-01", "2024-01-11")]):
        readings.filter(f"timestamp >= '{lower}' AND timestamp < '{upper}'").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(readings.schema).parquet(str(source))
        job = partials.start(stream, str(tmp_path / "p"), str(tmp_path / "cp"), compact_every=2, availableNow=True)
        job.awaitTermination()
        assert all(not p.stateOperators for p in job.recentProgress)
    assert snapshots.numbers(spark, str(tmp_path / "p"), "delta") == [0, 1, 2]
    assert rows(hourly_fill_of_partials(partials.stored(spark, str(tmp_path / "p"))), *HOURLY) == rows(hourly_fill(readings), *HOURLY)


def test_the_ingest_stream_keeps_partials(spark, sf_dir, tmp_path):
    fleet = Fleet(spark, sf_dir)
    ingest.start_ingest(fleet.message_stream(), lambda s: (Fleet(s, sf_dir).sensors, Fleet(s, sf_dir).bins), str(tmp_path / "out"),
                        str(tmp_path / "cp"), hourly_partials=True, availableNow=True).awaitTermination()
    stored = ingest.written_readings(spark, str(tmp_path / "out"))
    found = partials.stored(spark, str(tmp_path / "out" / "partials"))
    assert rows(hourly_fill_of_partials(found), *HOURLY) == rows(hourly_fill(stored), *HOURLY)
