"""Registry batches published as versions: races, lost writers, and the history they leave."""

import json
import threading
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import registry, resolve
from fleetgauge.sources import versions
from fleetgauge.sources.files import Files
from tests.helpers import rows, table, ts

AT = ts("2024-01-01 00:00:00")
ITEM = "item_seq int, mac_address string, device_name string, bin_id int, weight_offset double"


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "sensors")
    versions.create(table(spark, "sensors", {"sensor_id": 1, "sensor_code": "OLD", "bin_id": 1, "status": "active"}),
                    path, "sensor_id", AT)
    return path


def bins(spark):
    return table(spark, "waste_bins", *[{"bin_id": i, "bin_code": f"B{i}", "status": "active"} for i in (1, 2, 3)])


def registering(spark, number, bin_id=1):
    items = spark.createDataFrame([(1, f"AA:BB:CC:00:00:{number:02d}", f"scale {number}", bin_id, 0.5)], ITEM)
    return lambda sensors: registry.register_devices(items, sensors, bins(spark), AT)


def test_versions_follow_each_other(spark, store):
    assert versions.versions(spark, store) == [0]
    done = versions.change(spark, store, "sensor_id", AT, registering(spark, 1))
    assert done.version == 1 and rows(done.results, "action") == [("created",)] and done.errors.count() == 0
    assert versions.read(spark, store).count() == 2 and versions.read(spark, store, 0).count() == 1
    versions.create(versions.read(spark, store), store, "sensor_id", AT)          # there is one already
    assert versions.versions(spark, store) == [0, 1]


def test_of_two_batches_from_one_version_one_wins(spark, store):
    base = versions.read(spark, store, 0)
    first, second = registering(spark, 1)(base), registering(spark, 2)(base)
    assert versions.publish({"rows": first.snapshot}, store, 0)
    assert not versions.publish({"rows": second.snapshot}, store, 0)
    assert sorted(n for n in Files(spark).names(store)) == ["version=0", "version=1"]
    assert rows(versions.read(spark, store), "mac_address") == [("AA:BB:CC:00:00:01",), (None,)]


def test_a_lost_race_is_made_again(spark, store):
    tries = []

    def make(sensors):
        tries.append(sensors.count())
        if len(tries) == 1:  # another writer comes first
            versions.change(spark, store, "sensor_id", AT, registering(spark, 7))
        return registering(spark, 8)(sensors)

    done = versions.change(spark, store, "sensor_id", AT, make)
    assert tries == [1, 2] and done.version == 2
    # Both batches are in, each device with an id of its own.
    assert rows(versions.read(spark, store), "sensor_id", "mac_address") == [
        (1, None), (2, "AA:BB:CC:00:00:07"), (3, "AA:BB:CC:00:00:08")]
    with pytest.raises(versions.LostRace):
        versions.change(spark, store, "sensor_id", AT, lambda s: (
            versions.publish({"rows": s}, store, versions.versions(spark, store)[-1]), registering(spark, 9)(s))[1], attempts=2)


def test_writers_at_once_all_get_in(spark, store):
    failed = []

    def work(number):
        try:
            versions.change(spark, store, "sensor_id", AT, registering(spark, number))
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(1, 4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and versions.versions(spark, store) == [0, 1, 2, 3]
    found = rows(versions.read(spark, store), "sensor_id", "mac_address")
    assert len({i for i, _ in found}) == len({m for _, m in found}) == 4


def test_half_written_versions_are_never_served(spark, store):
    lost = Path(store) / "unpublished-1"
    registering(spark, 1)(versions.read(spark, store)).snapshot.write.parquet(f"{lost}/rows")
    (lost / "rows" / "_SUCCESS").unlink()

    def breaks(sensors):
        broken = registering(spark, 2)(sensors)
        return broken._replace(snapshot=broken.snapshot.withColumn("sensor_id", F.raise_error(F.lit("lost"))))

    with pytest.raises(Exception, match="lost"):
        versions.change(spark, store, "sensor_id", AT, breaks)
    assert versions.versions(spark, store) == [0] and versions.read(spark, store).count() == 1
    assert versions.change(spark, store, "sensor_id", AT, registering(spark, 3)).version == 1
    versions.expire(spark, store, keep=1)
    assert sorted(Files(spark).names(store)) == ["version=0", "version=1"]
    assert versions.read(spark, store).count() == 2 and versions.history(spark, store).count() == 2


def test_the_history_resolves_messages_as_they_came(spark, store):
    later = [AT + timedelta(hours=h) for h in (1, 2, 3)]
    versions.change(spark, store, "sensor_id", later[0], registering(spark, 1, bin_id=1))
    versions.change(spark, store, "sensor_id", later[1], registering(spark, 1, bin_id=2))
    gone = spark.createDataFrame([(2,)], "sensor_id int")
    none = table(spark, "sensor_readings")
    versions.change(spark, store, "sensor_id", later[2], lambda s: registry.delete_devices(gone, s, none, later[2]))
    messages = table(spark, "MESSAGES", *[
        {"topic": "waste/bins/b/sensors", "arrival_seq": i, "arrival_ts": AT + timedelta(minutes=30 + 60 * i),
         "payload": json.dumps({"mac_address": "aa:bb:cc:00:00:01", "fill_level": 5})} for i in range(4)])
    found = resolve.classify_messages(messages, versions.history(spark, store), bins(spark))
    assert rows(found, "arrival_seq", "sensor_id", "bin_id", "reason") == [
        (0, None, None, "unknown_device"), (1, 2, 1, None), (2, 2, 2, None), (3, None, None, "unknown_device")]


def test_states_are_made_of_the_written_rows(spark, tmp_path):
    path, rows = str(tmp_path / "sensors"), spark.range(3).selectExpr("CAST(id AS int) AS sensor_id")
    read = []
    assert versions.publish({"rows": rows, "states": lambda after: read.extend(after.inputFiles()) or after}, path, -1)
    assert read and all("/rows/" in name for name in read)
    assert versions.read(spark, path, 0, "states").count() == 3
