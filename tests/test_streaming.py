"""Streams give what one batch gives, however the input is cut into files and batches."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators.status import latest_readings
from fleetgauge.operators.timeline import hourly_fill
from fleetgauge.session import shared_dir
from fleetcheck.domain import Fleet
from fleetgauge.sources.messages import read_messages, stream_messages, without_resends
from fleetgauge.sources.schemas import SENSOR_READINGS
from fleetgauge.streaming import ingest, live, snapshots
from tests.helpers import rows, table, ts

READING = ["reading_id", "sensor_id", "bin_id", "fill_level", "weight_kg", "timestamp"]
ALERT = ["alert_id", "bin_id", "alert_type", "severity", "message", "triggered_at"]


def land(messages, folder, pieces):
    """The messages in ``pieces`` files, in arrival order."""
    total = messages.count()
    size = -(-total // pieces)
    for i in range(pieces):
        part = messages.filter(F.col("arrival_seq").between(i * size, (i + 1) * size - 1))
        part.coalesce(1).write.mode("append").json(f"{folder}/in/part{i}")


def flatten(folder, pieces):
    import shutil
    from pathlib import Path
    flat = Path(folder) / "flat"
    flat.mkdir()
    for i in range(pieces):
        for f in (Path(folder) / "in" / f"part{i}").glob("part-*.json"):
            target = flat / f"{i:03d}.json"
            shutil.copy(f, target)
            import os
            os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(flat)


@pytest.mark.parametrize("pieces", [1, 3])
def test_ingest_equals_the_batch(spark, sf_dir, tmp_path, pieces):
    fleet = Fleet(spark, sf_dir)
    land(fleet.messages, tmp_path, pieces)
    source = flatten(tmp_path, pieces)
    root = str(tmp_path / "out")
    job = ingest.start_ingest(stream_messages(spark, source, max_files=1),
                              lambda s: (Fleet(s, sf_dir).sensors, Fleet(s, sf_dir).bins), root,
                              str(tmp_path / "cp"), known_alerts=fleet.alerts, availableNow=True)
    job.awaitTermination()
    assert len(job.recentProgress) >= pieces
    batch = ingest.ingest_batch(read_messages(spark, source), fleet.sensors, fleet.bins, fleet.alerts)
    assert rows(ingest.written_readings(spark, root), *READING) == rows(batch.accepted, *READING)
    stored = ingest.alert_table(spark, root).filter("batch_id >= 0")
    assert rows(stored, *ALERT) == rows(batch.alerts, *ALERT)
    assert rows(spark.read.parquet(f"{root}/rejected"), "arrival_seq", "reason") == rows(
        batch.rejected, "arrival_seq", "reason")


def test_a_batch_of_one_file_is_parsed_in_several_tasks(spark, sf_dir, tmp_path, monkeypatch):
    fleet, parts = Fleet(spark, sf_dir), []
    land(fleet.messages, tmp_path, 1)
    classify = ingest.classify_messages
    monkeypatch.setattr(ingest, "classify_messages", lambda m, *r: parts.append(
        m._jdf.queryExecution().logical().toString()) or classify(m, *r))
    root = str(tmp_path / "out")
    ingest.start_ingest(stream_messages(spark, flatten(tmp_path, 1)), lambda s: (fleet.sensors, fleet.bins), root,
                        str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert len(parts) == 1 and "RepartitionByExpression" in parts[0]
    assert len(list(Path(f"{root}/rejected/batch_id=0").glob("part-*.parquet"))) == 1


def _payload(seq, fill):
    return {"topic": "waste/bins/b/sensors", "arrival_seq": seq, "arrival_ts": ts("2024-01-01 00:00:00"),
            "payload": json.dumps({"sensor_code": "S", "bin_id": "1", "bin_code": "B", "fill_level": fill})}


def _land_one(spark, source, seq, fill):
    table(spark, "MESSAGES", _payload(seq, fill)).coalesce(1).write.mode("append").json(source)


def test_registry_is_read_anew_and_closing_reopens(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    bins = table(spark, "waste_bins", {"bin_id": 1, "bin_code": "B", "status": "active"})
    state = {"sensors": table(spark, "sensors"), "closed": set()}

    def so_far(session, batch_id):
        stored = ingest.stored_alerts(session, f"{root}/alerts", batch_id)
        if not state["closed"]:
            return stored
        return stored.withColumn("status", F.when(F.col("alert_id").isin(*state["closed"]), "resolved")
                                 .otherwise(F.col("status")))

    def run():
        ingest.start_ingest(stream_messages(spark, source), lambda s: (state["sensors"], bins), root,
                            str(tmp_path / "cp"), alerts_so_far=so_far, availableNow=True).awaitTermination()
        return rows(ingest.alert_table(spark, root), "alert_id")

    _land_one(spark, source, 1, 95)
    assert run() == []                                    # unknown device
    state["sensors"] = table(spark, "sensors", {"sensor_id": 5, "sensor_code": "S"})
    _land_one(spark, source, 2, 80)
    assert run() == [(8,)]                                # known from this batch on
    _land_one(spark, source, 3, 95)
    assert run() == [(8,)]                                # one is open already
    state["closed"].add(8)
    _land_one(spark, source, 4, 95)
    assert run() == [(16,), (8,)]                         # closed: the next one opens


def test_replay_of_a_batch_gives_the_same_rows(spark, sf_dir, tmp_path):
    fleet = Fleet(spark, sf_dir)
    root = str(tmp_path)
    messages = fleet.messages
    empty = spark.createDataFrame([], ingest.ALERT_SCHEMA)
    empty.write.parquet(f"{root}/alerts/batch_id=-1")
    from fleetgauge.sources.tables import write_batch, write_readings
    for _ in range(2):
        earlier = ingest.stored_alerts(spark, f"{root}/alerts", 0)
        out = ingest.ingest_batch(messages, fleet.sensors, fleet.bins, earlier)
        write_readings(out.accepted, f"{root}/readings", 0)
        write_batch(out.alerts, f"{root}/alerts", 0)
    alone = ingest.ingest_batch(messages, fleet.sensors, fleet.bins, empty)
    assert ingest.written_readings(spark, root).count() == alone.accepted.count()
    assert rows(ingest.alert_table(spark, root), *ALERT) == rows(alone.alerts, *ALERT)


@pytest.fixture
def reading_files(spark, sf_dir, tmp_path):
    """Readings in three files, the oldest last: two thirds of a month late."""
    frame = Fleet(spark, sf_dir).readings
    for i, days in enumerate(((20, 31), (10, 19), (1, 9))):
        part = frame.filter(F.dayofmonth("timestamp").between(*days))
        shaped = part.select(*[F.col(f.name) if f.name in part.columns else F.lit(None).cast(f.dataType).alias(f.name)
                               for f in SENSOR_READINGS])
        shaped.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    import os
    import shutil
    from pathlib import Path
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(3):
        for f in Path(tmp_path / f"in{i}").glob("part-*.parquet"):
            shutil.copy(f, flat / f"{i}.parquet")
            os.utime(flat / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(flat)


def _stream(spark, path):
    return spark.readStream.schema(SENSOR_READINGS).option("maxFilesPerTrigger", 1).parquet(path)


def test_latest_equals_the_batch(spark, reading_files, tmp_path):
    out = str(tmp_path / "latest")
    live.start_latest(_stream(spark, reading_files), out, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    expected = latest_readings(spark.read.schema(SENSOR_READINGS).parquet(reading_files))
    columns = sorted(expected.columns)
    assert rows(snapshots.current(spark, out, ["bin_id"]), *columns) == rows(expected, *columns)


def test_hourly_equals_the_batch_however_late(spark, reading_files, tmp_path):
    out = str(tmp_path / "hourly")
    live.start_hourly(_stream(spark, reading_files), out, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    expected = hourly_fill(spark.read.schema(SENSOR_READINGS).parquet(reading_files))
    columns = ["hour", "avg_fill_level", "reading_count"]
    assert rows(snapshots.current(spark, out, ["hour"]), *columns) == rows(expected, *columns)


def test_appended_hours_are_final(spark, sf_dir, tmp_path):
    frame = Fleet(spark, sf_dir).readings
    stream = Fleet(spark, sf_dir).reading_stream()
    out = str(tmp_path / "hours")
    (live.hourly_appended(stream).writeStream.outputMode("append").format("parquet")
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination())
    columns = ["hour", "avg_fill_level", "reading_count"]
    got, whole = set(rows(spark.read.parquet(out), *columns)), set(rows(hourly_fill(frame), *columns))
    assert got and got < whole


def test_resends_are_kept_unless_asked(spark, tmp_path):
    source = str(tmp_path / "in")
    for seq in (1, 1, 2):
        _land_one(spark, source, seq, 5)
    for dedupe, expected in ((False, 3), (True, 2)):
        stream = stream_messages(spark, source)
        if dedupe:
            stream = without_resends(stream, ["arrival_seq"], "1 hour")
        out = str(tmp_path / f"out{dedupe}")
        (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"cp{dedupe}"))
         .trigger(availableNow=True).start(out).awaitTermination())
        assert spark.read.parquet(out).count() == expected


def _cut(folder):
    """As a lost driver leaves a folder: files, but no commit."""
    (folder / "_SUCCESS").unlink()


def _keyed(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k int, v int")


def test_half_written_folders_count_as_absent(spark, tmp_path):
    path = str(tmp_path / "t")
    (tmp_path / "t" / "base=-1" / "_temporary").mkdir(parents=True)
    snapshots.create(_keyed(spark, (1, 0)), path)                       # written, not taken as there
    assert rows(snapshots.current(spark, path, ["k"]), "k", "v") == [(1, 0)]
    snapshots.upsert(_keyed(spark, (1, 1), (2, 1)), path, ["k"], 0)
    snapshots.upsert(_keyed(spark, (2, 2)), path, ["k"], 1)
    _cut(tmp_path / "t" / "delta=1")
    assert rows(snapshots.current(spark, path, ["k"]), "k", "v") == [(1, 1), (2, 1)]
    snapshots.upsert(_keyed(spark, (2, 3)), path, ["k"], 1)             # the batch runs again
    assert rows(snapshots.current(spark, path, ["k"]), "k", "v") == [(1, 1), (2, 3)]


def test_compaction_keeps_the_table_and_the_work_of_a_batch(spark, tmp_path):
    path, expected = str(tmp_path / "t"), {}
    snapshots.create(_keyed(spark).limit(0), path)
    for n in range(9):
        snapshots.upsert(_keyed(spark, (n % 4, n)), path, ["k"], n, compact_every=3)
        expected[n % 4] = n
        found = snapshots.current(spark, path, ["k"])
        assert rows(found, "k", "v") == sorted(expected.items())
        assert len(found.inputFiles()) <= 4 + 4
    _cut(tmp_path / "t" / "base=8")                                      # the base before and its deltas serve
    assert rows(snapshots.current(spark, path, ["k"]), "k", "v") == sorted(expected.items())
    snapshots.upsert(_keyed(spark, (0, 8)), path, ["k"], 8, compact_every=3)
    assert rows(snapshots.current(spark, path, ["k"]), "k", "v") == sorted(expected.items())
    snapshots.expire(spark, path, keep=1)
    assert rows(snapshots.current(spark, path, ["k"]), "k", "v") == sorted(expected.items())


def test_open_alerts_from_before_survive_a_lost_start(spark, tmp_path):
    source, root = str(tmp_path / "in"), tmp_path / "out"
    bins = table(spark, "waste_bins", {"bin_id": 1, "bin_code": "B", "status": "active"})
    sensors = table(spark, "sensors", {"sensor_id": 5, "sensor_code": "S"})
    known = spark.createDataFrame([(1, 1, "bin_full", "open")], "alert_id long, bin_id int, alert_type string, status string")
    (root / "alerts" / "batch_id=-1" / "_temporary").mkdir(parents=True)
    (root / "open_keys" / "base=-1" / "_temporary").mkdir(parents=True)
    for seq in (1, 2):
        _land_one(spark, source, seq, 95)
        ingest.start_ingest(stream_messages(spark, source), lambda s: (sensors, bins), str(root),
                            str(tmp_path / "cp"), known_alerts=known, availableNow=True).awaitTermination()
    assert rows(ingest.alert_table(spark, str(root)), "alert_id", "batch_id") == [(1, -1)]


def test_first_alert_is_the_earliest_by_time(spark):
    from fleetgauge.operators.alerts import CANDIDATE_COLUMNS, new_open_alerts
    early, late = ts("2024-01-01 00:00:00"), ts("2024-01-01 00:00:05")
    made = [{"alert_id": 8, "bin_id": 1, "alert_type": "bin_full", "severity": "high", "message": "m",
             "triggered_at": late, "status": "open", "arrival_seq": 2},
            {"alert_id": 36, "bin_id": 1, "alert_type": "bin_full", "severity": "high", "message": "m",
             "triggered_at": early, "status": "open", "arrival_seq": 9}]
    frame = spark.createDataFrame([tuple(r.values()) for r in made], ingest.ALERT_SCHEMA)
    none = frame.limit(0)
    assert rows(new_open_alerts(frame.select(*CANDIDATE_COLUMNS), none), "alert_id") == [(36,)]


def test_shared_dir_follows_the_session(spark):
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert first != second
    root = spark.conf.get("spark.checkpoint.dir", None)
    assert root is None or first.startswith(root)


def test_gone_keys_stay_away_until_they_come_again(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.create(_keyed(spark, (1, 0), (2, 0), (3, 0)), path)
    none, gone = _keyed(spark, (0, 0)).limit(0), _keyed(spark, (2, 0), (9, 0))
    for _ in range(2):                                                   # the batch runs again
        snapshots.upsert(_keyed(spark, (1, 1)), path, ["k"], 0, gone=gone)
        assert rows(snapshots.current(spark, path, ["k"]), "k", "v") == [(1, 1), (3, 0)]
    assert rows(snapshots.current(spark, path, ["k"], -1), "k", "v") == [(1, 0), (2, 0), (3, 0)]
    snapshots.upsert(_keyed(spark, (2, 2), (3, 2)), path, ["k"], 1, gone=_keyed(spark, (3, 0), (1, 0)))
    assert rows(snapshots.current(spark, path, ["k"]), "k", "v") == [(2, 2), (3, 2)]
    snapshots.upsert(none, path, ["k"], 2, compact_every=3, gone=_keyed(spark, (2, 0)))
    base = spark.read.parquet(f"{path}/base=2")
    assert base.columns == ["k", "v"] and rows(base, "k", "v") == [(3, 2)]
    assert rows(snapshots.current(spark, path, ["k"]), "k", "v") == [(3, 2)]


def test_a_set_of_keys_alone_can_lose_some(spark, tmp_path):
    path, frame = str(tmp_path / "t"), _keyed(spark, (1, 1), (1, 2), (2, 1))
    snapshots.create(frame, path)
    snapshots.upsert(frame.limit(0), path, ["k", "v"], 0, gone=_keyed(spark, (1, 2)))
    assert rows(snapshots.current(spark, path, ["k", "v"]), "k", "v") == [(1, 1), (2, 1)]


CHANGED = "alert_id long, bin_id int, alert_type string, status string, changed_at timestamp_ntz"


class Closing:
    """A stream of one bin whose alert changes are given per batch."""

    def __init__(self, spark, tmp_path, *known):
        self.spark, self.source, self.root, self.cp = spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
        self.bins = table(spark, "waste_bins", {"bin_id": 1, "bin_code": "B", "status": "active"})
        self.sensors = table(spark, "sensors", {"sensor_id": 5, "sensor_code": "S"})
        self.known = spark.createDataFrame(list(known), "alert_id long, bin_id int, alert_type string, status string")
        self.asked = []

    def batch(self, seq, *changes, fill=95):
        """Alerts after one more message, before which the (alert, status, minute) changes come."""
        made = self.spark.createDataFrame(
            [(a, 1, "bin_full", status, ts(f"2024-01-01 00:{minute:02d}:00")) for a, status, minute in changes], CHANGED)

        def changes_of(session, batch_id):
            self.asked.append(batch_id)
            return made

        _land_one(self.spark, self.source, seq, fill)
        ingest.start_ingest(stream_messages(self.spark, self.source), lambda s: (self.sensors, self.bins), self.root,
                            self.cp, known_alerts=self.known, status_changes=changes_of, availableNow=True).awaitTermination()
        return rows(ingest.current_alerts(self.spark, self.root), "alert_id", "status")


@pytest.mark.parametrize("status", ["resolved", "acknowledged", "false_alarm"])
def test_a_closed_alert_lets_the_next_one_open(spark, tmp_path, status):
    job = Closing(spark, tmp_path)
    assert job.batch(1) == [(4, "open")]
    assert job.batch(2) == [(4, "open")]
    assert job.batch(3, (4, status, 1)) == [(12, "open"), (4, status)]
    # A change that names the old alert leaves the new one open; opened again, the old one blocks.
    assert job.batch(4, (4, "resolved", 2)) == [(12, "open"), (4, "resolved")]
    assert job.batch(5, (12, "resolved", 3), (4, "open", 4)) == [(12, "resolved"), (4, "open")]
    # The newest of several changes counts.
    assert job.batch(6, (4, "open", 5), (4, "resolved", 6)) == [(12, "resolved"), (24, "open"), (4, "resolved")]


def test_another_open_alert_still_blocks(spark, tmp_path):
    job = Closing(spark, tmp_path, (100, 1, "bin_full", "open"), (101, 1, "bin_full", "open"))
    assert job.batch(1, (100, "resolved", 1)) == [(100, "resolved"), (101, "open")]
    assert len(job.batch(2, (101, "resolved", 2))) == 3


def test_a_replayed_batch_sees_the_changes_of_its_first_run(spark, tmp_path):
    job = Closing(spark, tmp_path)
    job.batch(1)
    first = job.batch(2, (4, "resolved", 1))
    # As if the driver was lost before the batch was committed: it runs again, asked for other changes.
    (tmp_path / "cp" / "commits" / "1").unlink()
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    asked = len(job.asked)
    again = job.batch(3)
    assert first == [(4, "resolved"), (8, "open")] and again == first
    assert job.asked[asked:] in ([2], [1, 2])                            # stored changes are not asked for again
    assert spark.read.parquet(f"{job.root}/status_changes/batch_id=1").count() == 1
