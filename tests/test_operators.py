"""Operators on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import (alerts, collections, compliance, devices, export, integrity,
                                  readings, routes, status, timeline, weights)
from fleetgauge.sources import tables
from tests.helpers import dec, rows, table, ts

AS_OF = "2024-01-02 00:00:00"


@pytest.fixture(scope="module")
def bins(spark):
    return table(spark, "waste_bins",
                 {"bin_id": 1, "bin_code": "B1", "location": "Hall, east", "status": "active", "capacity": 100},
                 {"bin_id": 2, "bin_code": "B2", "location": "", "status": "active", "capacity": 100},
                 {"bin_id": 3, "bin_code": "B3", "location": "Yard", "status": "inactive", "capacity": 50})


@pytest.fixture(scope="module")
def frame(spark):
    made = [(1, 1, "10.00", "2.00", "2024-01-01 10:00:00"), (2, 1, "80.00", "0.00", "2024-01-01 11:00:00"),
            (3, 1, "95.00", None, "2024-01-01 23:59:00"), (4, 3, "50.00", "4.00", "2024-01-01 12:00:00"),
            (5, 1, "20.00", "7.00", "2023-12-30 00:00:00"), (6, 9, "99.00", "1.00", "2024-01-01 00:00:00")]
    return table(spark, "sensor_readings", *[
        {"reading_id": i, "sensor_id": b, "bin_id": b, "fill_level": dec(f), "weight_kg": dec(w),
         "timestamp": ts(t), "battery_level": dec("20.50"), "signal_strength": -50,
         "temperature_c": dec("25.00"), "distance_cm": dec("1.00")} for i, b, f, w, t in made])


@pytest.fixture(scope="module")
def alert_rows(spark):
    return table(spark, "alerts", *[
        {"alert_id": i, "bin_id": b, "alert_type": "bin_full", "severity": s, "status": st, "message": "m",
         "triggered_at": ts("2024-01-01 00:00:00")}
        for i, b, s, st in ((1, 1, "high", "open"), (2, 1, None, "open"), (3, 1, "low", "resolved"),
                            (4, 77, "", "open"))])


def test_status(spark, bins, frame, alert_rows):
    got = status.current_status(bins, frame, alert_rows)
    assert got.columns == status.STATUS_COLUMNS
    assert rows(got, "bin_id", "fill_level", "fill_status", "open_alerts", "last_reading") == [
        (1, dec("95.00"), "critical", 2, ts("2024-01-01 23:59:00")), (2, None, "low", 0, None),
        (3, dec("50.00"), "medium", 0, ts("2024-01-01 12:00:00"))]
    assert status.active_bins(got).count() == 2
    assert status.active_bins(got, "active").count() == 2
    assert status.active_bins(got, "inactive").count() == 0


def test_fleet_stats(spark, bins, frame, alert_rows):
    picked = table(spark, "collections", {"collection_id": 1, "bin_id": 1, "collection_time": ts("2023-12-26 00:00:00")},
                   {"collection_id": 2, "bin_id": 1, "collection_time": ts("2023-12-25 23:59:59")})
    current = status.current_status(bins, frame, alert_rows)
    got = status.fleet_stats(current, alert_rows, picked, AS_OF).first().asDict()
    assert got == {"total_bins": 2, "avg_fill_level": 72.5, "bins_need_attention": 1, "active_alerts": 3,
                   "recent_collections": 1}
    empty = status.fleet_stats(current.limit(0), alert_rows.limit(0), picked.limit(0), AS_OF).first().asDict()
    assert empty == {"total_bins": 0, "avg_fill_level": 0.0, "bins_need_attention": 0, "active_alerts": 0,
                     "recent_collections": 0}


def test_bin_detail(spark, bins, frame, alert_rows):
    picked = table(spark, "collections", *[
        {"collection_id": i, "bin_id": 1, "collection_time": ts(f"2024-01-0{i} 00:00:00")} for i in range(1, 8)])
    current = status.current_status(bins, frame, alert_rows)
    detail = status.bin_detail(current, frame, picked, 1)
    assert rows(detail["bin_info"], "bin_id") == [(1,)]
    assert rows(detail["recent_readings"], "rank", "reading_id") == [(1, 3), (2, 2), (3, 1), (4, 5)]
    assert rows(detail["collections"], "rank", "collection_id") == [(1, 7), (2, 6), (3, 5), (4, 4), (5, 3)]
    assert status.bin_detail(current, frame, picked, 404)["bin_info"].count() == 0


def test_daily_weight(bins, frame):
    daily = weights.daily_weight(bins, frame, AS_OF)
    assert rows(daily, "bin_id", "total_weight_today", "reading_count_today", "last_reading_today") == [
        (1, dec("2.00"), 1, ts("2024-01-01 10:00:00")), (2, dec("0.00"), 0, None)]
    assert weights.daily_weight_total(daily).first()[0] == dec("2.00")
    assert weights.daily_weight_total(daily.limit(0)).first()[0] == dec("0.00")


def test_weighing_history(frame):
    got = weights.weighing_history(frame, 3, bin_id=1)
    assert rows(got, "reading_id", "rank", "is_newest", "weight_text") == [(1, 3, True, "2.000 กก.")]
    assert rows(weights.weighing_history(frame, 10, bin_id=1), "reading_id", "is_newest") == [(1, True), (5, False)]


def test_compliance(bins, frame, alert_rows):
    active = status.active_bins(status.current_status(bins, frame, alert_rows))
    daily = weights.daily_weight(bins, frame, AS_OF)
    assert rows(compliance.department_cards(active, daily, AS_OF), "bin_id", "card_status", "sub_text") == [
        (1, "good", "กำลังชั่ง..."), (2, "none", "")]
    assert compliance.department_cards(active, daily, AS_OF, "none").count() == 1
    with pytest.raises(ValueError):
        compliance.of_class(active, "purple")
    assert rows(compliance.compliance_distribution(active, AS_OF), "card_status", "bin_count") == [
        ("good", 1), ("high", 0), ("medium", 0), ("none", 1), ("offline", 0)]
    assert rows(compliance.active_weighing(active, AS_OF), "weighing", "total_bins") == [(1, 2)]
    assert rows(compliance.weight_bars(active, daily, AS_OF), "bin_id", "label", "weight") == [
        (1, "Hall, east", dec("2.00")), (2, "B2", dec("0.00"))]
    assert rows(compliance.weighing_summary(active, daily, AS_OF), "bin_id", "total_text", "weighings",
                "battery_text", "signal_text") == [(1, "2.000", 1, "21%", "-50 dBm"), (2, "0.000", 0, "--", "--")]


def test_timelines(spark, frame, alert_rows):
    got = timeline.fill_timeline(frame, AS_OF, 24)
    assert [tuple(r) for r in got.collect()][1:3] == [
        (ts("2024-01-01 10:00:00"), 10.0, 1), (ts("2024-01-01 11:00:00"), 80.0, 1)]
    assert rows(timeline.alert_timeline(alert_rows, AS_OF, 24), "severity", "alert_count") == [
        ("", 1), ("high", 1), ("low", 1), (None, 1)]
    unknown = frame.withColumn("fill_level", F.lit(None).cast("decimal(5,2)"))
    assert timeline.hourly_fill(unknown).first()["avg_fill_level"] is None


def test_alert_lists(bins, alert_rows):
    listed = alerts.alerts_by_status(alert_rows, bins, "open", 2)
    assert [r["alert_id"] for r in listed.collect()] == [4, 2]
    assert alerts.alerts_by_status(alert_rows, bins, "resolved").count() == 1
    feed = alerts.alert_feed(alert_rows, bins)
    assert rows(feed, "alert_id", "title", "severity", "severity_label") == [
        (1, "น้ำหนักเกินขีด · B1", "high", "HIGH"), (2, "น้ำหนักเกินขีด · B1", "low", "LOW"),
        (4, "น้ำหนักเกินขีด · ", "low", "LOW")]


def test_lookback_of_one_bin_is_whole(bins, frame):
    got = readings.readings_lookback(frame, bins, AS_OF, 24, bin_id=1)
    assert [r["reading_id"] for r in got.collect()] == [3, 2, 1]
    assert readings.readings_lookback(frame, bins, AS_OF, 168).count() == 6
    with pytest.raises(ValueError):
        readings.readings_lookback(frame, bins, AS_OF, 200)


def test_devices(spark, bins, frame):
    sensors = table(spark, "sensors",
                    {"sensor_id": 1, "sensor_code": "S1", "bin_id": 1, "status": "active", "mac_address": "AA:BB:CC:DD:EE:01", "manufacturer": ""},
                    {"sensor_id": 2, "sensor_code": "S2", "bin_id": 99, "status": "active", "mac_address": "AA:BB:CC:DD:EE:02"},
                    {"sensor_id": 3, "sensor_code": "S3", "bin_id": 3, "status": "inactive", "mac_address": "AA:BB:CC:DD:EE:03", "weight_offset": 1.256},
                    {"sensor_id": 4, "sensor_code": "S4", "bin_id": 1, "status": "active"})
    listed = devices.device_list(sensors, bins, frame)
    assert rows(listed, "sensor_id", "bin_code", "last_seen") == [
        (1, "B1", ts("2024-01-01 23:59:00")), (2, None, None), (3, "B3", ts("2024-01-01 12:00:00")), (4, "B1", None)]
    assert rows(devices.device_report(listed, AS_OF), "sensor_id", "device_name", "bin_code", "offset_text", "seen_text", "online") == [
        (1, "S1", "B1", "0.00", "1 นาทีที่แล้ว", True), (2, "S2", "—", "0.00", "—", False),
        (3, "S3", "B3", "1.26", "12 ชม.ที่แล้ว", False)]
    asked = spark.createDataFrame([(1, " aa:bb:cc:dd:ee:01"), (2, "AA:BB:CC:DD:EE:02"), (3, "AA:BB:CC:DD:EE:03"), (4, "zz")],
                                  "n int, mac_address string")
    assert rows(devices.device_lookup(asked, sensors, bins), "n", "registered", "bin_id", "weight_offset") == [
        (1, True, "1", 0.0), (2, False, None, None), (3, False, None, None), (4, False, None, None)]
    assert rows(devices.sensors_with_bins(sensors, bins), "sensor_id", "location") == [
        (1, "Hall, east"), (2, None), (3, "Yard"), (4, "Hall, east")]


def test_collections(spark, bins):
    picked = table(spark, "collections", *[
        {"collection_id": i, "bin_id": 1, "fill_level_before": dec(f), "weight_collected": dec("1.50"),
         "collection_time": ts("2024-01-01 00:00:00"), "duration_minutes": i} for i, f in ((1, "80.00"), (2, None), (4, "90.00"))])
    assert rows(collections.collection_stats(bins, picked), "bin_id", "total_collections",
                "avg_fill_before_collection", "total_weight_collected", "avg_collection_duration") == [
        (1, 3, 85.0, dec("4.50"), 2.333333), (2, 0, None, None, None), (3, 0, None, None, None)]


def test_export(spark, bins, frame, tmp_path):
    start, end = export.interval("2023-12-30", "2024-01-01", "", "12:00")
    assert (start, end, export.export_hours(start, end)) == ("2023-12-30 00:00:00", "2024-01-01 12:00:00", 60)
    assert export.export_hours("2024-01-01 00:00:00", "2024-01-01 00:01:00") == 1
    assert export.export_hours("2024-01-01 00:00:00", "2024-03-01 00:00:00") == 1440
    with pytest.raises(ValueError):
        export.interval("2024-01-02", "2024-01-01")
    report = export.export_report(frame, bins, start, end)
    assert rows(report, "reading_id", "department") == [
        (1, "Hall, east"), (2, "Hall, east"), (4, "B3"), (5, "Hall, east"), (6, None)]
    path = str(tmp_path / "report")
    export.write_csv(report, path)
    lines = sorted(spark.read.text(path).collect())
    text = [r[0] for r in lines]
    assert "วันที่/เวลา,รหัสเครื่อง,หน่วยงาน,น้ำหนัก (กก.),แบตเตอรี่ (%),สัญญาณ (dBm),อุณหภูมิ (°C)" in text
    assert '2024-01-01T10:00:00,B1,"Hall, east",2.00,20.50,-50,25.00' in text
    assert "2024-01-01T00:00:00,,,1.00,20.50,-50,25.00" in text
    assert rows(export.read_csv(spark, path), "timestamp", "department", "weight_kg") == rows(
        report, "timestamp", "department", "weight_kg")


def test_csv_quotes_are_doubled(spark, bins, tmp_path):
    odd = spark.createDataFrame([('say "hi", ok',)], "department string").selectExpr(
        "CAST(NULL AS TIMESTAMP_NTZ) AS timestamp", "'b' AS bin_code", "department",
        "CAST(NULL AS DECIMAL(8,2)) AS weight_kg", "CAST(NULL AS DECIMAL(5,2)) AS battery_level",
        "CAST(NULL AS INT) AS signal_strength", "CAST(NULL AS DECIMAL(5,2)) AS temperature_c")
    path = str(tmp_path / "odd")
    export.write_csv(odd, path)
    assert ',b,"say ""hi"", ok",,,,' in [r[0] for r in spark.read.text(path).collect()]
    assert export.read_csv(spark, path).first()["department"] == 'say "hi", ok'


def test_json_rows(spark, frame, tmp_path):
    path = str(tmp_path / "rows")
    export.write_json(frame.select("reading_id", "timestamp"), path)
    assert '{"reading_id":1,"timestamp":"2024-01-01T10:00:00+07:00"}' in [r[0] for r in spark.read.text(path).collect()]


def test_integrity(spark, bins, frame):
    fleet = {"waste_bins": bins.unionByName(bins.filter("bin_id = 1")), "sensor_readings": frame,
             "sensors": table(spark, "sensors", {"sensor_id": 1, "sensor_code": "a"}, {"sensor_id": 3, "sensor_code": "b", "bin_id": 8}),
             "route_bins": table(spark, "route_bins", *[{"route_bin_id": i, "route_id": 1, "bin_id": 1} for i in (1, 2)])}
    assert rows(integrity.unique_violations(fleet), "table_name", "key_columns", "key_value", "occurrences") == [
        ("route_bins", "route_id,bin_id", "1,1", 2), ("waste_bins", "bin_code", "B1", 2), ("waste_bins", "bin_id", "1", 2)]
    assert rows(integrity.orphan_rows(fleet), "table_name", "column_name", "reference", "row_count") == [
        ("sensor_readings", "bin_id", 9, 1), ("sensor_readings", "sensor_id", 9, 1), ("sensors", "bin_id", 8, 1)]


def test_routes_and_geometry(spark, bins, frame, alert_rows):
    stops = table(spark, "route_bins", {"route_id": 1, "bin_id": 1, "sequence_order": 2, "estimated_time_minutes": 5},
                  {"route_id": 1, "bin_id": 88, "sequence_order": 1, "estimated_time_minutes": 7})
    paths = table(spark, "collection_routes", {"route_id": 1, "route_name": "R"})
    got = routes.route_manifest(paths, stops, status.current_status(bins, frame, alert_rows))
    assert rows(got, "sequence_order", "bin_id", "fill_status", "route_minutes", "route_stops") == [
        (1, 88, None, 12, 2), (2, 1, "critical", 12, 2)]
    # Height 8 cm: at 10 % the content is 7.2 cm away, at 95 % 0.4 cm; 1 cm was measured.
    far = {r["reading_id"]: r["gap_cm"] for r in routes.geometry_check(frame, bins, 0.55).collect()}
    assert far == {1: dec("6.200000"), 2: dec("0.600000"), 3: dec("0.600000"), 4: dec("1.000000"), 5: dec("5.400000")}


def test_tables(spark, bins, frame):
    assert [r["reading_id"] for r in tables.newest_rows(frame, 2).collect()] == [3, 4]
    assert rows(tables.row_counts({"b": bins, "e": bins.limit(0)}), "table_name", "row_count") == [("b", 3), ("e", 0)]
    filled = tables.with_defaults(spark.createDataFrame([(1, "resolved"), (2, None)], "alert_id long, status string"),
                                  "alerts", F.expr(f"TIMESTAMP_NTZ '{AS_OF}'"))
    assert rows(filled, "alert_id", "status", "triggered_at", "resolved_at") == [
        (1, "resolved", ts(AS_OF), None), (2, "open", ts(AS_OF), None)]


def test_replayed_batch_leaves_no_duplicates(spark, frame, tmp_path):
    path = str(tmp_path / "readings")
    tables.write_readings(frame, path, batch_id=0)
    tables.write_readings(frame.filter("reading_id < 3"), path, batch_id=1)
    tables.write_readings(frame, path, batch_id=0)
    assert spark.read.parquet(path).count() == 8


def test_numeric_room(spark):
    from fleetgauge.operators import collections, weights
    bins = table(spark, "waste_bins", {"bin_id": 1, "bin_code": "B", "status": "active"})
    frame = table(spark, "collections", {"collection_id": 1, "bin_id": 1, "duration_minutes": 2_000_000},
                  {"collection_id": 2, "bin_id": 1, "duration_minutes": 1_000_000})
    assert collections.collection_stats(bins, frame).first()["avg_collection_duration"] == 1_500_000.0
    most = dec("9999999999999999.99")
    daily = spark.createDataFrame([(most,)] * 3, "total_weight_today decimal(18,2)")
    assert weights.daily_weight_total(daily).first()[0] == 3 * most


def test_long_lookbacks_and_limits_are_parameters(spark, bins, frame):
    assert readings.readings_lookback(frame, bins, AS_OF, 2000, max_hours=None).count() >= 6
    assert readings.readings_lookback(frame, bins, AS_OF, 168, limit=2).count() == 2


def test_repeated_ids_are_the_same_dense_or_sparse(spark):
    from fleetgauge.operators import integrity
    dense = [*range(500), 7, 7, 499]
    for step in (1, 1_000_003):
        found = integrity.repeated_ids(spark.createDataFrame([(i * step,) for i in dense] + [(None,)], "x long"), "x")
        assert rows(found, "x", "occurrences") == [(499 * step, 2), (7 * step, 3)]
