"""The payload gate, device lookup, value checks and alert rules on hand-made messages."""

import json

import pytest

from fleetgauge.operators.alerts import AlertRules, alert_candidates, new_open_alerts
from fleetgauge.operators.resolve import (accepted_readings, classify_messages,
                                          rejected_messages, split_by_registry)
from fleetgauge.sources.messages import from_kafka, subscribed, topic_level
from tests.helpers import dec, rows, table, ts

TOPIC = "waste/bins/B1/sensors"
MAC = "AA:BB:CC:00:00:01"


@pytest.fixture(scope="module")
def registry(spark):
    bins = table(spark, "waste_bins", *[{"bin_id": i, "bin_code": f"B{i}", "status": "active"}
                                        for i in (1, 2, 3)])
    sensors = table(
        spark, "sensors",
        {"sensor_id": 10, "sensor_code": "S10", "bin_id": 1, "mac_address": MAC, "weight_offset": -0.25},
        {"sensor_id": 11, "sensor_code": "S11", "bin_id": 2, "status": "inactive"},
        {"sensor_id": 12, "sensor_code": "S12", "mac_address": "AA:BB:CC:00:00:02"},
        {"sensor_id": 13, "sensor_code": "S13", "bin_id": 99, "mac_address": "AA:BB:CC:00:00:03"})
    return sensors, bins


def messages(spark, *payloads):
    made = []
    for i, payload in enumerate(payloads):
        topic, body = payload if isinstance(payload, tuple) else (TOPIC, payload)
        body = body if isinstance(body, str) else json.dumps(body)
        made.append({"topic": topic, "payload": body, "arrival_seq": i,
                     "arrival_ts": ts("2024-01-01 00:00:00")})
    return table(spark, "MESSAGES", *made)


def classify(spark, registry, *payloads):
    return classify_messages(messages(spark, *payloads), *registry)


def reasons(spark, registry, *payloads):
    got = classify(spark, registry, *payloads).orderBy("arrival_seq").collect()
    return [r["reason"] for r in got]


def good(**extra):
    return {"bin_id": "2", "bin_code": "B2", "sensor_code": "S11", "fill_level": 10.5, **extra}


def test_gate(spark, registry):
    missing = good()
    del missing["fill_level"]
    assert reasons(spark, registry, "[1]", "3", "nope", "null", good(fill_level=None),
                   good(fill_level="5"), good(fill_level=True), good(fill_level=[1]),
                   good(battery_level="9"), good(temperature_c=None), missing, good()) == [
        "malformed", "malformed", "malformed", "malformed", *["not_a_number"] * 6, None, None]


def test_malformed_text(spark, registry):
    text = json.dumps(good())
    bad = [text + " x", text + text, text + "," + text, text + "]", text + " }", text[:-1],
           text.replace('"', "'"), "", "{,}", "[" + text + "]", "\ufeff" + text]
    assert reasons(spark, registry, *bad) == ["malformed"] * len(bad)
    assert reasons(spark, registry, f" \n{text}\t\r\n ", "{}") == [None, "unknown_device"]


def test_the_last_of_repeated_keys_counts(spark, registry):
    text = json.dumps(good())[:-1]
    got = accepted_readings(classify(spark, registry, text + ', "fill_level": 7}'))
    assert rows(got, "fill_level") == [(dec("7.00"),)]
    assert reasons(spark, registry, text + ', "fill_level": null}') == ["not_a_number"]


def test_topics(spark):
    # One level may be empty; a line end after the topic is another topic.
    topics = ["waste/bins/a/sensors", "waste/bins/a/b/sensors", "waste/bins//sensors",
              "x/waste/bins/a/sensors", "waste/bins/a/sensors\n"]
    df = messages(spark, *[(t, "{}") for t in topics])
    assert rows(subscribed(df).select(topic_level(subscribed(df)["topic"]).alias("t")), "t") == [("",), ("a",)]


def test_device_tiers(spark, registry):
    got = classify(
        spark, registry,
        good(mac_address=" aa:bb:cc:00:00:01 "),                     # MAC wins: bin 1, not 2
        good(mac_address="AA:BB:CC:00:00:99"),                       # unknown MAC, known code
        good(mac_address="AA:BB:CC:00:00:99", sensor_code="nope"),   # both unknown
        good(mac_address=None),                                      # explicit null
        good(mac_address=7),
        good(mac_address="  "),                                      # blank: by code
        good(mac_address="AA:BB:CC:00:00:02"),                       # registry without a bin
        good(mac_address="AA:BB:CC:00:00:03"),                       # registry bin is gone
        good(sensor_code=5), good(bin_id="77"))
    result = [(r["sensor_id"], r["bin_id"], r["reason"]) for r in got.orderBy("arrival_seq").collect()]
    assert result == [
        (10, 1, None), (11, 2, None), (None, 2, "unknown_device"), (None, 2, "bad_mac"),
        (None, 2, "bad_mac"), (11, 2, None), (12, None, "bad_bin"), (13, 99, "unknown_bin"),
        (None, 2, "unknown_device"), (11, 77, "unknown_bin")]


def test_bin_id_forms(spark, registry):
    forms = ["2", " 2 ", 2, 2.9, True, "2.0", "x", None]
    got = classify(spark, registry, *[good(bin_id=v) for v in forms]).orderBy("arrival_seq").collect()
    assert [r["bin_id"] for r in got] == [2, 2, 2, 2, 1, None, None, None]
    assert [r["reason"] for r in got] == [None] * 5 + ["bad_bin"] * 3


def test_values(spark, registry):
    assert reasons(spark, registry, good(fill_level=1000), good(timestamp="nope"), good(timestamp=5),
                   good(timestamp="2024"), good(timestamp="2024-05"), good(humidity="x"),
                   good(signal_strength="-5.5"), good(weight_kg="abc"), good(weight_kg=True),
                   good(distance_cm=False), good(weight_kg=10**9)) == ["bad_value"] * 11
    got = accepted_readings(classify(
        spark, registry,
        good(humidity=" 5.5 ", signal_strength=-55.5, weight_kg="1.005", timestamp="2024-05-06T10:30:00+07:00",
             distance_cm=1.234, gas_level=None),
        good(timestamp="", signal_strength="-60"), good(timestamp=None, fill_level=89.996),
        good(mac_address=MAC, weight_kg=1.0), good(mac_address=MAC, weight_kg=True),
        good(mac_address=MAC), good(timestamp="2024-5-6"))).orderBy("reading_id").collect()
    first = got[0]
    assert (first["humidity"], first["signal_strength"], first["weight_kg"], first["timestamp"],
            first["distance_cm"], first["gas_level"]) == (
        dec("5.50"), -56, dec("1.01"), ts("2024-05-06 10:30:00"), dec("1.23"), None)
    assert (got[1]["timestamp"], got[1]["signal_strength"]) == (ts("2024-01-01 00:00:00"), -60)
    assert (got[2]["timestamp"], got[2]["fill_level"]) == (ts("2024-01-01 00:00:00"), dec("90.00"))
    assert [r["weight_kg"] for r in got[3:6]] == [dec("0.75"), dec("0.75"), None]
    assert got[6]["timestamp"] == ts("2024-05-06 00:00:00")


def test_rejects_keep_the_message(spark, registry):
    got = rejected_messages(classify(spark, registry, "nope", good())).collect()
    assert [(r["arrival_seq"], r["payload"], r["reason"]) for r in got] == [(0, "nope", "malformed")]


def hits(spark, registry, *payloads, **kw):
    return rows(alert_candidates(classify(spark, registry, *payloads), **kw),
                "arrival_seq", "bin_id", "alert_type", "severity", "message")


def test_alert_limits(spark, registry):
    got = hits(spark, registry, good(battery_level=20), good(battery_level=19.99),
               good(temperature_c=45), good(temperature_c=45.01), good(fill_level=74.99),
               good(fill_level=75), good(fill_level=89.996), good(fill_level=90))
    assert [(s, k, v) for s, _, k, v, _ in got] == [
        (1, "sensor_fault", "medium"), (3, "unusual_activity", "high"), (5, "bin_full", "high"),
        (6, "bin_full", "high"), (7, "bin_full", "critical")]


def test_rules_see_every_digit(spark, registry):
    got = hits(spark, registry, good(fill_level=89.99999999999), good(fill_level=74.99999999999))
    assert [(s, v) for s, _, _, v, _ in got] == [(0, "high")]


def test_numbers_out_of_range(spark, registry):
    text = json.dumps(good())
    assert reasons(spark, registry, *[text.replace("10.5", v) for v in ("NaN", "1e400", "-1000", "1e3")]) == [
        "bad_value"] * 4
    got = accepted_readings(classify(spark, registry, text.replace("10.5", "1.25e1"),
                                     good(weight_kg=1.00499999999, distance_cm=0.125)))
    assert rows(got, "reading_id", "fill_level", "weight_kg", "distance_cm") == [
        (0, dec("12.50"), None, None), (1, dec("10.50"), dec("1.00"), dec("0.13"))]


def test_alert_messages_and_several_rules(spark, registry):
    got = hits(spark, registry, good(fill_level=95, battery_level=5, temperature_c=50.25),
               {"sensor_code": "S11", "bin_id": "2"})
    assert got == [
        (0, 2, "bin_full", "critical", "Bin B2 is 95.0% full - requires immediate collection"),
        (0, 2, "sensor_fault", "medium", "Low battery warning for B2: 5.0%"),
        (0, 2, "unusual_activity", "high", "High temperature detected in B2: 50.3°C")]


def test_alert_names_the_payload_bin(spark, registry):
    payloads = [good(mac_address=MAC, fill_level=95), good(mac_address=MAC, fill_level=95, bin_id="77")]
    assert [h[:2] for h in hits(spark, registry, *payloads)] == [(0, 2)]
    assert [h[:2] for h in hits(spark, registry, *payloads, alert_bin="resolved")] == [(0, 1), (1, 1)]


def test_rules_are_parameters(spark, registry):
    assert len(hits(spark, registry, good(fill_level=60), rules=AlertRules(fill_high=55.5))) == 1


def test_one_open_alert_per_bin_and_type(spark, registry):
    candidates = alert_candidates(classify(
        spark, registry, good(fill_level=80), good(fill_level=95), good(fill_level=95, bin_id="3")))
    none = table(spark, "alerts")
    assert rows(new_open_alerts(candidates, none), "bin_id", "severity", "arrival_seq") == [
        (2, "high", 0), (3, "critical", 2)]
    for state, kept in (("open", 1), ("resolved", 2), ("acknowledged", 2), ("false_alarm", 2)):
        held = table(spark, "alerts", {"alert_id": 1, "bin_id": 2, "alert_type": "bin_full", "status": state})
        assert new_open_alerts(candidates, held).count() == kept


def test_foreign_keys_split_readings(spark, registry):
    sensors, bins = registry
    readings = table(spark, "sensor_readings", {"reading_id": 1, "sensor_id": 10, "bin_id": 1},
                     {"reading_id": 2, "sensor_id": 99, "bin_id": 1},
                     {"reading_id": 3, "sensor_id": 10, "bin_id": 98}, {"reading_id": 4})
    kept, refused = split_by_registry(readings, sensors, bins)
    assert rows(kept, "reading_id") == [(1,), (4,)]
    assert rows(refused, "reading_id") == [(2,), (3,)]


def test_kafka_envelope(spark):
    records = spark.createDataFrame(
        [(b"waste/bins/a/sensors", b"{}", 5, 2), (b"waste/bins/a/sensors", b"{}", 5, 1)],
        "key binary, value binary, offset long, partition int").selectExpr(
            "*", "TIMESTAMP '2024-01-01 00:00:00' AS timestamp")
    assert rows(from_kafka(records, 4), "topic", "payload", "arrival_seq") == [
        ("waste/bins/a/sensors", "{}", 21), ("waste/bins/a/sensors", "{}", 22)]


def test_times(spark, registry):
    """Empty times of any kind are 'now'; the listed text forms are read; others are refused."""
    now = ts("2024-01-01 00:00:00")
    got = classify(spark, registry, *[good(timestamp=t) for t in (
        0, 0.0, False, [], {}, "", None, "20251219T103000", "Dec 19 2025 10:30", "2025-12-19 10:30:00",
        5, True, [1], {"a": 1}, "2025", "soon")]).orderBy("arrival_seq").collect()
    assert [r["timestamp"] for r in got[:10]] == [now] * 7 + [ts("2025-12-19 10:30:00")] * 3
    assert [r["reason"] for r in got] == [None] * 10 + ["bad_value"] * 6


def test_a_repeated_sensor_code_gives_one_reading(spark, registry):
    sensors, bins = registry
    twice = sensors.unionByName(table(spark, "sensors", {"sensor_id": 4, "sensor_code": "S11", "bin_id": 3}))
    got = classify_messages(messages(spark, good()), twice, bins).collect()
    assert [(r["sensor_id"], r["bin_id"]) for r in got] == [(4, 2)]
