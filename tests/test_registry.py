"""Registry batches against a plain one-by-one model on small random batches."""

import random
import re

import pytest

from fleetgauge.operators import registry
from fleetgauge.sources.tables import append_new
from tests.helpers import rows, table, ts

AS_OF = "2024-01-02 00:00:00"
MAC = re.compile("([0-9A-F]{2}:){5}[0-9A-F]{2}")


def item(seq, mac, name, bin_id, offset=0.0):
    return {"item_seq": seq, "mac_address": mac, "device_name": name, "bin_id": bin_id,
            "weight_offset": offset}


def mac(n, prefix="AA:BB:CC"):
    text = f"{n:06X}"
    return f"{prefix}:{text[:2]}:{text[2:4]}:{text[4:]}"


def base_code(name, m):
    kept = "".join(c if c.isascii() and (c.isalnum() or c in "-_") else "-" for c in name)
    return kept[:40].strip("-") or "MAC-" + m.replace(":", "")[-6:]


def register_one_by_one(items, sensors, active):
    """What registering each item in turn gives: outcome per item, and the devices."""
    devices = {s["mac_address"]: dict(s) for s in sensors if s.get("mac_address")}
    codes = {s["sensor_code"] for s in sensors}
    out = {}
    for it in sorted(items, key=lambda i: i["item_seq"]):
        m = it["mac_address"].strip().upper()
        name = it["device_name"].strip() or m
        if not MAC.fullmatch(m):
            out[it["item_seq"]] = ("invalid_mac", None)
        elif it["bin_id"] not in active:
            out[it["item_seq"]] = ("unknown_bin", None)
        elif m in devices:
            devices[m].update(bin_id=it["bin_id"], manufacturer=name, weight_offset=it["weight_offset"])
            out[it["item_seq"]] = ("updated", None)
        else:
            code = base_code(name, m)
            if code in codes:
                code = code[:36] + "-" + m.replace(":", "")[-4:]
            if code in codes:
                out[it["item_seq"]] = ("sensor_code_taken", None)
                continue
            codes.add(code)
            devices[m] = {"sensor_code": code, "bin_id": it["bin_id"], "manufacturer": name,
                          "weight_offset": it["weight_offset"], "mac_address": m}
            out[it["item_seq"]] = ("created", code)
    return out, devices


def registered(spark, items, sensors, bins):
    return registry.register_devices(table(spark, "DEVICE_ITEMS", *items),
                                     table(spark, "sensors", *sensors), bins, AS_OF, model="M1")


@pytest.fixture(scope="module")
def bins(spark):
    return table(spark, "waste_bins", *[
        {"bin_id": i, "bin_code": f"B{i}", "status": "inactive" if i == 9 else "active"}
        for i in range(1, 10)])


def check_against_model(spark, bins, items, sensors):
    change = registered(spark, items, sensors, bins)
    expected, devices = register_one_by_one(items, sensors, set(range(1, 9)))
    got = {r["item_seq"]: (r["action"], r["sensor_code"]) for r in change.results.collect()}
    got.update({r["item_seq"]: (r["error"], None) for r in change.errors.collect()})
    assert got == expected
    snapshot = change.snapshot.collect()
    assert {(r["mac_address"], r["sensor_code"], r["bin_id"], r["manufacturer"], r["weight_offset"])
            for r in snapshot if r["mac_address"]} == {
        (m, d["sensor_code"], d["bin_id"], d["manufacturer"], d["weight_offset"])
        for m, d in devices.items()}
    assert len({r["sensor_code"] for r in snapshot}) == len(snapshot)
    assert len({r["sensor_id"] for r in snapshot}) == len(snapshot)


SENSORS = [
    {"sensor_id": 1, "sensor_code": "Scale", "mac_address": mac(1), "manufacturer": "old",
     "bin_id": 1, "weight_offset": 0.5},
    {"sensor_id": 2, "sensor_code": "Scale-0007", "mac_address": None, "manufacturer": "x",
     "bin_id": 2, "weight_offset": 0.0},
    {"sensor_id": 5, "sensor_code": "free", "mac_address": mac(2), "manufacturer": "y",
     "bin_id": 3, "weight_offset": 0.0}]


def test_register_cases(spark, bins):
    check_against_model(spark, bins, [
        item(1, f" {mac(20).lower()} ", " New ", 1), item(2, mac(1), "renamed", 2, 1.5),
        item(3, mac(21), "Twice", 1), item(4, mac(21), "Twice again", 2, 0.25),
        item(5, "nope", "n", 1), item(6, mac(22), "n", 9), item(7, mac(23), "n", 77),
        item(8, mac(24), "  ", 1), item(9, mac(25), "Scale OT/01 -", 1), item(10, mac(26), "///", 1),
        item(11, mac(27), "Same", 1), item(12, mac(28), "Same", 1),
        item(13, mac(29), "Scale", 1),          # code in use: suffixed
        item(14, mac(7), "Scale", 1),           # suffixed code in use too: error
        item(15, mac(7), "Other", 1),
        item(16, mac(0x10001D), "Same", 1)], SENSORS)


def test_register_suffix_meets_a_base_code(spark, bins):
    # The second "Dup" becomes "Dup-0033", which a later device has as its own name.
    check_against_model(spark, bins, [
        item(1, mac(0x32), "Dup", 1), item(2, mac(0x33), "Dup", 1), item(3, mac(0x34), "Dup-0033", 1)], [])
    # Asked for in the other order, the plain name keeps it.
    check_against_model(spark, bins, [
        item(1, mac(0x34), "Dup-0033", 1), item(2, mac(0x32), "Dup", 1), item(3, mac(0x33), "Dup", 1)], [])


def test_register_chain_of_codes(spark, bins):
    # Each device after the first pair is named like the suffixed code of the one before.
    items = [item(1, mac(1, "AA:BB:CE"), "Chain", 1), item(2, mac(2, "AA:BB:CE"), "Chain", 1)]
    name = "Chain"
    for n in range(3, 9):
        name = name[:36] + f"-{n - 1:04X}"
        items.append(item(n, mac(n, "AA:BB:CE"), name, 1))
    check_against_model(spark, bins, items, [])


def test_register_later_item_of_a_failed_mac(spark, bins):
    m = mac(1, "AA:BB:CE")
    used = [{"sensor_id": 1, "sensor_code": "X"}, {"sensor_id": 2, "sensor_code": "X-0001"}]
    check_against_model(spark, bins, [item(1, m, "X", 1), item(2, m, "Good", 2), item(3, m, "X", 3)], used)


def update_one_by_one(items, sensors, bin_ids):
    held, out, final = {s["sensor_id"]: s.get("mac_address") for s in sensors}, {}, {}
    for seq, device, m, name, bin_id, _ in sorted(items):
        m = m.strip().upper()
        if not MAC.fullmatch(m):
            out[seq] = "invalid_mac"
        elif device not in held:
            out[seq] = "not_found"
        elif any(x == m and d != device for d, x in held.items()):
            out[seq] = "mac_in_use"
        elif bin_id not in bin_ids:
            out[seq] = "unknown_bin"
        else:
            out[seq], held[device], final[device] = "updated", m, (name.strip(), bin_id)
    return out, held, final


def check_updates(spark, bins, items, sensors):
    frame = spark.createDataFrame(items, "item_seq int, sensor_id int, mac_address string, "
                                         "device_name string, bin_id int, weight_offset double")
    change = registry.update_devices(frame, table(spark, "sensors", *sensors), bins, AS_OF)
    out, held, final = update_one_by_one(items, sensors, set(range(1, 10)))
    got = {r["item_seq"]: r["action"] for r in change.results.collect()}
    got.update({r["item_seq"]: r["error"] for r in change.errors.collect()})
    assert got == out
    snapshot = {r["sensor_id"]: r for r in change.snapshot.collect()}
    assert {d: r["mac_address"] for d, r in snapshot.items()} == held
    assert all((snapshot[d]["manufacturer"], snapshot[d]["bin_id"]) == f for d, f in final.items())


def test_update_hands_a_mac_over(spark, bins):
    sensors = [{"sensor_id": i, "sensor_code": f"S{i}", "mac_address": mac(i)} for i in (1, 2, 3)]
    check_updates(spark, bins, [update(1, 1, mac(50)), update(2, 2, mac(1)), update(3, 3, mac(2)),
                                update(4, 1, mac(3)), update(5, 1, mac(2)), update(6, 3, mac(2))], sensors)


@pytest.mark.parametrize("seed", range(6))
def test_update_random(spark, bins, seed):
    rng = random.Random(seed)
    sensors = [{"sensor_id": i, "sensor_code": f"S{i}", "mac_address": mac(i) if i % 3 else None}
               for i in range(1, 7)]
    check_updates(spark, bins, [update(n, rng.randint(1, 8), mac(rng.randint(1, 9)), rng.randint(1, 11))
                                for n in range(1, 25)], sensors)


@pytest.mark.parametrize("seed", range(1, 9))
def test_register_random(spark, bins, seed):
    rng = random.Random(seed)
    names = ["Scale", "Scale", "free", "a b", "///", "", "Unit", "Unit-0005", "Unit-0005-0007",
             "Scale-0003", "x" * 45]
    items = [item(i + 1, mac(rng.randint(1, 14), rng.choice(["AA:BB:CC", "AA:BB:CD"]))
                  if rng.random() > .1 else "bad", rng.choice(names), rng.randint(1, 10),
                  rng.choice([0.0, 0.5])) for i in range(40)]
    check_against_model(spark, bins, items, SENSORS)


def test_new_rows_carry_the_defaults(spark, bins):
    change = registered(spark, [item(3, mac(40), "N", 1)], SENSORS, bins)
    new = change.snapshot.filter("sensor_code = 'N'").first()
    assert (new["sensor_id"], new["sensor_type"], new["model"], new["status"], new["updated_at"],
            new["created_at"], new["installed_date"], new["last_calibration"]) == (
        8, "weight_scale", "M1", "active", ts(AS_OF), ts(AS_OF), ts(AS_OF), None)
    untouched = change.snapshot.filter("sensor_id = 2").first()
    assert untouched["updated_at"] is None


def test_form_rows(spark):
    df = table(spark, "DEVICE_ITEMS", item(1, " aabb-cc.ddeeff00", " ", 3, None), item(2, "x", "n", None, 2.0))
    assert rows(registry.form_rows(df), "item_seq", "mac_address", "device_name", "bin_id",
                "weight_offset", "mac_ok", "bin_ok") == [
        (1, "AA:BB:CC:DD:EE:FF", "AA:BB:CC:DD:EE:FF", 3, 0.0, True, True),
        (2, "", "n", 0, 2.0, False, False)]


def update(seq, sensor_id, m, bin_id=1):
    return (seq, sensor_id, m, f" name{seq} ", bin_id, 0.75)


def test_update(spark, bins):
    updates = spark.createDataFrame([
        update(1, 1, "bad"), update(2, 99, mac(50)), update(3, 1, mac(2)),   # held by sensor 5
        update(4, 5, mac(2), 9),                                             # its own MAC
        update(5, 2, mac(60), 77), update(6, 1, mac(61)), update(7, 1, mac(62)),
        update(8, 2, mac(62))],                                              # asked for by 1 before
        "item_seq int, sensor_id int, mac_address string, device_name string, bin_id int, weight_offset double")
    change = registry.update_devices(updates, table(spark, "sensors", *SENSORS), bins, AS_OF)
    assert rows(change.results, "item_seq", "sensor_id") == [(4, 5), (6, 1), (7, 1)]
    assert rows(change.errors, "item_seq", "error") == [
        (1, "invalid_mac"), (2, "not_found"), (3, "mac_in_use"), (5, "unknown_bin"), (8, "mac_in_use")]
    assert rows(change.snapshot, "sensor_id", "mac_address", "manufacturer", "bin_id", "sensor_code", "updated_at") == [
        (1, mac(62), "name7", 1, "Scale", ts(AS_OF)), (2, None, "x", 2, "Scale-0007", None),
        (5, mac(2), "name4", 9, "free", ts(AS_OF))]


def test_delete(spark):
    sensors = table(spark, "sensors", *SENSORS)
    readings = table(spark, "sensor_readings", {"reading_id": 1, "sensor_id": 1}, {"reading_id": 2, "sensor_id": 77})
    ids = spark.createDataFrame([(1,), (5,), (77,), (1,)], "sensor_id int")
    change = registry.delete_devices(ids, sensors, readings, AS_OF)
    assert rows(change.results, "sensor_id", "action") == [(1, "cleared"), (5, "deleted")]
    assert rows(change.errors, "sensor_id", "error") == [(77, "not_found")]
    assert rows(change.snapshot, "sensor_id", "mac_address", "updated_at", "sensor_code") == [
        (1, None, ts(AS_OF), "Scale"), (2, None, None, "Scale-0007")]


def test_deleted_devices_meet_their_readings_without_a_join(spark):
    sensors = table(spark, "sensors", *SENSORS, {"sensor_code": "no id"})
    readings = table(spark, "sensor_readings", {"reading_id": 1, "sensor_id": 2}, {"reading_id": 2})
    ids = spark.createDataFrame([(2,), (None,), (2,), (78,)], "sensor_id long")
    change = registry.delete_devices(ids, sensors, readings, AS_OF)
    assert rows(change.results, "sensor_id", "action") == [(2, "cleared")]
    assert rows(change.errors, "sensor_id", "error") == [(78, "not_found"), (None, "not_found")]
    assert change.results.schema["sensor_id"].dataType == ids.schema["sensor_id"].dataType
    assert "Join" not in change.results._jdf.queryExecution().executedPlan().toString()


def test_cascade(spark, bins):
    tables = {
        "waste_bins": bins, "sensors": table(spark, "sensors", *SENSORS),
        "sensor_readings": table(spark, "sensor_readings", {"reading_id": 1, "sensor_id": 1, "bin_id": 4},
                                 {"reading_id": 2, "sensor_id": 2, "bin_id": 1}, {"reading_id": 3, "sensor_id": 5, "bin_id": 4},
                                 {"reading_id": 4}),
        "collections": table(spark, "collections", {"collection_id": 1, "bin_id": 1}),
        "alerts": table(spark, "alerts", {"alert_id": 1, "bin_id": 2})}
    result = registry.delete_bins(tables, spark.createDataFrame([(1,), (1,)], "bin_id int"))
    counts = {r["table_name"]: (r["rows_before"], r["rows_kept"]) for r in result.counts.collect()}
    assert counts == {"waste_bins": (9, 8), "sensors": (3, 2), "sensor_readings": (4, 2),
                      "collections": (1, 0), "alerts": (1, 1)}
    for name, (_, kept) in counts.items():
        assert result.kept[name].count() == kept
    assert rows(result.kept["sensor_readings"], "reading_id") == [(3,), (4,)]
    sensors, readings = registry.delete_sensors(
        tables["sensors"], tables["sensor_readings"], spark.createDataFrame([(5,)], "sensor_id int"))
    assert (sensors.count(), rows(readings, "reading_id")) == (2, [(1,), (2,), (4,)])


def test_seed_skips_existing_keys(spark):
    incoming = spark.createDataFrame(
        [(1, "BIN001", "A"), (2, "BIN002", "B"), (3, "BIN002", "C")], "item_seq int, bin_code string, location string")
    existing = table(spark, "waste_bins", {"bin_id": 4, "bin_code": "BIN001"})
    got = append_new(incoming, existing, "waste_bins", "bin_code", "bin_id", AS_OF)
    assert rows(got, "bin_id", "bin_code", "location", "status", "created_at") == [
        (6, "BIN002", "B", "active", ts(AS_OF))]
    first = append_new(incoming, existing.limit(0), "waste_bins", "bin_code", "bin_id", AS_OF)
    assert rows(first, "bin_id") == [(1,), (2,)]
