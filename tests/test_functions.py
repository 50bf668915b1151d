from pyspark.sql import functions as F

from fleetgauge.functions import identity, labels, levels, measures, times
from tests.helpers import dec, one, ts

AS_OF = "2024-05-03 12:00:00"


def test_fill_status_limits(spark):
    values = [dec(v) for v in (None, "0", "49.99", "50", "74.99", "75", "89.99", "90")]
    assert one(spark, levels.fill_status, values, "decimal(5,2)") == [
        "low", "low", "low", "medium", "medium", "high", "high", "critical"]


def test_fill_band(spark):
    values = [dec(v) for v in (None, "49.99", "50", "74.99", "75")]
    assert one(spark, levels.fill_band, values, "decimal(5,2)") == [
        "green", "green", "yellow", "yellow", "red"]


def test_compliance_limits(spark):
    values = [None, ts("2024-05-03 12:00:01"), ts("2024-05-03 11:58:01"), ts("2024-05-03 11:58:00"),
              ts("2024-05-03 11:58:00.000001"), ts("2024-05-02 12:00:01"), ts("2024-05-02 12:00:00"),
              ts("2024-05-01 12:00:01"), ts("2024-05-01 12:00:00")]
    got = one(spark, lambda c: levels.compliance_class(c, AS_OF), values, "timestamp_ntz")
    assert got == ["none", "good", "good", "medium", "good", "medium", "high", "high", "offline"]


def test_online(spark):
    values = [ts("2024-05-03 11:55:01"), ts("2024-05-03 11:55:00"), None]
    assert one(spark, lambda c: levels.is_online(c, AS_OF), values, "timestamp_ntz") == [True, False, False]


def test_relative_time(spark):
    values = [None, ts("2024-05-03 12:10:00"), ts("2024-05-03 11:59:01"), ts("2024-05-03 11:59:00"),
              ts("2024-05-03 11:00:01"), ts("2024-05-03 11:00:00"), ts("2024-05-02 12:00:01"),
              ts("2024-05-02 12:00:00"), ts("2024-04-29 13:00:00")]
    units = one(spark, lambda c: levels.relative_unit(c, AS_OF), values, "timestamp_ntz")
    counts = one(spark, lambda c: levels.relative_count(c, AS_OF), values, "timestamp_ntz")
    assert list(zip(units, counts))[1:] == [
        ("now", 0), ("now", 0), ("minute", 1), ("minute", 59), ("hour", 1), ("hour", 23),
        ("day", 1), ("day", 3)]
    assert units[0] is None and counts[0] is None


def test_ages_do_not_depend_on_the_session_zone(spark):
    # The night the clocks change in this zone: two naive times are still an hour apart.
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = one(spark, lambda c: levels.relative_count(c, "2024-03-10 04:30:00"),
                  [ts("2024-03-10 01:30:00")], "timestamp_ntz")
        assert got == [3]
        df = spark.createDataFrame([(ts("2024-03-10 02:15:00"), dec("1.00"))],
                                   "timestamp timestamp_ntz, fill_level decimal(5,2)")
        from fleetgauge.operators.timeline import hourly_fill
        assert hourly_fill(df).first()[0] == ts("2024-03-10 02:00:00")
        assert one(spark, times.zoned_text, [ts("2024-03-10 02:15:00")], "timestamp_ntz") == [
            "2024-03-10T02:15:00+07:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_zone_suffix(spark):
    values = [ts("2024-01-01 00:00:00"), ts("2024-01-01 00:00:00.12"), None]
    assert one(spark, times.zoned_text, values, "timestamp_ntz") == [
        "2024-01-01T00:00:00+07:00", "2024-01-01T00:00:00.120000+07:00", None]
    texts = ["2024-01-01T00:00:00", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00+02:00",
             "2024-01-01 00:00:00", "short"]
    assert one(spark, times.zoned_string, texts, "string") == [
        "2024-01-01T00:00:00+07:00", *texts[1:]]


def test_chart_label(spark):
    assert one(spark, lambda c: labels.chart_label(c, F.lit("B1")),
               ["x" * 14, "x" * 15, "", None], "string") == ["x" * 14, "x" * 13 + "…", "B1", "B1"]


def test_alert_type_label(spark):
    assert one(spark, labels.alert_type_label, ["bin_full", "maintenance_required"], "string") == [
        labels.ALERT_TYPE_LABELS["bin_full"], "maintenance required"]


def test_card_sub_text(spark):
    df = spark.createDataFrame(
        [(1, "good", dec("2.50"), dec("9.00")), (2, "good", None, dec("9.00")),
         (3, "medium", dec("2.50"), dec("9.00")), (4, "high", dec("0.00"), dec("0.00")),
         (5, "none", None, None)],
        "i int, cls string, w decimal(8,2), t decimal(18,2)")
    got = [r[0] for r in df.orderBy("i").select(
        labels.card_sub_text(F.col("cls"), F.col("w"), F.col("t"))).collect()]
    kg = labels.KILOGRAMS
    assert got == [f"⚖️ 2.50{kg}", labels.WEIGHING_NOW, f"วันนี้ 9.00{kg}", f"ล่าสุด 0.00{kg}", ""]


def test_mac_rules(spark):
    macs = [" aa:bb:cc:dd:ee:ff\t", "AA:BB:CC:DD:EE", "AA:BB:CC:DD:EE:FG", "AA:BB:CC:DD:EE:FF\nX", None]
    assert one(spark, lambda c: identity.is_mac(identity.canonical_mac(c)), macs, "string") == [
        True, False, False, False, False]
    assert one(spark, identity.mac_from_hex, ["aabb-ccddeeff00", "a1b", "zz", ""], "string") == [
        "AA:BB:CC:DD:EE:FF", "A1:B", "", ""]


def test_device_code(spark):
    mac = F.lit("AA:BB:CC:DD:EE:FF")
    names = ["Scale OT/01 -", "///", "ก", "a" * 50, "x_y-z"]
    assert one(spark, lambda c: identity.device_code(c, mac), names, "string") == [
        "Scale-OT-01", "MAC-DDEEFF", "MAC-DDEEFF", "a" * 40, "x_y-z"]
    assert one(spark, lambda c: identity.suffixed_code(c, mac), ["a" * 40, "n"], "string") == [
        "a" * 36 + "-EEFF", "n-EEFF"]


def test_calibration(spark):
    df = spark.createDataFrame([(1, None, -0.25), (2, dec("1.0"), 0.0), (3, dec("1.0"), -0.25),
                                (4, dec("1.0"), None), (5, dec("1.004"), 0.001)],
                               "i int, w decimal(28,10), o double")
    got = [r[0] for r in df.orderBy("i").select(
        measures.calibrated(F.col("w"), F.col("o"))).collect()]
    assert got == [None, dec("1.00"), dec("0.75"), dec("1.00"), dec("1.01")]


def test_sums_hold_beyond_the_column_range(spark):
    # A decimal(5,2) column sums past 10^13 without overflow.
    df = spark.range(3).select(F.lit("999.99").cast("decimal(5,2)").alias("fill_level"))
    kind = df.agg(measures.total("fill_level").alias("t")).dtypes[0][1]
    assert kind == "decimal(18,2)"


def test_lookback_is_checked():
    import pytest
    for hours in (0, 169):
        with pytest.raises(ValueError):
            times.check_lookback(hours)
    assert times.check_lookback(168) == 168
