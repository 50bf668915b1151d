"""Report files byte by byte."""

from pathlib import Path

from fleetgauge.functions.labels import EXPORT_HEADERS
from fleetgauge.operators import export
from tests.helpers import dec, table, ts

ROWS = [
    # reading, minute, bin, location, weight, battery, signal, temperature, and the line
    (1, 1, "B1", "Ward, north", "12.50", "100.00", -70, "25.00", '"Ward, north",12.5,100,-70,25'),
    (2, 2, "B2", 'Say "hi"', "0.00", None, None, "-0.10", 'Say "hi",0,,,-0.1'),
    (3, 3, "B3", 'Both "a", b', None, "20.05", 0, None, '"Both "a", b",,20.05,0,'),
    (4, 4, "B4", "อาคาร เอ", "1000.00", "0.50", -5, "10.10", "อาคาร เอ,1000,0.5,-5,10.1"),
    (5, 5, "B5", None, None, None, None, None, "B5,,,,"),
]


def test_bytes_are_those_of_the_report(spark, tmp_path):
    bins = table(spark, "waste_bins", *[{"bin_id": i, "bin_code": code, "location": place, "status": "active"}
                                        for i, _, code, place, *_rest in ROWS])
    readings = table(spark, "sensor_readings", *[
        {"reading_id": i, "bin_id": i, "weight_kg": dec(w), "battery_level": dec(b), "signal_strength": s,
         "temperature_c": dec(t), "timestamp": ts(f"2024-01-02 10:0{m}:00" + (".250000" if m == 4 else ""))}
        for i, m, _, _, w, b, s, t, _ in ROWS]).repartition(3)
    report = export.export_report(readings, bins, "2024-01-01 00:00:00", "2024-01-03 00:00:00")
    path = tmp_path / "report"
    export.write_report_lines(report, str(path))
    got = b"".join(p.read_bytes() for p in sorted(Path(path).glob("part-*")))
    lines = [",".join(EXPORT_HEADERS.values())]
    for i, m, code, *_rest, tail in reversed(ROWS):  # the newest first
        lines.append(f"2024-01-02T10:0{m}:00{'.250000' if m == 4 else ''}+07:00,{code},{tail}")
    assert got == ("﻿" + "\n".join(lines) + "\n").encode()


def test_a_report_without_rows_is_its_header(spark, tmp_path):
    none = export.export_report(table(spark, "sensor_readings"), table(spark, "waste_bins"),
                                "2024-01-01 00:00:00", "2024-01-03 00:00:00")
    export.write_report_lines(none, str(tmp_path / "report"))
    got = b"".join(p.read_bytes() for p in sorted((tmp_path / "report").glob("part-*")))
    assert got == ("﻿" + ",".join(EXPORT_HEADERS.values()) + "\n").encode()
