"""Telemetry payloads: JSON text to typed fields, with a reason where that fails.

The payload is read in one pass into a struct of variants. A variant tells apart what a
typed field cannot: a key that is missing, an explicit null, a number, and a string that
looks like one. Of repeated keys the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetgauge.functions.identity import canonical_mac
from fleetgauge.plans.keyed import computed_once
from fleetgauge.sources.messages import subscribed

# The fields that must be numbers when present, and those that may also be numeric text.
GATED = {"fill_level": "decimal(5,2)", "temperature_c": "decimal(5,2)",
         "battery_level": "decimal(5,2)"}
LENIENT = {"distance_cm": "decimal(6,2)", "humidity": "decimal(5,2)", "gas_level": "decimal(5,2)"}
TAGGED = ("bin_id", "weight_kg", "signal_strength", "timestamp", "mac_address", "sensor_code",
          *GATED, *LENIENT)
# Wide enough for every digit a payload weight can have.
WEIGHT = "decimal(38,18)"
FIELDS = "array<struct<" + ", ".join(f"{n}: variant" for n in (*TAGGED, "bin_code")) + ">>"
# In brackets the parser has to reach the end of the text, so text after the object is
# an error; a closing bracket of the payload's own is caught by its last character.
_OBJECTS = f"from_json(concat('[', payload, ']'), '{FIELDS}', map('allowSingleQuotes', 'false'))"
_IS_OBJECT = ("size(_objects) = 1 AND _objects[0] IS NOT NULL "
              "AND endswith(btrim(payload, ' \\t\\r\\n'), '}')")


def _value(name: str, kind: str) -> str:
    return f"try_cast(_fields.{name} AS {kind})"


def _kind(name: str) -> Column:
    """missing, null, number, string, boolean or other."""
    tag = f"schema_of_variant(_fields.{name})"
    return F.expr(f"""CASE WHEN {tag} IS NULL THEN 'missing' WHEN {tag} = 'VOID' THEN 'null'
        WHEN {tag} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {tag} LIKE 'DECIMAL%' THEN 'number'
        WHEN {tag} = 'STRING' THEN 'string' WHEN {tag} = 'BOOLEAN' THEN 'boolean'
        ELSE 'other' END""")


def _stored(name: str, target: str) -> Column:
    """Numbers and numeric text; anything else is NULL and caught as misfit."""
    return F.expr(f"""CASE _k_{name} WHEN 'number' THEN try_cast({_value(name, 'double')} AS {target})
        WHEN 'string' THEN try_cast({_value(name, 'string')} AS {target}) END""")


# Whole numbers are taken as they are, others lose their fraction; text must be whole.
_BIN_ID = f"""CASE _k_bin_id
    WHEN 'string' THEN try_cast({_value('bin_id', 'string')} AS int)
    WHEN 'number' THEN try_cast({_value('bin_id', 'double')} AS int)
    WHEN 'boolean' THEN CAST({_value('bin_id', 'boolean')} AS int) END"""
_WEIGHT = f"""CASE _k_weight_kg
    WHEN 'number' THEN try_cast({_value('weight_kg', 'double')} AS {WEIGHT})
    WHEN 'string' THEN try_cast({_value('weight_kg', 'string')} AS {WEIGHT})
    WHEN 'boolean' THEN CAST(CAST({_value('weight_kg', 'boolean')} AS int) AS {WEIGHT}) END"""
_SIGNAL = f"""CASE _k_signal_strength
    WHEN 'number' THEN try_cast({_value('signal_strength', 'decimal(20,0)')} AS int)
    WHEN 'string' THEN try_cast({_value('signal_strength', 'string')} AS int) END"""
# An empty time of any kind counts as missing: "", 0, false, [], {}. Texts are ISO dates and
# times, with or without a zone that is not looked at; the basic form 20251219T103000; or
# Dec 19 2025 10:30. A year or a month alone is no time: there must be a second dash, before
# the day.
_TIME_TEXT = _value("timestamp", "string")
_EMPTY_TIME = f"""(_k_timestamp = 'number' AND {_value('timestamp', 'double')} = 0)
    OR (_k_timestamp = 'boolean' AND NOT {_value('timestamp', 'boolean')})
    OR (_k_timestamp = 'other' AND to_json(_fields.timestamp) IN ('[]', '{{}}'))"""
_TIME = f"""CASE WHEN _k_timestamp IN ('missing', 'null') OR {_EMPTY_TIME} THEN arrival_ts
    WHEN _k_timestamp <> 'string' THEN NULL
    WHEN {_TIME_TEXT} = '' THEN arrival_ts
    WHEN locate('-', ltrim({_TIME_TEXT}), 6) > 0 THEN try_cast({_TIME_TEXT} AS timestamp_ntz)
    ELSE CAST(coalesce(try_to_timestamp({_TIME_TEXT}, "yyyyMMdd'T'HHmmss"),
                       try_to_timestamp({_TIME_TEXT}, 'MMM d yyyy HH:mm')) AS timestamp_ntz) END"""

_BAD_GATE = " OR ".join(f"_k_{n} NOT IN ('missing', 'number')" for n in GATED)
_MISFIT = " OR ".join(
    [f"(_k_{n} = 'number' AND try_cast(raw_{n} AS {t}) IS NULL)" for n, t in GATED.items()]
    + [f"(_k_{n} NOT IN ('missing', 'null') AND {n} IS NULL)" for n in (*LENIENT, "signal_strength")]
    + ["(_k_weight_kg NOT IN ('missing', 'null') AND raw_weight_kg IS NULL)", "timestamp IS NULL"])
_REASON = f"""CASE WHEN _fields IS NULL THEN 'malformed'
    WHEN {_BAD_GATE} THEN 'not_a_number'
    WHEN _k_mac_address NOT IN ('missing', 'string') THEN 'bad_mac'
    WHEN {_MISFIT} THEN 'bad_value' END"""


def decode_messages(messages: DataFrame) -> DataFrame:
    """Subscribed messages with their fields and ``reason``, NULL where all is well.

    Stored measures are rounded to their column; the ``raw_`` fields keep the payload's
    own numbers for the alert rules.
    """
    read = computed_once(subscribed(messages), {"_objects": F.expr(_OBJECTS)})
    parsed = computed_once(read, {"_fields": F.expr(f"IF({_IS_OBJECT}, _objects[0], NULL)")}).drop(
        "_objects")
    tagged = computed_once(parsed, {f"_k_{n}": _kind(n) for n in TAGGED})
    typed = computed_once(tagged, {
        "mac": canonical_mac(F.expr(
            f"CASE WHEN _k_mac_address = 'string' THEN {_value('mac_address', 'string')} END")),
        "sensor_code": F.expr(
            f"CASE WHEN _k_sensor_code = 'string' THEN {_value('sensor_code', 'string')} END"),
        "bin_code": F.expr(_value("bin_code", "string")),
        "payload_bin_id": F.expr(_BIN_ID),
        **{n: _stored(n, t) for n, t in LENIENT.items()},
        **{f"raw_{n}": F.expr(f"CASE WHEN _k_{n} = 'number' THEN {_value(n, 'double')} END")
           for n in GATED},
        "raw_weight_kg": F.expr(_WEIGHT), "signal_strength": F.expr(_SIGNAL),
        "timestamp": F.expr(_TIME)})
    return computed_once(typed, {
        **{n: F.expr(f"try_cast(raw_{n} AS {t})") for n, t in GATED.items()},
        "reason": F.expr(_REASON), "weight_is_boolean": F.expr("_k_weight_kg = 'boolean'")}).select(
        *messages.columns, "mac", "sensor_code", "bin_code", "payload_bin_id",
        *GATED, *LENIENT, *[f"raw_{n}" for n in GATED], "raw_weight_kg", "weight_is_boolean",
        "signal_strength", "timestamp", "reason")
