"""SQL twins of the registered queries, for DuckDB over the same test tables."""

from __future__ import annotations

from fleetgauge.functions import labels
from fleetcheck import domain
from fleetcheck.domain import (ALERTS_AS_OF, COLLECTIONS_AS_OF, READINGS_AS_OF,
                                       SOURCE_TABLES)

_VIEWS = {
    "waste_bins": domain.WASTE_BINS, "sensor_readings": domain.SENSOR_READINGS,
    "sensors": domain.SENSORS, "alerts": domain.ALERTS, "collections": domain.COLLECTIONS,
    "messages": domain.MESSAGES, "collection_routes": domain.COLLECTION_ROUTES,
    "route_bins": domain.ROUTE_BINS, "device_items": domain.DEVICE_ITEMS,
    "sensor_states": domain.SENSOR_STATES, "bin_states": domain.BIN_STATES,
    "device_updates": domain.DEVICE_UPDATES, "seed_sensors": domain.SEED_SENSORS,
}
_PLAIN = {name: name for name in SOURCE_TABLES}
_NOW = f"TIMESTAMP '{READINGS_AS_OF}'"


_NATION_NAME = "(SELECT n_name FROM nation n WHERE n.n_nationkey = c.c_nationkey)"


def _with(views: str, *steps: str) -> str:
    """``views`` (blank-separated names) as CTEs, further named steps, then the query."""
    ctes = [f"{v} AS ({_VIEWS[v].format(**_PLAIN).replace('{nation_name}', _NATION_NAME)})" for v in views.split()]
    return "WITH RECURSIVE " + ",\n".join([*ctes, *steps[:-1]]) + "\n" + steps[-1]


def _case(column: str, texts: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items())
    return f"CASE {column} {arms} ELSE {default} END"


def _mean(column: str) -> str:
    return f"round(CAST(sum({column}) AS DOUBLE) / count({column}), 6)"


_FILL_STATUS = ("CASE WHEN fill_level >= 90 THEN 'critical' WHEN fill_level >= 75 THEN 'high' "
                "WHEN fill_level >= 50 THEN 'medium' ELSE 'low' END")
_CLASS = (f"CASE WHEN last_reading IS NULL THEN 'none' "
          f"WHEN last_reading > {_NOW} - INTERVAL 2 MINUTE THEN 'good' "
          f"WHEN last_reading > {_NOW} - INTERVAL 24 HOUR THEN 'medium' "
          f"WHEN last_reading > {_NOW} - INTERVAL 48 HOUR THEN 'high' ELSE 'offline' END")

_STATUS = f"""status AS (
  SELECT b.bin_id, b.bin_code, b.location, b.latitude, b.longitude, b.capacity, b.bin_type,
         b.status AS bin_status, r.fill_level, r.weight_kg, r.temperature_c, r.battery_level,
         r.signal_strength, r.timestamp AS last_reading, {_FILL_STATUS} AS fill_status,
         (SELECT count(*) FROM alerts a WHERE a.bin_id = b.bin_id AND a.status = 'open') AS open_alerts
  FROM waste_bins b LEFT JOIN (
    SELECT * FROM sensor_readings
    QUALIFY row_number() OVER (PARTITION BY bin_id ORDER BY timestamp DESC, reading_id DESC) = 1
  ) r ON r.bin_id = b.bin_id)"""
_STATUS_VIEWS = "waste_bins sensor_readings alerts"
_ACTIVE = f"active AS (SELECT *, {_CLASS} AS card_status FROM status WHERE bin_status = 'active')"
_DAILY = f"""daily AS (
  SELECT b.bin_id, b.bin_code, b.location,
         CAST(coalesce(sum(r.weight_kg), 0) AS DECIMAL(18,2)) AS total_weight_today,
         count(r.reading_id) AS reading_count_today, max(r.timestamp) AS last_reading_today
  FROM waste_bins b LEFT JOIN sensor_readings r
    ON r.bin_id = b.bin_id AND r.timestamp >= {_NOW} - INTERVAL 24 HOUR AND r.weight_kg > 0
  WHERE b.status = 'active' GROUP BY ALL)"""
_RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bin_id ORDER BY timestamp DESC, reading_id DESC) AS rank
  FROM sensor_readings)"""
_PICKED = """picked AS (
  SELECT *, row_number() OVER (PARTITION BY bin_id ORDER BY collection_time DESC,
         collection_id DESC, tie_part DESC, tie_price DESC) AS rank
  FROM collections)"""
_DEVICES = """devices AS (
  SELECT s.sensor_id, s.sensor_code, s.mac_address, s.manufacturer AS device_name, s.weight_offset,
         s.status, s.bin_id, b.bin_code, b.location,
         (SELECT max(r.timestamp) FROM sensor_readings r WHERE r.sensor_id = s.sensor_id) AS last_seen
  FROM sensors s LEFT JOIN waste_bins b ON b.bin_id = s.bin_id)"""

_KG = f"|| '{labels.KILOGRAMS}'"
_CARDS = f"""SELECT a.bin_id, a.bin_code, a.location, a.card_status,
  {_case('a.card_status', labels.COMPLIANCE_LABELS, 'a.card_status')} AS card_label,
  CASE WHEN a.card_status = 'good' THEN coalesce('{labels.WEIGHED}' || CAST(a.weight_kg AS VARCHAR) {_KG}, '{labels.WEIGHING_NOW}')
       WHEN d.total_weight_today > 0 THEN '{labels.TODAY}' || CAST(d.total_weight_today AS VARCHAR) {_KG}
       WHEN a.weight_kg IS NOT NULL THEN '{labels.LATEST}' || CAST(a.weight_kg AS VARCHAR) {_KG}
       ELSE '' END AS sub_text
FROM active a LEFT JOIN daily d ON d.bin_id = a.bin_id"""

# The payload gate, the two lookups and the checks, step by step as the rules read.
_FIELD_TYPE = ("CASE WHEN json_valid(payload) THEN "
               "coalesce(json_type(payload, '$.{0}'), 'MISSING') END")
_NUMERIC = "('DOUBLE', 'BIGINT', 'UBIGINT', 'MISSING')"
_CLASSIFIED = f"""heard AS (
  SELECT *, json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT' AS is_object,
         {_FIELD_TYPE.format('fill_level')} AS fill_type,
         {_FIELD_TYPE.format('temperature_c')} AS heat_type,
         {_FIELD_TYPE.format('battery_level')} AS battery_type,
         CASE WHEN json_valid(payload) THEN payload END AS doc
  FROM messages WHERE regexp_full_match(topic, 'waste/bins/[^/]*/sensors')),
gated AS (
  SELECT *, coalesce(is_object, false) AS object_ok,
         coalesce(fill_type IN {_NUMERIC} AND heat_type IN {_NUMERIC} AND battery_type IN {_NUMERIC}, false) AS numbers_ok,
         upper(trim(json_extract_string(doc, '$.mac_address'))) AS mac,
         json_extract_string(doc, '$.sensor_code') AS code,
         json_extract_string(doc, '$.bin_code') AS bin_code,
         TRY_CAST(json_extract_string(doc, '$.bin_id') AS INT) AS payload_bin_id
  FROM heard),
looked AS (
  SELECT g.*, coalesce(m.sensor_id, c.sensor_id) AS sensor_id,
         CASE WHEN m.sensor_id IS NOT NULL THEN m.bin_id ELSE g.payload_bin_id END AS bin_id,
         CASE WHEN m.sensor_id IS NOT NULL THEN m.weight_offset ELSE c.weight_offset END AS weight_offset
  FROM gated g
  LEFT JOIN sensors m ON g.object_ok AND g.numbers_ok AND m.mac_address = g.mac
  LEFT JOIN sensors c ON g.object_ok AND g.numbers_ok AND m.sensor_id IS NULL AND c.sensor_code = g.code),
classified AS (
  SELECT l.*, CASE WHEN NOT object_ok THEN 'malformed' WHEN NOT numbers_ok THEN 'not_a_number'
                   WHEN sensor_id IS NULL THEN 'unknown_device' WHEN l.bin_id IS NULL THEN 'bad_bin'
                   WHEN b.bin_id IS NULL THEN 'unknown_bin' END AS reason,
         CAST(json_extract_string(doc, '$.weight_kg') AS DECIMAL(8,2)) AS raw_weight,
         coalesce(CASE WHEN numbers_ok THEN CAST(json_extract_string(doc, '$.fill_level') AS DECIMAL(28,10)) END, 0) AS fill,
         coalesce(CASE WHEN numbers_ok THEN CAST(json_extract_string(doc, '$.battery_level') AS DECIMAL(28,10)) END, 100) AS battery,
         coalesce(CASE WHEN numbers_ok THEN CAST(json_extract_string(doc, '$.temperature_c') AS DECIMAL(28,10)) END, 25) AS heat
  FROM looked l LEFT JOIN waste_bins b ON b.bin_id = l.bin_id)"""
_INGEST_VIEWS = "messages sensors waste_bins"
_AS_OF_VIEWS = "messages sensor_states bin_states"
# The same with the states at arrival: of several devices the lowest answers.
_SPANS = ["""sensor_spans AS (
  SELECT *, CAST(valid_from AS TIMESTAMP) AS since, coalesce(lead(CAST(valid_from AS TIMESTAMP)) OVER (
    PARTITION BY sensor_id ORDER BY valid_from), TIMESTAMP '9999-01-01') AS until FROM sensor_states)""",
          """bin_spans AS (
  SELECT *, CAST(valid_from AS TIMESTAMP) AS since, coalesce(lead(CAST(valid_from AS TIMESTAMP)) OVER (
    PARTITION BY bin_id ORDER BY valid_from), TIMESTAMP '9999-01-01') AS until FROM bin_states)"""]
_AT = "NOT {0}.removed AND g.arrival_ts >= {0}.since AND g.arrival_ts < {0}.until"


def _holder(column: str, value: str) -> str:
    return f"""(SELECT min(s.sensor_id) FROM sensor_spans s
    WHERE g.object_ok AND g.numbers_ok AND s.{column} = g.{value} AND {_AT.format("s")})"""


_LOOKED_AS_OF = f"""held AS (
  SELECT g.*, {_holder("mac_address", "mac")} AS by_mac, {_holder("sensor_code", "code")} AS by_code FROM gated g),
looked AS (
  SELECT g.*, coalesce(by_mac, by_code) AS sensor_id,
         CASE WHEN by_mac IS NOT NULL THEN s.bin_id ELSE g.payload_bin_id END AS bin_id, s.weight_offset
  FROM held g LEFT JOIN sensor_spans s ON s.sensor_id = coalesce(by_mac, by_code) AND {_AT.format("s")}),
"""
_CLASSIFIED_AS_OF = (
    _CLASSIFIED[:_CLASSIFIED.index("looked AS (")] + _LOOKED_AS_OF
    + _CLASSIFIED[_CLASSIFIED.index("classified AS ("):].replace(
        "FROM looked l LEFT JOIN waste_bins b ON b.bin_id = l.bin_id",
        "FROM looked l LEFT JOIN bin_spans b ON b.bin_id = l.bin_id AND " + _AT.replace("g.", "l.").format("b")))
_ACCEPTED = """SELECT arrival_seq AS reading_id, sensor_id, bin_id,
  CAST(json_extract_string(doc, '$.fill_level') AS DECIMAL(5,2)) AS fill_level,
  CAST(NULL AS DECIMAL(6,2)) AS distance_cm,
  CAST(CASE WHEN weight_offset <> 0 THEN raw_weight + CAST(weight_offset AS DECIMAL(8,2)) ELSE raw_weight END AS DECIMAL(8,2)) AS weight_kg,
  CAST(json_extract_string(doc, '$.temperature_c') AS DECIMAL(5,2)) AS temperature_c,
  CAST(NULL AS DECIMAL(5,2)) AS humidity, CAST(NULL AS DECIMAL(5,2)) AS gas_level,
  CAST(json_extract_string(doc, '$.battery_level') AS DECIMAL(5,2)) AS battery_level,
  CAST(json_extract_string(doc, '$.signal_strength') AS INT) AS signal_strength,
  CAST(substr(json_extract_string(doc, '$.timestamp'), 1, 19) AS TIMESTAMP) AS timestamp,
  arrival_ts AS created_at
FROM classified WHERE reason IS NULL"""
_HITS = """sound AS (
  SELECT * FROM classified WHERE reason IS NULL
    AND payload_bin_id IN (SELECT bin_id FROM waste_bins)),
hits AS (
  SELECT arrival_seq, arrival_ts, payload_bin_id AS bin_id, 0 AS rule, 'bin_full' AS alert_type,
         CASE WHEN fill >= 90 THEN 'critical' ELSE 'high' END AS severity,
         'Bin ' || bin_code || ' is ' || CAST(CAST(fill AS DECIMAL(9,1)) AS VARCHAR) ||
         CASE WHEN fill >= 90 THEN '% full - requires immediate collection' ELSE '% full - collection needed soon' END AS message
  FROM sound WHERE fill >= 75
  UNION ALL
  SELECT arrival_seq, arrival_ts, payload_bin_id, 1, 'sensor_fault', 'medium',
         'Low battery warning for ' || bin_code || ': ' || CAST(CAST(battery AS DECIMAL(9,1)) AS VARCHAR) || '%'
  FROM sound WHERE battery < 20
  UNION ALL
  SELECT arrival_seq, arrival_ts, payload_bin_id, 2, 'unusual_activity', 'high',
         'High temperature detected in ' || bin_code || ': ' || CAST(CAST(heat AS DECIMAL(9,1)) AS VARCHAR) || '°C'
  FROM sound WHERE heat > 45)"""
_ALERT_ROW = """SELECT arrival_seq * 4 + rule AS alert_id, bin_id, alert_type, severity, message,
  arrival_ts AS triggered_at, 'open' AS status"""
_DEDUPED = f"""{_ALERT_ROW} FROM (
  SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY bin_id, alert_type ORDER BY arrival_ts, arrival_seq) = 1) h
WHERE NOT EXISTS (SELECT 1 FROM alerts a WHERE a.status = 'open' AND a.bin_id = h.bin_id AND a.alert_type = h.alert_type)"""

# Three blocks of messages; before block k the alerts so far of the bins with bin_id % 3 = k close.
_BLOCKS = ("arrival_ts < TIMESTAMP '2024-01-11'",
           "arrival_ts >= TIMESTAMP '2024-01-11' AND arrival_ts < TIMESTAMP '2024-01-21'",
           "arrival_ts >= TIMESTAMP '2024-01-21'")
_REOPENED = ["""known AS (
  SELECT alert_id, bin_id, alert_type, severity, message, triggered_at, status, -1 AS batch_id
  FROM alerts WHERE status = 'open')"""]
for _k, _block in enumerate(_BLOCKS):
    _so_far = " UNION ALL ".join(["SELECT * FROM known", *(f"SELECT * FROM new{i}" for i in range(_k))])
    _REOPENED.append(f"""new{_k} AS (
  SELECT arrival_seq * 4 + rule AS alert_id, bin_id, alert_type, severity, message,
         arrival_ts AS triggered_at, 'open' AS status, {_k} AS batch_id
  FROM (SELECT * FROM hits WHERE {_block}
        QUALIFY row_number() OVER (PARTITION BY bin_id, alert_type ORDER BY arrival_ts, arrival_seq) = 1) h
  WHERE NOT EXISTS (SELECT 1 FROM ({_so_far}) a WHERE a.bin_id = h.bin_id AND a.alert_type = h.alert_type
                    AND NOT (a.bin_id % 3 = 1 AND a.batch_id < 1 AND {_k} >= 1)
                    AND NOT (a.bin_id % 3 = 2 AND a.batch_id < 2 AND {_k} >= 2)))""")
_REOPENED.append("""SELECT alert_id, bin_id, alert_type, severity, message, triggered_at,
  CASE WHEN bin_id % 3 = 1 AND batch_id < 1 THEN 'resolved'
       WHEN bin_id % 3 = 2 AND batch_id < 2 THEN 'false_alarm' ELSE status END AS status,
  CAST(batch_id AS BIGINT) AS batch_id
FROM (SELECT * FROM new0 UNION ALL SELECT * FROM new1 UNION ALL SELECT * FROM new2)""")

_EXPORT = """export AS (
  SELECT r.reading_id, r.timestamp, b.bin_code,
         CASE WHEN b.status = 'active' AND b.location <> '' THEN b.location ELSE b.bin_code END AS department,
         r.weight_kg, r.battery_level, r.signal_strength, r.temperature_c
  FROM sensor_readings r LEFT JOIN waste_bins b ON b.bin_id = r.bin_id
  WHERE r.timestamp BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-30 23:59:00')"""



def _quoted(column: str) -> str:
    return f"coalesce(CASE WHEN {column} LIKE '%,%' THEN '\"' || {column} || '\"' ELSE {column} END, '')"


def _number(column: str) -> str:
    return f"coalesce(rtrim(rtrim(CAST({column} AS VARCHAR), '0'), '.'), '')"


# Registration: good items, what becomes of each MAC, and the codes of new devices. A
# device whose base code is taken gets its suffixed code unless that is taken as well.
_REGISTER = r"""asked AS (
  SELECT item_seq, upper(trim(mac_address)) AS mac, bin_id, weight_offset,
         coalesce(nullif(trim(device_name), ''), upper(trim(mac_address))) AS name FROM device_items),
checked AS (
  SELECT a.*, b.bin_code, s.sensor_id AS known_id,
         CASE WHEN NOT regexp_full_match(a.mac, '([0-9A-F]{2}:){5}[0-9A-F]{2}') THEN 'invalid_mac'
              WHEN b.bin_id IS NULL THEN 'unknown_bin' END AS error
  FROM asked a LEFT JOIN waste_bins b ON b.bin_id = a.bin_id AND b.status = 'active'
  LEFT JOIN sensors s ON s.mac_address = a.mac),
good AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY item_seq) AS k,
         coalesce(nullif(trim(substr(regexp_replace(name, '[^A-Za-z0-9\-_]', '-', 'g'), 1, 40), '-'), ''),
                  'MAC-' || right(replace(mac, ':', ''), 6)) AS base
  FROM checked WHERE error IS NULL),
-- One item at a time: the codes and MACs that exist by then.
steps AS (
  SELECT CAST(0 AS BIGINT) AS k, (SELECT list(sensor_code) FROM sensors) AS codes,
         (SELECT list(mac_address) FROM sensors WHERE mac_address IS NOT NULL) AS macs,
         CAST(NULL AS VARCHAR) AS sensor_code, CAST(NULL AS VARCHAR) AS action
  UNION ALL
  SELECT k, CASE WHEN action = 'created' THEN list_append(codes, code) ELSE codes END,
         CASE WHEN action = 'created' THEN list_append(macs, mac) ELSE macs END,
         CASE WHEN action = 'created' THEN code END, action
  FROM (SELECT g.k, s.codes, s.macs, g.mac, c.code,
               CASE WHEN list_contains(s.macs, g.mac) THEN 'updated' WHEN c.code IS NOT NULL THEN 'created' END AS action
        FROM steps s JOIN good g ON g.k = s.k + 1,
        LATERAL (SELECT CASE WHEN NOT list_contains(s.codes, g.base) THEN g.base
          WHEN NOT list_contains(s.codes, substr(g.base, 1, 36) || '-' || right(replace(g.mac, ':', ''), 4))
          THEN substr(g.base, 1, 36) || '-' || right(replace(g.mac, ':', ''), 4) END AS code) c)),
outcome AS (SELECT g.*, s.sensor_code, s.action FROM good g JOIN steps s ON s.k = g.k),
coded AS (SELECT mac, item_seq, sensor_code FROM outcome WHERE action = 'created')"""
_REGISTER_VIEWS = "device_items sensors waste_bins"
_FINAL = """final AS (SELECT mac, bin_id, name, weight_offset FROM outcome WHERE action IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY mac ORDER BY item_seq DESC) = 1)"""

_UPDATE = """asked AS (
  SELECT item_seq, sensor_id, upper(trim(mac_address)) AS mac, trim(device_name) AS name, bin_id,
         weight_offset FROM device_updates),
checked AS (
  SELECT a.*, CASE WHEN NOT regexp_full_match(mac, '([0-9A-F]{2}:){5}[0-9A-F]{2}') THEN 'invalid_mac'
    WHEN NOT EXISTS (SELECT 1 FROM sensors s WHERE s.sensor_id = a.sensor_id) THEN 'not_found'
    END AS error
  FROM asked a),
good AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY item_seq) AS k,
                bin_id IN (SELECT bin_id FROM waste_bins) AS bin_ok FROM checked WHERE error IS NULL),
-- One item at a time: which MAC each device holds by then, as lists side by side.
steps AS (
  SELECT CAST(0 AS BIGINT) AS k, (SELECT list(sensor_id ORDER BY sensor_id) FROM sensors) AS ids,
         (SELECT list(mac_address ORDER BY sensor_id) FROM sensors) AS macs, CAST(NULL AS VARCHAR) AS error
  UNION ALL
  SELECT k, ids, CASE WHEN error IS NULL THEN list_concat(list_concat(macs[1:pos - 1], [mac]), macs[pos + 1:len(macs)]) ELSE macs END, error
  FROM (SELECT g.k, s.ids, s.macs, g.mac, list_position(s.ids, g.sensor_id) AS pos,
               CASE WHEN len(list_filter(list_zip(s.ids, s.macs), lambda x: x[2] = g.mac AND x[1] <> g.sensor_id)) > 0 THEN 'mac_in_use'
                    WHEN NOT g.bin_ok THEN 'unknown_bin' END AS error
        FROM steps s JOIN good g ON g.k = s.k + 1)),
settled AS (SELECT g.* EXCLUDE (error), s.error FROM good g JOIN steps s ON s.k = g.k)"""
_UPDATE_VIEWS = "device_updates sensors waste_bins"

_DELETE = """asked AS (SELECT bin_id AS sensor_id FROM waste_bins),
outcome AS (
  SELECT a.sensor_id, CASE WHEN s.sensor_id IS NULL THEN 'not_found'
    WHEN EXISTS (SELECT 1 FROM sensor_readings r WHERE r.sensor_id = a.sensor_id) THEN 'cleared'
    ELSE 'deleted' END AS action
  FROM asked a LEFT JOIN sensors s ON s.sensor_id = a.sensor_id)"""
_DELETE_VIEWS = "waste_bins sensors sensor_readings"
_SENSOR_COLUMNS = "sensor_id, sensor_code, bin_id, sensor_type, manufacturer, status, mac_address, weight_offset"


def _cascade(table: str, extra: str = "") -> str:
    return (f"SELECT '{table}' AS table_name, count(*) AS rows_before, "
            f"count(*) FILTER (WHERE NOT coalesce(bin_id IN (SELECT bin_id FROM gone), false){extra}) AS rows_kept "
            f"FROM {table}")


def _repeated(table: str, *key: str) -> str:
    text = " || ',' || ".join(f"CAST({c} AS VARCHAR)" for c in key)
    present = " AND ".join(f"{c} IS NOT NULL" for c in key)
    return (f"SELECT '{table}' AS table_name, '{','.join(key)}' AS key_columns, {text} AS key_value, "
            f"count(*) AS occurrences FROM {table} WHERE {present} GROUP BY {', '.join(key)} HAVING count(*) > 1")


def _orphans(table: str, column: str, parent: str) -> str:
    key = {"waste_bins": "bin_id", "sensors": "sensor_id", "collection_routes": "route_id"}[parent]
    return (f"SELECT '{table}' AS table_name, '{column}' AS column_name, CAST(t.{column} AS BIGINT) AS reference, "
            f"count(*) AS row_count FROM {table} t WHERE t.{column} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {parent} p WHERE p.{key} = t.{column}) GROUP BY t.{column}")


_ALL_VIEWS = "waste_bins sensors sensor_readings collections alerts collection_routes route_bins"


def oracle_sql() -> dict[str, str]:
    relative = {k: v for k, v in labels.RELATIVE_LABELS.items() if k != "now"}
    lookback = f"r.timestamp >= {_NOW} - INTERVAL 168 HOUR"
    hourly = f"""SELECT date_trunc('hour', timestamp) AS hour, {_mean('fill_level')} AS avg_fill_level,
      count(*) AS reading_count FROM sensor_readings"""
    listed = """SELECT a.alert_id, a.bin_id, a.alert_type, a.severity, a.message, a.status, a.triggered_at,
      b.bin_code, b.location FROM alerts a LEFT JOIN waste_bins b ON b.bin_id = a.bin_id
      WHERE a.status = 'open' ORDER BY a.triggered_at DESC, a.alert_id DESC LIMIT 100"""
    twins = {
        "bin_current_status": _with(_STATUS_VIEWS, _STATUS, "SELECT * FROM status"),
        "active_bins": _with(_STATUS_VIEWS, _STATUS, "SELECT * FROM status WHERE bin_status = 'active'"),
        "active_bins_of_status": _with(_STATUS_VIEWS, _STATUS, """SELECT asked, bin_id, bin_status, fill_status
            FROM status, (VALUES ('active'), ('inactive')) AS a(asked) WHERE bin_status = 'active' AND bin_status = asked"""),
        "fleet_stats": _with(_STATUS_VIEWS + " collections", _STATUS, f"""SELECT
            (SELECT count(*) FROM waste_bins WHERE status = 'active') AS total_bins,
            (SELECT count(*) FROM alerts WHERE status = 'open') AS active_alerts,
            (SELECT count(*) FROM collections WHERE collection_time >= TIMESTAMP '{COLLECTIONS_AS_OF}' - INTERVAL 7 DAY) AS recent_collections,
            (SELECT round(coalesce(CAST(sum(fill_level) AS DOUBLE) / count(fill_level), 0), 2) FROM status) AS avg_fill_level,
            (SELECT count(*) FROM status WHERE fill_level >= 75) AS bins_need_attention"""),
        "fill_status_distribution": _with(_STATUS_VIEWS, _STATUS,
            "SELECT fill_status, count(*) AS bin_count FROM status GROUP BY fill_status"),
        "bin_recent_readings": _with("sensor_readings", _RANKED,
            "SELECT bin_id, rank, reading_id, timestamp, fill_level, weight_kg FROM ranked WHERE rank <= 10"),
        "bin_recent_collections": _with("collections", _PICKED,
            "SELECT bin_id, rank, collection_id, collection_time, weight_collected FROM picked WHERE rank <= 5"),
        "bin_detail": _with(_STATUS_VIEWS + " collections", _STATUS, _RANKED, _PICKED, """
            SELECT bin_id, 'status' AS section, CAST(0 AS BIGINT) AS rank, last_reading AS at, fill_level, weight_kg FROM status
            UNION ALL SELECT bin_id, 'reading', rank, timestamp, fill_level, weight_kg FROM ranked
              WHERE rank <= 10 AND bin_id IN (SELECT bin_id FROM waste_bins)
            UNION ALL SELECT bin_id, 'collection', rank, collection_time, fill_level_before, weight_collected FROM picked
              WHERE rank <= 5 AND bin_id IN (SELECT bin_id FROM waste_bins)"""),
        "bin_detail_of_one": _with(_STATUS_VIEWS + " collections", _STATUS, _RANKED, _PICKED, """
            SELECT bin_id, 'status' AS section, CAST(0 AS BIGINT) AS rank, last_reading AS at, fill_level, weight_kg
              FROM status WHERE bin_id = 5
            UNION ALL SELECT bin_id, 'reading', rank, timestamp, fill_level, weight_kg FROM ranked
              WHERE rank <= 10 AND bin_id = 5
            UNION ALL SELECT bin_id, 'collection', rank, collection_time, fill_level_before, weight_collected FROM picked
              WHERE rank <= 5 AND bin_id = 5"""),
        "fill_bands": _with("sensor_readings", """SELECT CASE WHEN coalesce(fill_level, 0) < 50 THEN 'green'
            WHEN coalesce(fill_level, 0) < 75 THEN 'yellow' ELSE 'red' END AS band, count(*) AS reading_count
            FROM sensor_readings GROUP BY 1"""),
        "readings_lookback": _with("sensor_readings waste_bins", f"""SELECT r.*, b.bin_code FROM sensor_readings r
            LEFT JOIN waste_bins b ON b.bin_id = r.bin_id WHERE {lookback}
            ORDER BY r.timestamp DESC, r.reading_id DESC LIMIT 1000"""),
        "readings_lookback_bin": _with("sensor_readings waste_bins", f"""SELECT r.*, b.bin_code FROM sensor_readings r
            LEFT JOIN waste_bins b ON b.bin_id = r.bin_id WHERE {lookback}"""),
        "latest_readings": _with("sensor_readings",
            "SELECT * FROM sensor_readings ORDER BY timestamp DESC, reading_id DESC LIMIT 10"),
        "alerts_by_status": _with("alerts waste_bins", listed),
        "alert_feed": _with("alerts waste_bins", f"listed AS ({listed})", f"""SELECT alert_id, bin_id,
            {_case('alert_type', labels.ALERT_TYPE_LABELS, "replace(alert_type, '_', ' ')")} || ' · ' || coalesce(bin_code, '') AS title, message,
            coalesce(nullif(severity, ''), 'low') AS severity, upper(coalesce(nullif(severity, ''), 'low')) AS severity_label,
            triggered_at FROM listed"""),
        "sensors_with_bins": _with("sensors waste_bins", """SELECT s.*, b.bin_code, b.location FROM sensors s
            LEFT JOIN waste_bins b ON b.bin_id = s.bin_id"""),
        "hourly_fill_timeline": _with("sensor_readings",
            f"{hourly} r WHERE {lookback} GROUP BY 1"),
        "hourly_fill_of_partials": _with("sensor_readings",
            f"{hourly} r WHERE {lookback} GROUP BY 1"),
        "hourly_alerts_by_severity": _with("alerts", f"""SELECT date_trunc('hour', triggered_at) AS hour, severity,
            count(*) AS alert_count FROM alerts
            WHERE triggered_at >= TIMESTAMP '{ALERTS_AS_OF}' - INTERVAL 168 HOUR GROUP BY 1, 2"""),
        "daily_weight": _with("waste_bins sensor_readings", _DAILY, "SELECT * FROM daily"),
        "daily_weight_of_partials": _with("waste_bins sensor_readings", _DAILY, "SELECT * FROM daily"),
        "daily_weight_total": _with("waste_bins sensor_readings", _DAILY,
            "SELECT CAST(sum(total_weight_today) AS DECIMAL(38,2)) AS total_weight_today FROM daily"),
        "weighing_history": _with("sensor_readings", _RANKED, f"""SELECT bin_id, reading_id, rank, timestamp, weight_kg,
            CAST(CAST(weight_kg AS DECIMAL(18,3)) AS VARCHAR) {_KG} AS weight_text,
            rank = min(rank) OVER (PARTITION BY bin_id) AS is_newest
            FROM ranked WHERE rank <= 10 AND weight_kg > 0"""),
        "weighing_summary": _with(_STATUS_VIEWS, _STATUS, _ACTIVE, _DAILY, f"""SELECT a.bin_id, a.bin_code,
            CAST(CAST(coalesce(d.total_weight_today, 0) AS DECIMAL(18,3)) AS VARCHAR) AS total_text,
            coalesce(d.reading_count_today, 0) AS weighings,
            coalesce(CAST(CAST(a.battery_level AS DECIMAL(18,0)) AS VARCHAR) || '%', '--') AS battery_text,
            coalesce(CAST(a.signal_strength AS VARCHAR) || ' dBm', '--') AS signal_text, a.card_status,
            {_case('a.card_status', labels.COMPLIANCE_LABELS, 'a.card_status')} AS card_label
            FROM active a LEFT JOIN daily d ON d.bin_id = a.bin_id"""),
        "collection_stats": _with("waste_bins collections", f"""SELECT b.bin_id, b.bin_code, b.location,
            count(c.collection_id) AS total_collections,
            {_mean('c.fill_level_before')} AS avg_fill_before_collection,
            CAST(sum(c.weight_collected) AS DECIMAL(18,2)) AS total_weight_collected,
            max(c.collection_time) AS last_collection_time,
            {_mean('c.duration_minutes')} AS avg_collection_duration
            FROM waste_bins b LEFT JOIN collections c ON c.bin_id = b.bin_id GROUP BY ALL"""),
        "recent_collections": _with("collections", f"""SELECT count(*) AS recent_collections FROM collections
            WHERE collection_time >= TIMESTAMP '{COLLECTIONS_AS_OF}' - INTERVAL 7 DAY"""),
        "collection_inference": _with("sensor_readings", """SELECT bin_id, reading_id, timestamp AS collected_at,
            fill_before, fill_level AS fill_after FROM (
              SELECT *, lag(fill_level) OVER (PARTITION BY bin_id ORDER BY timestamp, reading_id) AS fill_before
              FROM sensor_readings) WHERE fill_before > 85 AND fill_level <= 10"""),
        "compliance_cards": _with(_STATUS_VIEWS, _STATUS, _ACTIVE, _DAILY, _CARDS),
        "compliance_offline": _with(_STATUS_VIEWS, _STATUS, _ACTIVE, _DAILY,
            _CARDS + " WHERE a.card_status = 'offline'"),
        "compliance_distribution": _with(_STATUS_VIEWS, _STATUS, _ACTIVE, """SELECT k.card_status, count(a.bin_id) AS bin_count
            FROM (VALUES ('good'), ('medium'), ('high'), ('offline'), ('none')) k(card_status)
            LEFT JOIN active a ON a.card_status = k.card_status GROUP BY 1"""),
        "active_weighing": _with(_STATUS_VIEWS, _STATUS, _ACTIVE, """SELECT
            count(*) FILTER (WHERE card_status = 'good') AS weighing, count(*) AS total_bins FROM active"""),
        "weight_bars": _with(_STATUS_VIEWS, _STATUS, _ACTIVE, _DAILY, """SELECT a.bin_id,
            CASE WHEN length(coalesce(nullif(a.location, ''), a.bin_code)) > 14
                 THEN substr(coalesce(nullif(a.location, ''), a.bin_code), 1, 13) || '…'
                 ELSE coalesce(nullif(a.location, ''), a.bin_code) END AS label,
            CAST(coalesce(d.total_weight_today, 0) AS DECIMAL(18,2)) AS weight, a.card_status
            FROM active a LEFT JOIN daily d ON d.bin_id = a.bin_id"""),
        "device_list": _with("sensors waste_bins sensor_readings", _DEVICES, "SELECT * FROM devices"),
        "device_report": _with("sensors waste_bins sensor_readings", _DEVICES, f"""spans AS (
            SELECT *, CAST(floor(epoch({_NOW} - last_seen) / 60) AS BIGINT) AS minutes FROM devices
            WHERE mac_address IS NOT NULL AND mac_address <> ''),
            seen AS (SELECT *, CASE WHEN minutes < 1 THEN 'now' WHEN minutes < 60 THEN 'minute'
              WHEN minutes < 1440 THEN 'hour' WHEN minutes IS NOT NULL THEN 'day' END AS seen_unit,
              CASE WHEN minutes < 1 THEN 0 WHEN minutes < 60 THEN minutes WHEN minutes < 1440 THEN minutes // 60
              ELSE minutes // 1440 END AS seen_count FROM spans)""", f"""SELECT sensor_id, mac_address,
            coalesce(nullif(device_name, ''), nullif(sensor_code, ''), '—') AS device_name,
            coalesce(bin_code, '—') AS bin_code,
            coalesce(CAST(CAST(weight_offset AS DECIMAL(18,2)) AS VARCHAR), '0.00') AS offset_text,
            seen_unit, seen_count,
            CASE WHEN seen_unit IS NULL THEN '—' WHEN seen_unit = 'now' THEN '{labels.RELATIVE_LABELS['now']}'
                 ELSE CAST(seen_count AS VARCHAR) || {_case('seen_unit', relative, "''")} END AS seen_text,
            coalesce(last_seen > {_NOW} - INTERVAL 5 MINUTE, false) AS online FROM seen"""),
        "device_lookup": _with("device_items sensors waste_bins", """SELECT i.item_seq, upper(trim(i.mac_address)) AS mac,
            s.sensor_id IS NOT NULL AS registered, s.sensor_id, s.sensor_code, CAST(s.bin_id AS VARCHAR) AS bin_id,
            s.bin_code, s.location, CASE WHEN s.sensor_id IS NOT NULL THEN coalesce(s.weight_offset, 0.0) END AS weight_offset
            FROM device_items i LEFT JOIN (SELECT s.*, b.bin_code, b.location FROM sensors s
              JOIN waste_bins b ON b.bin_id = s.bin_id WHERE s.status = 'active') s
            ON s.mac_address = upper(trim(i.mac_address))"""),
        "readings_per_sensor": _with("sensor_readings",
            "SELECT sensor_id, count(*) AS reading_count FROM sensor_readings GROUP BY 1"),
        "ingest_accepted": _with(_INGEST_VIEWS, _CLASSIFIED, _ACCEPTED),
        "ingest_rejected": _with(_INGEST_VIEWS, _CLASSIFIED,
            "SELECT arrival_seq, arrival_ts, topic, payload, reason FROM classified WHERE reason IS NOT NULL"),
        "alert_candidates": _with(_INGEST_VIEWS, _CLASSIFIED, _HITS, f"{_ALERT_ROW} FROM hits"),
        "alerts_deduped": _with(_INGEST_VIEWS + " alerts", _CLASSIFIED, _HITS, _DEDUPED),
        "readings_refused": _with("sensor_readings sensors waste_bins", """SELECT reading_id, sensor_id, bin_id
            FROM sensor_readings r WHERE NOT EXISTS (SELECT 1 FROM sensors s WHERE s.sensor_id = r.sensor_id)
            OR NOT EXISTS (SELECT 1 FROM waste_bins b WHERE b.bin_id = r.bin_id)"""),
        "export_report": _with("sensor_readings waste_bins", _EXPORT,
            "SELECT *, CAST(ceil(date_diff('minute', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:59:00') / 60.0) AS INTEGER) AS lookback_hours FROM export"),
        "export_long": _with("sensor_readings waste_bins",
            _EXPORT.replace("2024-01-01 00:00:00", "2023-12-01 00:00:00"),
            "SELECT *, CAST(ceil(date_diff('minute', TIMESTAMP '2023-12-01 00:00:00', TIMESTAMP '2024-01-30 23:59:00') / 60.0) AS INTEGER) AS lookback_hours FROM export"),
        "report_csv_named": _with("sensor_readings waste_bins", _EXPORT,
            "SELECT 'infectious_waste_2024-01-01_2024-01-30' AS report, count(*) AS rows FROM export"),
        "status_json": _with(_STATUS_VIEWS, _STATUS, """SELECT bin_id, fill_status,
            strftime(last_reading, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(last_reading) % 1000000 = 0 THEN ''
              ELSE '.' || lpad(CAST(microsecond(last_reading) % 1000000 AS VARCHAR), 6, '0') END || '+07:00' AS last_reading,
            replace(CAST(last_reading AS VARCHAR), ' ', 'T') || '+07:00' AS updated_at FROM status"""),
        "export_csv": _with("sensor_readings waste_bins", _EXPORT,
            "SELECT * EXCLUDE (reading_id) FROM export"),
        "report_lines": _with("sensor_readings waste_bins", _EXPORT, f"""SELECT '{",".join(labels.EXPORT_HEADERS.values())}' AS line
            UNION ALL SELECT strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN ''
              ELSE '.' || lpad(CAST(microsecond(timestamp) % 1000000 AS VARCHAR), 6, '0') END || '+07:00' || ',' ||
              {" || ',' || ".join([_quoted('bin_code'), _quoted('department'), _number('weight_kg'), _number('battery_level'),
                                   "coalesce(CAST(signal_strength AS VARCHAR), '')", _number('temperature_c')])}
            FROM export"""),
        "readings_zoned": _with("sensor_readings", """SELECT reading_id,
            strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN ''
              ELSE '.' || lpad(CAST(microsecond(timestamp) % 1000000 AS VARCHAR), 6, '0') END || '+07:00' AS timestamp
            FROM sensor_readings"""),
        "registration_form": _with("device_items", r"""typed AS (SELECT *, rtrim(regexp_replace(substr(upper(
              regexp_replace(mac_address, '[^0-9A-Fa-f]', '', 'g')), 1, 12), '(..)', '\1:', 'g'), ':') AS mac FROM device_items)""",
            """SELECT item_seq, mac AS mac_address, coalesce(nullif(trim(device_name), ''), mac) AS device_name,
            bin_id, weight_offset, regexp_full_match(mac, '([0-9A-F]{2}:){5}[0-9A-F]{2}') AS mac_ok,
            bin_id <> 0 AS bin_ok FROM typed"""),
        "register_devices": _with(_REGISTER_VIEWS, _REGISTER, """SELECT item_seq, mac, bin_code,
            sensor_code, action FROM outcome WHERE action IS NOT NULL"""),
        "register_errors": _with(_REGISTER_VIEWS, _REGISTER, """
            SELECT item_seq, mac, error FROM checked WHERE error IS NOT NULL
            UNION ALL SELECT item_seq, mac, 'sensor_code_taken' FROM outcome
              WHERE action IS NULL"""),
        "register_snapshot": _with(_REGISTER_VIEWS, _REGISTER, _FINAL, f"""
            SELECT s.sensor_id, s.sensor_code, coalesce(f.bin_id, s.bin_id) AS bin_id, s.sensor_type,
              coalesce(f.name, s.manufacturer) AS manufacturer, s.status, s.mac_address,
              coalesce(f.weight_offset, s.weight_offset) AS weight_offset,
              CASE WHEN f.mac IS NOT NULL THEN {_NOW} END AS updated_at
            FROM sensors s LEFT JOIN final f ON f.mac = s.mac_address
            UNION ALL
            SELECT CAST((SELECT max(sensor_id) FROM sensors) + c.item_seq AS INT), c.sensor_code, f.bin_id,
              'weight_scale', f.name, 'active', c.mac, f.weight_offset, {_NOW}
            FROM coded c JOIN final f ON f.mac = c.mac"""),
        "update_devices": _with(_UPDATE_VIEWS, _UPDATE, """
            SELECT item_seq, sensor_id, mac, error AS outcome FROM checked WHERE error IS NOT NULL
            UNION ALL SELECT item_seq, sensor_id, mac, coalesce(error, 'updated') FROM settled"""),
        "update_snapshot": _with(_UPDATE_VIEWS, _UPDATE, f"""
            SELECT s.sensor_id, s.sensor_code, coalesce(u.bin_id, s.bin_id) AS bin_id, s.sensor_type,
              coalesce(u.name, s.manufacturer) AS manufacturer, s.status,
              coalesce(u.mac, s.mac_address) AS mac_address,
              coalesce(u.weight_offset, s.weight_offset) AS weight_offset,
              CASE WHEN u.mac IS NOT NULL THEN {_NOW} END AS updated_at
            FROM sensors s LEFT JOIN (SELECT * FROM settled WHERE error IS NULL
              QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY item_seq DESC) = 1) u ON u.sensor_id = s.sensor_id"""),
        "delete_devices": _with(_DELETE_VIEWS, _DELETE, "SELECT sensor_id, action FROM outcome"),
        "delete_snapshot": _with(_DELETE_VIEWS, _DELETE, f"""
            SELECT s.* REPLACE (CASE WHEN o.action = 'cleared' THEN NULL ELSE s.mac_address END AS mac_address),
              CASE WHEN o.action = 'cleared' THEN {_NOW} END AS updated_at
            FROM sensors s LEFT JOIN outcome o ON o.sensor_id = s.sensor_id
            WHERE o.action IS NULL OR o.action <> 'deleted'"""),
        "seed_insert": _with("seed_sensors sensors", f"""SELECT
            CAST((SELECT max(sensor_id) FROM sensors) + item_seq AS INT) AS sensor_id, sensor_code, bin_id,
            sensor_type, manufacturer, 'active' AS status, {_NOW} AS created_at FROM seed_sensors
            WHERE sensor_code NOT IN (SELECT sensor_code FROM sensors)"""),
        "cascade_delete_counts": _with(_ALL_VIEWS,
            "gone AS (SELECT bin_id FROM waste_bins WHERE status = 'inactive')",
            "gone_sensors AS (SELECT sensor_id FROM sensors WHERE bin_id IN (SELECT bin_id FROM gone))",
            " UNION ALL ".join([
                _cascade("waste_bins"), _cascade("sensors"),
                _cascade("sensor_readings", " AND NOT coalesce(sensor_id IN (SELECT sensor_id FROM gone_sensors), false)"),
                _cascade("collections"), _cascade("alerts"), _cascade("route_bins")])),
        "cascade_kept_readings": _with("waste_bins sensors sensor_readings",
            "gone AS (SELECT bin_id FROM waste_bins WHERE status = 'inactive')",
            """SELECT reading_id, sensor_id, bin_id FROM sensor_readings
            WHERE NOT coalesce(bin_id IN (SELECT bin_id FROM gone), false)
              AND NOT coalesce(sensor_id IN (SELECT sensor_id FROM sensors WHERE bin_id IN (SELECT bin_id FROM gone)), false)"""),
        "unique_violations": _with(_ALL_VIEWS, " UNION ALL ".join([
            _repeated("waste_bins", "bin_id"), _repeated("waste_bins", "bin_code"),
            _repeated("sensors", "sensor_id"), _repeated("sensors", "sensor_code"),
            _repeated("sensors", "mac_address"), _repeated("sensor_readings", "reading_id"),
            _repeated("collections", "collection_id"), _repeated("alerts", "alert_id"),
            _repeated("collection_routes", "route_id"), _repeated("route_bins", "route_id", "bin_id")])),
        "orphan_rows": _with(_ALL_VIEWS, " UNION ALL ".join([
            _orphans("sensors", "bin_id", "waste_bins"), _orphans("sensor_readings", "sensor_id", "sensors"),
            _orphans("sensor_readings", "bin_id", "waste_bins"), _orphans("collections", "bin_id", "waste_bins"),
            _orphans("alerts", "bin_id", "waste_bins"), _orphans("route_bins", "route_id", "collection_routes"),
            _orphans("route_bins", "bin_id", "waste_bins")])),
        "row_counts": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in SOURCE_TABLES),
        "route_manifest": _with(_STATUS_VIEWS + " collection_routes route_bins", _STATUS, """SELECT t.route_id,
            t.route_name, s.sequence_order, s.bin_id, v.bin_code, v.location, v.bin_status, v.fill_level, v.fill_status,
            s.estimated_time_minutes, CAST(sum(s.estimated_time_minutes) OVER (PARTITION BY s.route_id) AS BIGINT) AS route_minutes,
            count(*) OVER (PARTITION BY s.route_id) AS route_stops
            FROM route_bins s JOIN collection_routes t ON t.route_id = s.route_id
            LEFT JOIN status v ON v.bin_id = s.bin_id"""),
        "geometry_check": _with("sensor_readings waste_bins", """SELECT * FROM (
            SELECT reading_id, bin_id, fill_level, distance_cm, expected_cm,
                   CAST(abs(distance_cm - expected_cm) AS DECIMAL(18,6)) AS gap_cm FROM (
              SELECT r.reading_id, r.bin_id, r.fill_level, r.distance_cm,
                CAST(b.capacity * CAST(0.0008 AS DECIMAL(6,4)) * (CAST(100 AS DECIMAL(5,2)) - r.fill_level) AS DECIMAL(18,6)) AS expected_cm
              FROM sensor_readings r JOIN waste_bins b ON b.bin_id = r.bin_id)) WHERE gap_cm > 5"""),
        "ingest_as_of": _with(_AS_OF_VIEWS, *_SPANS, _CLASSIFIED_AS_OF, _ACCEPTED),
        "ingest_as_of_rejected": _with(_AS_OF_VIEWS, *_SPANS, _CLASSIFIED_AS_OF,
                                       "SELECT arrival_seq, reason FROM classified WHERE reason IS NOT NULL"),
        "stream_ingest": _with(_INGEST_VIEWS, _CLASSIFIED, _ACCEPTED),
        "stream_alerts": _with(_INGEST_VIEWS + " alerts", _CLASSIFIED, _HITS, _DEDUPED),
        "stream_alerts_reopened": _with(_INGEST_VIEWS + " alerts", _CLASSIFIED, _HITS, *_REOPENED),
        "stream_latest": _with("sensor_readings", _RANKED, """SELECT bin_id, fill_level, weight_kg, temperature_c,
            battery_level, signal_strength, timestamp AS last_reading FROM ranked WHERE rank = 1"""),
        "stream_hourly": _with("sensor_readings", f"{hourly} GROUP BY 1"),
        "stream_hourly_partials": _with("sensor_readings", f"{hourly} GROUP BY 1"),
        "stream_status": _with(_STATUS_VIEWS, _STATUS, "SELECT * FROM status"),
        "stream_without_resends": _with("messages", "SELECT DISTINCT arrival_seq, arrival_ts, topic FROM messages"),
    }
    # What is published is the batch's snapshot; its history has the devices of the first version
    # and those that the batch made or changed.
    twins["register_published"] = twins["register_snapshot"]
    shape = "sensor_id, sensor_code, mac_address, bin_id, weight_offset, false AS removed"
    twins["registry_history"] = f"""WITH older AS ({domain.SENSORS.format(**_PLAIN)}), newer AS ({twins["register_snapshot"]})
        SELECT {shape}, TIMESTAMP '2023-01-01 00:00:00' AS valid_from FROM older
        UNION ALL SELECT {shape}, {_NOW} FROM newer WHERE updated_at IS NOT NULL"""
    return twins
