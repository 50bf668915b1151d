"""The fleet tables as views over the supplied test tables.

Every view maps whole tables row by row; nothing is left out. Modulo terms only vary
values. Streams use the same mapping on a streaming scan of the same file.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

# "Now" for each family of tables, inside the range of its data.
READINGS_AS_OF = "2024-01-30 23:58:00"
ALERTS_AS_OF = "2001-08-01 00:00:00"
COLLECTIONS_AS_OF = "2001-11-04 00:00:00"

# The name of a customer's nation as a map of the 25 nations: a join would multiply the
# planned size of the bins, and large sides would be exchanged for them.
NATION_NAME = ("element_at((SELECT map_from_entries(collect_list(struct(n_nationkey, n_name))) "
               "FROM {nation}), c.c_nationkey)")

WASTE_BINS = """
SELECT CAST(c.c_custkey AS INT) AS bin_id, c.c_name AS bin_code,
       concat({{nation_name}}, ' - ', c.c_mktsegment) AS location,
       CAST(concat('13.', lpad(CAST(7500 + c.c_custkey % 500 AS STRING), 4, '0')) AS DECIMAL(10,8)) AS latitude,
       CAST(concat('100.', lpad(CAST(5000 + c.c_custkey % 700 AS STRING), 4, '0')) AS DECIMAL(11,8)) AS longitude,
       CAST(60 * (1 + c.c_custkey % 4) AS INT) AS capacity,
       CASE c.c_custkey % 4 WHEN 0 THEN 'general' WHEN 1 THEN 'recycle'
            WHEN 2 THEN 'organic' ELSE 'hazardous' END AS bin_type,
       CASE WHEN c.c_custkey % 10 = 9 THEN 'inactive'
            WHEN c.c_custkey % 25 = 7 THEN 'maintenance' ELSE 'active' END AS status
FROM {customer} c
"""

SENSOR_READINGS = """
SELECT event_id AS reading_id, CAST(user_id AS INT) AS sensor_id, CAST(user_id AS INT) AS bin_id,
       CAST(least(value, 100.0) AS DECIMAL(5,2)) AS fill_level,
       CAST(concat(CAST(event_id % 20 AS STRING), '.', CAST(event_id % 10 AS STRING)) AS DECIMAL(6,2)) AS distance_cm,
       CASE WHEN event_id % 13 = 0 THEN CAST(0 AS DECIMAL(8,2))
            WHEN event_id % 31 = 0 THEN NULL
            ELSE CAST(value AS DECIMAL(8,2)) END AS weight_kg,
       CAST(20 + event_id % 30 AS DECIMAL(5,2)) AS temperature_c,
       CAST(event_id % 101 AS DECIMAL(5,2)) AS battery_level,
       CAST(0 - 30 - event_id % 61 AS INT) AS signal_strength,
       ts AS timestamp
FROM {events}
"""

SENSORS = """
SELECT CAST(s_suppkey AS INT) AS sensor_id,
       concat('SENS', lpad(CAST(s_suppkey AS STRING), 6, '0')) AS sensor_code,
       CAST(s_suppkey AS INT) AS bin_id, 'weight_scale' AS sensor_type, s_name AS manufacturer,
       CASE WHEN s_suppkey % 11 = 5 THEN 'inactive' ELSE 'active' END AS status,
       CASE WHEN s_suppkey % 7 = 3 THEN NULL ELSE
         concat('AA:BB:CC:', substr(lpad(CAST(s_suppkey AS STRING), 6, '0'), 1, 2), ':',
                substr(lpad(CAST(s_suppkey AS STRING), 6, '0'), 3, 2), ':',
                substr(lpad(CAST(s_suppkey AS STRING), 6, '0'), 5, 2)) END AS mac_address,
       CASE WHEN s_suppkey % 3 = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS weight_offset
FROM {supplier}
"""

# Three states of the registry: all devices at first, then every second one in the next bin with
# a new offset and some with the MAC of the device after the next, at last every fifth one gone.
SENSOR_STATES = f"""
SELECT s.*, '2023-01-01 00:00:00' AS valid_from, false AS removed FROM ({SENSORS}) s
UNION ALL
SELECT s.sensor_id, s.sensor_code, s.bin_id + 1, s.sensor_type, s.manufacturer, s.status,
       CASE WHEN s.sensor_id % 4 = 0 AND t.mac_address IS NOT NULL THEN t.mac_address ELSE s.mac_address END,
       0.75, '2024-01-10 12:00:00', false
FROM ({SENSORS}) s LEFT JOIN ({SENSORS}) t ON t.sensor_id = s.sensor_id + 2 WHERE s.sensor_id % 2 = 0
UNION ALL
SELECT s.*, '2024-01-20 06:30:00', true FROM ({SENSORS}) s WHERE s.sensor_id % 5 = 0
"""

# Bins that were taken away in the middle of the month, some of which came back.
BIN_STATES = """
SELECT CAST(c_custkey AS INT) AS bin_id, '2023-01-01 00:00:00' AS valid_from, false AS removed FROM {customer}
UNION ALL
SELECT CAST(c_custkey AS INT), '2024-01-15 00:00:00', true FROM {customer} WHERE c_custkey % 6 = 1
UNION ALL
SELECT CAST(c_custkey AS INT), '2024-01-25 00:00:00', false FROM {customer} WHERE c_custkey % 12 = 1
"""

ALERTS = """
SELECT o_orderkey AS alert_id, CAST(o_custkey AS INT) AS bin_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'bin_full' WHEN 1 THEN 'sensor_fault'
            WHEN 2 THEN 'unusual_activity' ELSE 'maintenance_required' END AS alert_type,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high'
            WHEN '3' THEN 'medium' ELSE 'low' END AS severity,
       concat('Alert ', CAST(o_orderkey AS STRING)) AS message,
       CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'acknowledged' END AS status,
       o_orderdate AS triggered_at
FROM {orders}
"""

COLLECTIONS = """
SELECT l_orderkey * 10 + l_linenumber AS collection_id, CAST(l_suppkey AS INT) AS bin_id,
       l_shipdate AS collection_time,
       CAST(l_discount * 1000 AS DECIMAL(5,2)) AS fill_level_before,
       CAST(l_quantity AS DECIMAL(8,2)) AS weight_collected,
       CAST(l_linenumber * 5 AS INT) AS duration_minutes,
       l_partkey AS tie_part, l_extendedprice AS tie_price
FROM {lineitem}
"""

MESSAGES = """
SELECT event_id AS arrival_seq, ts AS arrival_ts,
       CASE WHEN event_id % 37 = 0 THEN 'waste/bins/x/y/sensors'
            ELSE concat('waste/bins/', CAST(user_id AS STRING), '/sensors') END AS topic,
       CASE WHEN event_id % 23 = 0 THEN 'not json' ELSE
         concat('{{"bin_id":"', CAST((user_id + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS STRING),
                '","bin_code":"B', CAST(user_id AS STRING),
                '","sensor_code":"SENS', lpad(CAST(user_id AS STRING), 6, '0'), '"',
                CASE WHEN event_id % 2 = 0 THEN
                  concat(',"mac_address":" aa:bb:cc:', substr(lpad(CAST(user_id AS STRING), 6, '0'), 1, 2), ':',
                         substr(lpad(CAST(user_id AS STRING), 6, '0'), 3, 2), ':',
                         substr(lpad(CAST(user_id AS STRING), 6, '0'), 5, 2), ' "') ELSE '' END,
                CASE WHEN event_id % 29 = 0 THEN ''
                     WHEN event_id % 17 = 0 THEN ',"fill_level":null'
                     WHEN event_id % 19 = 0 THEN ',"fill_level":"abc"'
                     ELSE concat(',"fill_level":', CAST(CAST(least(value, 100.0) AS DECIMAL(5,2)) AS STRING)) END,
                ',"weight_kg":', CAST(CAST(value AS DECIMAL(8,2)) AS STRING),
                ',"temperature_c":', CAST(20 + event_id % 30 AS STRING),
                ',"battery_level":', CAST(event_id % 101 AS STRING),
                ',"signal_strength":', CAST(0 - 30 - event_id % 61 AS STRING),
                ',"timestamp":"', substr(replace(CAST(ts AS STRING), ' ', 'T'), 1, 19), '+07:00"}}') END AS payload
FROM {events}
"""

COLLECTION_ROUTES = """
SELECT r_regionkey AS route_id, r_name AS route_name FROM {region}
"""

# The stops of a route: every bin of the nations in the region, in bin order. The
# position is unique inside a route because the bin id is; gaps are allowed.
ROUTE_BINS = """
SELECT n.n_regionkey AS route_id, CAST(c.c_custkey AS INT) AS bin_id,
       CAST(c.c_custkey AS INT) AS sequence_order,
       CAST(5 + c.c_custkey % 10 AS INT) AS estimated_time_minutes
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

# A registration batch with one item per customer row: bad MACs, known MACs, repeated
# MACs, blank names, shared names, names of symbols only, codes already in use.
DEVICE_ITEMS = """
SELECT CAST(c_custkey + 1 AS INT) AS item_seq,
       CASE WHEN c_custkey % 17 = 4 THEN 'not a mac'
            ELSE concat(' aa:bb:cc:', substr(lpad(CAST(c_custkey - c_custkey % 3 AS STRING), 6, '0'), 1, 2), ':',
                        substr(lpad(CAST(c_custkey - c_custkey % 3 AS STRING), 6, '0'), 3, 2), ':',
                        substr(lpad(CAST(c_custkey - c_custkey % 3 AS STRING), 6, '0'), 5, 2)) END AS mac_address,
       CASE c_custkey % 5 WHEN 0 THEN '   ' WHEN 1 THEN concat('Scale OT/', CAST(c_nationkey AS STRING), ' -')
            WHEN 2 THEN '///' WHEN 3 THEN concat('SENS', lpad(CAST(c_custkey % 200 AS STRING), 6, '0'))
            ELSE concat(' ', c_name, ' ') END AS device_name,
       CAST(c_custkey % 2000 AS INT) AS bin_id,
       CAST((c_custkey % 9) * 0.25 AS DOUBLE) AS weight_offset
FROM {customer}
"""

# A batch of single-device updates, one per customer row: unknown devices, MACs held by
# another device, bad MACs, unknown bins, several updates of one device.
DEVICE_UPDATES = """
SELECT CAST(c_custkey + 1 AS INT) AS item_seq,
       CAST(c_custkey - c_custkey % 2 AS INT) AS sensor_id,
       CASE WHEN c_custkey % 19 = 3 THEN 'zz'
            ELSE concat('aa:bb:', CASE WHEN c_custkey % 4 = 0 THEN 'cc' ELSE 'dd' END, ':',
                        substr(lpad(CAST(c_custkey + c_custkey % 3 AS STRING), 6, '0'), 1, 2), ':',
                        substr(lpad(CAST(c_custkey + c_custkey % 3 AS STRING), 6, '0'), 3, 2), ':',
                        substr(lpad(CAST(c_custkey + c_custkey % 3 AS STRING), 6, '0'), 5, 2)) END AS mac_address,
       concat(' ', c_name, ' ') AS device_name,
       CAST(CASE WHEN c_custkey % 23 = 5 THEN 0 - c_custkey ELSE c_custkey END AS INT) AS bin_id,
       CAST((c_custkey % 7) * 0.5 AS DOUBLE) AS weight_offset
FROM {customer}
"""

# A seed batch: one sensor per customer row; codes up to the supplier range exist.
SEED_SENSORS = """
SELECT CAST(c_custkey + 1 AS INT) AS item_seq,
       concat('SENS', lpad(CAST(c_custkey AS STRING), 6, '0')) AS sensor_code,
       CAST(c_custkey AS INT) AS bin_id, 'ultrasonic' AS sensor_type,
       c_mktsegment AS manufacturer
FROM {customer}
"""

SOURCE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


# Declared so that opening a table reads no file footer.
SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}


class Fleet:
    """Lazy fleet tables over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def source(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in SOURCE_SCHEMAS:
            reader = reader.schema(SOURCE_SCHEMAS[name])
        return reader.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, sql: str, *names: str) -> DataFrame:
        return self.spark.sql(sql, **{name: self.source(name) for name in names})

    @cached_property
    def bins(self) -> DataFrame:
        return self._view(WASTE_BINS.replace("{{nation_name}}", NATION_NAME), "customer", "nation")

    @cached_property
    def readings(self) -> DataFrame:
        return self._view(SENSOR_READINGS, "events")

    @cached_property
    def sensors(self) -> DataFrame:
        return self._view(SENSORS, "supplier")

    @cached_property
    def sensor_states(self) -> DataFrame:
        states = self._view(SENSOR_STATES, "supplier")
        return states.withColumn("valid_from", states["valid_from"].cast("timestamp_ntz"))

    @cached_property
    def bin_states(self) -> DataFrame:
        states = self._view(BIN_STATES, "customer")
        return states.withColumn("valid_from", states["valid_from"].cast("timestamp_ntz"))

    @cached_property
    def alerts(self) -> DataFrame:
        return self._view(ALERTS, "orders")

    @cached_property
    def collections(self) -> DataFrame:
        return self._view(COLLECTIONS, "lineitem")

    @cached_property
    def messages(self) -> DataFrame:
        return self._view(MESSAGES, "events")

    @cached_property
    def routes(self) -> DataFrame:
        return self._view(COLLECTION_ROUTES, "region")

    @cached_property
    def route_bins(self) -> DataFrame:
        return self._view(ROUTE_BINS, "customer", "nation")

    @cached_property
    def device_items(self) -> DataFrame:
        return self._view(DEVICE_ITEMS, "customer")

    @cached_property
    def device_updates(self) -> DataFrame:
        return self._view(DEVICE_UPDATES, "customer")

    @cached_property
    def seed_sensors(self) -> DataFrame:
        return self._view(SEED_SENSORS, "customer")

    def _event_stream(self) -> DataFrame:
        return (self.spark.readStream.schema(SOURCE_SCHEMAS["events"])
                .option("pathGlobFilter", "events.parquet").parquet(self.sf_dir))

    def message_stream(self) -> DataFrame:
        return self.spark.sql(MESSAGES, events=self._event_stream())

    def reading_stream(self) -> DataFrame:
        return self.spark.sql(SENSOR_READINGS, events=self._event_stream())
