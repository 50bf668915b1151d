"""The layout of stored readings: how much a reader of one bin, a time, or both meets."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fleetgauge.operators.status import of_bin, recent_readings
from fleetgauge.sources.schemas import SENSOR_READINGS
from fleetgauge.sources.tables import write_readings

BINS, DAYS, PER_DAY = 1000, 3, 60


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Readings of the even bins up to 2000, a minute apart, in the order of their arrival."""
    path = str(tmp_path_factory.mktemp("layout") / "readings")
    n = BINS * DAYS * PER_DAY
    arrived = spark.range(0, n, 1, 4).select(
        F.col("id").alias("reading_id"), F.lit(1).alias("sensor_id"), (F.col("id") % BINS * 2).cast("int").alias("bin_id"),
        (F.rand(1) * 100).cast("decimal(5,2)").alias("fill_level"), (F.rand(2) * 10).cast("decimal(8,2)").alias("weight_kg"),
        F.expr(f"TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(CAST(id DIV {BINS * PER_DAY} AS int), 0, CAST(id DIV {BINS} % {PER_DAY} AS int), 0)").alias("timestamp"))
    missing = [f for f in SENSOR_READINGS if f.name not in arrived.columns]
    frame = arrived.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    write_readings(frame, path, row_group_bytes=64 << 10, page_rows=1024)
    return path, frame


def scanned_rows(frame):
    """Rows that the scans of an executed plan gave."""
    plan = frame._jdf.queryExecution().executedPlan()
    frame._jdf.queryExecution().toRdd().count()

    def scans(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return scans(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return scans(node.plan())
        found = [node.metrics().apply("numOutputRows").value()] if name == "FileSourceScanExec" else []
        children = node.children()
        return found + [x for i in range(children.size()) for x in scans(children.apply(i))]

    return sum(scans(plan))


def test_one_bin_meets_few_row_groups(spark, stored):
    path, _ = stored
    groups = [pq.ParquetFile(f).metadata.row_group(i) for f in glob.glob(f"{path}/*/*.parquet")
              for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    at = next(i for i in range(groups[0].num_columns) if groups[0].column(i).path_in_schema == "bin_id")
    own = [g for g in groups if g.column(at).statistics.min <= 500 <= g.column(at).statistics.max]
    assert len(groups) >= 10 * DAYS and 10 * len(own) <= len(groups)
    frame = spark.read.parquet(path)
    whole = BINS * DAYS * PER_DAY
    found = of_bin(frame, 500).select("reading_id", "fill_level")
    assert found.count() == DAYS * PER_DAY
    assert 10 * scanned_rows(found) <= whole


def test_a_bin_that_is_absent_is_not_read(spark, stored):
    path, _ = stored
    # An odd bin lies inside the range of some row groups; their Bloom filters do not know it.
    assert scanned_rows(of_bin(spark.read.parquet(path), 501).select("reading_id")) == 0


def test_lists_of_one_bin_are_right_and_small(spark, stored):
    path, frame = stored
    got = recent_readings(spark.read.parquet(path), 10, 500).select("reading_id", "rank").collect()
    want = frame.filter("bin_id = 500").orderBy(F.desc("timestamp"), F.desc("reading_id")).limit(10).collect()
    assert [r.reading_id for r in sorted(got, key=lambda r: r["rank"])] == [r.reading_id for r in want]
    both = spark.read.parquet(path).filter("bin_id = 500 AND reading_date = DATE'2024-01-02'")
    assert both.count() == PER_DAY and 10 * scanned_rows(both.select("reading_id")) <= BINS * PER_DAY
