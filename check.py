"""Run registered queries against their SQL twins: ``python check.py [names ...]``."""

from __future__ import annotations

import os
import sys
import time

from fleetcheck import catalog, oracles
from fleetgauge.session import build_session
from tests.oracle_check import compare, duck


def main() -> int:
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, twins = catalog.queries(), oracles.oracle_sql()
    bad = 0
    for name in sys.argv[1:] or queries:
        start = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            diff = compare(con, frame, twins[name]) if name in twins else f"rows {frame.count()}"
        except Exception as error:  # report and go on with the next query
            diff = f"{type(error).__name__}: {str(error)[:700]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {name} {time.time() - start:.2f}s {diff or ''}",
              flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
