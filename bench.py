"""Headline queries of the table engine, timed on a warm session.

Prints one JSON line. The tables are made before the clock starts for queries
that read; commands that change tables are timed with their commits.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

READS = ["insert_select_filter", "pred_compare", "part_year", "part_month", "join_inner", "join_semi", "join_lake_subqueries", "agg_having", "agg_cube", "win_row_number", "win_running_sum", "topn", "set_except"]
WRITES = ["insert_overwrite_filter", "update_rows", "delete_rows", "scd1_changes", "scd1_snapshot", "scd2_snapshot"]
RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from moraine.queries.base import engine_for, lake_table
    from moraine.queries.changes import CHANGES
    from moraine.queries.reads import READS as ALL_READS

    by_name = {q.name: q for q in (*ALL_READS, *CHANGES)}
    shared = engine_for(spark)
    for t in sorted({t for n in READS for t in by_name[n].tables}):
        lake_table(shared, sf_dir, t)
    out = {}
    for name in READS:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            by_name[name].result(shared, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        out[name] = round(median(times[1:]), 3)
    for name in WRITES:
        times = []
        for _ in range(2):
            start = time.perf_counter()
            by_name[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        out[name] = round(min(times), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
