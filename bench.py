"""Time registered queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; one JSON line.

The star schema is loaded first and reported as its own entry. Each query then runs once to
warm up and ``$BENCH_RUNS`` times for its median, always over its whole result (noop sink).
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

HEADLINE = """tpcds_001 tpcds_002 tpcds_003 tpcds_004 tpcds_005 tpcds_007 tpcds_009 tpcds_012 tpcds_013 tpcds_014_ tpcds_016 tpcds_017 tpcds_018
tpcds_022 tpcds_023 tpcds_030 tpcds_033 tpcds_038 tpcds_040 tpcds_041 tpcds_045 tpcds_047 tpcds_050 tpcds_052 tpcds_054 tpcds_067 tpcds_070
tpcds_075 tpcds_080 tpcds_081 tpcds_087 tpcds_091 tpcds_100 joi_03 joi_05 joi_08 joi_15 agg_02 agg_05 agg_08 agg_16 win_01 win_07 set_03
arr_01 jsn_06 xml_01 stm_04 job_11 evt_08 evt_25 ver_03 ml_02 job_08 job_17""".split()


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tallyforge.catalogue import QUERIES
    from tallyforge.plans.mart import load_star_schema, open_mart
    from tallyforge.session import local_session, scratch

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "1"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus)
    start = time.perf_counter()
    load_star_schema(spark, sf_dir, scratch(spark, "bench-star"))
    seconds = {"load_star_schema": round(time.perf_counter() - start, 3)}
    open_mart(spark, sf_dir)
    for name in sorted(QUERIES):
        if not any(name.startswith(w) for w in wanted):
            continue
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(median(times[1:]), 3)
    print(json.dumps({"metric": "sum of query medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
