"""Headline queries on one folder; prints one JSON line.

``store_*`` entries time the writing of the derived tables the later queries read; the rest time one full
evaluation of a query each, results drained on the executors.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import catalog, testbed  # noqa: E402
from tidemark.session import local_session, release, use_folder  # noqa: E402

HEADLINE = [
    "panel_join", "scd2_intervals", "interval_semi", "listed_days", "daily_state", "state_checks", "rank_pct", "winsor",
    "industry_rank", "macd", "beta", "mart_features", "sequence_dataset", "daily_ic", "quantile_spread", "quantile_detail",
    "neutral_residuals", "neutral_ic", "quality", "correlation", "regime_ic", "recommend",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores))
    use_folder(spark, tempfile.mkdtemp(prefix="spark-bench-"))
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times: dict[str, float] = {}

    def timed(name, fn) -> None:
        start = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - start, 3)

    timed("store_raw", lambda: (testbed.cells(spark, folder), testbed.wide(spark, folder)))
    timed("store_state", lambda: testbed.state(spark, folder))
    timed("store_dataset", lambda: testbed.dataset(spark, folder))
    for name in sys.argv[1:] or HEADLINE:
        timed(name, lambda: catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    release(spark)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
