"""Benchmark the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

a ``noop`` write so the whole result is computed. Each run reads and derives its inputs, builds the
library plan (size checks included) and executes it in full; nothing is kept between runs. Deviations
from default settings are printed with the result: 8 shuffle partitions (``$BENCH_SHUFFLE_PARTITIONS``)
and the driver's memory. Prints one JSON line: the summed medians as the metric, per-query medians
(and minima) in seconds. With ``$BENCH_EVENT_LOG_DIR`` set, Spark
writes its event log there; ``tools/eventlog_summary.py`` turns it into per-query stage, task and
shuffle figures.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spendguard.registry import QUERIES  # noqa: E402
from spendguard.session import local_session  # noqa: E402

HEADLINE = [
    "budget_status",
    "price_as_of_usage",
    "job_stop_plan",
    "stop_plan_gated",
    "resume_plan",
    "current_spend",
    "targets_parsed",
    "stop_plan_targeted",
    "run_cancel_plan_targeted",
    "audit_rows_succeeded",
    "resume_previous_month",
    "price_as_of_usage_shuffled",
    "run_cancel_plan_targeted_shuffled",
    "budget_status_incremental",
    "enforcement_cycle",
    "resume_cycle",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    spark.sparkContext.setJobGroup(name, name)  # lets tools/eventlog_summary.py group the jobs per query
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    extra = {}
    if os.environ.get("BENCH_EVENT_LOG_DIR"):  # Spark's event log, for stage/task figures
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG_DIR"]}
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")), extra=extra)
    medians, minima = {}, {}
    for name in names:
        run_once(spark, name, sf_dir)  # warm-up
        times = [run_once(spark, name, sf_dir) for _ in range(runs)]
        medians[name] = round(statistics.median(times), 4)
        minima[name] = round(min(times), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(medians.values()), 4),
        "unit": "sec",
        "queries": medians,
        "min": minima,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "runs": runs,
        "cpus": cpus,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "driver_memory": spark.conf.get("spark.driver.memory"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
