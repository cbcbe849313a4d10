"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the cores.  Each query is built and
all its rows are computed (noop sink); the value is the sum over the queries.
Names given as arguments, or ``--all``, replace the headline list.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from claimlens.plans.registry import QUERIES  # noqa: E402

HEADLINE = [
    "billtran", "billitems", "opservice", "dispenseditem", "dispensing", "opdx",
    "fdh_ins", "fdh_pat", "fdh_opd", "fdh_odx_by_visit", "fdh_cht", "fdh_cha", "fdh_dru", "fdh_phdb",
    "cipn_ipadt", "cipn_ipdx", "cipn_invoices", "cipn_billitems",
    "walkin_with_cancer", "cancer_missing_z", "check_nondrug_fdh", "audit_full", "fund_scoreboard",
    "delete_walkin_lines", "invoice_debt",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("claimlens-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [a for a in sys.argv[1:] if not a.startswith("--")] or HEADLINE
    if "--all" in sys.argv:
        names = list(QUERIES)
    # run queries outside the list first so that no timed query pays for the cold start
    for name in ("visit_expenses", "fdh_oop", "dense_ids"):
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        if "--verbose" in sys.argv:
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
