"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from spendframe.plans import catalog  # noqa: E402
from spendframe.session import build_session  # noqa: E402

HEADLINE = [
    "rep_monthly",
    "rep_monthly_fx",
    "rep_category",
    "rep_trend",
    "rep_currency",
    "report_sections",
    "export_item_rows",
    "invoice_csv_rows",
    "batch_totals_rows",
    "job_progress",
    "job_files_status",
    "upload_admission",
    "dq_score",
    "dq_dup_asin",
    "checklist_b",
    "compare_all_jobs",
    "clean_final",
    "classify_format",
    "detect_language",
    "route_documents",
    "extract_headers",
    "extract_items",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries, seconds = catalog.all_queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    documents = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    extra = {}
    if "extract_headers" in seconds:
        extra["invoices_per_second"] = round(documents / seconds["extract_headers"], 1)
    total = round(sum(seconds.values()), 3)
    line = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir), **extra}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
