"""Benchmark: build the marts, then run the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
``value`` is the total wall time: mart build plus every query run one
after another (each query is one ``collect`` of its final, small result).
``page_*`` entries are extra: each dashboard page's queries submitted
together, as the source's page loader does (one thread per query); they
are not part of ``value``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "kpi_compare", "revenue_by_month", "sales_by_period", "sales_by_category", "top_products", "payment_mix",
    "same_months_by_year", "orders_by_weekday_hour", "state_summary", "top_cities", "seller_origin_late",
    "rfm_overview", "rfm_segments", "rfm_matrix", "segment_customers", "recency_histogram", "churn_by_state",
    "churn_by_last_category", "cooling_customers", "campaign_pool", "campaign_targets", "filter_options",
    "kpi_derived", "segment_profile", "campaign_evaluate", "campaign_curve",
    "dq_unique", "dq_not_null", "dq_relationships", "check_report",
]

#: Timed too, but not part of ``value``: load and report jobs.
EXTRA = ["load_audit", "sink_truncate_append", "report_numbers"]

PAGES = {
    "overview": ["kpi_compare", "revenue_by_month", "sales_by_category", "payment_mix", "top_products"],
    "trends": ["sales_by_period_month", "sales_by_period", "same_months_by_year", "orders_by_weekday_hour",
               "state_summary", "top_cities"],
    "rfm": ["rfm_overview", "rfm_segments", "rfm_matrix", "segment_customers"],
    "churn": ["rfm_overview", "recency_histogram", "churn_by_state", "churn_by_last_category", "cooling_customers"],
    "decision": ["campaign_pool", "rfm_overview", "campaign_targets"],
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from basketry.catalog import QUERIES
    from basketry.catalog.core import wh
    from basketry.session import get_spark

    spark = get_spark(cpus)
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}
    t0 = time.perf_counter()
    w = wh(spark, sf_dir)
    w.build_all(threads=4)
    times["build_marts"] = round(time.perf_counter() - t0, 3)
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name][0](spark, sf_dir).collect()
        times[name] = round(time.perf_counter() - t, 3)
    total = round(sum(times.values()), 3)
    with ThreadPoolExecutor(max_workers=8) as pool:
        for page, names in PAGES.items():
            t = time.perf_counter()
            list(pool.map(lambda n: QUERIES[n][0](spark, sf_dir).collect(), names))
            times[f"page_{page}"] = round(time.perf_counter() - t, 3)
    for name in EXTRA:
        t = time.perf_counter()
        QUERIES[name][0](spark, sf_dir).collect()
        times[name] = round(time.perf_counter() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "marts_build_plus_headline_queries",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
