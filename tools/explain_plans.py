"""Write docs/PLANS.md: physical plans of the key queries and builds.

Usage: python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from basketry.catalog.core import DEF, FILTERED, wh  # noqa: E402
from basketry.operators.ntile import global_ntile  # noqa: E402
from basketry.operators.rownum import keyed_row_number  # noqa: E402
from basketry.plans import customers as C  # noqa: E402
from basketry.plans import models as M  # noqa: E402
from basketry.plans import sales as S  # noqa: E402
from basketry.session import get_spark  # noqa: E402


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree = text.split("\n\n")[0]
    details = re.findall(r"(PushedFilters: .*|ReadSchema: .*|Location: .*)", text)
    keep = [d for d in details if not d.startswith("Location")]
    return tree + "\n\n" + "\n".join(sorted(set(keep)))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark(8)
    spark.sparkContext.setLogLevel("OFF")
    w = wh(spark, sf)
    w.build_all()
    fact = w.table("fct_order_items_sales")
    rfm_in = M.rfm_recency(M.rfm_metrics(M.rfm_customer_orders(fact)))
    cases = [
        ("revenue_by_month, states + categories filter (one pruned scan, no join)",
         S.revenue_by_month(w, FILTERED)),
        ("kpi_compare (customer-grain distinct counts, no Expand)", S.kpi_compare(w, DEF)),
        ("state_summary (order-level roll-up, then state)", S.state_summary(w, DEF)),
        ("rfm_overview (RFM mart scan, unfiltered last date as a scalar subquery)", C.rfm_overview(w, FILTERED)),
        ("churn_by_last_category (category pre-computed in the RFM mart)", C.churn_by_last_category(w, DEF)),
        ("int_customers_deduplicated (partial max before the shuffle)", w.view("int_customers_deduplicated")),
        ("fct_sales_wide build (order-grain joins, one fact shuffle, date ranges)", w._plan("fct_sales_wide")),
        ("global_ntile with several ranges (6 ranges)",
         global_ntile(rfm_in, 5, [("recency_days", True), ("customer_unique_id", False)], "r_score",
                      ranges=6)),
        ("keyed_row_number: item number per order with hot orders split (12 ranges)",
         keyed_row_number(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_orderkey"],
                          [("l_linenumber", False), ("l_partkey", False), ("l_suppkey", False),
                           ("l_extendedprice", False)], "order_item_id", ranges=12)),
    ]
    out = ["# Physical plans", "", f"Generated by `tools/explain_plans.py` on `{sf}` (local[8]); "
           "AQE re-plans at run time, so these are the initial plans.", ""]
    for title, df in cases:
        out += [f"## {title}", "", "```", plan_text(df).strip(), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
