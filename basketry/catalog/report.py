"""The report job's figures, registered with reference SQL."""

from __future__ import annotations

from datetime import date

from basketry.catalog.core import DEF, from_query, register, wh
from basketry.catalog.pages import _kpi_sql
from basketry.plans import report as R
from basketry.plans import sales as S
from basketry.plans.filters import Filters
from basketry.profile import TEST_PROFILE

_Y2 = TEST_PROFILE.compare_years[1]
H1 = Filters(date(_Y2, 1, 1), date(_Y2, 6, 30))
register("kpi_compare_h1", _kpi_sql(H1))(lambda s, d: S.kpi_compare(wh(s, d), H1))


def _f(section: str, figure: str, expr: str, src: str) -> str:
    return f"SELECT '{section}' AS section, '{figure}' AS figure, CAST({expr} AS DOUBLE) AS value FROM {src}"


_parts = [_f("overview", k, k, from_query("kpi_derived")) for k in (
    "orders", "revenue", "aov", "freight_per_order", "customers", "revenue_change", "orders_change",
    "customers_change")]
_parts += [_f("overview", "h1_orders", "orders", from_query("kpi_compare_h1")),
           _f("overview", "h1_revenue", "revenue", from_query("kpi_compare_h1")),
           _f("overview", "categories", "count(*)", from_query("sales_by_category")),
           _f("overview", "top10_products_share", "share", from_query("top_products_share")),
           _f("trends", "same_months_revenue_growth", "max(CASE WHEN measure = 'revenue' THEN growth END)",
              from_query("yoy_growth")),
           _f("trends", "same_months_orders_growth", "max(CASE WHEN measure = 'orders' THEN growth END)",
              from_query("yoy_growth")),
           _f("trends", "orders_share_10_21", "share_10_21", from_query("hour_band_share")),
           _f("trends", "orders_share_0_5", "share_0_5", from_query("hour_band_share"))]
_parts += [_f("trends", f"national_{k}", k, from_query("state_overall"))
           for k in ("freight_ratio", "late_rate", "delivery_days", "aov")]
_parts += [_f("trends", "state_orders", "sum(orders)", from_query("seller_origin_late")),
           _f("trends", "state_seller_item_share", "CAST(sum(state_items) AS DOUBLE) / sum(items)",
              from_query("seller_origin_late"))]
_parts += [_f("rfm", k, k, from_query("rfm_overview")) for k in ("customers", "repeat_rate", "median_recency",
                                                                  "churn_rate")]
_parts += [_f("rfm", "single_purchase_share", "max(CASE WHEN f_score = 1 THEN share END)", from_query("f_score_share")),
           _f("churn", "crossing_in_30_days", "coalesce(sum(CASE WHEN bucket = 151 THEN customers END), 0)",
              from_query("recency_histogram")),
           _f("churn", "states_with_300_customers", "count_if(customers >= 300)", from_query("churn_by_state")),
           _f("churn", "cooling_list_size", "count(*)", from_query("cooling_customers")),
           _f("churn", "cooling_list_min", "min(monetary)", from_query("cooling_customers")),
           _f("churn", "cooling_list_max", "max(monetary)", from_query("cooling_customers")),
           _f("decision", "target_customers", "customers", from_query("target_cohort")),
           _f("decision", "target_aov", "aov", from_query("target_cohort")),
           _f("decision", "organic_rate", "repeat_rate", from_query("pool_kpis")),
           _f("decision", "best_profit", "profit", from_query("campaign_best")),
           _f("decision", "best_breakeven", "breakeven", from_query("campaign_best"))]

def _rows(section: str, prefix: str, figures: dict[str, str], src: str) -> list[str]:
    return [f"SELECT '{section}' AS section, {prefix} || '_{name}' AS figure, CAST({expr} AS DOUBLE) AS value FROM {src}"
            for name, expr in figures.items()]


_parts += _rows("overview", "category", {"orders": "orders"},
                f"(SELECT * FROM {from_query('sales_by_category')} ORDER BY orders DESC, category LIMIT 5) five")
_parts += _rows("trends", "'weekday_' || day_of_week", {"orders": "orders", "share": "share"}, from_query("weekday_share"))
_parts += _rows("trends", "CASE WHEN has_state THEN 'with_state_seller' ELSE 'without_state_seller' END",
                {"orders": "orders", "late_rate": "late_rate"}, from_query("seller_origin_late"))
_parts += [_f("rfm", k, k, from_query("rfm_overview")) for k in ("avg_monetary", "active", "cooling", "cooling_value")]
_parts += [_f("rfm", f"last_purchase_{k}", f"{k}(last_purchase)", from_query("rfm_overview")) for k in ("year", "month", "day")]
_parts += _rows("rfm", "'f_score_' || f_score", {"customers": "customers", "share": "share"}, from_query("f_score_share"))
_parts += _rows("decision", "'scenario_' || scenario_index", {k: k for k in R.SCENARIO_FIGURES}, from_query("campaign_evaluate"))

_parts += _rows("trends", "'month_' || year || '_' || month", {"revenue": "revenue", "orders": "orders"}, from_query("same_months_by_year"))
_parts += _rows("trends", "'busy_slot_' || day_of_week || '_' || hour", {"orders": "orders"}, from_query("peak_slot"))

register("report_numbers", " UNION ALL ".join(_parts))(lambda s, d: R.report_figures(wh(s, d), DEF))
