"""The report job: every headline figure of the report as one table.

``report_figures`` returns ``(section, figure, value)`` rows built from the
page queries and finishing steps; ``write_report`` writes that table and the
per-section detail tables below one output folder.  Each source frame is read
once and unfolded into its figures; only the two ends of the default target
range (one row) come to the driver.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import SEGMENT_ORDER
from basketry.operators.scalar import attach_scalar
from basketry.operators.topk import top_k
from basketry.plans import campaign as K
from basketry.plans import customers as C
from basketry.plans import finish as Fn
from basketry.plans import sales as S
from basketry.plans.filters import Filters, default_filters
from basketry.plans.warehouse import Warehouse

CHURN_STATE_MIN = 300


def first_half(wh: Warehouse) -> Filters:
    y = wh.profile.compare_years[1]
    return Filters(date(y, 1, 1), date(y, 6, 30))


def _fig(df: DataFrame, section: str, figures: dict[str, Column]) -> DataFrame:
    """One row for each figure of a one-row frame: the frame is computed once and unfolded."""
    rows = F.array(*[F.struct(F.lit(name).alias("figure"), v.cast("double").alias("value")) for name, v in figures.items()])
    return df.select(F.explode(rows).alias("x")).select(F.lit(section).alias("section"), "x.*")


def _each(df: DataFrame, section: str, prefix: Column, figures: dict[str, Column]) -> DataFrame:
    """The figures of every row of a small frame, each named by the row's prefix."""
    rows = F.array(*[F.struct(F.concat(prefix, F.lit(f"_{name}")).alias("figure"), v.cast("double").alias("value")) for name, v in figures.items()])
    return df.select(F.explode(rows).alias("x")).select(F.lit(section).alias("section"), "x.*")


SCENARIO_FIGURES = ("reached", "buyers", "revenue", "discount_cost", "contact_cost", "spend", "profit", "roi", "breakeven", "response")


def report_figures(wh: Warehouse, f: Filters | None = None) -> DataFrame:
    """(section, figure, value); frames that several figures start from are written once."""
    f = f or default_filters(wh.profile)
    c = F.col
    out: list[DataFrame] = []
    kpi = wh.save_result("report/kpi", S.kpi_compare(wh, f))
    out.append(_fig(Fn.kpi_derived(kpi), "overview", {k: c(k) for k in (
        "orders", "revenue", "aov", "freight_per_order", "customers", "revenue_change", "orders_change",
        "customers_change")}))
    h1 = S.kpi_compare(wh, first_half(wh))
    out.append(_fig(h1, "overview", {"h1_orders": c("orders"), "h1_revenue": c("revenue")}))
    categories = wh.save_result("report/categories", S.sales_by_category(wh, f))
    out.append(_fig(categories.agg(F.count(F.lit(1)).alias("n")), "overview", {"categories": c("n")}))
    five = top_k(categories, [("orders", True), ("category", False)], 5)
    out.append(_each(five, "overview", c("category"), {"orders": c("orders")}))
    share = Fn.top_products_share(S.top_products(wh, f, 10), kpi)
    out.append(_fig(share, "overview", {"top10_products_share": c("share")}))

    same = wh.save_result("report/same_months", S.same_months_by_year(wh, f))
    month = F.concat(F.lit("month_"), c("year").cast("string"), F.lit("_"), c("month").cast("string"))
    out.append(_each(same, "trends", month, {"revenue": c("revenue"), "orders": c("orders")}))
    yoy = Fn.yoy_growth(same, wh.profile.compare_years)
    growth = yoy.agg(F.max(F.when(c("measure") == "revenue", c("growth"))).alias("r"),
                     F.max(F.when(c("measure") == "orders", c("growth"))).alias("o"))
    out.append(_fig(growth, "trends", {"same_months_revenue_growth": c("r"), "same_months_orders_growth": c("o")}))
    grid = wh.save_result("report/weekday_hour", S.orders_by_weekday_hour(wh, f))
    out.append(_fig(Fn.hour_band_share(grid), "trends", {"orders_share_10_21": c("share_10_21"), "orders_share_0_5": c("share_0_5")}))
    day = F.concat(F.lit("weekday_"), c("day_of_week").cast("string"))
    out.append(_each(Fn.weekday_share(grid), "trends", day, {"orders": c("orders"), "share": c("share")}))
    slot = F.concat(F.lit("busy_slot_"), c("day_of_week").cast("string"), F.lit("_"), c("hour").cast("string"))
    out.append(_each(Fn.peak_slots(grid, 3), "trends", slot, {"orders": c("orders")}))
    nat = Fn.state_overall(S.state_summary(wh, f))
    out.append(_fig(nat, "trends", {"national_freight_ratio": c("freight_ratio"), "national_late_rate": c("late_rate"),
                                    "national_delivery_days": c("delivery_days"), "national_aov": c("aov")}))
    buyers, sellers = wh.profile.origin_states
    origin = wh.save_result("report/origin", S.seller_origin_late(wh, Filters(f.start, f.end, (buyers,), ()), sellers))
    both = origin.agg(F.sum("orders").alias("o"), (F.sum("state_items") / F.sum("items")).alias("s"))
    out.append(_fig(both, "trends", {"state_orders": c("o"), "state_seller_item_share": c("s")}))
    group = F.when(c("has_state"), "with_state_seller").otherwise("without_state_seller")
    out.append(_each(origin, "trends", group, {"orders": c("orders"), "late_rate": c("late_rate")}))

    ov = C.rfm_overview(wh, f)
    out.append(_fig(ov, "rfm", {k: c(k) for k in ("customers", "repeat_rate", "median_recency", "avg_monetary", "churn_rate",
                                                 "active", "cooling", "cooling_value")}
                    | {"last_purchase_year": F.year("last_purchase"), "last_purchase_month": F.month("last_purchase"),
                       "last_purchase_day": F.day("last_purchase")}))
    by_f = wh.save_result("report/f_score", Fn.f_score_share(C.rfm_matrix(wh, f)))
    single = by_f.agg(F.max(F.when(c("f_score") == 1, c("share"))).alias("s"))
    out.append(_fig(single, "rfm", {"single_purchase_share": c("s")}))
    out.append(_each(by_f, "rfm", F.concat(F.lit("f_score_"), c("f_score").cast("string")), {"customers": c("customers"), "share": c("share")}))

    hist = C.recency_histogram(wh, f).agg(
        F.coalesce(F.sum(F.when(c("bucket") == 151, c("customers"))), F.lit(0)).alias("x"))
    out.append(_fig(hist, "churn", {"crossing_in_30_days": c("x")}))
    big = C.churn_by_state(wh, f).agg(F.count_if(c("customers") >= CHURN_STATE_MIN).alias("n"))
    out.append(_fig(big, "churn", {"states_with_300_customers": c("n")}))
    cool = C.cooling_customers(wh, f).agg(F.count(F.lit(1)).alias("n"), F.min("monetary").alias("lo"),
                                          F.max("monetary").alias("hi"))
    out.append(_fig(cool, "churn", {"cooling_list_size": c("n"), "cooling_list_min": c("lo"), "cooling_list_max": c("hi")}))

    pool = wh.save_result("report/pool", C.campaign_pool(wh, f))
    cohort = attach_scalar(Fn.target_cohort(pool, SEGMENT_ORDER), Fn.pool_kpis(pool).select("repeat_rate"))
    out.append(_fig(cohort, "decision", {"target_customers": c("customers"), "target_aov": c("aov"),
                                         "organic_rate": c("repeat_rate")}))
    cases = wh.save_result("report/scenarios", K.evaluate(cohort, K.DEFAULT_SCENARIOS, organic="repeat_rate"))
    out.append(_fig(K.best_scenario(cases), "decision", {"best_profit": c("profit"), "best_breakeven": c("breakeven")}))
    name = F.concat(F.lit("scenario_"), c("scenario_index").cast("string"))
    out.append(_each(cases, "decision", name, {k: c(k) for k in SCENARIO_FIGURES}))
    return reduce(DataFrame.unionByName, out)


def write_report(wh: Warehouse, out_dir: str, f: Filters | None = None) -> None:
    """The figures plus the detail tables, one folder each (CSV with header)."""
    f = f or default_filters(wh.profile)
    pool = wh.save_result("report/pool", C.campaign_pool(wh, f))
    tables = {
        "figures": report_figures(wh, f),
        "revenue_by_month": S.revenue_by_month(wh, f),
        "sales_by_quarter": S.sales_by_period(wh, f, "quarter"),
        "categories": Fn.category_rank(S.sales_by_category(wh, f)),
        "payments": Fn.payment_share(S.payment_mix(wh, f)),
        "top_products": S.top_products(wh, f),
        "states": Fn.state_share(S.state_summary(wh, f)),
        "top_cities": S.top_cities(wh, f),
        "segments": Fn.segment_profile(C.rfm_segments(wh, f)),
        "recency": Fn.recency_status(C.recency_histogram(wh, f)),
        "churn_states": Fn.churn_ranked_states(C.churn_by_state(wh, f)),
        "churn_categories": Fn.churn_ranked_categories(C.churn_by_last_category(wh, f)),
        "pool_by_segment": Fn.pool_by_segment(pool),
        "pool_by_state": Fn.pool_by_state(pool, 5),
    }
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out_dir}/{name}")
