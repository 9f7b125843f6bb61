"""Finishing computations: the numbers the pages derive from query results.

The source does these steps in pandas after collecting each result.  Here
they stay DataFrame transforms over the (already aggregated, small) query
outputs, so a caller collects only the final figures.  Shares use a one-row
total attached by broadcast; dense grids are generated, not cross-joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.columns import (
    CHURN_DAYS,
    COOLING_FROM,
    SEGMENT_ORDER,
    money_sum,
    ordered_sum,
    safe_divide,
    title_case,
)
from basketry.operators.scalar import attach_scalar
from basketry.operators.share import with_shares
from basketry.operators.topk import order_small, top_k

# Payment-type labels (display names; unknown types keep their code).
PAYMENT_LABELS = {
    "credit_card": "Credit card",
    "boleto": "Boleto",
    "voucher": "Voucher",
    "debit_card": "Debit card",
    "not_defined": "Not defined",
    "unknown": "No payment data",
}
# Segment value tiers and the suggested action per segment.
SEGMENT_TIER = {
    "Champions": "High value",
    "Loyal Customers": "High value",
    "Promising / New Customers": "Growing",
    "Potential Loyalists": "Growing",
    "About to Sleep": "At risk",
    "At Risk / Need Attention": "At risk",
    "Lost / Hibernating": "At risk",
}
SEGMENT_ACTION = {
    "Champions": "VIP offers, early access to new products, ask for reviews and referrals",
    "Loyal Customers": "Loyalty points, cross-sell from the categories already bought",
    "Promising / New Customers": "Post-purchase care mail, second-order voucher within 30 days",
    "Potential Loyalists": "Remind of viewed products, free shipping on the next order",
    "About to Sleep": "Short-lived offer to bring them back before they lapse",
    "At Risk / Need Attention": "Personal contact and a deep offer: they used to buy often",
    "Lost / Hibernating": "No big budget; holiday-season messages only",
}
CHURN_MIN_CUSTOMERS = 300
WEEKDAY_BAND = (10, 21)  # hours 10..21 inclusive
NIGHT_BAND = (0, 5)  # hours 0..5 inclusive
R_ORDER = (5, 4, 3, 2, 1)
F_ORDER = (1, 3, 4, 5)


def _map(mapping: dict, column: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[column]


def _rank_of(mapping_order: Sequence, column: Column) -> Column:
    return _map({v: i for i, v in enumerate(mapping_order)}, column)


# ------------------------------------------------------------ overview page

def kpi_derived(kpi: DataFrame) -> DataFrame:
    """AOV and freight per order (0 when no orders); % change vs previous
    (null when the previous value is 0 or absent)."""
    k = kpi.fillna(0)

    def per_order(num: str, orders: str) -> Column:
        return F.when(F.col(orders) != 0, F.col(num) / F.col(orders)).otherwise(F.lit(0.0))

    k = k.select(
        "*",
        per_order("revenue", "orders").alias("aov"),
        per_order("freight", "orders").alias("freight_per_order"),
        per_order("prev_revenue", "prev_orders").alias("prev_aov"),
        per_order("prev_freight", "prev_orders").alias("prev_freight_per_order"),
    )

    def change(cur: str, prev: str) -> Column:
        return F.when(F.col(prev) != 0, (F.col(cur) - F.col(prev)) / F.col(prev))

    return k.select(
        F.col("orders").cast("bigint").alias("orders"),
        "revenue", "aov", "freight_per_order",
        F.col("customers").cast("bigint").alias("customers"),
        change("revenue", "prev_revenue").alias("revenue_change"),
        change("orders", "prev_orders").alias("orders_change"),
        change("aov", "prev_aov").alias("aov_change"),
        change("freight_per_order", "prev_freight_per_order").alias("freight_per_order_change"),
        change("customers", "prev_customers").alias("customers_change"),
    )


def period_partial_flag(trend: DataFrame, start: date, end: date, months: int, period: str = "period") -> DataFrame:
    """A period is partial if it starts before the filter or ends after it."""
    p = F.to_date(F.col(period))
    period_end = F.date_sub(F.add_months(p, months), 1)
    return trend.withColumn("partial", (p < F.lit(start)) | (period_end > F.lit(end)))


def peak_full_period(flagged: DataFrame, field: str, period: str = "period") -> DataFrame:
    """Best period among complete ones; all periods when none is complete."""
    return top_k(flagged, [("partial", False), (field, True), (period, False)], 1)


def category_rank(categories: DataFrame, field: str = "revenue", n: int = 10) -> DataFrame:
    return top_k(categories, [(field, True), ("category", False)], n)


def payment_share(payments: DataFrame) -> DataFrame:
    out = with_shares(payments, ["orders"], suffix="_share")
    label = F.coalesce(_map(PAYMENT_LABELS, F.col("payment_type")), F.col("payment_type"))
    return out.select("payment_type", "orders", F.col("orders_share").alias("share"), label.alias("label"))


def product_labels(products: DataFrame) -> DataFrame:
    """Short product label: the first 8 characters of the id and an ellipsis."""
    return products.withColumn("product", F.concat(F.substring(F.col("product_id").cast("string"), 1, 8), F.lit("…")))


def city_labels(cities: DataFrame) -> DataFrame:
    """'City · STATE' with the city in title case."""
    return cities.withColumn("label", F.concat(title_case("city"), F.lit(" · "), F.col("state")))


def top_products_share(products: DataFrame, kpi: DataFrame) -> DataFrame:
    top = products.agg(money_sum("revenue").alias("top_revenue"), F.count(F.lit(1)).alias("products"))
    total = kpi.select(F.col("revenue").alias("period_revenue"))
    out = attach_scalar(top, total)
    return out.select("products", "top_revenue", "period_revenue",
                      safe_divide(F.col("top_revenue"), F.col("period_revenue")).alias("share"))


# --------------------------------------------------------------- trends page

def yoy_pivot(yoy: DataFrame, field: str, years: tuple[int, int]) -> DataFrame:
    """month x year pivot of ``field`` (values listed, so no extra pass)."""
    return order_small(yoy.groupBy("month").pivot("year", list(years)).agg(F.sum(field)), "month")


def yoy_growth(yoy: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Sum over the compared months per year and growth second/first - 1,
    only when both years are present."""
    y1, y2 = years
    totals = {"revenue": money_sum, "orders": lambda c: F.sum(c).cast("double")}
    sums = [total(F.when(F.col("year") == y, F.col(field))).alias(f"{field}_{k}") for field, total in totals.items() for k, y in enumerate((y1, y2))]
    first, second = F.col("x.first_year_total"), F.col("x.second_year_total")
    rows = F.array(*[F.struct(F.lit(f).alias("measure"), F.col(f"{f}_0").alias("first_year_total"), F.col(f"{f}_1").alias("second_year_total")) for f in totals])
    one = yoy.agg(*sums).select(F.explode(rows).alias("x"))
    return one.select("x.*", F.when(first.isNotNull() & second.isNotNull() & (first != 0), second / first - 1).alias("growth"))


def weekday_hour_grid(spark: SparkSession, grid: DataFrame) -> DataFrame:
    """Dense 7 x 24 grid (1 = Sunday), missing slots 0."""
    cells = spark.range(7 * 24).select(
        ((F.col("id") - F.col("id") % 24) / 24 + 1).cast("bigint").alias("day_of_week"),
        (F.col("id") % 24).cast("bigint").alias("hour"),
    )
    g = grid.select("day_of_week", "hour", "orders")
    return cells.join(F.broadcast(g), ["day_of_week", "hour"], "left").select(
        "day_of_week", "hour", F.coalesce(F.col("orders"), F.lit(0)).cast("bigint").alias("orders")
    )


def peak_slots(grid: DataFrame, n: int = 3) -> DataFrame:
    return top_k(grid, [("orders", True), ("day_of_week", False), ("hour", False)], n)


def weekday_share(grid: DataFrame) -> DataFrame:
    """Orders and share per weekday; ``is_busiest`` marks the first day with the most orders."""
    by_day = grid.groupBy("day_of_week").agg(F.sum("orders").alias("orders"))
    shares = with_shares(by_day, ["orders"], suffix="_share").withColumnRenamed("orders_share", "share")
    busiest = top_k(by_day, [("orders", True), ("day_of_week", False)], 1).select(F.col("day_of_week").alias("__b"))
    return attach_scalar(shares, busiest).select(
        "day_of_week", "orders", "share", (F.col("day_of_week") == F.col("__b")).alias("is_busiest"))


def hour_band_share(grid: DataFrame) -> DataFrame:
    h = F.col("hour")
    total = F.sum("orders").cast("double")
    return grid.agg(
        safe_divide(F.sum(F.when(h.between(*WEEKDAY_BAND), F.col("orders"))).cast("double"), total).alias(
            "share_10_21"),
        safe_divide(F.sum(F.when(h.between(*NIGHT_BAND), F.col("orders"))).cast("double"), total).alias(
            "share_0_5"),
    )


def state_share(states: DataFrame) -> DataFrame:
    out = with_shares(states, ["revenue", "orders"], suffix="_share", money=["revenue"])
    return out.withColumnRenamed("revenue_share", "share_revenue").withColumnRenamed("orders_share", "share_orders")


def state_rank(states: DataFrame, field: str) -> DataFrame:
    """States with a value for ``field``, ranked high to low; share of the
    total for additive measures; ``is_leader`` marks the first."""
    data = states.filter(F.col(field).isNotNull()).select("state", field)
    if field in ("revenue", "orders"):
        data = with_shares(data, [field], suffix="_share", money=["revenue"]).withColumnRenamed(f"{field}_share", "share")
    else:
        data = data.withColumn("share", F.lit(None).cast("double"))
    ranked = top_k(data, [(field, True), ("state", False)], None)
    leader = top_k(data, [(field, True), ("state", False)], 1).select(F.col("state").alias("leader"))
    return attach_scalar(ranked, leader).select(
        "state", field, "share", (F.col("state") == F.col("leader")).alias("is_leader"))


def state_overall(states: DataFrame) -> DataFrame:
    """National figures rebuilt from the per-state rows: freight ratio from
    revenue / (1 + ratio), late rate and delivery days weighted by delivered
    orders, AOV from the sums.  One row per state: the double terms are added
    in a fixed order (``ordered_sum``) so the figures do not depend on it."""
    ratio = F.col("freight_ratio")
    price = F.col("revenue") / (1 + ratio)
    w = F.col("delivered_orders").cast("double")
    terms = states.select(
        (price * ratio).alias("fr_num"), F.when(ratio.isNotNull(), price).alias("fr_den"),
        (F.col("late_rate") * w).alias("lt_num"), F.when(F.col("late_rate").isNotNull(), w).alias("lt_den"),
        (F.col("delivery_days") * w).alias("dd_num"), F.when(F.col("delivery_days").isNotNull(), w).alias("dd_den"),
        "revenue", "orders",
    )
    return terms.agg(
        safe_divide(ordered_sum("fr_num"), ordered_sum("fr_den")).alias("freight_ratio"),
        safe_divide(ordered_sum("lt_num"), F.sum("lt_den")).alias("late_rate"),
        safe_divide(ordered_sum("dd_num"), F.sum("dd_den")).alias("delivery_days"),
        safe_divide(money_sum("revenue"), F.sum("orders").cast("double")).alias("aov"),
    )


# ------------------------------------------------------------------ RFM page

def segment_profile(segments: DataFrame) -> DataFrame:
    """Shares, value index, tier, fixed display order and action per segment."""
    s = with_shares(segments.filter(F.col("customers").isNotNull()), ["customers", "revenue"], suffix="_share",
                    money=["revenue"])
    s = s.withColumnRenamed("customers_share", "customer_share").withColumnRenamed("revenue_share", "revenue_share")
    return s.select(
        "segment",
        _map(SEGMENT_TIER, F.col("segment")).alias("tier"),
        _rank_of(SEGMENT_ORDER, F.col("segment")).cast("bigint").alias("display_order"),
        "customers",
        "revenue",
        "customer_share",
        "revenue_share",
        safe_divide(F.col("revenue_share"), F.col("customer_share")).alias("value_index"),
        _map(SEGMENT_ACTION, F.col("segment")).alias("action"),
    )


def rfm_grid(spark: SparkSession, matrix: DataFrame) -> DataFrame:
    """Dense R (5..1) x F (1, 3, 4, 5) grid with log10(n + 1) intensity and
    the single-purchase share (column F = 1)."""
    cells = spark.range(len(R_ORDER) * len(F_ORDER)).select(
        F.element_at(F.array(*[F.lit(r) for r in R_ORDER]),
                     ((F.col("id") - F.col("id") % len(F_ORDER)) / len(F_ORDER) + 1).cast("int"))
        .cast("bigint").alias("r_score"),
        F.element_at(F.array(*[F.lit(f) for f in F_ORDER]), (F.col("id") % len(F_ORDER) + 1).cast("int"))
        .cast("bigint").alias("f_score"),
    )
    m = matrix.select("r_score", "f_score", "customers")
    dense = cells.join(F.broadcast(m), ["r_score", "f_score"], "left").select(
        "r_score", "f_score", F.coalesce(F.col("customers"), F.lit(0)).cast("bigint").alias("customers"))
    single = dense.agg(safe_divide(F.sum(F.when(F.col("f_score") == 1, F.col("customers"))).cast("double"),
                                   F.sum("customers")).alias("single_purchase_share"))
    return attach_scalar(dense, single).withColumn("intensity", F.log10(F.col("customers") + 1))


def f_score_share(matrix: DataFrame) -> DataFrame:
    by_f = matrix.groupBy("f_score").agg(F.sum("customers").alias("customers"))
    return with_shares(by_f, ["customers"], suffix="_share").withColumnRenamed("customers_share", "share")


# ---------------------------------------------------------------- churn page

def recency_status(histogram: DataFrame) -> DataFrame:
    b = F.col("bucket")
    return histogram.select(
        "bucket",
        F.concat(b.cast("string"), F.lit("-"), (b + 29).cast("string")).alias("label"),
        F.when(b > CHURN_DAYS, "churned").when(b >= COOLING_FROM, "cooling").otherwise("active").alias("status"),
        "customers",
        "monetary",
    )


def churn_ranked_states(states: DataFrame, min_customers: int = CHURN_MIN_CUSTOMERS) -> DataFrame:
    """States with at least ``min_customers`` (all states if none qualify),
    by churn rate; overall rate weighted over all states; worst flagged."""
    overall = states.agg(
        safe_divide(ordered_sum(F.col("churn_rate") * F.col("customers")), F.sum("customers").cast("double"))
        .alias("overall_churn_rate"),
        F.count_if(F.col("customers") >= min_customers).alias("__qualified"),
    )
    s = attach_scalar(states, overall)
    shown = s.filter((F.col("__qualified") == 0) | (F.col("customers") >= min_customers))
    worst = top_k(shown, [("churn_rate", True), ("state", False)], 1).select(F.col("state").alias("__worst"))
    return attach_scalar(shown, worst).select(
        "state", "customers", "churn_rate", "overall_churn_rate", (F.col("state") == F.col("__worst")).alias("is_worst"))


def churn_ranked_categories(categories: DataFrame) -> DataFrame:
    worst = top_k(categories, [("churn_rate", True), ("category", False)], 1).select(
        F.col("category").alias("__worst"))
    return attach_scalar(categories, worst).select(
        "category", "customers", "churn_rate", (F.col("category") == F.col("__worst")).alias("is_worst"))


# ------------------------------------------------------------- campaign pool

COOLING_BUCKETS = (COOLING_FROM, CHURN_DAYS - 29)  # bucket starts 91..151


def _cooling(pool: DataFrame) -> DataFrame:
    return pool.filter(F.col("bucket").between(*COOLING_BUCKETS))


def pool_kpis(pool: DataFrame) -> DataFrame:
    """Cooling customers and money, those crossing the churn line within 30
    days (bucket 151), historic repeat rate (customers with 2+ orders)."""
    b = F.col("bucket")
    cool = b.between(*COOLING_BUCKETS)
    return pool.agg(
        F.sum(F.when(cool, F.col("customers")).otherwise(0)).alias("cooling_customers"),
        F.sum(F.when(b == COOLING_BUCKETS[1], F.col("customers")).otherwise(0)).alias("crossing_customers"),
        F.coalesce(money_sum(F.when(cool, F.col("monetary"))), F.lit(0.0)).alias("cooling_monetary"),
        safe_divide(F.sum("repeaters").cast("double"), F.sum("customers")).alias("repeat_rate"),
    )


def pool_by_segment(pool: DataFrame) -> DataFrame:
    by = _cooling(pool).groupBy("segment").agg(F.sum("customers").alias("customers"),
                                               money_sum("monetary").alias("monetary"))
    by = with_shares(by, ["customers"], suffix="_share").withColumnRenamed("customers_share", "share")
    top = top_k(by, [("customers", True), ("segment", False)], 1).select(F.col("segment").alias("__top"))
    return attach_scalar(by, top).select(
        "segment",
        _rank_of(SEGMENT_ORDER, F.col("segment")).cast("bigint").alias("display_order"),
        "customers", "monetary", "share",
        safe_divide(F.col("monetary"), F.col("customers")).alias("mean_monetary"),
        (F.col("segment") == F.col("__top")).alias("is_top"),
    )


def pool_by_state(pool: DataFrame, n: int = 10) -> DataFrame:
    by = _cooling(pool).groupBy("state").agg(F.sum("customers").alias("customers"),
                                             money_sum("monetary").alias("monetary"))
    return top_k(by.withColumn("mean_monetary", safe_divide(F.col("monetary"), F.col("customers"))),
                 [("customers", True), ("state", False)], n)


def default_bucket_range(pool: DataFrame) -> DataFrame:
    """91..151 when both buckets exist in the pool, else its min..max."""
    b = F.col("bucket")
    return pool.agg(
        F.when((F.count_if(b == COOLING_BUCKETS[0]) > 0) & (F.count_if(b == COOLING_BUCKETS[1]) > 0),
               F.lit(COOLING_BUCKETS[0])).otherwise(F.min(b)).cast("bigint").alias("bucket_from"),
        F.when((F.count_if(b == COOLING_BUCKETS[0]) > 0) & (F.count_if(b == COOLING_BUCKETS[1]) > 0),
               F.lit(COOLING_BUCKETS[1])).otherwise(F.max(b)).cast("bigint").alias("bucket_to"),
    )


def _in_range(pool: DataFrame, buckets: tuple[int, int] | None) -> DataFrame:
    """Pool rows of the given buckets; by default those of ``default_bucket_range``."""
    b = F.col("bucket")
    if buckets is not None:
        return pool.filter(b.between(*buckets))
    return attach_scalar(pool, default_bucket_range(pool)).filter(b.between(F.col("bucket_from"), F.col("bucket_to"))).drop("bucket_from", "bucket_to")


def target_cohort(pool: DataFrame, segments: Sequence[str], buckets: tuple[int, int] | None = None) -> DataFrame:
    """Cohort size and AOV (= money / orders, 0 when no orders); the default range of buckets unless one is given."""
    t = _in_range(pool, buckets).filter(F.col("segment").isin(*segments))
    return t.agg(
        F.coalesce(F.sum("customers"), F.lit(0)).cast("double").alias("customers"),
        F.coalesce(F.sum("orders"), F.lit(0)).cast("double").alias("orders"),
        F.coalesce(money_sum("monetary"), F.lit(0.0)).alias("monetary"),
    ).withColumn("aov", F.when(F.col("orders") != 0, F.col("monetary") / F.col("orders")).otherwise(F.lit(0.0)))


def cohorts_by(pool: DataFrame, key: str, buckets: tuple[int, int] | None = None) -> DataFrame:
    """Cohorts per ``key`` (segment, state, ...) with size and AOV; the default range of buckets unless one is given."""
    t = _in_range(pool, buckets).groupBy(key).agg(
        F.sum("customers").cast("double").alias("customers"),
        F.sum("orders").cast("double").alias("orders"),
        money_sum("monetary").alias("monetary"),
    )
    return t.withColumn("aov", F.when(F.col("orders") != 0, F.col("monetary") / F.col("orders")).otherwise(F.lit(0.0)))
