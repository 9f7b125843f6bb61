"""Sales questions: one pruned scan of ``fct_sales_wide`` plus aggregation.

Every function takes the warehouse and a ``Filters`` and returns a lazy
DataFrame.  Money is summed as decimal and cast to double last; averages
are ``sum / count`` in double so they do not depend on summation order.
"""

from __future__ import annotations

import calendar
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import as_double, count_if, safe_divide
from basketry.operators.topk import order_small, top_k
from basketry.plans.filters import Filters, sales_filter
from basketry.plans.models import sales_star_join
from basketry.plans.warehouse import Warehouse

def sales_base(wh: Warehouse, f: Filters) -> DataFrame:
    """Filtered star join (22 columns) read from the materialised wide table."""
    return sales_filter(wh.table("fct_sales_wide"), f)


def sales_base_joined(wh: Warehouse, f: Filters) -> DataFrame:
    """The same rows, joined at query time from the star schema."""
    j = sales_star_join(
        wh.table("fct_order_items_sales"), wh.table("dim_time"), wh.table("dim_customers"),
        wh.table("dim_products"), wh.table("dim_sellers"), wh.table("dim_payments"),
    )
    return sales_filter(j, f)


def _money(c: str | Column) -> Column:
    return as_double(F.sum(c))


def _avg(c: Column) -> Column:
    return safe_divide(F.sum(c).cast("double"), F.count(c))


def kpi_compare(wh: Warehouse, f: Filters) -> DataFrame:
    """Current and previous period in one widened scan, split at ``f.start``.

    An order has one customer and one purchase date, so distinct orders and
    customers per period come from one aggregate at (period, customer) grain
    (a single-distinct, two-phase aggregate) and a global sum over it, instead
    of four conditional distinct counts (an Expand that copies every row).
    """
    prev = f.previous(wh.profile.data_start)
    wide = replace(f, start=prev.start) if prev else f
    s = sales_base(wh, wide).withColumn("__cur", F.col("full_date") >= F.lit(f.start))
    per_customer = s.groupBy("__cur", "customer_unique_id").agg(
        F.countDistinct("order_id").alias("n_orders"),
        F.sum("item_total_amount").alias("amount"),
        F.sum("freight_value").alias("freight"),
    )
    cur, old = F.col("__cur"), ~F.col("__cur")
    zero = F.lit(0).cast("decimal(18,4)")

    def part(cond: Column, prefix: str) -> list[Column]:
        return [
            F.coalesce(F.sum(F.when(cond, F.col("n_orders"))), F.lit(0)).cast("bigint").alias(f"{prefix}orders"),
            _money(F.when(cond, F.col("amount")).otherwise(zero)).alias(f"{prefix}revenue"),
            _money(F.when(cond, F.col("freight")).otherwise(zero)).alias(f"{prefix}freight"),
            F.count_if(cond & F.col("customer_unique_id").isNotNull()).alias(f"{prefix}customers"),
        ]

    return per_customer.agg(*part(cur, ""), *part(old, "prev_"))


def _period(grain: str) -> Column:
    return F.trunc(F.col("full_date"), grain).cast("timestamp_ntz")


def revenue_by_month(wh: Warehouse, f: Filters) -> DataFrame:
    return (
        sales_base(wh, f)
        .groupBy(_period("month").alias("month"))
        .agg(_money("item_total_amount").alias("revenue"), F.countDistinct("order_id").alias("orders"))
        .transform(lambda d: order_small(d, "month"))
    )


def sales_by_period(wh: Warehouse, f: Filters, grain: str) -> DataFrame:
    if grain not in ("month", "quarter"):
        raise ValueError(grain)
    return (
        sales_base(wh, f)
        .groupBy(_period(grain).alias("period"))
        .agg(_money("item_total_amount").alias("revenue"), F.countDistinct("order_id").alias("orders"))
        .transform(lambda d: order_small(d, "period"))
    )


def sales_by_category(wh: Warehouse, f: Filters) -> DataFrame:
    return (
        sales_base(wh, f)
        .groupBy("category")
        .agg(_money("item_total_amount").alias("revenue"), F.countDistinct("order_id").alias("orders"))
    )


def top_products(wh: Warehouse, f: Filters, limit: int = 10) -> DataFrame:
    # category is constant per product: a grouping key, not a string max
    agg = sales_base(wh, f).groupBy("product_id", "category").agg(
        _money("item_total_amount").alias("revenue"),
        F.countDistinct("order_id").alias("orders"),
        _avg(F.col("price")).alias("avg_price"),
    )
    return top_k(agg, [("revenue", True), ("product_id", False)], limit)


def payment_mix(wh: Warehouse, f: Filters) -> DataFrame:
    agg = sales_base(wh, f).groupBy("payment_type").agg(F.countDistinct("order_id").alias("orders"))
    return order_small(agg, F.col("orders").desc(), "payment_type")


def same_months_by_year(wh: Warehouse, f: Filters) -> DataFrame:
    """Months 1..8 of the two compare years; overrides the date filter only."""
    y1, y2 = wh.profile.compare_years
    last = wh.profile.compare_last_month
    both = replace(f, start=date(y1, 1, 1), end=date(y2, last, calendar.monthrange(y2, last)[1]))
    return (
        sales_base(wh, both)
        .filter(F.col("month") <= last)
        .groupBy("year", "month")
        .agg(_money("item_total_amount").alias("revenue"), F.countDistinct("order_id").alias("orders"))
        .transform(lambda d: order_small(d, "year", "month"))
    )


def orders_by_weekday_hour(wh: Warehouse, f: Filters) -> DataFrame:
    return (
        sales_base(wh, f)
        .groupBy("day_of_week", F.hour("order_purchase_timestamp").cast("bigint").alias("hour"))
        .agg(F.countDistinct("order_id").alias("orders"))
    )


# Attributes of the order itself: constant within an order.
ORDER_ATTRIBUTES = ("customer_state", "customer_city", "order_status", "order_purchase_timestamp",
                    "order_delivered_customer_date", "order_estimated_delivery_date")


def order_level(s: DataFrame) -> DataFrame:
    """Items rolled up to one row per order.

    The order's own attributes are constant within it, so they are grouping
    keys next to ``order_id`` (same groups as ``any_value`` per order); the
    remaining aggregates are decimal sums, which plan as a hash aggregate
    (a ``max`` of strings would force a sort-based one).
    """
    delivered = (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()
    return s.groupBy("order_id", *ORDER_ATTRIBUTES).agg(
        F.sum("item_total_amount").alias("revenue"),
        F.sum("price").alias("price"),
        F.sum("freight_value").alias("freight"),
    ).select(
        "order_id",
        "customer_state",
        "customer_city",
        F.col("order_purchase_timestamp").alias("purchased_at"),
        F.col("order_delivered_customer_date").alias("delivered_at"),
        F.col("order_estimated_delivery_date").alias("estimated_at"),
        delivered.alias("is_delivered"),
        "revenue",
        "price",
        "freight",
    )


def state_summary(wh: Warehouse, f: Filters) -> DataFrame:
    o = order_level(sales_base(wh, f))
    delivered = F.col("is_delivered")
    late = delivered & (F.to_date("delivered_at") > F.to_date("estimated_at"))
    days = F.when(delivered, F.datediff(F.to_date("delivered_at"), F.to_date("purchased_at")))
    return o.groupBy(F.col("customer_state").alias("state")).agg(
        F.count(F.lit(1)).alias("orders"),
        _money("revenue").alias("revenue"),
        (F.sum("revenue").cast("double") / F.count(F.lit(1))).alias("aov"),
        safe_divide(F.sum("freight").cast("double"), F.sum("price").cast("double")).alias("freight_ratio"),
        count_if(delivered).alias("delivered_orders"),
        safe_divide(count_if(late).cast("double"), count_if(delivered)).alias("late_rate"),
        _avg(days).alias("delivery_days"),
    )


def top_cities(wh: Warehouse, f: Filters, limit: int = 10) -> DataFrame:
    o = order_level(sales_base(wh, f))
    agg = o.groupBy(F.col("customer_city").alias("city"), F.col("customer_state").alias("state")).agg(
        F.count(F.lit(1)).alias("orders"), _money("revenue").alias("revenue")
    )
    return top_k(agg, [("orders", True), ("city", False), ("state", False)], limit)


def seller_origin_late(wh: Warehouse, f: Filters, seller_state: str) -> DataFrame:
    """Orders split by 'has an item from ``seller_state``': counts, item share, late rate."""
    s = sales_base(wh, f)
    from_state = F.col("seller_state") == seller_state
    keys = ("order_status", "order_delivered_customer_date", "order_estimated_delivery_date")  # constant per order
    per_order = s.groupBy("order_id", *keys).agg(
        F.bool_or(from_state).alias("has_state"),
        count_if(from_state).alias("state_items"),
        F.count(F.lit(1)).alias("items"),
    ).select(
        "has_state", "state_items", "items",
        ((F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()).alias(
            "delivered"),
        (F.to_date("order_delivered_customer_date") > F.to_date("order_estimated_delivery_date")).alias("late"),
    )
    out = per_order.groupBy("has_state").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("state_items").alias("state_items"),
        F.sum("items").alias("items"),
        count_if(F.col("delivered")).alias("delivered_orders"),
        safe_divide(count_if(F.col("delivered") & F.col("late")).cast("double"), count_if(F.col("delivered"))).alias(
            "late_rate"
        ),
    )
    return order_small(out, F.col("has_state").desc())
