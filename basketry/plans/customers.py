"""Customer (RFM / churn / campaign-pool) questions over ``rfm_customers``.

Customer pages filter by state only; date and category filters do not apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import (
    as_double,
    count_if,
    is_cooling,
    recency_bucket,
    safe_divide,
)
from basketry.plans import models as M
from basketry.operators.scalar import attach_scalar
from basketry.operators.topk import order_small, top_k
from basketry.plans.filters import Filters, optional_in
from basketry.plans.warehouse import Warehouse


def rfm_base(wh: Warehouse, f: Filters) -> DataFrame:
    """RFM mart with the customer's state and city, state filter applied."""
    return optional_in(wh.table("rfm_customers"), "customer_state", f.states)


def _avg(c: Column) -> Column:
    return safe_divide(F.sum(c).cast("double"), F.count(c))


def _churn_rate() -> Column:
    return _avg(F.col("is_churn").cast("bigint"))


def data_end(wh: Warehouse) -> DataFrame:
    return wh.table("fct_customer_rfm").agg(F.to_date(F.max("last_purchase_timestamp")).alias("last_date"))


def rfm_overview(wh: Warehouse, f: Filters) -> DataFrame:
    c = rfm_base(wh, f)
    cooling = is_cooling()
    zero = F.lit(0).cast("decimal(18,4)")
    agg = c.agg(
        F.count(F.lit(1)).alias("customers"),
        safe_divide(count_if(F.col("frequency_orders") >= 2).cast("double"), F.count(F.lit(1))).alias("repeat_rate"),
        F.expr("percentile_disc(0.5) within group (order by recency_days)").cast("bigint").alias("median_recency"),
        _avg(F.col("monetary_value")).alias("avg_monetary"),
        _churn_rate().alias("churn_rate"),
        count_if(~F.col("is_churn")).alias("active"),
        count_if(cooling).alias("cooling"),
        as_double(F.sum(F.when(cooling, F.col("monetary_value")).otherwise(zero))).alias("cooling_value"),
    )
    # unfiltered scalar subquery: one row
    return attach_scalar(agg, data_end(wh).withColumnRenamed("last_date", "last_purchase"))


def rfm_segments(wh: Warehouse, f: Filters) -> DataFrame:
    return rfm_base(wh, f).groupBy(F.col("customer_segment").alias("segment")).agg(
        F.count(F.lit(1)).alias("customers"),
        as_double(F.sum("monetary_value")).alias("revenue"),
        _avg(F.col("recency_days")).alias("recency"),
        _avg(F.col("frequency_orders")).alias("frequency"),
        _avg(F.col("monetary_value")).alias("monetary"),
        _churn_rate().alias("churn_rate"),
    )


def rfm_matrix(wh: Warehouse, f: Filters) -> DataFrame:
    return rfm_base(wh, f).groupBy("r_score", "f_score").agg(F.count(F.lit(1)).alias("customers"))


def segment_customers(wh: Warehouse, f: Filters, segment: str, limit: int = 500) -> DataFrame:
    rows = rfm_base(wh, f).filter(F.col("customer_segment") == segment).select(
        "customer_unique_id",
        "customer_state",
        "customer_city",
        "recency_days",
        "frequency_orders",
        as_double("monetary_value").alias("monetary"),
        "rfm_code",
    )
    return top_k(rows, [("monetary", True), ("customer_unique_id", False)], limit)


def recency_histogram(wh: Warehouse, f: Filters) -> DataFrame:
    return (
        rfm_base(wh, f)
        .groupBy(recency_bucket().alias("bucket"))
        .agg(F.count(F.lit(1)).alias("customers"), as_double(F.sum("monetary_value")).alias("monetary"))
        .transform(lambda d: order_small(d, "bucket"))
    )


def churn_by_state(wh: Warehouse, f: Filters) -> DataFrame:
    return rfm_base(wh, f).groupBy(F.col("customer_state").alias("state")).agg(
        F.count(F.lit(1)).alias("customers"), _churn_rate().alias("churn_rate")
    )


def last_item_category(wh: Warehouse) -> DataFrame:
    """Category of each customer's last valid item (query-time form; the
    ``rfm_customers`` mart carries the same column)."""
    return M.last_item_category(wh.table("fct_order_items_sales"), wh.table("dim_products")) \
        .withColumnRenamed("last_category", "category")


def churn_by_last_category(wh: Warehouse, f: Filters, limit: int = 15) -> DataFrame:
    c = rfm_base(wh, f).filter(F.col("last_category").isNotNull())
    agg = c.groupBy(F.col("last_category").alias("category")).agg(
        F.count(F.lit(1)).alias("customers"), _churn_rate().alias("churn_rate")
    )
    return top_k(agg, [("customers", True), ("category", False)], limit)


def cooling_customers(wh: Warehouse, f: Filters, limit: int = 500) -> DataFrame:
    rows = rfm_base(wh, f).filter(is_cooling()).select(
        "customer_unique_id",
        "customer_state",
        F.col("customer_segment").alias("segment"),
        "recency_days",
        "frequency_orders",
        as_double("monetary_value").alias("monetary"),
    )
    return top_k(rows, [("monetary", True), ("customer_unique_id", False)], limit)


def campaign_pool(wh: Warehouse, f: Filters) -> DataFrame:
    """Segment x state x 30-day bucket cube the campaign model slices."""
    return rfm_base(wh, f).groupBy(
        F.col("customer_segment").alias("segment"),
        F.col("customer_state").alias("state"),
        recency_bucket().alias("bucket"),
    ).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("frequency_orders").alias("orders"),
        count_if(F.col("frequency_orders") >= 2).alias("repeaters"),
        as_double(F.sum("monetary_value")).alias("monetary"),
    )


def campaign_targets(wh: Warehouse, f: Filters, rmin: int, rmax: int, segments: tuple,
                     limit: int | None = None) -> DataFrame:
    """Marketing list: recency range and segments (empty list = no rows)."""
    rows = rfm_base(wh, f).filter(
        F.col("recency_days").between(int(rmin), int(rmax)) & F.col("customer_segment").isin(*segments)
        if segments
        else F.lit(False)
    ).select(
        "customer_unique_id",
        "customer_state",
        "customer_city",
        F.col("customer_segment").alias("segment"),
        "recency_days",
        "frequency_orders",
        as_double("monetary_value").alias("monetary"),
    )
    return top_k(rows, [("monetary", True), ("customer_unique_id", False)], limit)


def filter_options(wh: Warehouse) -> DataFrame:
    """(kind, value) rows: states, categories, last purchase date."""
    states = wh.table("dim_customers").select(F.lit("state").alias("kind"), F.col("customer_state").alias("value"))
    cats = wh.table("dim_products").select(
        F.lit("category").alias("kind"), F.col("product_category_name_english").alias("value")
    )
    last = data_end(wh).select(F.lit("last_date").alias("kind"), F.col("last_date").cast("string").alias("value"))
    return states.distinct().unionByName(cats.distinct()).unionByName(last).orderBy("kind", "value")

