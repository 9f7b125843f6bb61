"""The declared data-quality tests of the marts, and what each mart's write measures for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry.functions.columns import ACCEPTED_STATUSES

# The declared tests.
UNIQUE_KEYS = (
    ("dim_customers", "customer_unique_id"),
    ("dim_products", "product_id"),
    ("dim_sellers", "seller_id"),
    ("dim_time", "date_key"),
    ("dim_payments", "order_id"),
    ("fct_customer_rfm", "customer_unique_id"),
)
NOT_NULL = UNIQUE_KEYS + (
    ("fct_order_items_sales", "order_id"),
    ("fct_order_items_sales", "order_item_id"),
    ("fct_customer_rfm", "customer_segment"),
    ("fct_customer_rfm", "is_churn"),
)
RELATIONSHIPS = (
    ("fct_order_items_sales", "customer_unique_id", "dim_customers", "customer_unique_id", "error"),
    ("fct_order_items_sales", "product_id", "dim_products", "product_id", "error"),
    ("fct_order_items_sales", "seller_id", "dim_sellers", "seller_id", "error"),
    ("fct_order_items_sales", "order_date_key", "dim_time", "date_key", "error"),
    ("fct_order_items_sales", "order_id", "dim_payments", "order_id", "warn"),
)


def nulls(column: str) -> str:
    return f"nulls_{column}"


def measures(mart: str) -> dict[str, Column]:
    """Aggregates that the job which writes a mart observes: no later read of the mart is needed for them."""
    out = {nulls(c): F.count_if(F.col(c).isNull()) for m, c in NOT_NULL if m == mart}
    if mart == "fct_order_items_sales":
        out["foreign_statuses"] = F.count_if(~F.col("order_status").isin(*ACCEPTED_STATUSES))  # rows; a null status is accepted
        out["amount"] = F.sum("item_total_amount")
    return out
