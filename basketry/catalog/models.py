"""Model outputs (staging, intermediate, marts, RFM steps) with reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry import oracle as O
from basketry.catalog.core import register, wh
from basketry.plans import models as M

_STG_SQL = {
    "stg_orders": "SELECT * FROM stg_orders",
    "stg_order_items": """SELECT order_id, order_item_id, product_id, seller_id, shipping_limit_date,
  CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value FROM stg_order_items""",
    "stg_customers": "SELECT * FROM stg_customers",
    "stg_products": """SELECT product_id, product_category_name, product_name_length, product_description_length,
  product_photos_qty, CAST(product_weight_g AS DOUBLE) AS product_weight_g,
  CAST(product_length_cm AS DOUBLE) AS product_length_cm, CAST(product_height_cm AS DOUBLE) AS product_height_cm,
  CAST(product_width_cm AS DOUBLE) AS product_width_cm FROM stg_products""",
    "stg_order_payments": """SELECT order_id, payment_sequential, payment_type, payment_installments,
  CAST(payment_value AS DOUBLE) AS payment_value FROM stg_order_payments""",
    "stg_sellers": "SELECT * FROM stg_sellers",
}
for _name, _sql in _STG_SQL.items():
    register(_name, O.with_models(_sql))(lambda s, d, _n=_name: wh(s, d).view(_n))

register("int_customers_deduplicated", O.with_models("SELECT * FROM int_customers_deduplicated"))(
    lambda s, d: wh(s, d).view("int_customers_deduplicated"))
register("int_products_enriched", O.with_models("""
SELECT product_id, product_category_name_english, product_name_length, product_description_length,
  product_photos_qty, CAST(product_weight_g AS DOUBLE) AS product_weight_g,
  CAST(product_length_cm AS DOUBLE) AS product_length_cm, CAST(product_height_cm AS DOUBLE) AS product_height_cm,
  CAST(product_width_cm AS DOUBLE) AS product_width_cm FROM int_products_enriched"""))(
    lambda s, d: wh(s, d).view("int_products_enriched"))
register("int_order_payments_aggregated", O.with_models("""
SELECT order_id, payment_installments_count, max_installments,
  CAST(total_payment_value AS DOUBLE) AS total_payment_value, primary_payment_type
FROM int_order_payments_aggregated"""))(lambda s, d: wh(s, d).view("int_order_payments_aggregated"))

register("dim_customers", O.with_models("SELECT * FROM dim_customers"))(lambda s, d: wh(s, d).table("dim_customers"))
register("dim_products", O.with_models("""
SELECT product_id, product_category_name_english, product_name_length, product_description_length,
  product_photos_qty, CAST(product_weight_g AS DOUBLE) AS product_weight_g,
  CAST(product_length_cm AS DOUBLE) AS product_length_cm, CAST(product_height_cm AS DOUBLE) AS product_height_cm,
  CAST(product_width_cm AS DOUBLE) AS product_width_cm FROM dim_products"""))(
    lambda s, d: wh(s, d).table("dim_products"))
register("dim_sellers", O.with_models("SELECT * FROM dim_sellers"))(lambda s, d: wh(s, d).table("dim_sellers"))
register("dim_payments", O.with_models("""
SELECT order_id, payment_type_primary, max_installments, CAST(total_payment_value AS DOUBLE) AS total_payment_value
FROM dim_payments"""))(lambda s, d: wh(s, d).table("dim_payments"))
register("dim_time", O.with_models("""
SELECT date_key, CAST(full_date AS TIMESTAMP) AS full_date, year, quarter, month, month_name, day, day_of_week,
  day_name, is_weekend FROM dim_time"""))(lambda s, d: wh(s, d).table("dim_time"))
register("fct_order_items_sales", O.with_models("""
SELECT order_id, order_item_id, customer_id, customer_unique_id, product_id, seller_id, order_date_key, order_status,
  order_purchase_timestamp, order_delivered_customer_date, order_estimated_delivery_date,
  CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value,
  CAST(item_total_amount AS DOUBLE) AS item_total_amount
FROM fct_order_items_sales"""))(lambda s, d: wh(s, d).table("fct_order_items_sales"))

_RFM_COLS = """customer_unique_id, recency_days, frequency_orders, CAST(monetary_value AS DOUBLE) AS monetary_value,
  last_purchase_timestamp, r_score, f_score, m_score, rfm_code, customer_segment, is_churn"""
register("fct_customer_rfm", O.with_models(f"SELECT {_RFM_COLS} FROM fct_customer_rfm"))(
    lambda s, d: wh(s, d).table("fct_customer_rfm"))

register("rfm_customer_orders", O.with_models("""
SELECT customer_unique_id, order_id, order_purchase_timestamp, CAST(item_total_amount AS DOUBLE) AS item_total_amount
FROM rfm_customer_orders"""))(lambda s, d: M.rfm_customer_orders(wh(s, d).table("fct_order_items_sales")))
register("rfm_reference_date", O.with_models("""
SELECT CAST(max_date AS TIMESTAMP) AS reference_date FROM rfm_reference_date"""))(
    lambda s, d: M.rfm_reference_date(M.rfm_metrics(M.rfm_customer_orders(wh(s, d).table("fct_order_items_sales")))))
register("rfm_metrics", O.with_models("""
SELECT customer_unique_id, recency_days, frequency_orders, CAST(monetary_value AS DOUBLE) AS monetary_value,
  last_purchase_timestamp FROM rfm_metrics"""))(
    lambda s, d: M.rfm_recency(M.rfm_metrics(M.rfm_customer_orders(wh(s, d).table("fct_order_items_sales")))))
register("rfm_ntile_scores", O.with_models("""
SELECT customer_unique_id, CAST(r_score AS BIGINT) AS r_score, CAST(m_score AS BIGINT) AS m_score FROM rfm_scoring"""))(
    lambda s, d: M.rfm_scores(wh(s, d).rfm_recency()).select("customer_unique_id", F.col("r_score").cast("bigint").alias("r_score"),
                                   F.col("m_score").cast("bigint").alias("m_score")))
register("rfm_f_score", O.with_models("""
SELECT customer_unique_id, frequency_orders, CAST(f_score AS BIGINT) AS f_score FROM rfm_scoring"""))(
    lambda s, d: wh(s, d).table("fct_customer_rfm").select("customer_unique_id", "frequency_orders", "f_score"))
register("rfm_code", O.with_models("SELECT customer_unique_id, rfm_code FROM fct_customer_rfm"))(
    lambda s, d: wh(s, d).table("fct_customer_rfm").select("customer_unique_id", "rfm_code"))
register("rfm_segment", O.with_models("""
SELECT customer_unique_id, r_score, f_score, customer_segment, is_churn FROM fct_customer_rfm"""))(
    lambda s, d: wh(s, d).table("fct_customer_rfm").select(
        "customer_unique_id", "r_score", "f_score", "customer_segment", "is_churn"))
