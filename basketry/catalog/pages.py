"""Page queries (sales, customers) registered with their reference SQL."""

from __future__ import annotations

from datetime import date

from basketry import oracle as O
from basketry.catalog.core import ALL, DEF, FILTERED, RJ, RJ_SELLER_STATE, _rfm_sql, _sales_sql, register, wh
from basketry.functions.columns import SEGMENT_ORDER
from basketry.plans import customers as C
from basketry.plans import sales as S
from basketry.plans.filters import Filters
from basketry.profile import TEST_PROFILE

# ------------------------------------------------------------------ sales

def _kpi_sql(f: Filters) -> str:
    prev = f.previous(TEST_PROFILE.data_start)
    start = prev.start if prev else f.start
    wide = Filters(start, f.end, f.states, f.categories)
    figures = """count(DISTINCT order_id) AS {p}orders, CAST(coalesce(sum(item_total_amount), 0) AS DOUBLE) AS {p}revenue,
    CAST(coalesce(sum(freight_value), 0) AS DOUBLE) AS {p}freight, count(DISTINCT customer_unique_id) AS {p}customers"""
    return _sales_sql(wide, f"""
SELECT * FROM (SELECT {figures.format(p='')} FROM sales WHERE full_date >= {O._d(f.start)}) this_period,
  (SELECT {figures.format(p='prev_')} FROM sales WHERE full_date < {O._d(f.start)}) period_before""")


for _name, _f in (("kpi_compare", DEF), ("kpi_compare_all", ALL), ("kpi_compare_filtered", FILTERED)):
    register(_name, _kpi_sql(_f))(lambda s, d, _f=_f: S.kpi_compare(wh(s, d), _f))


def _period_sql(f: Filters, grain: str, alias: str) -> str:
    return _sales_sql(f, f"""
SELECT CAST(date_trunc('{grain}', full_date) AS TIMESTAMP) AS {alias},
  CAST(sum(item_total_amount) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders
FROM sales GROUP BY 1 ORDER BY 1""")


register("revenue_by_month", _period_sql(DEF, "month", "month"))(lambda s, d: S.revenue_by_month(wh(s, d), DEF))
register("sales_by_period_month", _period_sql(ALL, "month", "period"))(
    lambda s, d: S.sales_by_period(wh(s, d), ALL, "month"))
register("sales_by_period", _period_sql(DEF, "quarter", "period"))(
    lambda s, d: S.sales_by_period(wh(s, d), DEF, "quarter"))


def _category_sql(f: Filters) -> str:
    return _sales_sql(f, """
SELECT category, CAST(sum(item_total_amount) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders
FROM sales GROUP BY category""")


register("sales_by_category", _category_sql(DEF))(lambda s, d: S.sales_by_category(wh(s, d), DEF))
register("sales_by_category_filtered", _category_sql(FILTERED))(
    lambda s, d: S.sales_by_category(wh(s, d), FILTERED))

register("top_products", _sales_sql(DEF, """
SELECT product_id, max(category) AS category, CAST(sum(item_total_amount) AS DOUBLE) AS revenue,
  count(DISTINCT order_id) AS orders, CAST(sum(price) AS DOUBLE) / count(price) AS avg_price
FROM sales GROUP BY product_id ORDER BY revenue DESC, product_id LIMIT 10"""))(
    lambda s, d: S.top_products(wh(s, d), DEF, 10))

register("payment_mix", _sales_sql(DEF, """
SELECT payment_type, count(DISTINCT order_id) AS orders FROM sales
GROUP BY payment_type ORDER BY orders DESC, payment_type"""))(lambda s, d: S.payment_mix(wh(s, d), DEF))

_y1, _y2 = TEST_PROFILE.compare_years
register("same_months_by_year", _sales_sql(Filters(date(_y1, 1, 1), date(_y2, 8, 31)), """
SELECT year, month, CAST(sum(item_total_amount) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders
FROM sales WHERE month <= 8 GROUP BY year, month ORDER BY year, month"""))(
    lambda s, d: S.same_months_by_year(wh(s, d), DEF))

register("orders_by_weekday_hour", _sales_sql(DEF, """
SELECT day_of_week, hour(order_purchase_timestamp) AS hour, count(DISTINCT order_id) AS orders
FROM sales GROUP BY 1, 2"""))(lambda s, d: S.orders_by_weekday_hour(wh(s, d), DEF))

register("order_level", _sales_sql(DEF, """
SELECT order_id, customer_state, customer_city, purchased_at, delivered_at, estimated_at, is_delivered,
  CAST(revenue AS DOUBLE) AS revenue, CAST(price AS DOUBLE) AS price, CAST(freight AS DOUBLE) AS freight
FROM order_level""", O.ORDER_LEVEL))(lambda s, d: S.order_level(S.sales_base(wh(s, d), DEF)))


def _state_summary_sql(f: Filters) -> str:
    return _sales_sql(f, """
SELECT customer_state AS state, count(*) AS orders, CAST(sum(revenue) AS DOUBLE) AS revenue,
  CAST(sum(revenue) AS DOUBLE) / count(*) AS aov,
  CAST(sum(freight) AS DOUBLE) / NULLIF(CAST(sum(price) AS DOUBLE), 0) AS freight_ratio,
  CAST(count_if(is_delivered) AS BIGINT) AS delivered_orders,
  CAST(count_if(is_delivered AND CAST(delivered_at AS DATE) > CAST(estimated_at AS DATE)) AS DOUBLE)
    / NULLIF(count_if(is_delivered), 0) AS late_rate,
  CAST(sum(CASE WHEN is_delivered THEN date_diff('day', CAST(purchased_at AS DATE), CAST(delivered_at AS DATE)) END)
    AS DOUBLE) / NULLIF(count(CASE WHEN is_delivered THEN 1 END), 0) AS delivery_days
FROM order_level GROUP BY customer_state""", O.ORDER_LEVEL)


register("state_summary", _state_summary_sql(DEF))(lambda s, d: S.state_summary(wh(s, d), DEF))
register("state_summary_filtered", _state_summary_sql(FILTERED))(
    lambda s, d: S.state_summary(wh(s, d), FILTERED))

register("top_cities", _sales_sql(DEF, """
SELECT customer_city AS city, customer_state AS state, count(*) AS orders, CAST(sum(revenue) AS DOUBLE) AS revenue
FROM order_level GROUP BY 1, 2 ORDER BY orders DESC, city, state LIMIT 10""", O.ORDER_LEVEL))(
    lambda s, d: S.top_cities(wh(s, d), DEF, 10))

register("seller_origin_late", _sales_sql(RJ, f"""
SELECT has_state, CAST(sum(first_item) AS BIGINT) AS orders, CAST(sum(here) AS BIGINT) AS state_items, count(*) AS items,
  CAST(sum(first_item * arrived) AS BIGINT) AS delivered_orders,
  CAST(sum(first_item * arrived * late) AS DOUBLE) / NULLIF(sum(first_item * arrived), 0) AS late_rate
FROM (
  SELECT EXISTS (SELECT 1 FROM sales other WHERE other.order_id = s.order_id AND other.seller_state = '{RJ_SELLER_STATE}') AS has_state,
    coalesce(CAST(seller_state = '{RJ_SELLER_STATE}' AS INT), 0) AS here,
    CAST(order_item_id = min(order_item_id) OVER (PARTITION BY order_id) AS INT) AS first_item,
    CAST(order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL AS INT) AS arrived,
    coalesce(CAST(CAST(order_delivered_customer_date AS DATE) > CAST(order_estimated_delivery_date AS DATE) AS INT), 0) AS late
  FROM sales s
) flags GROUP BY has_state ORDER BY has_state DESC"""))(
    lambda s, d: S.seller_origin_late(wh(s, d), RJ, RJ_SELLER_STATE))

register("sales_base", _sales_sql(DEF, """
SELECT order_id, order_item_id, CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value,
  CAST(item_total_amount AS DOUBLE) AS item_total_amount, order_status, order_purchase_timestamp,
  order_delivered_customer_date, order_estimated_delivery_date, payment_type, CAST(full_date AS TIMESTAMP) AS full_date,
  year, quarter, month, day_of_week, day_name, customer_unique_id, customer_state, customer_city,
  product_id, category, seller_state
FROM sales"""))(lambda s, d: S.sales_base(wh(s, d), DEF).drop("order_date_key"))

register("sales_base_joined", _sales_sql(FILTERED, """
SELECT order_id, order_item_id, CAST(item_total_amount AS DOUBLE) AS item_total_amount, payment_type,
  customer_state, category, seller_state FROM sales"""))(
    lambda s, d: S.sales_base_joined(wh(s, d), FILTERED).select(
        "order_id", "order_item_id", "item_total_amount", "payment_type", "customer_state", "category",
        "seller_state"))

# -------------------------------------------------------------- customers

register("rfm_overview", _rfm_sql(ALL, """
SELECT count(*) AS customers,
  CAST(count_if(frequency_orders >= 2) AS DOUBLE) / NULLIF(count(*), 0) AS repeat_rate,
  quantile_disc(recency_days, 0.5) AS median_recency,
  CAST(sum(monetary_value) AS DOUBLE) / NULLIF(count(monetary_value), 0) AS avg_monetary,
  CAST(sum(CAST(is_churn AS BIGINT)) AS DOUBLE) / NULLIF(count(is_churn), 0) AS churn_rate,
  CAST(count_if(NOT is_churn) AS BIGINT) AS active,
  CAST(count_if(recency_days BETWEEN 91 AND 180) AS BIGINT) AS cooling,
  CAST(sum(CASE WHEN recency_days BETWEEN 91 AND 180 THEN monetary_value ELSE 0 END) AS DOUBLE) AS cooling_value,
  (SELECT CAST(CAST(max(last_purchase_timestamp) AS DATE) AS TIMESTAMP) FROM fct_customer_rfm) AS last_purchase
FROM customers_rfm"""))(lambda s, d: C.rfm_overview(wh(s, d), ALL))

register("rfm_overview_filtered", _rfm_sql(FILTERED, """
SELECT count(*) AS customers,
  CAST(count_if(frequency_orders >= 2) AS DOUBLE) / NULLIF(count(*), 0) AS repeat_rate,
  quantile_disc(recency_days, 0.5) AS median_recency,
  CAST(sum(monetary_value) AS DOUBLE) / NULLIF(count(monetary_value), 0) AS avg_monetary,
  CAST(sum(CAST(is_churn AS BIGINT)) AS DOUBLE) / NULLIF(count(is_churn), 0) AS churn_rate,
  CAST(count_if(NOT is_churn) AS BIGINT) AS active,
  CAST(count_if(recency_days BETWEEN 91 AND 180) AS BIGINT) AS cooling,
  CAST(sum(CASE WHEN recency_days BETWEEN 91 AND 180 THEN monetary_value ELSE 0 END) AS DOUBLE) AS cooling_value,
  (SELECT CAST(CAST(max(last_purchase_timestamp) AS DATE) AS TIMESTAMP) FROM fct_customer_rfm) AS last_purchase
FROM customers_rfm"""))(lambda s, d: C.rfm_overview(wh(s, d), FILTERED))

register("rfm_segments", _rfm_sql(ALL, """
SELECT customer_segment AS segment, count(*) AS customers, CAST(sum(monetary_value) AS DOUBLE) AS revenue,
  CAST(sum(recency_days) AS DOUBLE) / count(recency_days) AS recency,
  CAST(sum(frequency_orders) AS DOUBLE) / count(frequency_orders) AS frequency,
  CAST(sum(monetary_value) AS DOUBLE) / count(monetary_value) AS monetary,
  CAST(sum(CAST(is_churn AS BIGINT)) AS DOUBLE) / count(is_churn) AS churn_rate
FROM customers_rfm GROUP BY customer_segment"""))(lambda s, d: C.rfm_segments(wh(s, d), ALL))

register("rfm_matrix", _rfm_sql(ALL, """
SELECT r_score, f_score, count(*) AS customers FROM customers_rfm GROUP BY r_score, f_score"""))(
    lambda s, d: C.rfm_matrix(wh(s, d), ALL))

register("segment_customers", _rfm_sql(ALL, """
SELECT customer_unique_id, customer_state, customer_city, recency_days, frequency_orders,
  CAST(monetary_value AS DOUBLE) AS monetary, rfm_code
FROM customers_rfm WHERE customer_segment = 'Champions'
ORDER BY monetary DESC, customer_unique_id LIMIT 500"""))(
    lambda s, d: C.segment_customers(wh(s, d), ALL, "Champions", 500))

register("recency_histogram", _rfm_sql(ALL, f"""
SELECT {O.RECENCY_BUCKET} AS bucket, count(*) AS customers, CAST(sum(monetary_value) AS DOUBLE) AS monetary
FROM customers_rfm GROUP BY 1 ORDER BY 1"""))(lambda s, d: C.recency_histogram(wh(s, d), ALL))

register("churn_by_state", _rfm_sql(ALL, """
SELECT customer_state AS state, count(*) AS customers,
  CAST(sum(CAST(is_churn AS BIGINT)) AS DOUBLE) / count(is_churn) AS churn_rate
FROM customers_rfm GROUP BY customer_state"""))(lambda s, d: C.churn_by_state(wh(s, d), ALL))

register("churn_by_last_category", _rfm_sql(ALL, """
SELECT l.category, count(*) AS customers,
  CAST(sum(CAST(c.is_churn AS BIGINT)) AS DOUBLE) / count(c.is_churn) AS churn_rate
FROM customers_rfm c JOIN last_item l USING (customer_unique_id)
GROUP BY l.category ORDER BY customers DESC, l.category LIMIT 15""", """
last_item AS (
  SELECT customer_unique_id, category FROM (
    SELECT f.customer_unique_id, p.product_category_name_english AS category,
      row_number() OVER (PARTITION BY f.customer_unique_id
        ORDER BY f.order_purchase_timestamp DESC, f.price DESC, f.order_id, f.order_item_id) AS rn
    FROM fct_order_items_sales f JOIN dim_products p ON f.product_id = p.product_id
    WHERE f.order_status NOT IN ('canceled', 'unavailable')
  ) x WHERE rn = 1
)"""))(lambda s, d: C.churn_by_last_category(wh(s, d), ALL, 15))

register("cooling_customers", _rfm_sql(ALL, """
SELECT customer_unique_id, customer_state, customer_segment AS segment, recency_days, frequency_orders,
  CAST(monetary_value AS DOUBLE) AS monetary
FROM customers_rfm WHERE recency_days BETWEEN 91 AND 180
ORDER BY monetary DESC, customer_unique_id LIMIT 500"""))(lambda s, d: C.cooling_customers(wh(s, d), ALL, 500))

register("campaign_pool", _rfm_sql(ALL, f"""
SELECT customer_segment AS segment, customer_state AS state, {O.RECENCY_BUCKET} AS bucket,
  count(*) AS customers, CAST(sum(frequency_orders) AS BIGINT) AS orders,
  CAST(count_if(frequency_orders >= 2) AS BIGINT) AS repeaters,
  CAST(sum(monetary_value) AS DOUBLE) AS monetary
FROM customers_rfm GROUP BY 1, 2, 3"""))(lambda s, d: C.campaign_pool(wh(s, d), ALL))

_ALL_SEGMENTS = SEGMENT_ORDER
register("campaign_targets", _rfm_sql(ALL, f"""
SELECT customer_unique_id, customer_state, customer_city, customer_segment AS segment, recency_days,
  frequency_orders, CAST(monetary_value AS DOUBLE) AS monetary
FROM customers_rfm
WHERE recency_days BETWEEN 91 AND 180 AND {O._in('customer_segment', _ALL_SEGMENTS)}
ORDER BY monetary DESC, customer_unique_id"""))(
    lambda s, d: C.campaign_targets(wh(s, d), ALL, 91, 180, _ALL_SEGMENTS))

register("data_end", O.with_models("""
SELECT CAST(CAST(max(last_purchase_timestamp) AS DATE) AS TIMESTAMP) AS last_date FROM fct_customer_rfm"""))(
    lambda s, d: C.data_end(wh(s, d)))

register("filter_options", O.with_models("""
SELECT 'state' AS kind, customer_state AS value FROM dim_customers GROUP BY customer_state
UNION ALL
SELECT 'category' AS kind, product_category_name_english AS value FROM dim_products
GROUP BY product_category_name_english
UNION ALL
SELECT 'last_date' AS kind, CAST(CAST(max(last_purchase_timestamp) AS DATE) AS VARCHAR) AS value FROM fct_customer_rfm
ORDER BY kind, value"""))(lambda s, d: C.filter_options(wh(s, d)))

register("rfm_base", _rfm_sql(FILTERED, """
SELECT customer_unique_id, recency_days, frequency_orders, CAST(monetary_value AS DOUBLE) AS monetary_value,
  last_purchase_timestamp, r_score, f_score, m_score, rfm_code, customer_segment, is_churn,
  customer_state, customer_city
FROM customers_rfm"""))(lambda s, d: C.rfm_base(wh(s, d), FILTERED).drop("last_category"))
