"""Finishing computations and the campaign model, with reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry import oracle as O
from basketry.catalog.core import DEF, QUERIES, from_query, register, wh
from basketry.functions.columns import SEGMENT_ORDER
from basketry.operators.scalar import attach_scalar
from basketry.plans import campaign as K
from basketry.plans import finish as Fn
from basketry.profile import TEST_PROFILE


def _run(name: str, s, d):
    return QUERIES[name][0](s, d)


def _stored(name: str, s, d):
    """A registered query's result, written once for all figures that start from it."""
    return wh(s, d).result(name, lambda: _run(name, s, d))


def _case_map(mapping: dict, col: str) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} END"


def _order_case(values, col: str) -> str:
    whens = " ".join(f"WHEN {col} = '{v}' THEN {i}" for i, v in enumerate(values))
    return f"CASE {whens} END"


# ------------------------------------------------------------- overview page

register("kpi_derived", f"""
SELECT CAST(orders AS BIGINT) AS orders, revenue, aov, freight_per_order, CAST(customers AS BIGINT) AS customers,
  CASE WHEN prev_revenue <> 0 THEN (revenue - prev_revenue) / prev_revenue END AS revenue_change,
  CASE WHEN prev_orders <> 0 THEN (orders - prev_orders) / prev_orders END AS orders_change,
  CASE WHEN prev_aov <> 0 THEN (aov - prev_aov) / prev_aov END AS aov_change,
  CASE WHEN prev_freight_per_order <> 0 THEN (freight_per_order - prev_freight_per_order) / prev_freight_per_order
    END AS freight_per_order_change,
  CASE WHEN prev_customers <> 0 THEN (customers - prev_customers) / prev_customers END AS customers_change
FROM (
  SELECT *,
    CASE WHEN orders <> 0 THEN revenue / orders ELSE 0.0 END AS aov,
    CASE WHEN orders <> 0 THEN freight / orders ELSE 0.0 END AS freight_per_order,
    CASE WHEN prev_orders <> 0 THEN prev_revenue / prev_orders ELSE 0.0 END AS prev_aov,
    CASE WHEN prev_orders <> 0 THEN prev_freight / prev_orders ELSE 0.0 END AS prev_freight_per_order
  FROM (SELECT coalesce(orders, 0) AS orders, coalesce(revenue, 0) AS revenue, coalesce(freight, 0) AS freight,
      coalesce(customers, 0) AS customers, coalesce(prev_orders, 0) AS prev_orders,
      coalesce(prev_revenue, 0) AS prev_revenue, coalesce(prev_freight, 0) AS prev_freight,
      coalesce(prev_customers, 0) AS prev_customers
    FROM {from_query('kpi_compare')}) k
) k2""")(lambda s, d: Fn.kpi_derived(_stored("kpi_compare", s, d)))

_PARTIAL = (f"(CAST(month AS DATE) < {O._d(DEF.start)}) "
            f"OR (CAST(month AS DATE) + INTERVAL 1 MONTH - INTERVAL 1 DAY > {O._d(DEF.end)})")
register("period_partial_flag", f"""
SELECT month, revenue, orders, {_PARTIAL} AS partial FROM {from_query('revenue_by_month')}""")(
    lambda s, d: Fn.period_partial_flag(_run("revenue_by_month", s, d), DEF.start, DEF.end, 1, period="month"))
register("peak_full_period", f"""
SELECT month, revenue, orders, partial FROM (
  SELECT month, revenue, orders, {_PARTIAL} AS partial FROM {from_query('revenue_by_month')}
) x ORDER BY partial, revenue DESC, month LIMIT 1""")(
    lambda s, d: Fn.peak_full_period(
        Fn.period_partial_flag(_run("revenue_by_month", s, d), DEF.start, DEF.end, 1, period="month"),
        "revenue", period="month"))

register("category_rank", f"""
SELECT category, revenue, orders FROM {from_query('sales_by_category')}
ORDER BY revenue DESC, category LIMIT 10""")(lambda s, d: Fn.category_rank(_run("sales_by_category", s, d)))
register("category_rank_orders", f"""
SELECT category, revenue, orders FROM {from_query('sales_by_category')}
ORDER BY orders DESC, category LIMIT 10""")(lambda s, d: Fn.category_rank(_run("sales_by_category", s, d), "orders"))

register("payment_share", f"""
SELECT payment_type, orders, CAST(orders AS DOUBLE) / sum(orders) OVER () AS share,
  coalesce({_case_map(Fn.PAYMENT_LABELS, 'payment_type')}, payment_type) AS label
FROM {from_query('payment_mix')}""")(lambda s, d: Fn.payment_share(_run("payment_mix", s, d)))

register("top_products_share", f"""
SELECT p.products, p.top_revenue, k.revenue AS period_revenue,
  CASE WHEN k.revenue <> 0 THEN p.top_revenue / k.revenue END AS share
FROM (SELECT CAST(sum(CAST(revenue AS DECIMAL(38,4))) AS DOUBLE) AS top_revenue, count(*) AS products
      FROM {from_query('top_products')}) p,
  {from_query('kpi_compare', 'k')}""")(
    lambda s, d: Fn.top_products_share(_run("top_products", s, d), _stored("kpi_compare", s, d)))

# --------------------------------------------------------------- trends page

_Y1, _Y2 = TEST_PROFILE.compare_years
register("yoy_pivot", f"""
SELECT month, sum(CASE WHEN year = {_Y1} THEN revenue END) AS "{_Y1}",
  sum(CASE WHEN year = {_Y2} THEN revenue END) AS "{_Y2}"
FROM {from_query('same_months_by_year')} GROUP BY month ORDER BY month""")(
    lambda s, d: Fn.yoy_pivot(_stored("same_months_by_year", s, d), "revenue", TEST_PROFILE.compare_years))
register("yoy_growth", " UNION ALL ".join(f"""
SELECT '{m}' AS measure, s1 AS first_year_total, s2 AS second_year_total,
  CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL AND s1 <> 0 THEN s2 / s1 - 1 END AS growth
FROM (SELECT CAST(sum(CASE WHEN year = {_Y1} THEN CAST({m} AS {'DECIMAL(38,4)' if m == 'revenue' else 'BIGINT'}) END)
          AS DOUBLE) AS s1,
        CAST(sum(CASE WHEN year = {_Y2} THEN CAST({m} AS {'DECIMAL(38,4)' if m == 'revenue' else 'BIGINT'}) END)
          AS DOUBLE) AS s2
      FROM {from_query('same_months_by_year')}) t""" for m in ("revenue", "orders")))(
    lambda s, d: Fn.yoy_growth(_stored("same_months_by_year", s, d), TEST_PROFILE.compare_years))

register("weekday_hour_grid", f"""
SELECT c.day_of_week, c.hour, CAST(coalesce(g.orders, 0) AS BIGINT) AS orders
FROM (SELECT CAST(i // 24 + 1 AS BIGINT) AS day_of_week, CAST(i % 24 AS BIGINT) AS hour FROM range(168) t(i)) c
LEFT JOIN {from_query('orders_by_weekday_hour', 'g')} ON c.day_of_week = g.day_of_week AND c.hour = g.hour""")(
    lambda s, d: Fn.weekday_hour_grid(s, _stored("orders_by_weekday_hour", s, d)))
register("peak_slot", f"""
SELECT day_of_week, hour, orders FROM {from_query('orders_by_weekday_hour')}
ORDER BY orders DESC, day_of_week, hour LIMIT 3""")(lambda s, d: Fn.peak_slots(_stored("orders_by_weekday_hour", s, d)))
register("weekday_share", f"""
SELECT day_of_week, orders, CAST(orders AS DOUBLE) / sum(orders) OVER () AS share,
  day_of_week = first(day_of_week ORDER BY orders DESC, day_of_week) OVER () AS is_busiest
FROM (SELECT day_of_week, CAST(sum(orders) AS BIGINT) AS orders FROM {from_query('orders_by_weekday_hour')}
      GROUP BY day_of_week) w""")(
    lambda s, d: Fn.weekday_share(_stored("orders_by_weekday_hour", s, d)))
register("hour_band_share", f"""
SELECT CAST(sum(CASE WHEN hour BETWEEN 10 AND 21 THEN orders END) AS DOUBLE) / NULLIF(CAST(sum(orders) AS DOUBLE), 0)
    AS share_10_21,
  CAST(sum(CASE WHEN hour BETWEEN 0 AND 5 THEN orders END) AS DOUBLE) / NULLIF(CAST(sum(orders) AS DOUBLE), 0)
    AS share_0_5
FROM {from_query('orders_by_weekday_hour')}""")(lambda s, d: Fn.hour_band_share(_stored("orders_by_weekday_hour", s, d)))

_STATE_COLS = "state, orders, revenue, aov, freight_ratio, delivered_orders, late_rate, delivery_days"
register("state_share", f"""
SELECT {_STATE_COLS}, revenue / CAST(sum(CAST(revenue AS DECIMAL(38,4))) OVER () AS DOUBLE) AS share_revenue,
  CAST(orders AS DOUBLE) / sum(orders) OVER () AS share_orders
FROM {from_query('state_summary')}""")(lambda s, d: Fn.state_share(_stored("state_summary", s, d)))
register("state_rank", f"""
SELECT state, revenue, revenue / CAST(sum(CAST(revenue AS DECIMAL(38,4))) OVER () AS DOUBLE) AS share,
  state = first(state ORDER BY revenue DESC, state) OVER () AS is_leader
FROM {from_query('state_summary')} WHERE revenue IS NOT NULL""")(
    lambda s, d: Fn.state_rank(_stored("state_summary", s, d), "revenue"))
register("state_rank_late_rate", f"""
SELECT state, late_rate, CAST(NULL AS DOUBLE) AS share,
  state = first(state ORDER BY late_rate DESC, state) OVER () AS is_leader
FROM {from_query('state_summary')} WHERE late_rate IS NOT NULL""")(
    lambda s, d: Fn.state_rank(_stored("state_summary", s, d), "late_rate"))

def _osum(x: str) -> str:
    """Doubles added in ascending order (matches ``ordered_sum``)."""
    return f"list_reduce(list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL)), lambda a, b: a + b, 0.0)"


register("state_overall", f"""
SELECT CASE WHEN {_osum('fr_den')} <> 0 THEN {_osum('fr_num')} / {_osum('fr_den')} END AS freight_ratio,
  CASE WHEN sum(lt_den) <> 0 THEN {_osum('lt_num')} / sum(lt_den) END AS late_rate,
  CASE WHEN sum(dd_den) <> 0 THEN {_osum('dd_num')} / sum(dd_den) END AS delivery_days,
  CAST(sum(CAST(revenue AS DECIMAL(38,4))) AS DOUBLE) / NULLIF(CAST(sum(orders) AS DOUBLE), 0) AS aov
FROM (
  SELECT revenue / (1 + freight_ratio) * freight_ratio AS fr_num,
    CASE WHEN freight_ratio IS NOT NULL THEN revenue / (1 + freight_ratio) END AS fr_den,
    late_rate * CAST(delivered_orders AS DOUBLE) AS lt_num,
    CASE WHEN late_rate IS NOT NULL THEN CAST(delivered_orders AS DOUBLE) END AS lt_den,
    delivery_days * CAST(delivered_orders AS DOUBLE) AS dd_num,
    CASE WHEN delivery_days IS NOT NULL THEN CAST(delivered_orders AS DOUBLE) END AS dd_den,
    revenue, orders
  FROM {from_query('state_summary')}) t""")(lambda s, d: Fn.state_overall(_stored("state_summary", s, d)))

# ------------------------------------------------------------------ RFM page

register("segment_profile", f"""
SELECT segment, {_case_map(Fn.SEGMENT_TIER, 'segment')} AS tier,
  CAST({_order_case(SEGMENT_ORDER, 'segment')} AS BIGINT) AS display_order, customers, revenue,
  customer_share, revenue_share,
  CASE WHEN customer_share <> 0 THEN revenue_share / customer_share END AS value_index,
  {_case_map(Fn.SEGMENT_ACTION, 'segment')} AS action
FROM (SELECT segment, customers, revenue, CAST(customers AS DOUBLE) / sum(customers) OVER () AS customer_share,
        revenue / CAST(sum(CAST(revenue AS DECIMAL(38,4))) OVER () AS DOUBLE) AS revenue_share
      FROM {from_query('rfm_segments')} WHERE customers IS NOT NULL) x""")(
    lambda s, d: Fn.segment_profile(_run("rfm_segments", s, d)))

register("rfm_grid", f"""
SELECT r_score, f_score, customers,
  sum(CASE WHEN f_score = 1 THEN customers END) OVER () / NULLIF(sum(customers) OVER (), 0) AS single_purchase_share,
  log10(customers + 1) AS intensity
FROM (
  SELECT r.r_score, f.f_score, CAST(coalesce(m.customers, 0) AS BIGINT) AS customers
  FROM (SELECT CAST(v AS BIGINT) AS r_score FROM (VALUES (5), (4), (3), (2), (1)) x(v)) r
  JOIN (SELECT CAST(v AS BIGINT) AS f_score FROM (VALUES (1), (3), (4), (5)) y(v)) f ON TRUE
  LEFT JOIN {from_query('rfm_matrix', 'm')} ON m.r_score = r.r_score AND m.f_score = f.f_score
) g""")(lambda s, d: Fn.rfm_grid(s, _stored("rfm_matrix", s, d)))

register("f_score_share", f"""
SELECT f_score, customers, CAST(customers AS DOUBLE) / sum(customers) OVER () AS share
FROM (SELECT f_score, CAST(sum(customers) AS BIGINT) AS customers FROM {from_query('rfm_matrix')} GROUP BY f_score) x""")(
    lambda s, d: Fn.f_score_share(_stored("rfm_matrix", s, d)))

# ---------------------------------------------------------------- churn page

register("recency_status", f"""
SELECT bucket, CAST(bucket AS VARCHAR) || '-' || CAST(bucket + 29 AS VARCHAR) AS label,
  CASE WHEN bucket > 180 THEN 'churned' WHEN bucket >= 91 THEN 'cooling' ELSE 'active' END AS status,
  customers, monetary
FROM {from_query('recency_histogram')}""")(lambda s, d: Fn.recency_status(_run("recency_histogram", s, d)))

register("churn_ranked_states", f"""
WITH st AS (SELECT * FROM {from_query('churn_by_state')}),
ov AS (SELECT list_reduce(list_sort(list(churn_rate * customers) FILTER (WHERE churn_rate * customers IS NOT NULL)),
                           lambda a, b: a + b, 0.0) / NULLIF(CAST(sum(customers) AS DOUBLE), 0) AS overall_churn_rate,
         count_if(customers >= 300) AS q FROM st),
shown AS (SELECT st.*, ov.overall_churn_rate FROM st, ov WHERE ov.q = 0 OR st.customers >= 300)
SELECT state, customers, churn_rate, overall_churn_rate,
  state = first(state ORDER BY churn_rate DESC, state) OVER () AS is_worst
FROM shown""")(lambda s, d: Fn.churn_ranked_states(_stored("churn_by_state", s, d), 300))
register("churn_ranked_states_min_50", f"""
WITH st AS (SELECT * FROM {from_query('churn_by_state')}),
ov AS (SELECT list_reduce(list_sort(list(churn_rate * customers) FILTER (WHERE churn_rate * customers IS NOT NULL)),
                           lambda a, b: a + b, 0.0) / NULLIF(CAST(sum(customers) AS DOUBLE), 0) AS overall_churn_rate,
         count_if(customers >= 50) AS q FROM st),
shown AS (SELECT st.*, ov.overall_churn_rate FROM st, ov WHERE ov.q = 0 OR st.customers >= 50)
SELECT state, customers, churn_rate, overall_churn_rate,
  state = first(state ORDER BY churn_rate DESC, state) OVER () AS is_worst
FROM shown""")(lambda s, d: Fn.churn_ranked_states(_stored("churn_by_state", s, d), 50))
register("churn_ranked_categories", f"""
SELECT category, customers, churn_rate,
  category = first(category ORDER BY churn_rate DESC, category) OVER () AS is_worst
FROM {from_query('churn_by_last_category')}""")(
    lambda s, d: Fn.churn_ranked_categories(_run("churn_by_last_category", s, d)))

# ------------------------------------------------------------- campaign pool

register("pool_kpis", f"""
SELECT CAST(sum(CASE WHEN bucket BETWEEN 91 AND 151 THEN customers ELSE 0 END) AS BIGINT) AS cooling_customers,
  CAST(sum(CASE WHEN bucket = 151 THEN customers ELSE 0 END) AS BIGINT) AS crossing_customers,
  coalesce(CAST(sum(CASE WHEN bucket BETWEEN 91 AND 151 THEN CAST(monetary AS DECIMAL(38,4)) END) AS DOUBLE), 0.0)
    AS cooling_monetary,
  CAST(sum(repeaters) AS DOUBLE) / NULLIF(sum(customers), 0) AS repeat_rate
FROM {from_query('campaign_pool')}""")(lambda s, d: Fn.pool_kpis(_stored("campaign_pool", s, d)))

register("pool_by_segment", f"""
SELECT segment, CAST({_order_case(SEGMENT_ORDER, 'segment')} AS BIGINT) AS display_order, customers, monetary,
  CAST(customers AS DOUBLE) / sum(customers) OVER () AS share,
  CASE WHEN customers <> 0 THEN monetary / customers END AS mean_monetary,
  segment = first(segment ORDER BY customers DESC, segment) OVER () AS is_top
FROM (SELECT segment, CAST(sum(customers) AS BIGINT) AS customers,
        CAST(sum(CAST(monetary AS DECIMAL(38,4))) AS DOUBLE) AS monetary
      FROM {from_query('campaign_pool')} WHERE bucket BETWEEN 91 AND 151 GROUP BY segment) x""")(
    lambda s, d: Fn.pool_by_segment(_stored("campaign_pool", s, d)))
register("pool_by_state", f"""
SELECT state, customers, monetary, CASE WHEN customers <> 0 THEN monetary / customers END AS mean_monetary
FROM (SELECT state, CAST(sum(customers) AS BIGINT) AS customers,
        CAST(sum(CAST(monetary AS DECIMAL(38,4))) AS DOUBLE) AS monetary
      FROM {from_query('campaign_pool')} WHERE bucket BETWEEN 91 AND 151 GROUP BY state) x
ORDER BY customers DESC, state LIMIT 10""")(lambda s, d: Fn.pool_by_state(_stored("campaign_pool", s, d), 10))

register("default_bucket_range", f"""
SELECT CAST(CASE WHEN count_if(bucket = 91) > 0 AND count_if(bucket = 151) > 0 THEN 91 ELSE min(bucket) END AS BIGINT)
    AS bucket_from,
  CAST(CASE WHEN count_if(bucket = 91) > 0 AND count_if(bucket = 151) > 0 THEN 151 ELSE max(bucket) END AS BIGINT)
    AS bucket_to
FROM {from_query('campaign_pool')}""")(lambda s, d: Fn.default_bucket_range(_stored("campaign_pool", s, d)))

_IN_RANGE = f"""bucket BETWEEN (SELECT bucket_from FROM {from_query('default_bucket_range')}) AND (SELECT bucket_to FROM {from_query('default_bucket_range')})"""
_TARGET_SQL = f"""
SELECT customers, orders, monetary, CASE WHEN orders <> 0 THEN monetary / orders ELSE 0.0 END AS aov
FROM (SELECT CAST(coalesce(sum(customers), 0) AS DOUBLE) AS customers,
        CAST(coalesce(sum(orders), 0) AS DOUBLE) AS orders,
        coalesce(CAST(sum(CAST(monetary AS DECIMAL(38,4))) AS DOUBLE), 0.0) AS monetary
      FROM {from_query('campaign_pool')}
      WHERE {_IN_RANGE} AND {O._in('segment', SEGMENT_ORDER)}) x"""
register("target_cohort", _TARGET_SQL)(
    lambda s, d: Fn.target_cohort(_stored("campaign_pool", s, d), SEGMENT_ORDER))

# ------------------------------------------------------------ campaign model


def _cohort(s, d):
    pool = _stored("campaign_pool", s, d)
    organic = Fn.pool_kpis(pool).select("repeat_rate")
    return attach_scalar(Fn.target_cohort(pool, SEGMENT_ORDER), organic)


def _scen_sql() -> str:
    rows = ", ".join(f"({i}, '{x.name}', {x.reach!r}, {x.response!r}, {x.discount!r}, {x.contact_cost!r})"
                     for i, x in enumerate(K.DEFAULT_SCENARIOS))
    return (f"(SELECT CAST(i AS INTEGER) AS scenario_index, scenario, CAST(reach AS DOUBLE) AS reach, "
            f"CAST(response AS DOUBLE) AS response, CAST(discount AS DOUBLE) AS discount, "
            f"CAST(cost_per_contact AS DOUBLE) AS cost_per_contact "
            f"FROM (VALUES {rows}) v(i, scenario, reach, response, discount, cost_per_contact))")


_COHORT_SQL = f"""
cohort AS (SELECT t.*, k.repeat_rate FROM ({_TARGET_SQL}) t,
  (SELECT CAST(sum(repeaters) AS DOUBLE) / NULLIF(sum(customers), 0) AS repeat_rate
   FROM {from_query('campaign_pool')}) k),
scen AS {_scen_sql()},
ev AS (
  SELECT c.customers, c.orders, c.monetary, c.aov, c.repeat_rate, s.*,
    c.customers * s.reach AS reached,
    c.customers * s.reach * s.response AS buyers,
    c.customers * s.reach * s.response * c.aov * (1 - s.discount) AS revenue,
    (c.customers * s.reach * s.response + c.customers * s.reach * c.repeat_rate) * c.aov * s.discount AS discount_cost,
    c.customers * s.cost_per_contact AS contact_cost,
    (c.customers * s.reach * s.response + c.customers * s.reach * c.repeat_rate) * c.aov * s.discount
      + c.customers * s.cost_per_contact AS spend,
    c.customers * s.reach * s.response * c.aov * 0.3
      - ((c.customers * s.reach * s.response + c.customers * s.reach * c.repeat_rate) * c.aov * s.discount
         + c.customers * s.cost_per_contact) AS profit,
    CASE WHEN c.customers * s.reach * c.aov * (0.3 - s.discount) > 0
      THEN (c.customers * s.reach * c.repeat_rate * c.aov * s.discount + c.customers * s.cost_per_contact)
           / (c.customers * s.reach * c.aov * (0.3 - s.discount)) END AS breakeven
  FROM cohort c, scen s
)"""


def _ev(s, d):
    return K.evaluate(_cohort(s, d), K.DEFAULT_SCENARIOS, organic="repeat_rate", margin=K.DEFAULT_MARGIN)


register("campaign_evaluate", f"""
WITH {_COHORT_SQL}
SELECT *, CASE WHEN spend <> 0 THEN profit / spend END AS roi FROM ev""")(_ev)
register("campaign_breakeven", f"""
WITH {_COHORT_SQL}
SELECT scenario_index, scenario, breakeven FROM ev""")(
    lambda s, d: _ev(s, d).select("scenario_index", "scenario", "breakeven"))
register("campaign_best", f"""
WITH {_COHORT_SQL}
SELECT scenario, profit, spend, breakeven, profit > 0 AS recommended,
  CASE WHEN profit > 0 THEN (response - breakeven) * 100 END AS margin_points
FROM ev ORDER BY profit DESC, scenario_index LIMIT 1""")(lambda s, d: K.best_scenario(_ev(s, d)))


def _budget(s, d):
    ev = _ev(s, d)
    best = attach_scalar(K.best_scenario(ev), ev.agg(F.max("customers").alias("customers")))  # one cohort
    return K.budget_cap(best, "customers", 1000.0).drop("customers")


register("campaign_budget", f"""
WITH {_COHORT_SQL}
SELECT scenario, profit, spend, breakeven, recommended, margin_points,
  CASE WHEN spend > 1000.0 THEN customers * 1000.0 / spend END AS affordable_customers
FROM (SELECT e.*, profit > 0 AS recommended,
        CASE WHEN profit > 0 THEN (response - breakeven) * 100 END AS margin_points
      FROM ev e ORDER BY profit DESC, scenario_index LIMIT 1) b""")(_budget)

register("campaign_curve", f"""
WITH {_COHORT_SQL},
up AS (SELECT least(greatest(max(response), coalesce(max(breakeven), 0.0), 0.01) * 1.6, 1.0) AS upper FROM ev)
SELECT scenario_index, scenario, point, response_rate,
  customers * reach * response_rate * aov * 0.3
    - ((customers * reach * response_rate + customers * reach * repeat_rate) * aov * discount
       + customers * cost_per_contact) AS profit
FROM (SELECT ev.*, CAST(p AS INTEGER) AS point,
        CASE WHEN p = 59 THEN up.upper ELSE p * (up.upper / 59) END AS response_rate
      FROM ev, up, range(60) r(p)) x""")(lambda s, d: K.profit_curve(_ev(s, d), (), organic="repeat_rate"))

register("campaign_defaults", f"""
SELECT d.*, CAST(0.3 AS DOUBLE) AS margin, k.repeat_rate AS organic
FROM {_scen_sql()} d, {from_query('pool_kpis', 'k')}""")(
    lambda s, d: K.default_assumptions(Fn.pool_kpis(_stored("campaign_pool", s, d))))



def _segment_cohorts(s, d):
    pool = _stored("campaign_pool", s, d)
    organic = Fn.pool_kpis(pool).select("repeat_rate")
    return attach_scalar(Fn.cohorts_by(pool, "segment"), organic)


register("campaign_evaluate_by_segment", f"""
WITH seg AS (
  SELECT segment, customers, orders, monetary, CASE WHEN orders <> 0 THEN monetary / orders ELSE 0.0 END AS aov
  FROM (SELECT segment, CAST(sum(customers) AS DOUBLE) AS customers, CAST(sum(orders) AS DOUBLE) AS orders,
          CAST(sum(CAST(monetary AS DECIMAL(38,4))) AS DOUBLE) AS monetary
        FROM {from_query('campaign_pool')} WHERE {_IN_RANGE} GROUP BY segment) x),
k AS (SELECT CAST(sum(repeaters) AS DOUBLE) / NULLIF(sum(customers), 0) AS repeat_rate
      FROM {from_query('campaign_pool')}),
scen AS {_scen_sql()}
SELECT c.segment, s.scenario_index, s.scenario,
  c.customers * s.reach * s.response * c.aov * 0.3
    - ((c.customers * s.reach * s.response + c.customers * s.reach * k.repeat_rate) * c.aov * s.discount
       + c.customers * s.cost_per_contact) AS profit
FROM seg c, k, scen s""")(
    lambda s, d: K.evaluate(_segment_cohorts(s, d), K.DEFAULT_SCENARIOS, organic="repeat_rate")
    .select("segment", "scenario_index", "scenario", "profit"))

_TITLE = ("array_to_string(list_transform(range(1, greatest(length(city), 1) + 1), lambda i: CASE WHEN i = 1 "
          "OR NOT regexp_matches(substr(city, i - 1, 1), '\\p{L}') THEN upper(substr(city, i, 1)) "
          "ELSE lower(substr(city, i, 1)) END), '')")
register("city_labels", f"""
SELECT city, state, orders, revenue, {_TITLE} || ' · ' || state AS label FROM {from_query('top_cities')}""")(
    lambda s, d: Fn.city_labels(_run("top_cities", s, d)))
register("product_labels", f"""
SELECT product_id, category, revenue, orders, avg_price, substr(CAST(product_id AS VARCHAR), 1, 8) || '…' AS product
FROM {from_query('top_products')}""")(lambda s, d: Fn.product_labels(_run("top_products", s, d)))
