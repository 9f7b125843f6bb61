"""Staging, intermediate and mart models as lazy DataFrame functions.

Each model takes DataFrames and returns a DataFrame; nothing is executed here.
Staging imposes the typed contract by casts; intermediate models clean and
combine; marts are the tables the queries read (materialised by
``plans.warehouse``).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from basketry.functions.columns import date_key, f_score, is_churn, segment, valid_order
from basketry.operators.hotkeys import split_join
from basketry.operators.latest import latest_per_key
from basketry.operators.ntile import global_ntiles
from basketry.operators.scalar import attach_scalar

MONEY = "decimal(18,4)"
SIZE = "decimal(18,3)"
TS = "timestamp_ntz"


def _int64(df: DataFrame, name: str) -> Column:
    """int64 cast; floating input is rounded half away from zero first, as the source does."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, FractionalType):
        c = F.round(c)
    return c.cast("bigint")


def _id(name: str) -> Column:
    """Ids are text from staging on, whatever type the raw table has."""
    return F.col(name).cast("string").alias(name)


# ---------------------------------------------------------------- staging


def stg_orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        _id("order_id"),
        _id("customer_id"),
        F.col("order_status").cast("string").alias("order_status"),
        *[
            F.col(c).cast(TS).alias(c)
            for c in (
                "order_purchase_timestamp",
                "order_approved_at",
                "order_delivered_carrier_date",
                "order_delivered_customer_date",
                "order_estimated_delivery_date",
            )
        ],
    )


def stg_order_items(raw: DataFrame) -> DataFrame:
    return raw.select(
        _id("order_id"),
        _int64(raw, "order_item_id").alias("order_item_id"),
        _id("product_id"),
        _id("seller_id"),
        F.col("shipping_limit_date").cast(TS).alias("shipping_limit_date"),
        F.col("price").cast(MONEY).alias("price"),
        F.col("freight_value").cast(MONEY).alias("freight_value"),
    )


def stg_customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        _id("customer_id"),
        _id("customer_unique_id"),
        _int64(raw, "customer_zip_code_prefix").alias("customer_zip_code_prefix"),
        F.trim(F.lower(F.col("customer_city").cast("string"))).alias("customer_city"),
        F.upper(F.col("customer_state").cast("string")).alias("customer_state"),
    )


def stg_products(raw: DataFrame) -> DataFrame:
    return raw.select(
        _id("product_id"),
        F.col("product_category_name").cast("string").alias("product_category_name"),
        _int64(raw, "product_name_lenght").alias("product_name_length"),
        _int64(raw, "product_description_lenght").alias("product_description_length"),
        _int64(raw, "product_photos_qty").alias("product_photos_qty"),
        *[
            F.col(c).cast(SIZE).alias(c)
            for c in ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
        ],
    )


def stg_order_payments(raw: DataFrame) -> DataFrame:
    return raw.select(
        _id("order_id"),
        _int64(raw, "payment_sequential").alias("payment_sequential"),
        F.col("payment_type").cast("string").alias("payment_type"),
        _int64(raw, "payment_installments").alias("payment_installments"),
        F.col("payment_value").cast(MONEY).alias("payment_value"),
    )


def stg_sellers(raw: DataFrame) -> DataFrame:
    return raw.select(
        _id("seller_id"),
        _int64(raw, "seller_zip_code_prefix").alias("seller_zip_code_prefix"),
        F.trim(F.lower(F.col("seller_city").cast("string"))).alias("seller_city"),
        F.upper(F.col("seller_state").cast("string")).alias("seller_state"),
    )


# ----------------------------------------------------------- intermediate


def int_customers_deduplicated(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Latest address per customer_unique_id: by purchase time desc, customer_id desc.

    Orders are first reduced to their latest purchase per customer_id (the
    only order column the ranking uses), then the winner per unique customer
    is a ``max(struct)`` aggregate: partial aggregation absorbs hot keys.
    """
    last_order = orders.groupBy("customer_id").agg(F.max("order_purchase_timestamp").alias("__last_ts"))
    joined = customers.join(last_order, "customer_id", "left")
    return latest_per_key(
        joined,
        ["customer_unique_id"],
        [("__last_ts", True), ("customer_id", True)],
        ["customer_id", "customer_city", "customer_state", "customer_zip_code_prefix"],
    )


def int_products_enriched(products: DataFrame, translations: DataFrame) -> DataFrame:
    t = translations.select(F.col("string_field_0"), F.col("string_field_1"))
    joined = products.join(t, products.product_category_name == t.string_field_0, "left")
    return joined.select(
        "product_id",
        F.coalesce(F.col("string_field_1"), F.col("product_category_name"), F.lit("others")).alias(
            "product_category_name_english"
        ),
        "product_name_length",
        "product_description_length",
        "product_photos_qty",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
    )


def int_order_payments_aggregated(payments: DataFrame) -> DataFrame:
    """Per order: payment count, max instalments, total, type of the largest payment.

    The largest payment is ``max(struct(value, -sequential, type))``: ties on
    value go to the lowest sequence number (the source leaves ties open).
    """
    top = F.max(F.struct(F.col("payment_value"), -F.col("payment_sequential"), F.col("payment_type").alias("t")))
    return payments.groupBy("order_id").agg(
        F.count("payment_sequential").alias("payment_installments_count"),
        F.max("payment_installments").alias("max_installments"),
        F.sum("payment_value").alias("total_payment_value"),
        top.getField("t").alias("primary_payment_type"),
    )


# ------------------------------------------------------------------ marts


def dim_customers(dedup: DataFrame) -> DataFrame:
    return dedup.select(
        "customer_unique_id", "customer_id", "customer_city", "customer_state", "customer_zip_code_prefix"
    )


def dim_products(enriched: DataFrame) -> DataFrame:
    return enriched


def dim_sellers(sellers: DataFrame) -> DataFrame:
    return sellers.select("seller_id", "seller_city", "seller_state", "seller_zip_code_prefix")


def dim_payments(agg: DataFrame) -> DataFrame:
    return agg.select(
        "order_id",
        F.col("primary_payment_type").alias("payment_type_primary"),
        "max_installments",
        "total_payment_value",
    )


#: Purchase dates outside are taken for errors: they widen no calendar (and stay out of the calendar's joins).
PLAUSIBLE = (date(1970, 1, 1), date(2099, 12, 31))


def calendar_days(orders: DataFrame, plausible: tuple[date, date] = PLAUSIBLE) -> DataFrame:
    """Every day of the whole calendar years spanned by the plausible order purchase
    dates (the source's fixed 2016-2018 calendar is exactly that for its
    data).  At most one row for each year of ``plausible`` is made before the days, which
    spread over the tasks by year; ``implausible_dates`` counts what is left out."""
    day = F.to_date("order_purchase_timestamp")
    span = orders.where(day.between(*map(F.lit, plausible))).agg(F.year(F.min(day)).alias("y0"), F.year(F.max(day)).alias("y1"))
    years = span.select(F.explode(F.sequence("y0", "y1")).alias("y")).repartition("y")
    first, last = F.make_date("y", F.lit(1), F.lit(1)), F.make_date("y", F.lit(12), F.lit(31))
    return years.select(F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("full_date"))


def implausible_dates(orders: DataFrame, plausible: tuple[date, date] = PLAUSIBLE) -> DataFrame:
    """One row: orders without a purchase date, and with one outside ``plausible``."""
    day = F.to_date("order_purchase_timestamp")
    return orders.agg(F.count_if(day.isNull()).alias("missing"), F.count_if(~day.between(*map(F.lit, plausible))).alias("implausible"))


def dim_time(days: DataFrame) -> DataFrame:
    """One row per calendar day; day_of_week 1 = Sunday."""
    d = F.col("full_date")
    dow = F.dayofweek(d)
    return days.select(
        date_key(d).alias("date_key"),
        d,
        F.year(d).cast("bigint").alias("year"),
        F.quarter(d).cast("bigint").alias("quarter"),
        F.month(d).cast("bigint").alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.dayofmonth(d).cast("bigint").alias("day"),
        dow.cast("bigint").alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        dow.isin(1, 7).alias("is_weekend"),
    )


def orders_with_buyer(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with their customer's unique id (order grain)."""
    return orders.join(customers.select("customer_id", "customer_unique_id"), "customer_id")


def _items_with_order(items: DataFrame, per_order: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Join by order; an order among ``hot`` (``hot_keys``) is dealt over several tasks by its item numbers."""
    return items.join(per_order, "order_id") if hot is None else split_join(items, per_order, "order_id", ["order_item_id"], hot)


def fct_order_items_sales(items: DataFrame, orders: DataFrame, customers: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Item-grain sales fact.

    Orders and customers (both order grain) are joined first so the item
    table, the largest input, is shuffled once, on order_id.  Without ``customers``,
    ``orders`` is ``orders_with_buyer`` already.
    """
    oc = orders if customers is None else orders_with_buyer(orders, customers)
    f = _items_with_order(items, oc, hot)
    return f.select(
        "order_id",
        "order_item_id",
        "customer_id",
        "customer_unique_id",
        "product_id",
        "seller_id",
        date_key("order_purchase_timestamp").alias("order_date_key"),
        "order_status",
        "order_purchase_timestamp",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
        "price",
        "freight_value",
        (F.col("price") + F.col("freight_value")).alias("item_total_amount"),
    )


# ------------------------------------------------------------------- RFM


def rfm_customer_orders(fact: DataFrame) -> DataFrame:
    """Valid item rows with the customer key (the fact already carries it)."""
    return fact.filter(valid_order()).select(
        "customer_unique_id", "order_id", "order_purchase_timestamp", "item_total_amount"
    )


def rfm_metrics(customer_orders: DataFrame) -> DataFrame:
    """Per customer: last purchase, distinct orders, money (recency comes later)."""
    return customer_orders.groupBy("customer_unique_id").agg(
        F.countDistinct("order_id").alias("frequency_orders"),
        F.sum("item_total_amount").alias("monetary_value"),
        F.max("order_purchase_timestamp").alias("last_purchase_timestamp"),
    )


def rfm_reference_date(metrics: DataFrame) -> DataFrame:
    """One row: last valid purchase date + 1 day."""
    return metrics.agg(F.date_add(F.to_date(F.max("last_purchase_timestamp")), 1).alias("reference_date"))


def rfm_recency(metrics: DataFrame) -> DataFrame:
    ref = rfm_reference_date(metrics)
    return attach_scalar(metrics, ref).select(
        "customer_unique_id",
        F.datediff(F.col("reference_date"), F.to_date("last_purchase_timestamp")).cast("bigint").alias("recency_days"),
        "frequency_orders",
        "monetary_value",
        "last_purchase_timestamp",
    )


def rfm_scores(recency: DataFrame) -> DataFrame:
    """R: ntile(5) by recency desc, id; M: ntile(5) by money asc, id; F: fixed map.

    Both rankings are comparisons with their four cut rows: no row moves.
    """
    ident = ("customer_unique_id", False)
    orders = {"r_score": [("recency_days", True), ident], "m_score": [("monetary_value", False), ident]}
    return global_ntiles(recency, 5, orders).withColumn("f_score", f_score().cast("int"))


def rfm_segmented(scored: DataFrame) -> DataFrame:
    code = F.concat(F.col("r_score").cast("string"), F.col("f_score").cast("string"), F.col("m_score").cast("string"))
    return scored.select(
        "customer_unique_id",
        "recency_days",
        "frequency_orders",
        "monetary_value",
        "last_purchase_timestamp",
        F.col("r_score").cast("bigint").alias("r_score"),
        F.col("f_score").cast("bigint").alias("f_score"),
        F.col("m_score").cast("bigint").alias("m_score"),
        code.alias("rfm_code"),
        segment().alias("customer_segment"),
        is_churn().alias("is_churn"),
    )


# ------------------------------------------------------ query-side marts


#: Of the calendar, in the wide table.
CALENDAR = ("full_date", "year", "quarter", "month", "day_of_week", "day_name")
_BEFORE = ("order_id", "order_item_id", "order_date_key", "price", "freight_value", "item_total_amount",
           "order_status", "order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date", "payment_type")
_AFTER = ("customer_unique_id", "customer_state", "customer_city", "product_id", "category", "seller_state")
WIDE = (*_BEFORE, *CALENDAR, *_AFTER)


def sales_star_join(fact: DataFrame, time: DataFrame, customers: DataFrame, products: DataFrame,
                    sellers: DataFrame, payments: DataFrame, buyers: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """The six-table star join every sales question starts from (no filters).

    Inner joins drop rows outside the calendar or without a dimension row;
    payments is a left join whose misses become 'unknown'.

    Customer and payment attributes belong to the order, so they are joined
    to a one-row-per-order table first (order grain is several times smaller
    than item grain); ``buyers`` (order_id, customer_unique_id) is that table where the caller
    has it, else it is reduced from the fact.  The item-grain fact is then shuffled once, by ``order_id``.  Calendar,
    products and sellers are left to the planner's and AQE's size checks.
    """
    t = time.select("date_key", *CALENDAR)
    c = customers.select("customer_unique_id", "customer_state", "customer_city")
    p = products.select("product_id", F.col("product_category_name_english").alias("category"))
    s = sellers.select("seller_id", "seller_state")
    pay = payments.select("order_id", "payment_type_primary")
    of_order = (fact if buyers is None else buyers).select("order_id", "customer_unique_id")
    per_order = (
        (of_order.distinct() if buyers is None else of_order)  # one customer per order
        .join(c, "customer_unique_id")
        .join(pay, "order_id", "left")
        .select("order_id", "customer_state", "customer_city",
                F.coalesce(F.col("payment_type_primary"), F.lit("unknown")).alias("payment_type"))
    )
    j = (
        _items_with_order(fact.join(t, fact.order_date_key == t.date_key), per_order, hot)
        .join(p, "product_id")
        .join(s, "seller_id")
    )
    return j.select(*WIDE)


def order_slice(df: DataFrame, k: int, n: int) -> DataFrame:
    """The rows of the ``k``-th of ``n`` shares of the orders (by a hash of ``order_id``, a text): joins by order never cross shares."""
    return df if n == 1 else df.where(F.pmod(F.xxhash64("order_id"), F.lit(n)) == k)


def sales_orders(customers: DataFrame, payments: DataFrame, buyers: DataFrame) -> DataFrame:
    """All columns of the wide table that belong to the order, at order grain."""
    c = customers.select("customer_unique_id", "customer_state", "customer_city")
    paid = payments.select("order_id", F.col("payment_type_primary").alias("payment_type"))
    of_order = buyers.select("order_id", "customer_unique_id").join(c, "customer_unique_id").join(paid, "order_id", "left") \
        .select("order_id", "customer_state", "customer_city", F.coalesce("payment_type", F.lit("unknown")).alias("payment_type"))
    order = buyers.select("order_id", "customer_unique_id", date_key("order_purchase_timestamp").alias("order_date_key"), "order_status",
                          "order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date")
    return order.join(of_order, "order_id")


def sales_undated(items: DataFrame, products: DataFrame, sellers: DataFrame, orders: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """The rows of ``sales_star_join`` without the items' total and the calendar's columns and filter, from the staged items.

    All that belongs to the order is joined at order grain before (``sales_orders``), so the items are shuffled by ``order_id`` once, not
    first for the fact and again for the wide table; the products are the same joins in another order.  Products and
    sellers come first: where they are too many to broadcast, they move the items' own columns only.
    """
    p = products.select("product_id", F.col("product_category_name_english").alias("category"))
    s = sellers.select("seller_id", "seller_state")
    of_item = items.select("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")
    named = of_item.join(p, "product_id").join(s, "seller_id").drop("seller_id")
    return _items_with_order(named, orders, hot).select(*[c for c in (*_BEFORE, *_AFTER) if c != "item_total_amount"])


def with_calendar(undated: DataFrame, time: DataFrame) -> DataFrame:
    """``sales_undated`` with the items' total and its calendar columns; the calendar is broadcast (at most the days of ``PLAUSIBLE``), so rows stay where they are."""
    t = F.broadcast(time.select("date_key", *CALENDAR))
    amount = F.col("price") + F.col("freight_value")
    return undated.join(t, undated.order_date_key == t.date_key).withColumn("item_total_amount", amount).select(*WIDE)


#: Of the wide table: constant within an order, and so grouping keys of its rollup (next to the category).
ROLLUP_KEYS = ("order_id", "category", "order_date_key", "order_status", "order_purchase_timestamp", "order_delivered_customer_date",
               "order_estimated_delivery_date", "payment_type", "full_date", "year", "quarter", "month", "day_of_week", "day_name",
               "customer_unique_id", "customer_state", "customer_city")


def order_rollup(wide: DataFrame, time: DataFrame, tasks: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """The wide table by order and category with its money summed exactly; items are counted, their own columns go.

    Few items of an order share a category, so combining them before the shuffle saves next to nothing and
    widens every row by the sums' buffers.  The items are dealt by order instead (to ``tasks``): an order's rows stay
    neighbours, their equal columns (which come first) compress, and all its rows end in one file, where the readers'
    counts of distinct orders combine.  Only the orders among ``hot`` (``hot_keys``) are combined before their
    shuffle.  The calendar's columns follow from the date and are added last.
    """
    keys = [c for c in ROLLUP_KEYS if c not in (*CALENDAR, "category")] + ["category"]
    money = ("price", "freight_value", "item_total_amount")
    sums = [F.sum(c).alias(c) for c in money]

    def rolled(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("items"))

    rows = wide.select(*keys, *money)
    dealt = ("order_id",) if tasks is None else (tasks, "order_id")
    if hot is None:
        out = rolled(rows.repartition(*dealt))
    else:
        some = F.broadcast(hot.select("order_id"))
        ordinary = rolled(rows.join(some, "order_id", "left_anti").repartition(*dealt))
        out = ordinary.unionByName(rolled(rows.join(some, "order_id", "left_semi").select(*keys, *money)))
    t = F.broadcast(time.select("date_key", *CALENDAR))
    return out.join(t, out.order_date_key == t.date_key).select(*ROLLUP_KEYS, *money, "items")


def last_item_category(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Category of each customer's last valid item.

    Order: purchase time desc, price desc, order_id, order_item_id.  The pick
    is an aggregate (skew-safe), and products are joined to one row per
    customer instead of one per item.
    """
    last = latest_per_key(
        fact.filter(valid_order()),
        ["customer_unique_id"],
        [("order_purchase_timestamp", True), ("price", True), ("order_id", False), ("order_item_id", False)],
        ["product_id"],
    )
    p = products.select("product_id", F.col("product_category_name_english").alias("last_category"))
    return last.join(p, "product_id").select("customer_unique_id", "last_category")


def rfm_with_customers(rfm: DataFrame, customers: DataFrame, last_category: DataFrame | None = None) -> DataFrame:
    """RFM mart with the customer's state and city (and, when given, the
    category of the last valid item; null when it has none)."""
    c = customers.select("customer_unique_id", "customer_state", "customer_city")
    out = rfm.join(c, "customer_unique_id")
    return out.join(last_category, "customer_unique_id", "left") if last_category is not None else out
