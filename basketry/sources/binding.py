"""Raw retail tables derived from the driver's TPC-H-like test tables.

The source reads nine raw e-commerce tables; the test data has none of them,
so each raw table is a lazy DataFrame over the given parquet files (mapping in
FIXTURES.md §2).  Ids stay ``bigint``.  Nothing here is collected: the binding
is part of every plan and grows with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.rownum import split_row_number
from basketry.sources import files

RAW_TABLES = (
    "orders",
    "order_items",
    "customers",
    "products",
    "order_payments",
    "sellers",
    "category_name_translation",
)

#: Raw tables that are loaded and audited but feed no mart.
SIDE_TABLES = ("order_reviews", "geolocation")

ITEM_TASK_BYTES = 16 * 1024 * 1024  # of line items in Parquet: about 150 MB of rows in a sort

SOURCE_TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _add_hours(ts: str, n: Column) -> Column:
    return F.timestamp_add("HOUR", n, F.col(ts))


def _add_days(ts: str, n: Column) -> Column:
    return F.timestamp_add("DAY", n, F.col(ts))


def _status(letter: Column, key: Column) -> Column:
    return (
        F.when(letter == "P", "canceled")
        .when(letter == "O", "shipped")
        .when((letter == "F") & (key % 50 == 0), "unavailable")
        .when(letter == "F", "delivered")
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    delivered = F.when(
        (F.col("o_orderstatus") == "F") & (key % 97 != 0), _add_days("o_orderdate", (key % 40).cast("int"))
    )
    return o.select(
        key.alias("order_id"),
        key.alias("customer_id"),
        _status(F.col("o_orderstatus"), key).alias("order_status"),
        _add_hours("o_orderdate", (key % 24).cast("int")).alias("order_purchase_timestamp"),
        _add_hours("o_orderdate", F.lit(1)).alias("order_approved_at"),
        _add_days("o_orderdate", F.lit(2)).alias("order_delivered_carrier_date"),
        delivered.alias("order_delivered_customer_date"),
        _add_days("o_orderdate", F.lit(25)).alias("order_estimated_delivery_date"),
    )


def _item_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks that number the items, by the size of their files, so that none has to spill; none if Spark's shuffle setting gives as many."""
    found = files.data_files(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet")
    tasks = -(-sum(n for _, n in found) // ITEM_TASK_BYTES)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _items_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_shipdate", "l_returnflag", "l_quantity")
    # item number = row_number per order; one order may hold a large share of
    # the items, so the numbering splits hot orders across ranges
    order = [("l_linenumber", False), ("l_partkey", False), ("l_suppkey", False), ("l_extendedprice", False)]
    li = split_row_number(li, "l_orderkey", order, "order_item_id", _item_tasks(spark, sf_dir))
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        price.alias("price"),
        (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,4)").alias("freight_value"),
        F.col("l_returnflag"),
        F.col("l_quantity"),
    )


def items_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their surrogate item number (shared by items and payments)."""
    return _items_numbered(spark, sf_dir)


def order_items_from(numbered: DataFrame) -> DataFrame:
    return numbered.drop("l_returnflag", "l_quantity")


def order_payments_from(numbered: DataFrame) -> DataFrame:
    items = numbered
    flag = F.col("l_returnflag")
    ptype = F.when(flag == "A", "credit_card").when(flag == "R", "boleto").when(flag == "N", "voucher")
    return items.filter(F.col("order_id") % 500 != 0).select(
        "order_id",
        F.col("order_item_id").alias("payment_sequential"),
        ptype.alias("payment_type"),
        F.col("l_quantity").cast("bigint").alias("payment_installments"),
        (F.col("price") + F.col("freight_value")).cast("decimal(18,4)").alias("payment_value"),
    )


def raw_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_items_from(_items_numbered(spark, sf_dir))


def raw_order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_payments_from(_items_numbered(spark, sf_dir))


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cust_state = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name")
    return o.join(cust_state, o.o_custkey == cust_state.c_custkey, "left").select(
        F.col("o_orderkey").alias("customer_id"),
        F.col("o_custkey").alias("customer_unique_id"),
        (F.col("o_orderkey") % 90000).alias("customer_zip_code_prefix"),
        F.lower(F.trim(F.col("o_orderpriority"))).alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    size = F.col("p_size")
    dim = size.cast("decimal(18,3)")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 100 != 0, F.lower("p_brand")).alias("product_category_name"),
        F.length("p_name").cast("bigint").alias("product_name_lenght"),
        (size * 10).cast("bigint").alias("product_description_lenght"),
        (size % 5).cast("bigint").alias("product_photos_qty"),
        (size * 100).cast("decimal(18,3)").alias("product_weight_g"),
        dim.alias("product_length_cm"),
        dim.alias("product_height_cm"),
        dim.alias("product_width_cm"),
    )


def raw_category_name_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.lower(F.col("p_brand"))
    return (
        _read(spark, sf_dir, "part")
        .select(brand.alias("string_field_0"))
        .distinct()
        .filter(F.col("string_field_0") != "brand#13")
        .select(
            "string_field_0",
            F.concat(F.lit("cat_"), F.replace(F.col("string_field_0"), F.lit("brand#"), F.lit(""))).alias(
                "string_field_1"
            ),
        )
    )


def raw_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
        F.col("s_suppkey").alias("seller_id"),
        (F.col("s_suppkey") % 90000).alias("seller_zip_code_prefix"),
        F.lower(F.col("s_name")).alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )


def raw_order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews whose message is a document's whole text, with its line breaks, quotes and commas; empty ones are null, as in CSV."""
    d = _read(spark, sf_dir, "documents")
    days = (F.col("doc_id") % 700).cast("int")
    base = F.lit("2017-01-01 00:00:00").cast("timestamp_ntz")
    return d.select(
        F.col("doc_id").alias("review_id"),
        (F.col("doc_id") * 4 + 1).alias("order_id"),
        (F.col("doc_id") % 5 + 1).alias("review_score"),
        F.col("source").alias("review_comment_title"),
        F.nullif("text", F.lit("")).alias("review_comment_message"),
        F.timestamp_add("DAY", days, base).alias("review_creation_date"),
        F.when(F.col("doc_id") % 7 != 0, F.timestamp_add("DAY", days + 2, base)).alias("review_answer_timestamp"),
    )


def raw_geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
        (F.col("s_suppkey") % 90000).alias("geolocation_zip_code_prefix"),
        ((F.col("s_suppkey") % 180 - 90).cast("double") / 2).alias("geolocation_lat"),
        ((F.col("s_suppkey") % 360 - 180).cast("double") / 2).alias("geolocation_lng"),
        F.lower(F.col("s_name")).alias("geolocation_city"),
        F.col("n_name").alias("geolocation_state"),
    )


_BUILDERS = {
    "order_reviews": raw_order_reviews,
    "geolocation": raw_geolocation,
    "orders": raw_orders,
    "order_items": raw_order_items,
    "customers": raw_customers,
    "products": raw_products,
    "order_payments": raw_order_payments,
    "sellers": raw_sellers,
    "category_name_translation": raw_category_name_translation,
}


def bind_raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All raw tables as lazy DataFrames over ``sf_dir``."""
    return {name: _BUILDERS[name](spark, sf_dir) for name in RAW_TABLES}


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _BUILDERS[name](spark, sf_dir)
