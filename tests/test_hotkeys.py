"""Joins that split hot keys: the same rows as a plain join, no task far above the others."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from basketry.operators.hotkeys import hot_keys, split_join
from basketry.plans import models as M
from basketry.plans.warehouse import Warehouse

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _frames(spark, keys, partners):
    many = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i long")
    one = spark.createDataFrame([(k, f"v{j}") for j, k in enumerate(partners)], "k string, v string")
    return many, one


def test_hot_keys_are_named_with_their_pieces(spark):
    many, _ = _frames(spark, ["hot"] * 400 + [f"k{i}" for i in range(600)], [])
    assert [tuple(r) for r in hot_keys(many, "k", 10).collect()] == [("hot", 16)]
    assert hot_keys(many.where("k <> 'hot'"), "k", 10).isEmpty()
    assert hot_keys(many.limit(0), "k", 10).isEmpty()


def test_null_keys_are_not_hot(spark):
    many, one = _frames(spark, [None] * 500 + ["a"] * 300 + ["b"] * 3, ["a", "b", None])
    hot = hot_keys(many, "k", 8)
    assert [r.k for r in hot.collect()] == ["a"]
    for how in ("inner", "left"):
        assert _rows(split_join(many, one, "k", ["i"], hot, how)) == _rows(many.join(one, "k", how))


@settings(max_examples=8, deadline=None)
@given(keys=st.lists(st.sampled_from(["a", "a", "a", "b", "c", None]), max_size=60),
       partners=st.lists(st.sampled_from(["a", "b", "d", None]), max_size=6),
       how=st.sampled_from(["inner", "left"]))
def test_property_equals_plain_join(spark, keys, partners, how):
    """Also where the other side has several rows for a key, or none."""
    many, one = _frames(spark, keys, partners)
    assert _rows(split_join(many, one, "k", ["i"], hot_keys(many, "k", 4), how)) == _rows(many.join(one, "k", how))


def test_other_joins_are_refused(spark):
    many, one = _frames(spark, ["a"], ["a"])
    with pytest.raises(ValueError):
        split_join(many, one, "k", ["i"], hot_keys(many, "k", 4), "right")


def _largest_to_median(df):
    per_task = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    return per_task[-1] / per_task[len(per_task) // 2]


def test_an_order_with_a_third_of_the_items(spark):
    """The fact's join by order: the largest task stays within three times the median, a plain join's does not."""
    was = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    n = 24_000
    items = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("o"), F.col("id") % 6000)).alias("order_id"),
        F.col("id").alias("order_item_id"), F.lit("p").alias("product_id"), F.lit("s").alias("seller_id"),
        F.lit(1).cast("decimal(18,4)").alias("price"), F.lit(2).cast("decimal(18,4)").alias("freight_value"))
    at = F.lit("1996-06-01 10:00:00").cast("timestamp_ntz")
    orders = items.select("order_id").distinct().select(
        "order_id", F.concat(F.lit("c"), "order_id").alias("customer_id"), F.concat(F.lit("u"), "order_id").alias("customer_unique_id"),
        F.lit("delivered").alias("order_status"), at.alias("order_purchase_timestamp"),
        at.alias("order_delivered_customer_date"), at.alias("order_estimated_delivery_date"))
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        hot = hot_keys(items, "order_id")
        assert [tuple(r) for r in hot.collect()] == [("hot", 16)]
        split, plain = M.fct_order_items_sales(items, orders, hot=hot), M.fct_order_items_sales(items, orders)
        assert split.columns == plain.columns
        assert split.count() == n and split.exceptAll(plain).isEmpty()
        assert _largest_to_median(plain) > 3
        assert _largest_to_median(split) <= 3
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)


def test_warehouse_splits_a_hot_order(spark):
    """Half of the items moved to one order: it is found, and fact and wide table keep every row."""
    plain = Warehouse(spark, SF)
    items = plain.raw("order_items")
    top = items.agg(F.min("order_id").alias("o")).first()["o"]
    moved = items.withColumn("order_id", F.when(F.xxhash64("order_id", "order_item_id") % 2 == 0, F.lit(top)).otherwise(F.col("order_id")))
    number = F.monotonically_increasing_id().cast(items.schema["order_item_id"].dataType)  # unique in the order still
    moved = moved.withColumn("order_item_id", number)
    raw = {"order_items": moved, **{t: plain.raw(t) for t in ("orders", "customers", "products", "category_name_translation", "sellers", "order_payments")}}
    wh = Warehouse(spark, SF, raw=raw)
    assert [str(r.order_id) for r in wh.hot_orders().collect()] == [str(top)]
    want = items.join(plain.raw("orders").select("order_id"), "order_id").count()
    assert wh.table("fct_order_items_sales").count() == want
    assert wh.table("fct_sales_wide").count() == plain.table("fct_sales_wide").count()
