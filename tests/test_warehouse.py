"""Concurrent mart build and the report job."""

import os
import tempfile

from basketry.plans import report as R
from basketry.plans.warehouse import MARTS, Warehouse

SF = "/root/testdata/sf0.001"


def test_build_all_concurrently_builds_each_once(spark):
    wh = Warehouse(spark, SF)
    writes = []
    original = wh._write

    def counting(name, df):
        writes.append(name)
        return original(name, df)

    wh._write = counting
    built = wh.build_all(threads=4)
    assert set(built) == set(MARTS)
    marts = [w for w in writes if not w.startswith("raw/") and not w.startswith("_")]
    assert sorted(marts) == sorted(MARTS)  # each mart written exactly once
    assert wh.table("fct_sales_wide").count() > 0


def test_write_report(spark):
    wh = Warehouse(spark, SF)
    out = tempfile.mkdtemp(prefix="basketry-report-")
    R.write_report(wh, out)
    assert {"figures", "revenue_by_month", "segments", "pool_by_state"} <= set(os.listdir(out))
    figures = spark.read.option("header", True).csv(f"{out}/figures")
    assert figures.filter("figure = 'orders'").count() == 1


def test_hot_date_spans_several_wide_table_files(spark):
    """Two thirds of the orders on one day: the date-ranged wide table still
    spreads them over several files (ranges cut on date, order, item)."""
    from pyspark.sql import functions as F

    from basketry.sources.binding import raw_orders

    orders = raw_orders(spark, SF)
    hot = F.col("order_id") % 3 != 0
    ts = ["order_purchase_timestamp", "order_approved_at"]
    orders = orders.withColumns({c: F.when(hot, F.lit("1996-06-01 10:00:00").cast("timestamp_ntz"))
                                 .otherwise(F.col(c)) for c in ts})
    wh = Warehouse(spark, SF, raw={"orders": orders})
    wide = wh.table("fct_sales_wide")
    per_file = wide.groupBy(F.input_file_name().alias("f")).agg(
        F.count(F.lit(1)).alias("n"), F.min("order_date_key").alias("lo"), F.max("order_date_key").alias("hi"))
    files = sorted(per_file.collect(), key=lambda r: (r.lo, r.hi))
    total = sum(r.n for r in files)
    hot_rows = wide.filter(F.col("order_date_key") == 19960601).count()
    assert hot_rows > total / 2
    assert max(r.n for r in files) < hot_rows  # the hot day is split
    # ranges stay contiguous in date: files overlap at most on a shared boundary day
    for a, b in zip(files, files[1:]):
        assert a.hi <= b.lo


def test_changed_input_is_seen_and_drop_removes(spark, tmp_path):
    import os
    import shutil

    from basketry.plans.warehouse import open_warehouse

    src, copy = "/root/testdata/sf0.001", str(tmp_path / "in")
    os.makedirs(copy)
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        shutil.copyfile(f"{src}/{t}.parquet", f"{copy}/{t}.parquet")
    first = open_warehouse(spark, copy)
    n = first.raw("sellers").count()
    assert open_warehouse(spark, copy) is first
    spark.read.parquet(f"{src}/supplier.parquet").limit(3).toPandas().to_parquet(f"{copy}/supplier.parquet")
    second = open_warehouse(spark, copy)
    assert second is not first and second.raw("sellers").count() == 3 < n
    assert os.path.isdir(second.root)
    second.drop()
    assert not os.path.exists(second.root)
    assert second.raw("sellers").count() == 3  # built again


def test_wide_table_is_the_star_join_and_leaves_the_fact_unwritten(spark):
    """Orders and customers that come twice included: joined at order grain, the wide table has each row as often as the joins of the marts."""
    from basketry.plans import models as M
    from basketry.sources.binding import raw_customers, raw_orders

    twice = {n: f(spark, SF).unionAll(f(spark, SF).where("customer_id % 7 = 0")) for n, f in (("orders", raw_orders), ("customers", raw_customers))}
    for raw in (None, twice):
        wh = Warehouse(spark, SF, raw=raw)
        wide = wh.table("fct_sales_wide")
        assert "fct_order_items_sales" not in wh.made
        star = M.sales_star_join(*[wh.table(t) for t in ("fct_order_items_sales", "dim_time", "dim_customers", "dim_products", "dim_sellers", "dim_payments")], wh._buyers())
        assert wide.schema.simpleString() == star.schema.simpleString()
        assert wide.count() == star.count() and wide.exceptAll(star).isEmpty()


def test_tables_of_items_are_written_by_shares_of_the_orders(spark, monkeypatch):
    """The fact, the wide table and its rollup have the same rows in one part and in several, and no order in two of them."""
    from pyspark.sql import functions as F

    from basketry.plans import warehouse as W
    from basketry.sources import published

    names = ("fct_order_items_sales", "fct_sales_wide", "_order_rollup")

    def built(n):
        monkeypatch.setattr(W, "SLICES", n)
        monkeypatch.setattr(W, "SLICE_BYTES", 1)
        wh = Warehouse(spark, SF)
        wh.order_rollup(), wh.table("fct_order_items_sales")
        return wh

    whole, shared = built(1), built(3)
    for name in names:
        a, b = whole._built[name], shared._built[name]
        assert len(whole._parts(name)) == 1 and len(shared._parts(name)) == 3
        assert a.schema == b.schema and a.count() == b.count() and a.exceptAll(b).isEmpty()
        one, now = (published.current(spark, w.path(name)) for w in (whole, shared))
        assert now.rows == one.rows and now.info["measures"] == one.info["measures"]
        orders = [p.select("order_id").distinct() for p in shared._parts(name)]
        both = orders[0].unionAll(orders[1]).unionAll(orders[2])
        assert both.count() == both.distinct().count() and all(not o.isEmpty() for o in orders)
    rows = spark.createDataFrame([(None,), ("1",), ("2",), ("2",)], "order_id string")
    from basketry.plans.models import order_slice
    shares = [order_slice(rows, k, 3) for k in range(3)]
    assert sum(s.count() for s in shares) == 4 and sum(s.where(F.col("order_id") == "2").count() > 0 for s in shares) == 1


def test_a_hot_order_and_repeated_keys_in_shares(spark, monkeypatch):
    """Half of the items in one order, some of the orders and customers twice: as the joins of the marts have it."""
    from pyspark.sql import functions as F

    from basketry.plans import models as M
    from basketry.sources.binding import raw_customers, raw_order_items, raw_orders

    monkeypatch.setattr(Warehouse, "_slices", lambda self: 3)
    items = raw_order_items(spark, SF).withColumn("order_id", F.when(F.col("order_id") % 2 == 0, 42).otherwise(F.col("order_id")))
    twice = {n: f(spark, SF).unionAll(f(spark, SF).where("customer_id % 7 = 0")) for n, f in (("orders", raw_orders), ("customers", raw_customers))}
    wh = Warehouse(spark, SF, raw={"order_items": items, **twice})
    assert wh.hot_orders() is not None
    fact = M.fct_order_items_sales(wh.stg("order_items"), wh.stg("orders"), wh.stg("customers"))
    assert wh.table("fct_order_items_sales").count() == fact.count() and wh.table("fct_order_items_sales").exceptAll(fact).isEmpty()
    star = M.sales_star_join(fact, *[wh.table(t) for t in ("dim_time", "dim_customers", "dim_products", "dim_sellers", "dim_payments")], wh._buyers())
    assert wh.table("fct_sales_wide").count() == star.count() and wh.table("fct_sales_wide").exceptAll(star).isEmpty()


def test_a_write_leaves_no_shuffle_files(spark):
    import time

    from basketry.session import _CLEANUP

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    wh = Warehouse(spark, SF)
    hot, before = wh.hot_orders(), files()
    wh.table("dim_customers"), wh.table("dim_payments"), wh._buyers()
    wh.save_result("checks/orders", wh.table("dim_payments").groupBy("order_id").count())
    for _ in range(50):  # other threads remove the files
        if not files() - before:
            break
        time.sleep(0.2)
    assert hot is None and not files() - before
    assert spark.conf.get(_CLEANUP) == "false"
