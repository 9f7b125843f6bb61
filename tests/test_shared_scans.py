"""Breakdowns over one read of the wide table, the default target range, and the calendar's bounds."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from basketry.plans import finish as Fn
from basketry.plans import models as M
from basketry.plans import quality as Q
from basketry.plans import sales as S
from basketry.plans.filters import all_filters, default_filters
from basketry.plans.warehouse import RolledUp, Warehouse, open_warehouse

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def wh(spark):
    return open_warehouse(spark, SF)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("ask", [
    S.kpi_compare, S.revenue_by_month, S.sales_by_category, S.payment_mix, S.same_months_by_year, S.orders_by_weekday_hour, S.state_summary, S.top_cities,
    lambda w, f: S.sales_by_period(w, f, "quarter")])
def test_rollup_answers_as_the_wide_table(wh, ask):
    f = default_filters(wh.profile)
    assert rows(ask(RolledUp(wh), f)) == rows(ask(wh, f))


def test_breakdowns_do_not_read_the_wide_table(wh):
    wh.order_rollup()
    plan = Q.recon_breakdowns(wh)._jdf.queryExecution().executedPlan().toString()
    assert "fct_sales_wide" not in plan and "_order_rollup" in plan
    plan = S.kpi_compare(RolledUp(wh), all_filters(wh.profile))._jdf.queryExecution().executedPlan().toString()
    assert "fct_sales_wide" not in plan


def test_the_checks_compute_the_kpi_once(spark):
    own = Warehouse(spark, SF)
    made = [g(own) for g in (Q.recon_kpi, Q.recon_breakdowns, Q.recon_rfm)]
    assert own.made.count("results/kpi_of_all_dates") == 1
    assert all(r.result == "PASS" for m in made for r in m.collect())


def pool(spark, buckets):
    return spark.createDataFrame([("s", "At Risk / Need Attention", b, 2, 3, 30.0, 1) for b in buckets], "state string, segment string, bucket bigint, customers bigint, orders bigint, monetary double, repeaters bigint")


def test_target_range_falls_back_to_the_pool(spark):
    segments = ("At Risk / Need Attention",)
    assert Fn.target_cohort(pool(spark, [61, 91, 121, 151, 181]), segments).first().customers == 6.0
    assert Fn.target_cohort(pool(spark, [31, 61, 121]), segments).first().customers == 6.0  # neither end of the cooling range: all buckets
    assert Fn.target_cohort(pool(spark, [31, 61, 121]), segments, (91, 151)).first().customers == 2.0
    assert Fn.target_cohort(pool(spark, []), segments).first().customers == 0.0
    assert Fn.cohorts_by(pool(spark, [31, 61]), "segment").first().customers == 4.0


def test_bad_dates_do_not_widen_the_calendar(spark):
    days = ["0001-01-01 00:00:00", "2017-05-06 10:00:00", "2018-01-01 00:00:00", "9999-12-31 23:00:00", None]
    orders = spark.createDataFrame([(d and datetime.fromisoformat(d),) for d in days], "order_purchase_timestamp timestamp_ntz")
    made = M.calendar_days(orders)
    got = made.agg(F.count(F.lit(1)), F.min("full_date").cast("string"), F.max("full_date").cast("string"), F.countDistinct("full_date")).first()
    assert tuple(got) == (730, "2017-01-01", "2018-12-31", 730)
    assert tuple(M.implausible_dates(orders).first()) == (1, 2)
    assert M.calendar_days(orders.where("false")).count() == 0


def test_rollup_deals_items_by_order_and_combines_hot_ones(spark, wh):
    wide = wh.table("fct_sales_wide")
    sums = [F.sum(c).alias(c) for c in ("price", "freight_value", "item_total_amount")]
    want = wide.groupBy(*M.ROLLUP_KEYS).agg(*sums, F.count(F.lit(1)).alias("items"))
    hot = wide.groupBy("order_id").count().orderBy(F.desc("count"), "order_id").limit(2).select("order_id", F.lit(3).alias("__pieces"))
    for one in (None, hot):
        got = M.order_rollup(wide, wh.table("dim_time"), 3, one)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert rows(got) == rows(want)
    plan = M.order_rollup(wide, wh.table("dim_time"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "hashpartitioning(order_id" in plan


def test_buyers_are_written_without_unused_dates(wh):
    assert not {"order_approved_at", "order_delivered_carrier_date"} & set(wh._buyers().columns)
