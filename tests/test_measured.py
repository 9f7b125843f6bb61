"""Checks that read what a mart's write measured, and fall back to the mart where nothing was measured."""

import pytest
from pyspark.sql import functions as F

from basketry.plans import quality as Q
from basketry.plans.declared import measures
from basketry.plans.warehouse import MARTS, Warehouse, open_warehouse
from basketry.sources import published

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def wh(spark):
    return open_warehouse(spark, SF)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def unmeasured(wh):
    """The same tables, put in place of the published ones."""
    other = Warehouse(wh.spark, wh.sf_dir, wh.profile, root=wh.root)
    for m in MARTS:
        other._built[m] = wh.table(m).select("*")
    return other


@pytest.mark.parametrize("check", [Q.dq_not_null, Q.dq_accepted_values, Q.recon_pipeline])
def test_measured_checks_equal_a_read_of_the_marts(wh, check):
    assert rows(check(wh)) == rows(check(unmeasured(wh)))


def test_measured_checks_read_no_mart(wh):
    for check in (Q.dq_not_null, Q.dq_accepted_values):
        assert all("/_manifests/" in f for f in check(wh).inputFiles())
        assert not any("/_manifests/" in f for f in check(unmeasured(wh)).inputFiles())
    # the grain is the only read of the fact, of its two key columns
    assert "item_total_amount" not in plan(Q.recon_pipeline(wh)) and "item_total_amount" in plan(Q.recon_pipeline(unmeasured(wh)))


def test_measures_equal_the_tables(wh):
    for m in MARTS:
        kept = wh.measured(m)
        asked = measures(m)
        assert (kept is None) == (not asked)
        if asked:
            want = wh.table(m).agg(F.count(F.lit(1)).alias("rows"), *[c.cast("string").alias(n) for n, c in asked.items()])
            assert tuple(kept.select(*want.columns).first()) == tuple(want.first())


def test_a_bad_row_is_measured_and_a_new_version_measures_anew(spark, tmp_path):
    target = f"{tmp_path}/t"
    fact = "fct_order_items_sales"
    cols = "order_id string, order_item_id bigint, order_status string, item_total_amount decimal(18,2)"
    first = spark.createDataFrame([("a", 1, "lost", 1), (None, 2, None, 2), ("b", None, "shipped", None)], cols.replace("decimal(18,2)", "int"))
    asked = {n: c for n, c in measures(fact).items()}
    now = published.replace(first, target, measures=asked)
    got = published.measured(spark, target, now).first()
    assert (got.rows, got.foreign_statuses, got.nulls_order_id, got.nulls_order_item_id, got.amount) == (3, "1", "1", "1", "3")
    later = published.replace(first.where("false"), target, measures=asked)
    empty = published.measured(spark, target, later).first()
    assert (empty.rows, empty.foreign_statuses, empty.amount) == (0, "0", None)
    assert published.measured(spark, target, now).first().rows == 3  # a reader of the older version
    assert published.measured(spark, target, published.replace(first, target)) is None


def test_unknown_status_is_counted_from_the_mart(spark):
    wh = Warehouse(spark, SF)
    fact = wh.table("fct_order_items_sales")
    bad = fact.limit(2).withColumn("order_status", F.lit("lost"))
    wh._write("fct_order_items_sales", fact.unionByName(bad))
    assert wh.measure("fct_order_items_sales", "foreign_statuses") == "2"
    assert Q.dq_accepted_values(wh).first().failures == 1  # distinct values, not rows
