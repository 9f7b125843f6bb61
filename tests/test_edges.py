"""Hand-made edge rows (string ids, the source's own calendar)."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from basketry.plans import customers as C
from basketry.plans import quality as Q
from basketry.plans import sales as S
from basketry.plans.filters import Filters
from basketry.plans.warehouse import Warehouse
from basketry.profile import SOURCE_PROFILE

TS = "timestamp_ntz"
ORDERS = (f"order_id string, customer_id string, order_status string, order_purchase_timestamp {TS}, "
          f"order_approved_at {TS}, order_delivered_carrier_date {TS}, order_delivered_customer_date {TS}, "
          f"order_estimated_delivery_date {TS}")
ITEMS = (f"order_id string, order_item_id bigint, product_id string, seller_id string, shipping_limit_date {TS}, "
         "price decimal(18,2), freight_value decimal(18,2)")
CUSTOMERS = ("customer_id string, customer_unique_id string, customer_zip_code_prefix double, "
             "customer_city string, customer_state string")
PRODUCTS = ("product_id string, product_category_name string, product_name_lenght double, "
            "product_description_lenght double, product_photos_qty double, product_weight_g double, "
            "product_length_cm double, product_height_cm double, product_width_cm double")
PAYMENTS = ("order_id string, payment_sequential bigint, payment_type string, payment_installments bigint, "
            "payment_value decimal(18,2)")
SELLERS = "seller_id string, seller_zip_code_prefix bigint, seller_city string, seller_state string"
TRANSL = "string_field_0 string, string_field_1 string"

LAST = datetime(2018, 1, 1, 10, 0)  # latest purchase: reference date 2018-01-02
REF = date(2018, 1, 2)
RECENCIES = (90, 91, 120, 121, 150, 151, 180, 181)


def _order(oid, cid, status="delivered", ts=datetime(2017, 5, 1, 9), delivered=None, estimated=None):
    return (oid, cid, status, ts, ts, ts, delivered, estimated or ts + timedelta(days=20))


@pytest.fixture(scope="module")
def wh(spark):
    orders, items, customers, payments = [], [], [], []
    # dedup: U1 has two customer ids ordering at the same second -> higher id wins
    customers += [("c1", "U1", 1000.0, " Sao Paulo ", "sp"), ("c2", "U1", 2000.0, "rio", "rj")]
    orders += [_order("o1", "c1", ts=datetime(2017, 3, 1, 8)), _order("o2", "c2", ts=datetime(2017, 3, 1, 8))]
    # U2: a customer id with no order at all
    customers += [("c3", "U2", 2.5, "campinas", "sp")]
    # U3: one id with an order, one without -> the one with the order wins (nulls last)
    customers += [("c4", "U3", 4.0, "recife", "pe"), ("c5", "U3", 5.0, "olinda", "pe")]
    orders += [_order("o3", "c4", ts=datetime(2017, 4, 1, 8))]
    # latest purchase of the data set (recency 1)
    customers += [("c6", "U4", 6.0, "natal", "rn")]
    orders += [_order("o4", "c6", ts=LAST)]
    # recency edge customers
    for r in RECENCIES:
        customers += [(f"cr{r}", f"R{r}", 7.0, "city", "mg")]
        orders += [_order(f"or{r}", f"cr{r}", ts=datetime.combine(REF - timedelta(days=r), datetime.min.time()))]
    # frequency 1..5: five customer ids (orders) for one unique customer each
    for f in range(1, 6):
        for j in range(f):
            customers += [(f"cf{f}_{j}", f"F{f}", 8.0, "city", "ba")]
            orders += [_order(f"of{f}_{j}", f"cf{f}_{j}", ts=datetime(2017, 6, 1 + j, 12))]
    # delivery: late by hours on the same date (not late), delivered status with null date (not delivered)
    customers += [("cd1", "D1", 9.0, "x", "am"), ("cd2", "D2", 9.0, "y", "am")]
    orders += [_order("od1", "cd1", ts=datetime(2017, 7, 1, 9), delivered=datetime(2017, 7, 10, 20),
                      estimated=datetime(2017, 7, 10, 0)),
               _order("od2", "cd2", ts=datetime(2017, 7, 1, 9), delivered=None)]
    # a state whose only order is not delivered yet: late rate null
    customers += [("cs1", "S1", 9.0, "z", "ac")]
    orders += [_order("os1", "cs1", status="shipped", ts=datetime(2017, 7, 2, 9))]
    # a canceled order does not count
    customers += [("cx1", "X1", 9.0, "z", "ac")]
    orders += [_order("ox1", "cx1", status="canceled", ts=datetime(2017, 7, 3, 9))]

    for o in orders:
        oid = o[0]
        if oid == "o1":  # an order with two categories from two sellers
            items += [(oid, 1, "p1", "s1", o[3], Decimal("100.00"), Decimal("10.00")),
                      (oid, 2, "p2", "s2", o[3], Decimal("50.00"), Decimal("5.00"))]
            # equal top payments: the lower sequence number decides the type
            payments += [(oid, 1, "boleto", 1, Decimal("82.50")), (oid, 2, "voucher", 1, Decimal("82.50"))]
        else:
            items += [(oid, 1, "p1", "s1", o[3], Decimal("10.00"), Decimal("1.00"))]
            if oid != "o3":
                payments += [(oid, 1, "credit_card", 2, Decimal("11.00"))]
    products = [("p1", "beleza_saude", 10.0, 100.0, 1.0, 200.0, 10.0, 10.0, 10.0),
                ("p2", None, 10.0, 100.0, 1.0, 200.0, 10.0, 10.0, 10.0)]
    sellers = [("s1", 1, " Sao Paulo", "sp"), ("s2", 2, "curitiba", "pr")]
    transl = [("beleza_saude", "health_beauty")]
    raw = {
        "orders": spark.createDataFrame(orders, ORDERS),
        "order_items": spark.createDataFrame(items, ITEMS),
        "customers": spark.createDataFrame(customers, CUSTOMERS),
        "products": spark.createDataFrame(products, PRODUCTS),
        "order_payments": spark.createDataFrame(payments, PAYMENTS),
        "sellers": spark.createDataFrame(sellers, SELLERS),
        "category_name_translation": spark.createDataFrame(transl, TRANSL),
    }
    return Warehouse(spark, "/nonexistent", SOURCE_PROFILE, raw=raw)


ALL = Filters(SOURCE_PROFILE.calendar_start, SOURCE_PROFILE.calendar_end)


def _rows(df, key):
    return {getattr(r, key): r for r in df.collect()}


def test_dedup_latest_address(wh):
    d = _rows(wh.table("dim_customers"), "customer_unique_id")
    assert d["U1"].customer_id == "c2" and d["U1"].customer_state == "RJ"
    assert d["U2"].customer_id == "c3"
    assert d["U2"].customer_zip_code_prefix == 3  # 2.5 rounds half away from zero
    assert d["U3"].customer_id == "c4"


def test_staging_trim_lower_upper(wh):
    s = _rows(wh.view("stg_sellers"), "seller_id")
    assert s["s1"].seller_city == "sao paulo" and s["s1"].seller_state == "SP"


def test_primary_payment_tie_goes_to_lowest_sequence(wh):
    p = _rows(wh.table("dim_payments"), "order_id")
    assert p["o1"].payment_type_primary == "boleto"
    assert "o3" not in p


def test_products_translation_and_others(wh):
    p = _rows(wh.table("dim_products"), "product_id")
    assert p["p1"].product_category_name_english == "health_beauty"
    assert p["p2"].product_category_name_english == "others"


def test_order_in_two_categories_counts_in_both(wh):
    cats = _rows(S.sales_by_category(wh, ALL), "category")
    assert cats["health_beauty"].orders >= 1 and cats["others"].orders == 1


def test_unknown_payment_type(wh):
    pays = _rows(S.payment_mix(wh, ALL), "payment_type")
    assert pays["unknown"].orders == 1  # o3 has no payment row


def test_delivery_flags(wh):
    lvl = _rows(S.order_level(S.sales_base(wh, ALL)), "order_id")
    assert lvl["od1"].is_delivered is True
    assert lvl["od2"].is_delivered is False
    states = _rows(S.state_summary(wh, ALL), "state")
    assert states["AM"].delivered_orders == 1 and states["AM"].late_rate == 0.0
    assert states["AC"].late_rate is None and states["AC"].delivered_orders == 0


def test_recency_buckets_churn_cooling(wh):
    rfm = _rows(wh.table("fct_customer_rfm"), "customer_unique_id")
    assert rfm["U4"].recency_days == 1
    got = {r: rfm[f"R{r}"].recency_days for r in RECENCIES}
    assert got == {r: r for r in RECENCIES}
    assert [rfm[f"R{r}"].is_churn for r in RECENCIES] == [False] * 7 + [True]
    hist = _rows(C.recency_histogram(wh, ALL), "bucket")
    assert {61, 91, 121, 151, 181} <= set(hist)
    ov = C.rfm_overview(wh, ALL).collect()[0]
    assert ov.cooling == 6  # 91, 120, 121, 150, 151, 180
    assert "X1" not in rfm  # canceled only


def test_f_scores(wh):
    rfm = _rows(wh.table("fct_customer_rfm"), "customer_unique_id")
    assert [rfm[f"F{f}"].f_score for f in range(1, 6)] == [1, 3, 4, 5, 5]
    assert [rfm[f"F{f}"].frequency_orders for f in range(1, 6)] == [1, 2, 3, 4, 5]


def test_every_segment_rule(spark):
    from basketry.functions.columns import segment

    pairs = [(r, f) for r in range(1, 6) for f in (1, 3, 4, 5)]
    df = spark.createDataFrame(pairs, "r int, f int").select("r", "f", segment("r", "f").alias("s"))
    got = {(x.r, x.f): x.s for x in df.collect()}
    assert got[(5, 5)] == "Champions" and got[(3, 3)] == "Loyal Customers"
    assert got[(4, 1)] == "Promising / New Customers" and got[(3, 1)] == "Potential Loyalists"
    assert got[(2, 4)] == "At Risk / Need Attention" and got[(2, 1)] == "About to Sleep"
    assert got[(1, 1)] == "Lost / Hibernating" and got[(3, 4)] == "Loyal Customers"


def test_quality_and_reconciliation_pass(wh):
    dq = {(r.test, r.model, r.column_name): r for r in Q.dq_all(wh).collect()}
    assert all(r.status == "PASS" for k, r in dq.items() if k[1] != "fct_order_items_sales" or k[0] != "relationships"
               or k[2] != "order_id")
    assert dq[("relationships", "fct_order_items_sales", "order_id")].status == "WARN"  # o3 has no payment
    checks = Q.check_report(wh).collect()
    assert [c.check_name for c in checks if c.result != "PASS"] == []


def test_empty_segment_list_gives_no_rows(wh):
    assert C.campaign_targets(wh, ALL, 0, 10_000, ()).count() == 0


def test_empty_filter_sets_mean_no_filter(wh):
    a = S.kpi_compare(wh, ALL).collect()[0]
    b = S.kpi_compare(wh, Filters(ALL.start, ALL.end, (), ())).collect()[0]
    assert a == b and a.orders > 0
