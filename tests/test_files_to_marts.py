"""From CSV files to marts: declared schemas, load, warehouse over the loaded tables, reconciliation."""

import tempfile

import pytest

from basketry.plans import quality as Q
from basketry.plans.warehouse import Warehouse
from basketry.profile import TEST_PROFILE
from basketry.sources import loaders as L
from basketry.sources.schemas import RAW_SCHEMAS, load_specs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landing(spark):
    """The raw tables as CSV folders, and two tables the test data doesn't have."""
    root = tempfile.mkdtemp(prefix="basketry-landing-")
    src = Warehouse(spark, SF, TEST_PROFILE)
    paths = {}
    for t, schema in RAW_SCHEMAS.items():
        paths[t] = f"{root}/{t}"
        if t == "order_reviews":
            rows = [("r1", "1", 5, "good", 'two\nlines, "quoted"', None, None), ("r2", "2", 1, None, None, None, None)]
            L.write_csv(spark.createDataFrame(rows, schema), paths[t])
        elif t == "geolocation":
            L.write_csv(spark.createDataFrame([(1001, -23.5, -46.6, "sao paulo", "SP")], schema), paths[t])
        else:
            raw = src.raw(t)
            if t == "category_name_translation":
                raw = raw.withColumnsRenamed({v: k for k, v in L.TRANSLATION_COLUMNS.items()})
            L.write_csv(raw, paths[t])
    return paths


def test_load_build_and_reconcile(spark, landing):
    target = tempfile.mkdtemp(prefix="basketry-loaded-")
    audit = {r["table"]: r for r in L.load_tables(spark, load_specs(landing), target).collect()}
    assert set(audit) == set(RAW_SCHEMAS) and {r.status for r in audit.values()} == {"loaded"}
    assert audit["order_reviews"].rows == 2  # quoted line breaks stay inside their row
    wh = Warehouse.from_tables(spark, target, TEST_PROFILE)
    assert dict(wh.stg("orders").dtypes)["order_id"] == "string"
    report = Q.check_report(wh).collect()
    assert len(report) == 24 and [r.check_name for r in report if r.result != "PASS"] == []
    assert {r.status for r in Q.dq_all(wh).collect()} <= {"PASS", "WARN"}


def test_absent_tables(spark, landing):
    target = tempfile.mkdtemp(prefix="basketry-loaded-")
    some = {t: landing[t] for t in ("sellers", "geolocation")} | {"orders": landing["orders"] + "-gone"}
    audit = {r["table"]: r.status for r in L.load_tables(spark, load_specs(some), target).collect()}
    assert audit == {"sellers": "loaded", "geolocation": "loaded", "orders": "missing"}
    assert "seller_id" in Warehouse.from_tables(spark, target, TEST_PROFILE).stg("sellers").columns
