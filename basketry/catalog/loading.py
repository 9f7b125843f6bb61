"""Loader, sink and export jobs, registered with reference SQL.

Each job writes into a fresh folder below the shared root and returns the
rows it reads back (or its audit); the reference SQL is the plain select of
the same input.  Landing files hold their columns in two orders, as files of two exports
would; those without quoted line breaks are gzipped, each with a bounded number of records, as one task
reads each.  No timestamps or paths are returned.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry import oracle as O
from basketry.catalog.core import QUERIES, from_query, register, wh
from basketry.session import shared_root
from basketry.sources import loaders as L
from basketry.sources import published
from basketry.sources.binding import RAW_TABLES, SIDE_TABLES, raw_table
from basketry.sources.schemas import MULTI_LINE
from basketry.streaming.chunked_load import load_in_chunks, read_loaded

LANDING_RECORDS = 1_000_000  # in a gzipped landing file, about 70 MB of text


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_root(spark)}/basketry-io/{what}-{uuid.uuid4().hex[:10]}"


def _csv_extract(spark: SparkSession, sf_dir: str, table: str, files: int | None = None) -> tuple[str, DataFrame]:
    """Write a raw table as CSV files (the landing copy) and return its folder.

    Plain files where their splits matter: with quoted line breaks, and where a chunk of the load is one of ``files``.
    """
    # no mart reads the side tables: the landing copy is the first that is written of them
    raw = raw_table(spark, sf_dir, table) if table in SIDE_TABLES else wh(spark, sf_dir).raw(table)
    if table == "category_name_translation":
        raw = raw.withColumnsRenamed({v: k for k, v in L.TRANSLATION_COLUMNS.items()})
    path = scratch(spark, f"landing-{table}")
    rows = raw.repartition(files) if files else raw
    swap = F.pmod(F.xxhash64(raw.columns[0]), F.lit(2)) == 0
    records = None if files or table in MULTI_LINE else LANDING_RECORDS
    L.write_csv(rows.where(~swap), f"{path}/first", records)
    L.write_csv(rows.where(swap).select(*reversed(raw.columns)), f"{path}/second", records)
    return path, raw


def _load_raw_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, raw = _csv_extract(spark, sf_dir, "orders")
    return L.read_csv(spark, path, raw.schema)


register("load_raw_csv", O.with_models("SELECT * FROM raw_orders"))(_load_raw_csv)


def _load_raw_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, raw = _csv_extract(spark, sf_dir, "order_items")
    header = ",".join(raw.columns)
    # Malformed lines appended to the landing folder (text in numeric columns).
    junk = [header] + [f"{i},not-a-number,1,1,1997-01-01T00:00:00.000,x{i},0.5" for i in range(7)]
    spark.createDataFrame([(line,) for line in junk], "value string").coalesce(1).write.text(f"{path}/junk")
    good, bad = L.read_csv_tolerant(spark, path, raw.schema)
    if bad != 7:
        raise AssertionError(f"expected 7 malformed rows, found {bad}")
    return good


register("load_raw_bad_rows", O.with_models("""
SELECT order_id, order_item_id, product_id, seller_id, shipping_limit_date, CAST(price AS DOUBLE) AS price,
  CAST(freight_value AS DOUBLE) AS freight_value FROM raw_order_items"""))(_load_raw_bad_rows)


def _load_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews: messages with line breaks and quotes, 50 malformed records among them, read by many tasks."""
    path, raw = _csv_extract(spark, sf_dir, "order_reviews")
    # Malformed records with quoted line breaks (text in a numeric column).
    junk = [",".join(raw.columns)] + [f'bad{i},1,5,t,"a ""quoted""\nline, and {i}",2017-01-01T00:00:00.000,' for i in range(50)]
    spark.createDataFrame([(line,) for line in junk], "value string").coalesce(1).write.text(f"{path}/junk")
    good, bad = L.read_csv_tolerant(spark, path, raw.schema, multi_line=True)
    if bad != 50:
        raise AssertionError(f"expected 50 malformed rows, found {bad}")
    return good


register("load_reviews_bad_rows", O.with_models("SELECT * FROM raw_order_reviews", O.SIDE))(_load_reviews)


def _load_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, raw = _csv_extract(spark, sf_dir, "category_name_translation")
    return L.rename_translation(L.read_csv(spark, path, raw.schema))


register("load_rename", O.with_models("SELECT * FROM raw_category_name_translation"))(_load_rename)


def _sink_full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    sellers = wh(spark, sf_dir).raw("sellers")
    target = scratch(spark, "sellers")
    published.replace(sellers, target)
    published.replace(sellers, target)  # a second run replaces, never doubles
    return published.read(spark, target)


register("sink_full_refresh", O.with_models("SELECT * FROM raw_sellers"))(_sink_full_refresh)


def _sink_truncate_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, raw = _csv_extract(spark, sf_dir, "orders", files=4)
    target, ckpt = scratch(spark, "orders-chunked"), scratch(spark, "orders-chunked-ckpt")
    load_in_chunks(spark, path, raw.schema, target, ckpt, files_per_chunk=1)
    return read_loaded(spark, target)


register("sink_truncate_append", O.with_models("SELECT * FROM raw_orders"))(_sink_truncate_append)


def _specs(spark: SparkSession, sf_dir: str, tables, absent) -> list[L.LoadSpec]:
    specs = []
    for t in tables:
        if t in absent:
            path, schema = scratch(spark, f"absent-{t}"), wh(spark, sf_dir).raw("orders").schema
        else:
            path, raw = _csv_extract(spark, sf_dir, t)
            schema = raw.schema
        specs.append(L.LoadSpec(t, path, schema, t in MULTI_LINE))
    return specs


def _audit_sql(tables, absent=()) -> str:
    parts = []
    for t in tables:
        if t not in absent:
            ncols = {"order_reviews": 7, "geolocation": 5, "orders": 8, "order_items": 7, "customers": 5, "products": 9, "order_payments": 5,
                     "sellers": 4, "category_name_translation": 2}[t]
            parts.append(f"SELECT '{t}' AS \"table\", 'loaded' AS status, count(*) AS rows, "
                         f"CAST({ncols} AS BIGINT) AS columns, CAST(NULL AS VARCHAR) AS message FROM raw_{t}")
        else:
            parts.append(f"SELECT '{t}' AS \"table\", 'missing' AS status, CAST(NULL AS BIGINT) AS rows, "
                         f"CAST(NULL AS BIGINT) AS columns, 'file not found: ' || '{t}' AS message")
    return O.with_models(" UNION ALL ".join(parts), O.SIDE)


def _load_audit(spark: SparkSession, sf_dir: str, tables, absent=()) -> DataFrame:
    audit = L.load_tables(spark, _specs(spark, sf_dir, tables, absent), scratch(spark, "raw-layer"))
    # the message of a missing file names the table, not the scratch path
    return audit.withColumn("message", F.when(F.col("status") == "missing",
                                              F.concat(F.lit("file not found: "), F.col("table"))))


_ALL = (*RAW_TABLES, *SIDE_TABLES)
register("load_audit", _audit_sql(_ALL))(lambda s, d: _load_audit(s, d, _ALL))
_ISOLATION = ("orders", "order_reviews", "sellers", "geolocation", "category_name_translation")
register("load_isolation", _audit_sql(_ISOLATION, SIDE_TABLES))(lambda s, d: _load_audit(s, d, _ISOLATION, SIDE_TABLES))


def _materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of the marts, counted in one job."""
    w = wh(spark, sf_dir)
    counts = [w.table(m).agg(F.lit(m).alias("mart"), F.count(F.lit(1)).alias("rows"),
                             F.lit(len(w.table(m).columns)).cast("bigint").alias("columns")) for m in _MART_COLS]
    return reduce(DataFrame.unionAll, counts)


_MART_COLS = {"dim_time": 10, "dim_customers": 5, "dim_products": 9, "dim_sellers": 4, "dim_payments": 4,
              "fct_order_items_sales": 14, "fct_customer_rfm": 11}
register("materialize_marts", O.with_models(" UNION ALL ".join(
    f"SELECT '{m}' AS mart, count(*) AS rows, CAST({n} AS BIGINT) AS columns FROM {m}"
    for m, n in _MART_COLS.items())))(_materialize)


def _export_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = QUERIES["campaign_targets"][0](spark, sf_dir)
    path = scratch(spark, "export-campaign-targets")
    L.write_csv(targets, path)
    return L.read_csv(spark, path, targets.schema)


register("export_list", f"SELECT * FROM {from_query('campaign_targets')}")(_export_list)
