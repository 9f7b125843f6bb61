"""CSV loading edges: BOM, quoted newline, bad-row limit, missing file, empty table."""

import os
import tempfile
from datetime import datetime

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from basketry.sources import files
from basketry.sources import loaders as L
from basketry.sources.loaders import LoadSpec

SCHEMA = StructType([StructField("id", LongType()), StructField("name", StringType())])


def _write(text: str, encoding: str = "utf-8") -> str:
    d = tempfile.mkdtemp(prefix="basketry-csv-")
    with open(os.path.join(d, "part.csv"), "w", encoding=encoding, newline="") as fh:
        fh.write(text)
    return d


def test_bom_and_quoted_newline(spark):
    path = _write('﻿id,name\n1,"two\nlines"\n2,plain\n')
    rows = sorted(map(tuple, L.read_csv(spark, path, SCHEMA, multi_line=True).collect()))
    assert rows == [(1, "two\nlines"), (2, "plain")]


def test_translation_rename(spark):
    schema = StructType([StructField("product_category_name", StringType()),
                         StructField("product_category_name_english", StringType())])
    path = _write("﻿product_category_name,product_category_name_english\nbeleza_saude,health_beauty\n")
    df = L.rename_translation(L.read_csv(spark, path, schema))
    assert df.columns == ["string_field_0", "string_field_1"]
    assert df.collect()[0].string_field_1 == "health_beauty"


@pytest.mark.parametrize("bad,ok", [(50, True), (51, False)])
def test_bad_row_limit(spark, bad, ok):
    lines = ["id,name"] + [f"{i},good" for i in range(100)] + [f"x{i},bad" for i in range(bad)]
    path = _write("\n".join(lines) + "\n")
    if ok:
        good, n = L.read_csv_tolerant(spark, path, SCHEMA)
        assert n == bad and good.count() == 100
    else:
        with pytest.raises(L.TooManyBadRows):
            L.read_csv_tolerant(spark, path, SCHEMA)


def test_missing_file_and_empty_table_are_isolated(spark):
    good = _write("id,name\n1,a\n")
    empty = _write("id,name\n")
    target = tempfile.mkdtemp(prefix="basketry-target-")
    audit = L.load_tables(spark, [LoadSpec("a", good, SCHEMA), LoadSpec("gone", "/nonexistent/x.csv", SCHEMA),
                                  LoadSpec("e", empty, SCHEMA)], target)
    rows = {r.table: r for r in audit.collect()}
    assert rows["a"].status == "loaded" and rows["a"].rows == 1 and rows["a"].columns == 2
    assert rows["gone"].status == "missing" and rows["gone"].rows is None
    assert rows["e"].status == "loaded" and rows["e"].rows == 0


def test_full_refresh_replaces(spark):
    target = tempfile.mkdtemp(prefix="basketry-refresh-") + "/t"
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    L.write_full_refresh(df, target)
    L.write_full_refresh(df.limit(1), target)
    assert spark.read.parquet(target).count() == 1


def test_jdbc_options():
    o = L.jdbc_options("jdbc:postgresql://db/x", "orders", "id", 0, 1000, 8)
    assert o["partitionColumn"] == "id" and o["numPartitions"] == "8" and o["fetchsize"] == "20000"
    with pytest.raises(ValueError):
        L.jdbc_options("jdbc:x", "t", "id")


def test_chunked_streaming_load_is_exactly_once(spark):
    from basketry.streaming.chunked_load import load_in_chunks, read_loaded

    landing = tempfile.mkdtemp(prefix="basketry-landing-")
    for i in range(3):
        with open(os.path.join(landing, f"chunk{i}.csv"), "w") as fh:
            fh.write("id,name\n" + "".join(f"{i * 10 + j},n\n" for j in range(5)))
    target = tempfile.mkdtemp(prefix="basketry-chunked-") + "/t"
    ckpt = tempfile.mkdtemp(prefix="basketry-chunked-ckpt-")
    batches = load_in_chunks(spark, landing, SCHEMA, target, ckpt)
    assert batches == 3
    # a rerun with the same checkpoint takes no file twice
    load_in_chunks(spark, landing, SCHEMA, target, ckpt)
    assert read_loaded(spark, target).count() == 15


def test_large_csv_is_split_between_tasks(spark):
    """Without quoted line breaks one file is read by several tasks."""
    path = _write("id,name\n" + "".join(f"{i},some text to fill the line\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert L.read_csv(spark, path, SCHEMA).rdd.getNumPartitions() > 3
        assert L.read_csv(spark, path, SCHEMA).count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_failed_table_keeps_its_whole_message(spark):
    path = _write("id,name\nnot a number,x\n")
    strict = StructType([StructField("id", SCHEMA.fields[0].dataType), StructField("name", StringType())])
    audit = L.load_tables(spark, [L.LoadSpec("t", path, strict), L.LoadSpec("gone", path + "-none", strict)], tempfile.mkdtemp())
    rows = {r["table"]: r for r in audit.collect()}
    assert rows["gone"].status == "missing"
    assert rows["t"].status == "failed" and len(rows["t"].message) > 200


def test_batch_count_beyond_the_progress_history(spark):
    from basketry.streaming.chunked_load import load_in_chunks, read_loaded

    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")  # the default is 100
    landing = tempfile.mkdtemp(prefix="basketry-landing-")
    for i in range(8):
        with open(os.path.join(landing, f"chunk{i}.csv"), "w") as fh:
            fh.write(f"id,name\n{i},n\n")
    try:
        target = tempfile.mkdtemp(prefix="basketry-chunked-") + "/t"
        assert load_in_chunks(spark, landing, SCHEMA, target, tempfile.mkdtemp()) == 8
        assert read_loaded(spark, target).count() == 8
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)


LINE_ITEMS = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
              "l_tax double, l_returnflag string, l_shipdate timestamp_ntz")


def _line_items(spark, folder):
    rows = [(i // 3, i, i % 5, i % 3, 2.0, 10.0 + i, 0.05, "ARN"[i % 3], datetime(1997, 1, 1)) for i in range(90)]
    rows.append((None, 7, 7, 1, 1.0, 1.0, 0.0, None, None))
    spark.createDataFrame(rows, LINE_ITEMS).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return len(rows)


def test_landing_files_are_gzipped_and_hold_few_records(spark, tmp_path, monkeypatch):
    from basketry.catalog import loading

    n = _line_items(spark, tmp_path)
    monkeypatch.setattr(loading, "LANDING_RECORDS", 10)
    for table in ("order_items", "order_payments"):
        path, raw = loading._csv_extract(spark, str(tmp_path), table)
        found = [p for p, _ in files.data_files(spark, path)]
        assert found and all(p.endswith(".csv.gz") for p in found)
        assert max(r["count"] for r in spark.read.option("header", True).csv(found).groupBy("_metadata.file_path").count().collect()) <= 10
        got = L.read_csv(spark, path, raw.schema)
        assert sorted(map(str, got.collect())) == sorted(map(str, raw.collect()))
        assert table == "order_payments" or got.count() == n


def test_reviews_land_plain_and_without_a_raw_copy(spark, tmp_path):
    from basketry.catalog import loading

    texts = ['a\n"b", c', "", None, "plain", 'x\n\ny ""']
    rows = [(i, t, "en", f"s{i}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    path, raw = loading._csv_extract(spark, str(tmp_path), "order_reviews")
    assert all(p.endswith(".csv") for p, _ in files.data_files(spark, path))  # split by many tasks
    assert all("raw/order_reviews" not in f for f in raw.inputFiles())
    got = L.read_csv(spark, path, raw.schema, multi_line=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, raw.collect()))


def test_items_are_numbered_by_tasks_in_proportion_to_their_files(spark, tmp_path, monkeypatch):
    from basketry.sources import binding

    n = _line_items(spark, tmp_path)
    size = sum(b for _, b in files.data_files(spark, f"{tmp_path}/lineitem.parquet"))
    assert binding._item_tasks(spark, str(tmp_path)) is None
    monkeypatch.setattr(binding, "ITEM_TASK_BYTES", size // 12)
    assert binding._item_tasks(spark, str(tmp_path)) >= 12
    got = binding.raw_order_items(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= 12
    assert sorted((r.order_id, r.order_item_id) for r in got.where("order_id is not null").collect()) == [(i // 3, i % 3 + 1) for i in range(n - 1)]
