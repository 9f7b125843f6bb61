"""Tables that change all at once, the batch ledger, and marts that another process finds."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from basketry.plans import warehouse as W
from basketry.sources import loaders as L
from basketry.sources import published
from basketry.sources.loaders import LoadSpec
from basketry.streaming import chunked_load as C

SCHEMA = "id bigint, name string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def failing(spark, n=8):
    """A frame whose last task fails after the others have written."""
    return spark.range(n, numPartitions=4).select("id", F.when(F.col("id") == n - 1, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("string").alias("name"))


def test_failed_refresh_keeps_the_old_rows(spark, tmp_path):
    target = f"{tmp_path}/t"
    published.replace(spark.createDataFrame([(1, "a")], SCHEMA), target)
    with pytest.raises(Exception, match="broken"):
        published.replace(failing(spark), target)
    assert rows(published.read(spark, target)) == [(1, "a")]
    published.replace(spark.createDataFrame([(2, "b"), (3, None)], SCHEMA), target)
    assert rows(published.read(spark, target)) == [(2, "b"), (3, None)]
    assert published.current(spark, target).rows == 2


def test_failed_refresh_of_a_plain_folder(spark, tmp_path):
    target = f"{tmp_path}/t"
    L.write_full_refresh(spark.createDataFrame([(1, "a")], SCHEMA), target)
    with pytest.raises(Exception, match="broken"):
        L.write_full_refresh(failing(spark), target)
    assert rows(spark.read.parquet(target)) == [(1, "a")]


def test_readers_of_an_older_manifest_go_on_and_vacuum(spark, tmp_path):
    target = f"{tmp_path}/t"
    with pytest.raises(published.NotPublished):
        published.read(spark, target)
    for k in range(4):
        published.replace(spark.createDataFrame([(k, "v")], SCHEMA), target)
        if k == 1:
            old = published.read(spark, target)
    published.replace(spark.createDataFrame([], SCHEMA), target)
    assert rows(old) == [(1, "v")] and published.read(spark, target).count() == 0
    spark.range(3).write.parquet(f"{target}/{published.stage(target)}")  # a running writer's folder
    assert published.vacuum(spark, target) == []  # all too young
    assert len(published.vacuum(spark, target, keep=2, min_age_s=0)) == 4  # three old versions and the folder no manifest names
    assert published.read(spark, target).count() == 0
    assert published.current(spark, target).number == 5


def test_two_writers_never_share_a_number(spark, tmp_path):
    target, seen = f"{tmp_path}/t", []
    frames = [spark.createDataFrame([(k, "w")], SCHEMA) for k in range(6)]
    threads = [threading.Thread(target=lambda f=f: seen.append(published.replace(f, target).number)) for f in frames]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(seen) == [1, 2, 3, 4, 5, 6]
    assert published.read(spark, target).count() == 1


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as fh:
        fh.write(text)


def test_bad_file_keeps_the_loaded_table(spark, tmp_path):
    put(f"{tmp_path}/in", "a.csv", "id,name\n1,a\n2,b\n")
    spec, target = LoadSpec("t", f"{tmp_path}/in", SCHEMA), f"{tmp_path}/out"
    assert L.load_tables(spark, [spec], target).first().status == "loaded"
    put(f"{tmp_path}/in", "a.csv", "id,name\n1,a\nnot a number,b\n")
    assert L.load_tables(spark, [spec], target).first().status == "failed"
    assert rows(published.read(spark, f"{target}/t")) == [(1, "a"), (2, "b")]


def test_run_stopped_halfway_shows_nothing(spark, tmp_path, monkeypatch):
    for k in range(4):
        put(f"{tmp_path}/landing", f"{k}.csv", f"name,id\nn,{k}\n" if k % 2 else f"id,name\n{k},n\n")
    target, ckpt = f"{tmp_path}/t", f"{tmp_path}/ckpt"
    published.replace(spark.createDataFrame([(99, "before")], SCHEMA), target)
    schema = published.current(spark, target).schema
    made, real = [], C._writer

    def stopping(*args):
        write = real(*args)

        def some(batch, batch_id):
            if batch_id == 2 and not made:
                made.append(batch_id)
                raise RuntimeError("stopped")
            write(batch, batch_id)

        return some

    monkeypatch.setattr(C, "_writer", stopping)
    with pytest.raises(Exception, match="stopped"):
        C.load_in_chunks(spark, f"{tmp_path}/landing", schema, target, ckpt)
    assert rows(C.read_loaded(spark, target)) == [(99, "before")]
    assert len(C.ledger(spark, target, ckpt)) == 2
    assert C.load_in_chunks(spark, f"{tmp_path}/landing", schema, target, ckpt) == 2
    assert rows(C.read_loaded(spark, target)) == [(k, "n") for k in range(4)]
    number = published.current(spark, target).number
    assert C.load_in_chunks(spark, f"{tmp_path}/landing", schema, target, ckpt) == 0
    assert published.current(spark, target).number == number  # nothing new, nothing published
    put(f"{tmp_path}/landing", "4.csv", "id,name\n4,n\n")
    assert C.load_in_chunks(spark, f"{tmp_path}/landing", schema, target, ckpt) == 1
    assert rows(C.read_loaded(spark, target)) == [(k, "n") for k in range(5)]


def test_second_process_builds_nothing_and_changes_rebuild_what_depends_on_them(spark, tmp_path):
    import shutil

    src = "/root/testdata/sf0.001"
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        shutil.copyfile(f"{src}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    tables = ("dim_sellers", "dim_products", "dim_customers", "fct_customer_rfm")

    def fresh():
        """What another process would open: nothing is remembered here."""
        W._OPEN.clear()
        w = W.open_warehouse(spark, str(tmp_path))
        got = {t: w.table(t) for t in tables}
        return w, {t: sorted(map(tuple, df.collect()), key=str) for t, df in got.items()}

    first, want = fresh()
    assert set(tables) <= set(first.made)
    second, again = fresh()
    assert second is not first and second.made == [] and again == want
    before = rows(first.table("dim_sellers"))
    spark.read.parquet(f"{src}/supplier.parquet").limit(3).toPandas().to_parquet(f"{tmp_path}/supplier.parquet")
    third, changed = fresh()
    assert sorted(third.made) == ["dim_sellers", "raw/sellers"]
    assert len(changed["dim_sellers"]) == 3 and changed["fct_customer_rfm"] == want["fct_customer_rfm"]
    assert rows(first.table("dim_sellers")) == before  # a reader of the older table goes on
    third.drop()


def test_parts_are_published_together_and_their_measures_add_up(spark, tmp_path):
    target = str(tmp_path / "parts")
    asked = {"n": F.count_if(F.col("id") > 1), "amount": F.sum(F.col("id").cast("decimal(18,4)"))}
    parts = [spark.createDataFrame(rows, SCHEMA) for rows in ([(1, "a"), (2, "b")], [], [(3, "c")])]
    now = published.replace(parts, target, measures=asked)
    assert len(now.folders) == 3 and now.rows == 3 and now.info["measures"] == {"n": "2", "amount": "6.0000"}
    assert sorted(r.id for r in published.read(spark, target).collect()) == [1, 2, 3]
    assert [p.count() for p in published.read_parts(spark, target, now)] == [2, 0, 1]
    empty = published.replace([parts[1], parts[1]], target, measures=asked)
    assert empty.info["measures"] == {"n": "0", "amount": None} and published.read(spark, target).isEmpty()
    with pytest.raises(Exception, match="broken"):
        published.replace([parts[0], failing(spark)], target)
    assert published.current(spark, target).number == empty.number  # the part that was written is not shown
