"""global_ntile must equal SQL ntile over the whole frame."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators.ntile import global_ntile


def _compare(spark, rows, tiles, desc, ranges=None):
    df = spark.createDataFrame(rows, "k long, id long")
    order = [("k", desc), ("id", False)]
    mine = global_ntile(df, tiles, order, "t", ranges)
    w = Window.orderBy(F.col("k").desc() if desc else F.col("k").asc(), F.col("id").asc())
    ref = df.withColumn("t", F.ntile(tiles).over(w))
    a = sorted((r.id, r.t) for r in mine.collect())
    b = sorted((r.id, r.t) for r in ref.collect())
    assert a == b


def test_small_sizes(spark):
    for n in (1, 3, 4, 5, 6, 7, 13):
        rows = [(i % 3, i) for i in range(n)]
        _compare(spark, rows, 5, False, 4)
        _compare(spark, rows, 5, True)


def test_all_tied_keys_split_across_ranges(spark):
    rows = [(7, i) for i in range(1500)]
    _compare(spark, rows, 5, True, 15)


def test_null_keys(spark):
    rows = [(None if i % 4 == 0 else i % 9, i) for i in range(200)]
    _compare(spark, rows, 5, False, 7)
    _compare(spark, rows, 5, True, 7)


@settings(max_examples=12, deadline=None)
@given(
    keys=st.lists(st.integers(min_value=0, max_value=6), min_size=1, max_size=120),
    tiles=st.integers(min_value=1, max_value=7),
    desc=st.booleans(),
    ranges=st.integers(min_value=1, max_value=20),
)
def test_property_equals_sql_ntile(spark, keys, tiles, desc, ranges):
    rows = [(k, i) for i, k in enumerate(keys)]
    _compare(spark, rows, tiles, desc, ranges)


def test_refinement_over_many_rounds(spark):
    """A sample far smaller than the table: brackets shrink by counting until one holds the row."""
    n = 20_000
    df = spark.range(n, numPartitions=8).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), "id")
    for key, desc in (("k", True),):
        order = [(key, desc), ("id", False)]
        ref = df.withColumn("t", F.ntile(5).over(Window.orderBy(F.col(key).desc() if desc else F.col(key).asc(), "id")))
        mine = global_ntile(df, 5, order, "u", sample=128)
        assert ref.join(mine, ["k", "id"]).where("t <> u").count() == 0 and mine.count() == n


def test_no_sort_no_shuffle(spark):
    from basketry.operators.ntile import global_ntiles

    df = spark.range(5_000).select(F.lit(3).alias("k"), F.col("id").cast("string").alias("id"))
    out = global_ntiles(df, 5, {"a": [("k", True), ("id", False)], "b": [("id", True)]}, sample=300)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "Window" not in plan
    ref = df.withColumn("x", F.ntile(5).over(Window.orderBy(F.col("k").desc(), "id"))).withColumn("y", F.ntile(5).over(Window.orderBy(F.col("id").desc())))
    assert out.join(ref, "id").where("a <> x or b <> y").count() == 0


def test_hot_key_and_extreme_values(spark):
    rows = [(0, i) for i in range(900)] + [(None, 1000 + i) for i in range(300)] + [(-5, 2000), (9, 2001), (10**12, 2002)]
    for desc in (False, True):
        _compare(spark, rows, 5, desc, 30)


def test_empty_frame(spark):
    assert global_ntile(spark.createDataFrame([], "k long, id long"), 5, [("k", False), ("id", False)], "t").count() == 0
