"""keyed_row_number must equal SQL row_number() OVER (PARTITION BY key ORDER BY ...)."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators.rownum import keyed_row_number


def _compare(spark, rows, desc, ranges=None):
    df = spark.createDataFrame(rows, "k long, v long, id long")
    order = [("v", desc), ("id", False)]
    mine = keyed_row_number(df, ["k"], order, "rn", ranges)
    w = Window.partitionBy("k").orderBy(F.col("v").desc() if desc else F.col("v").asc(), F.col("id").asc())
    ref = df.withColumn("rn", F.row_number().over(w))
    a = sorted((r.id, r.rn) for r in mine.collect())
    b = sorted((r.id, r.rn) for r in ref.collect())
    assert a == b
    assert mine.count() == df.count()


def test_hot_key_split_across_ranges(spark):
    # one key holds most rows: it spans many ranges and still numbers 1..n
    rows = [(1 if i % 10 else i, i % 7, i) for i in range(1200)]
    _compare(spark, rows, False, 24)
    _compare(spark, rows, True, 24)


def test_null_keys_and_values(spark):
    rows = [(None if i % 5 == 0 else i % 3, None if i % 4 == 0 else i % 6, i) for i in range(300)]
    _compare(spark, rows, False, 15)
    _compare(spark, rows, True)


def test_two_keys(spark):
    df = spark.createDataFrame([(i % 2, i % 3, i) for i in range(90)], "a long, b long, id long")
    mine = keyed_row_number(df, ["a", "b"], [("id", True)], "rn", ranges=13)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.col("id").desc())))
    assert sorted(map(tuple, mine.select("id", "rn").collect())) == sorted(map(tuple, ref.select("id", "rn").collect()))


@settings(max_examples=10, deadline=None)
@given(
    keys=st.lists(st.integers(min_value=0, max_value=4), min_size=1, max_size=100),
    desc=st.booleans(),
    ranges=st.integers(min_value=1, max_value=20),
)
def test_property_equals_sql_row_number(spark, keys, desc, ranges):
    rows = [(k, (i * 7) % 5, i) for i, k in enumerate(keys)]
    _compare(spark, rows, desc, ranges)


def test_hot_key_rows_spread_over_ranges(spark):
    """A key holding most rows is cut into several ranges of bounded size."""
    from basketry.operators.placed import placed

    n, ranges = 3000, 15
    rows = [(1 if i % 4 else i, i % 11, i) for i in range(n)]  # key 1 holds 3/4 of the rows
    df = spark.createDataFrame(rows, "k long, v long, id long")
    spread, total = placed(df, [("k", False), ("v", False), ("id", False)], ranges)
    hot = [r["count"] for r in spread.filter("k = 1").groupBy("__range").count().collect()]
    assert total.first()["n"] == n
    assert sum(hot) == sum(1 for r in rows if r[0] == 1)
    assert len(hot) >= ranges // 2
    assert max(hot) < 4 * n // ranges


def test_empty_and_one_path(spark):
    """No size switch: one row and no row go through the same steps."""
    for rows in ([], [(1, 2, 3)]):
        _compare(spark, rows, False)


def test_ordinary_keys_by_window_hot_and_null_keys_by_range(spark):
    from basketry.operators.rownum import split_row_number

    rows = [(None if i % 11 == 0 else 1 if i % 3 else i % 40, i % 7, i) for i in range(1200)]
    for some in (rows, [(i % 400, i % 7, i) for i in range(1200)]):
        df = spark.createDataFrame(some, "k long, v long, id long")
        mine = split_row_number(df, "k", [("v", True), ("id", False)], "rn")
        ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.col("v").desc(), "id")))
        assert sorted((r.id, r.rn) for r in mine.collect()) == sorted((r.id, r.rn) for r in ref.collect())


def test_ordinary_keys_are_numbered_by_as_many_tasks_as_asked(spark):
    from basketry.operators.rownum import split_row_number

    df = spark.createDataFrame([(i % 400, i % 7, i) for i in range(1200)], "k long, v long, id long")
    mine = split_row_number(df, "k", [("v", True), ("id", False)], "rn", 11)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.col("v").desc(), "id")))
    assert mine.rdd.getNumPartitions() == 11
    assert sorted((r.id, r.rn) for r in mine.collect()) == sorted((r.id, r.rn) for r in ref.collect())
