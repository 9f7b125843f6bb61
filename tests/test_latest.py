"""latest_per_key (max-struct aggregate) equals row_number() = 1."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators.latest import latest_per_key


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 5)), st.integers(0, 4)),
                min_size=1, max_size=60))
def test_equals_row_number(spark, rows):
    data = [(k, ts, price, i) for i, (k, ts, price) in enumerate(rows)]
    df = spark.createDataFrame(data, "k long, ts long, price long, id long")
    mine = latest_per_key(df, ["k"], [("ts", True), ("price", True), ("id", False)], ["id"])
    w = Window.partitionBy("k").orderBy(F.col("ts").desc_nulls_last(), F.col("price").desc_nulls_last(),
                                        F.col("id").asc())
    ref = df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("k", "id")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, ref.collect()))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.sampled_from(["a", "b", "c"]), st.integers(0, 2)),
                min_size=1, max_size=50))
def test_mixed_directions_with_string_ids(spark, rows):
    """ts desc, then string id asc, then numeric item asc: two runs, one semi-join."""
    data = [(k, ts, sid, item, i) for i, (k, ts, sid, item) in enumerate(rows)]
    df = spark.createDataFrame(data, "k long, ts long, sid string, item long, id long")
    order = [("ts", True), ("sid", False), ("item", False), ("id", False)]
    mine = latest_per_key(df, ["k"], order, ["id"])
    w = Window.partitionBy("k").orderBy(F.col("ts").desc(), F.col("sid").asc(), F.col("item").asc(), F.col("id").asc())
    ref = df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("k", "id")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, ref.collect()))


def test_runs_of_exact_types_are_one_aggregate(spark):
    """Timestamp and decimal descending before text ascending: no join back, nulls and the ends of the types in their place."""
    df = spark.sql("""SELECT k, CAST(t AS timestamp_ntz) AS t, CAST(p AS decimal(18,4)) AS p, d, n, s, i FROM VALUES
        (1, '1997-01-01 00:00:00', 2, DATE'2000-01-01', 1L, 'b', 1), (1, '1997-01-01 00:00:00', 2, DATE'2000-01-01', 1L, 'a', 2),
        (1, '1997-01-01 00:00:00', NULL, DATE'2000-01-01', 1L, '0', 3), (1, NULL, 9, DATE'2001-01-01', 1L, '0', 4),
        (2, '0001-01-01 00:00:00', -2, NULL, -9223372036854775808L, 'a', 5), (2, '0001-01-01 00:00:00', -2, NULL, 9223372036854775807L, 'z', 6),
        (2, '0001-01-01 00:00:00', -2, NULL, NULL, 'a', 7), (3, NULL, NULL, NULL, NULL, 'x', 8), (3, NULL, NULL, NULL, NULL, NULL, 9),
        (4, '1960-03-01 00:00:00.000001', 1, DATE'1960-01-01', 0L, 'a', 10), (4, '1960-03-01 00:00:00', 1, DATE'1970-01-01', 0L, 'a', 11),
        (NULL, '9999-12-31 23:59:59.999999', 1, DATE'1970-01-01', 0L, 'a', 12), (NULL, '1969-12-31 23:59:59', 1, DATE'1970-01-01', 0L, 'a', 13)
        AS v(k, t, p, d, n, s, i)""")
    for desc in (["t", "p"], ["d", "t"], ["n"], ["d", "n", "p"]):
        order = [(c, True) for c in desc] + [("s", False), ("i", False)]
        mine = latest_per_key(df, ["k"], order, ["i"])
        assert "Join" not in mine._jdf.queryExecution().optimizedPlan().toString()
        w = Window.partitionBy("k").orderBy(*[F.col(c).desc_nulls_last() for c in desc], F.col("s").asc_nulls_first(), F.col("i").asc())
        ref = df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("k", "i")
        assert sorted(map(tuple, mine.collect()), key=str) == sorted(map(tuple, ref.collect()), key=str)


def test_doubles_and_texts_keep_their_own_run(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'b', 1D, 'x'), (1, 'b', 1D, 'w'), (1, 'a', double('NaN'), 'a'), (2, 'a', double('NaN'), 'b'), (2, 'a', 3D, 'a') AS v(k, s, x, i)")
    for first in ("s", "x"):
        mine = latest_per_key(df, ["k"], [(first, True), ("i", False)], ["i"])
        assert "Join" in mine._jdf.queryExecution().optimizedPlan().toString()
        w = Window.partitionBy("k").orderBy(F.col(first).desc(), F.col("i").asc())
        ref = df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("k", "i")
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, ref.collect()))
