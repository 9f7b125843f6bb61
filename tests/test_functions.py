from hypothesis import given, settings, strategies as st

from basketry.functions.columns import f_score, recency_bucket, title_case

TEXT = st.text(alphabet="abcXYZ çãéÉ019-'·.", max_size=20)


@settings(max_examples=10, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_title_case_matches_python(spark, values):
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(title_case("c")).collect()]
    assert got == [v.title() for v in values]


def test_recency_bucket_edges(spark):
    rec = [1, 30, 31, 90, 91, 120, 121, 150, 151, 180, 181]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rec], "r long").select(recency_bucket("r")).collect()]
    assert got == [(x - 1) // 30 * 30 + 1 for x in rec]


def test_f_score_map(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in range(1, 7)], "f long").select(f_score("f")).collect()]
    assert got == [1, 3, 4, 5, 5, 5]
