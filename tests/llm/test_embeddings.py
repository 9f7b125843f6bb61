"""Epsilon grid order join against all pairs."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from basketry.llm import embeddings


def brute(rows, threshold):
    ok = []
    for _, v, lab in rows:
        good = v is not None and lab is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
        ok.append(np.array(v, float) if good else None)
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = ok[a], ok[b]
            if x is not None and y is not None and len(x) == len(y) and rows[a][2] == rows[b][2] and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for k, r in enumerate(rows):
        ids[find(k)].append(r[0])
    low = {c: min((i for i in some if i is not None), default=None) for c, some in ids.items()}
    return Counter((r[0], n[k], low[find(k)], r[0] == low[find(k)]) for k, r in enumerate(rows))


@pytest.mark.parametrize("block", [2048, 40])
def test_against_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = []
    for k in range(420):
        v = centres[k % 12] + rng.normal(size=8) * (0.08 if k % 3 else 0.3)
        rows.append((k, [float(np.float32(c)) for c in v], int(k % 4 > 0)))
    rows += [(500 + k, rows[7][1], rows[7][2]) for k in range(60)]  # copies
    rows += [(600 + k, (np.array(rows[7][1]) * (1 + 0.001 * rng.normal(size=8))).tolist(), rows[7][2]) for k in range(90)]  # one hot group
    rows += [(700, None, 1), (701, [0.0] * 8, 1), (702, [math.nan] + [1.0] * 7, 1), (703, [None] + [1.0] * 7, 1), (704, [], 1), (705, rows[7][1], None), (706, [1.0, 2.0], 1), (707, [2.0, 4.0], 1), (None, rows[7][1], rows[7][2]), (7, rows[8][1], 1), (7, rows[7][1], rows[7][2]), (708, [math.inf] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 as cid", "'x' as block", "2 as n_links").repartition(3)
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], lab) for i, v, lab in rows]
    out = embeddings.near_duplicates(df, 0.98, block=block).collect()
    want = brute(rows, 0.98)
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == Counter({(a, b, c, a == c): m for (a, b, c, _), m in want.items()})


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embeddings.near_duplicates(none).count() == 0
    only = spark.createDataFrame([(1, None, 1), (2, [1.0], None)], "vec_id bigint, embedding array<float>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(only).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_work_follows_the_rows_at_fixed_density(spark, monkeypatch):
    """Clusters apart from each other: twice the clusters, about twice the vectors dealt to pairs of blocks, and far fewer than whole blocks whose cells overlap in bounds."""
    from pyspark.sql import functions as F

    dealt, whole = [], []
    near = embeddings._near_cells

    def watched(blocked, cs):
        out = near(blocked, cs)
        dealt.append(blocked.join(out, ["block", *cs[:3]]).count())
        boxes = [r for r in blocked.groupBy("block").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{c}") for c in cs for k, f in (("lo", F.min), ("hi", F.max))]).collect()]
        touch = [(a, b) for a in boxes for b in boxes if a.block <= b.block and all(a[f"lo{c}"] <= b[f"hi{c}"] + 1 and b[f"lo{c}"] <= a[f"hi{c}"] + 1 for c in cs)]
        whole.append(sum(a.n + (b.n if a.block < b.block else 0) for a, b in touch))
        return out

    monkeypatch.setattr(embeddings, "_near_cells", watched)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(64, 6))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    for clusters in (32, 64):
        rows = [(k, (centres[k % clusters] + 0.01 * rng.normal(size=6)).tolist(), 1) for k in range(40 * clusters)]
        out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), block=40)
        assert out.agg(F.min("n_links")).first()[0] >= 39
    assert dealt[1] < 3 * dealt[0] and dealt[1] < whole[1] / 2, (dealt, whole)


def test_fewer_directions_than_key_cells(spark):
    rows = [(k, [math.cos(k / 9), math.sin(k / 9)], 1) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    want = brute(rows, 0.98)
    for dims in (1, 2, 3):
        out = embeddings.near_duplicates(df, 0.98, block=7, dims=dims).collect()
        assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == want
