"""Learned scores: held-out accuracy, what they must not use, and the awkward cases."""

import random
import zlib

from corpus import CLASHING, corpus, frame, prose
from pyspark.sql import functions as F

from basketry.llm import quality, toxicity

WORDS = ["vilewort", "scumfoo", "trashbar"]


def labelled(spark, n=900, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic, good = rng.random() < 0.2, rng.random() < 0.7
        words = prose(rng, rng.randint(30, 90)).split()
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w = rng.choice(WORDS)
                words.insert(rng.randrange(len(words)), rng.choice([w, w.upper(), w.replace("o", "0"), w.replace("a", "а")]))
        text = " ".join(words) if good else " | ".join(words)
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = labelled(spark)
    docs, lab = frame(spark, rows, CLASHING), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    lexicon = toxicity.learn(docs, lab)
    truth = {i: t for i, _, t in labels}
    out = toxicity.rate(docs, lexicon).select("d_doc_id", "score", toxicity.held_out(F.col("d_doc_id"), 5, 0).alias("held")).collect()
    held = [r for r in out if r.held]
    assert {r.d_doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum((r.score >= 0.5) == bool(truth[r.d_doc_id]) for r in held) / len(held) > 0.95
    left = toxicity.drop_toxic(docs, docs, lab)
    assert left.columns == docs.columns and left.count() == sum(r.score < 0.5 for r in out)


def test_toxicity_folds_and_excepts():
    assert toxicity.fold("ІDI0T, 5tupid​ ｌoser!") == " idiot stupid loser "
    lex = toxicity.Lexicon({" trash ": 5.0, " lo": 3.0}, {" trash can "}, [-2.0, 1.0, 0.0, 0.0, 0.0])
    assert [t for _, t, _ in lex.matches(toxicity.fold("the trash can, TR4SH loony bálo lo"))] == [" trash ", " lo", " lo"]
    assert lex.score("trásh") > 0.9 > 0.2 > lex.score("a trash can") and lex.score(None) == lex.score("")


def test_quality_held_out(spark):
    rows, labels = labelled(spark, seed=4)
    docs, lab = frame(spark, rows, CLASHING), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = quality.rate(docs, quality.learn(docs, lab)).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held) / len(held) > 0.95


def test_scores_of_awkward_rows(spark):
    rows, labels = labelled(spark, 300)
    odd = corpus()
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (100_000, 0, 1)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, rows, ["y", "x"])
    more = frame(spark, odd, CLASHING)
    for out in (quality.rate(more, quality.learn(docs, lab)), toxicity.rate(more, toxicity.learn(docs, lab))):
        got = out.collect()
        assert len(got) == len(odd) and all(r.score is not None and 0 <= r.score <= 1 for r in got)


def test_without_labels(spark):
    docs = frame(spark, corpus()[:8])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(k, 1, 0) for k in range(80)], "doc_id bigint, quality int, toxic int")
    for lab in (none, one):
        assert {r.score for r in toxicity.rate(docs, toxicity.learn(docs, lab)).collect()} == {0.0}
        assert {r.score for r in quality.rate(docs, quality.learn(docs, lab)).collect()} == {0.5}
    empty = frame(spark, [])
    assert quality.rate(empty, None).count() == toxicity.rate(empty, toxicity.learn(empty, none)).count() == 0


def test_toxicity_of_rare_labels(spark):
    """One label in fifty is toxic: a term of 20 toxic and 78 other documents weighs 2.5, though fewer toxic ones have it."""
    docs, labels = [], []
    for i in range(20_000):
        toxic = i < 400
        word = "vilewort" if i < 20 or 400 <= i < 478 else "scumfoo" if i < 120 or 500 <= i < 650 else "plain"
        docs.append((i, f"some {word} text"))
        labels.append((i, 1, int(toxic)))
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    weights = toxicity.learn(frame(spark, docs), lab, fold_of=1, held=1).weights
    assert 2.5 <= weights[" vilewort "] < weights[" scumfoo "] and " plain " not in weights


def test_quality_learns_from_every_labelled_row(spark):
    """25,000 rows, all in the blocks of the fit, with both labels (a sample stopped at 20,000)."""
    rows = [(i, "one | two | three" if i % 200 == 0 else f"plain words of text {i % 7}") for i in range(25_000)]
    lab = spark.createDataFrame([(i, int(i % 200 != 0)) for i, _ in rows], "doc_id bigint, quality int")
    seen = []
    kept = quality._newton_sums
    quality._newton_sums = lambda blocks, edges, w: (seen or seen.append(blocks.selectExpr(
        "sum(length(good)) g", "sum(length(bad)) b", "count(*) n").first())) and None or kept(blocks, edges, w)
    try:
        out = quality.rate(frame(spark, rows), quality.learn(frame(spark, rows), lab, fold_of=1, held=1))
    finally:
        quality._newton_sums = kept
    width = len(quality.FEATURES)
    assert (seen[0].g, seen[0].b, seen[0].n) == ((25_000 - 125) * width, 125 * width, 7)
    assert {r.predicted for r in out.where("doc_id % 200 = 0").selectExpr("int(score >= 0.5) predicted").collect()} == {0}
