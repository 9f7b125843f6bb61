"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

import random

from pyspark.sql import types as T

#: Names that the operators use themselves, as extra columns of the input.
CLASHING = ["node", "score", "sig", "n_words", "keys", "anchors", "text_crc32", "__id", "lost"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng, n, words=400):
    vocab = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "st", "la", "mo")][:words]
    return " ".join(rng.choice(vocab) for _ in range(n))


def near(rng, text, changes):
    w = text.split(" ")
    for k in rng.sample(range(len(w)), changes):
        w[k] = "changed" + str(rng.randrange(1000))
    return " ".join(w)


def corpus(seed=5):
    rng = random.Random(seed)
    line = "This Very Common Line is found in many documents"
    passage = prose(rng, 25)
    base = [prose(rng, rng.choice([1, 3, 4, 9, 30, 60, 120])) for _ in range(20)]
    texts = [None, None, "", "", " \t\n", "a", "a b c", "ab\n\n  \nab", "é" * 30, "ß ü 中文 🙂 " * 9]
    texts += base + base[:5]  # exact copies
    texts += [near(rng, base[k], c) for k in range(20) for c in (1, 2) if len(base[k].split()) > 50]
    texts += [f"{prose(rng, 8)}\n  {line}\t\n{prose(rng, 5)}" for _ in range(6)] + [f"{line}\n{line.upper()}", line.lower()]
    texts += [f"{prose(rng, 12)} {passage} {prose(rng, 12)}" for _ in range(4)]
    texts += [prose(rng, 6000), "x" * 9000, "ab" * 3000 + " " + prose(rng, 10), "=" * 5000 + "\n" + line]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    rows += [(rows[12][0], rows[12][1]), (rows[15][0], "another text of an id that is there twice"), (None, base[3]), (None, "no id here"), (None, None)]
    return rows


def frame(spark, rows, extra=()):
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA).repartition(3)
    from pyspark.sql import functions as F

    for c in extra:
        df = df.withColumn(c, F.lit("kept"))
    return df


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
