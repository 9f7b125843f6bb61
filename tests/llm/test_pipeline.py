"""The pipeline: each stage against brute force on its own input, and run() against the stages one by one."""

import random
from collections import Counter

import numpy as np
import pytest
from corpus import corpus, frame, prose
from test_exact import ALNUM, kept_lines, links, low, sha
from test_learned import WORDS

import corpus_pipeline
from basketry.llm import bpe, toxicity


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(6)
    rows, labels = corpus(), []
    for k in range(300):
        toxic = k % 4 == 0
        words = prose(rng, 40).split()
        if toxic:
            words[rng.randrange(40)] = rng.choice(WORDS)
        rows.append((5000 + k, " ".join(words)))
        labels.append((5000 + k, 1, int(toxic)))
    item = prose(rng, 14)
    rows += [(7000, f"{prose(rng, 20)} {item} {prose(rng, 3)}"), (7001, item.upper())]
    frame(spark, rows).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf_dir, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "bpe"]
    stages = dict(corpus_pipeline.STAGES)
    documents = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def step(name):
        out = stages[name](spark, docs, sf_dir)
        if name != "bpe":
            assert out.dtypes == documents.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}")

    rows = pairs(docs)
    docs = step("toxicity")
    lexicon = toxicity.learn(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert Counter(pairs(docs)) == Counter((i, t) for i, t in rows if lexicon.score(t) < 0.5)
    assert len(rows) - 80 <= docs.count() <= len(rows) - 60

    rows = pairs(docs)
    docs = step("line_dedup")
    want = Counter((i, t if t is None else "\n".join(kept_lines(rows, i, t)[1])) for i, t in rows)
    assert Counter(pairs(docs)) == want != Counter(rows)

    rows = pairs(docs)
    docs = step("jaccard_join")
    _, comp = links(rows, 5, 80)
    kept = set(pairs(docs))
    assert Counter(comp[rows.index(r)] for r in kept) == Counter(set(comp)) and len(kept) < len(set(rows))
    for r in kept:
        group = [i for (i, _), c in zip(rows, comp) if c == comp[rows.index(r)]]
        assert r[0] == min(group, key=lambda i: -1 if i is None else i)

    rows = pairs(docs)
    docs = step("decontamination")
    item = ALNUM.findall(low(spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id = 1").first().text))
    windows = {tuple(item[k:k + 10]) for k in range(len(item) - 9)}
    hit = lambda t: any(tuple(w[k:k + 10]) in windows for w in [ALNUM.findall(low(t))] for k in range(len(w) - 9))
    assert Counter(pairs(docs)) == Counter((i, t) for i, t in rows if not hit(t)) != Counter(rows)

    rows = pairs(docs)
    out = step("bpe")
    tk = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_vocabulary())
    ids = {t: tk.encode(t or "", add_special_tokens=False).ids for _, t in rows}
    want = Counter((i, len(ids[t]), sha(np.array(ids[t], "<u4").tobytes()), sha(t or "")) for i, t in rows)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    assert got == want
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_empty(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
