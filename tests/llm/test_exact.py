"""Operators with one right answer, against brute force over a corpus of awkward cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from corpus import CLASHING, corpus, frame, prose
from pyspark.sql import functions as F

from basketry.llm import bpe, decontaminate, jaccard, licenses, lines, repeats, sharding

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return (t or "").translate(LOW)


def sha(b):
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def got(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows, CLASHING).cache()


def drops(rows, min_chars=20, min_docs=3):
    """Keys and the document that keeps each: (key, doc_id)."""
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(LOW)
            if len(key) >= min_chars:
                held[key].add(-1 if i is None else i)
    return {k: max(ids) for k, ids in held.items() if len(ids) >= min_docs}


def kept_lines(rows, i, t):
    keep = drops(rows)
    ls = (t or "").split("\n")
    return ls, [x for x in ls if keep.get(x.strip(" \t\n\x0b\x0c\r").translate(LOW), -2) in (-2, -1 if i is None else i)]


def test_line_dedup(docs, rows):
    out = lines.dedup(docs, with_text=False)
    want = Counter()
    for i, t in rows:
        ls, stay = kept_lines(rows, i, t)
        want[i, len(ls), len(ls) - len(stay), sha("\n".join(stay))] += 1
    assert got(out, "d_doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert any(k[2] for k in want)


def test_line_dedup_keeps_columns(docs, rows):
    out = lines.drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert got(out, "doc_id", "text", "n_chars", "node") == Counter((i, t if t is None else "\n".join(kept_lines(rows, i, t)[1]), None if t is None else len("\n".join(kept_lines(rows, i, t)[1])), "kept") for i, t in rows)


def links(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return sets, [find(x) for x in range(len(rows))]


@pytest.mark.parametrize("n,percent,group_bytes", [(4, 85, 64 << 20), (5, 80, 64 << 20), (5, 80, 2_000)])
def test_jaccard_components(docs, rows, n, percent, group_bytes):
    sets, comp = links(rows, n, percent)
    ids = defaultdict(list)
    for (i, _), c in zip(rows, comp):
        ids[c].append(i)
    smallest = {c: min((i for i in some if i is not None), default=None) for c, some in ids.items()}
    want = Counter((i, len(s), smallest[c]) for (i, _), s, c in zip(rows, sets, comp))
    assert got(jaccard.link_components(docs, n, percent, group_bytes=group_bytes), "doc_id", "n_shingles", "component_id") == want
    assert max(Counter(comp).values()) >= 3


def test_jaccard_keeps_one_of_each(docs, rows):
    _, comp = links(rows, 5, 80)
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    kept = Counter(comp[rows.index((r.doc_id, r.text))] for r in out.select("doc_id", "text").distinct().collect())
    assert set(kept) == set(comp) and set(kept.values()) == {1}


def test_jaccard_shingles_small_slices(spark):
    """What a task holds to shingle a batch doesn't grow with the batch, and Spark reads texts in short column vectors."""
    import random
    import tracemalloc

    import pyarrow as pa

    text = prose(random.Random(4), 5_000)
    batch = pa.RecordBatch.from_pydict({"text": [text] * (4_000_000 // len(text))})
    tracemalloc.start()
    firsts = [f for _, _, f in jaccard._doc_shingles([batch], 4, "text")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(f) - 1 for f in firsts) == batch.num_rows
    assert peak < 40 << 20, peak
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def thue_morse(bits):
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_jaccard_long_words(spark):
    """Words of which any polynomial hash modulo a power of two is equal."""
    rows = []
    for bits in (3, 5, 8, 10, 11, 12):
        w = thue_morse(bits)
        rows += [(len(rows), w), (len(rows) + 1, w.translate(str.maketrans("ab", "ba")))]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(frame(spark, rows)).collect()}
    assert out == {i: (1, i) for i, _ in rows}
    together = frame(spark, [(1, " x y z ".join(w for _, w in rows))])
    assert jaccard.link_components(together, n=1).collect()[0].n_shingles == len(rows) + 3


def chained(rng):
    """Long chains of near copies, each linked to its neighbours only, in one coarse component with bystanders."""
    rows, base = [], prose(rng, 130).split(" ")
    for chain in range(3):
        words = list(base[:30]) + prose(rng, 100).split(" ")
        for step in range(25):
            words[35 + 3 * step % 90] = f"new{chain}x{step}"
            rows.append((1000 * chain + step, " ".join(words)))
    rows += [(5000 + k, " ".join(base[:30] + prose(rng, 90).split(" "))) for k in range(25)]
    return rows


@pytest.mark.parametrize("group_bytes", [64 << 20, 20_000, 3_000])
def test_jaccard_chains_in_large_components(spark, group_bytes):
    import random

    rows = chained(random.Random(12))
    sets, comp = links(rows, 4, 85)
    smallest = defaultdict(lambda: 1 << 60)
    for (i, _), c in zip(rows, comp):
        smallest[c] = min(smallest[c], i)
    want = Counter((i, len(s), smallest[c]) for (i, _), s, c in zip(rows, sets, comp))
    docs = frame(spark, rows + rows[:40])
    assert got(jaccard.link_components(docs, group_bytes=group_bytes), "doc_id", "n_shingles", "component_id") == want + Counter({k: 1 for k in list(want)[:40]})
    assert max(Counter(comp).values()) == 25


def test_jaccard_repeated_rows(spark):
    """A third of all rows are one row, or have no id."""
    import random

    rng = random.Random(4)
    same, near = prose(rng, 60), prose(rng, 60)
    rows = [(7, same)] * 200 + [(None, near)] * 100 + [(k, near + f" {k}") for k in range(20, 50)] + [(100 + k, prose(rng, 50)) for k in range(200)]
    out = Counter((r.doc_id, r.component_id) for r in jaccard.link_components(frame(spark, rows)).collect())
    assert out[7, 7] == 200 and out[None, 20] == 100 and all(out[k, 20] == 1 for k in range(20, 50)) and all(out[100 + k, 100 + k] == 1 for k in range(200))


@pytest.mark.parametrize("max_windows", [200_000, 5])
def test_decontamination(spark, docs, rows, max_windows):
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[0].split()[3:18])), (2, texts[1]), (3, "Changed a"), (4, None), (5, " ,. "), (10, texts[0].upper()), (3, "Changed a"), (7, "no such words " * 5), (None, texts[2]), (None, texts[4])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k:k + 10])].add(i)
    want = Counter()
    for i, t in rows:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if s := windows.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    found |= s
        want[i, len(w), len(hit), len(found), sha(",".join(sorted(str(x) for x in found if x is not None))), bool(hit)] += 1
    cols = ("d_doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(decontaminate.rate(docs.drop("n_words"), bench, max_windows=max_windows), *cols) == want
    assert any(k[3] == 1 and k[2] and k[4] == sha("") for k in want)  # hit by an item without an id only
    assert got(decontaminate.rate(docs.drop("n_words"), bench, max_windows=20), *cols) == want  # the benchmark in many parts
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[-1]) < len(rows)


@pytest.mark.parametrize("memory", [256 << 20, 1000])
def test_suffix_array_dedup(docs, rows, memory):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k:k + 50]
            first[s] = min(first.get(s, 1 << 62), -1 if i is None else i)
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < (-1 if i is None else i):
                gone[k:k + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone) if not y)
        want[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)] += 1
    assert got(repeats.remove_repeats(docs, memory=memory), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_sharding(docs, rows):
    out = sharding.assign(docs, shards=7, vnodes=5).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    counts = [len(by[k]) for k in range(7)]
    assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sharding_moves_little(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text")
    a = {r.doc_id: r.shard for r in sharding.assign(docs, shards=8, load_factor=1.25).collect()}
    more = {r.doc_id: r.shard for r in sharding.assign(docs.unionAll(docs.selectExpr("doc_id + 4000 as doc_id", "text").limit(100)), shards=8, load_factor=1.25).collect()}
    assert max(Counter(a.values()).values()) <= -(-5000 // 8)
    assert sum(a[i] != more[i] for i in a) < 200


def test_line_dedup_with_several_small_filters(spark, docs, rows, monkeypatch):
    """Keys dealt by hash over three filters of 2**18 bits: the same result."""
    whole = got(lines.dedup(docs, with_text=False), "d_doc_id", "n_lines", "n_dropped", "kept_sha256")
    monkeypatch.setattr(lines, "filters_for", lambda n: [lines.Share(k, 3, 18) for k in range(3)])
    assert got(lines.dedup(docs, with_text=False), "d_doc_id", "n_lines", "n_dropped", "kept_sha256") == whole


def test_filters_follow_the_keys(spark, monkeypatch):
    assert lines.filters_for(0) == [lines.Share(0, 1, 27)] and lines.filters_for(100_000_000) == [lines.Share(0, 1, 30)]
    many = lines.filters_for(1_400_000_000)  # the bound of 30 GB
    assert len(many) == 8 and {s.bits for s in many} == {30} and [s.part for s in many] == list(range(8))
    # as many unique lines as a filter is made for: few are suspected
    monkeypatch.setattr(lines, "MIN_FILTER_BITS", 18)
    monkeypatch.setattr(lines, "MAX_FILTER_BITS", 18)
    n = int(2 ** 18 / lines.BITS_A_KEY) * 2
    one = [(k, "\n".join(f"unique line number {k * 100 + j:08d}" for j in range(100))) for k in range(n // 100)]
    docs = spark.createDataFrame(one, "doc_id bigint, text string").repartition(6).selectExpr("*", "1L as same")
    made = lines.shares(docs, 20, "text")
    assert [(s.of, s.bits) for s in made] in ([(2, 18)] * 2, [(3, 18)] * 3)
    found = sum(lines.suspects(docs, 20, s).count() for s in made)
    assert 0 < found < 0.1 * n


def test_rows_without_an_id_get_their_own_keys(spark):
    """A third of the rows has no id, another third one id: no list of keys is longer than a text has lines."""
    line = [f"a line of over twenty characters {k}" for k in range(90)]
    more = [(None, line[k]) for k in range(30)] + [(5, line[k]) for k in range(30)] + [(10 + k % 3, line[k // 3]) for k in range(90)] + [(None, line[0])] * 40
    docs = frame(spark, more)
    assert lines.losses(docs, 20, 3).selectExpr("max(size(keys)) as n").first().n == 1
    confirmed = spark.createDataFrame([(b"common", 1000)] + [(b"%d" % k, 3) for k in range(300)], "key binary, n bigint")
    hot = lines._hot(confirmed).collect()
    assert [bytes(r[0]) for r in hot] == [b"common"] and hot[0][1] > 4
    want = Counter()
    for i, t in more:
        ls, kept = kept_lines(more, i, t)
        want[i, len(ls), len(ls) - len(kept)] += 1
    assert got(lines.dedup(docs), "d_doc_id", "n_lines", "n_dropped") == want


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_licences(spark, docs, rows):
    more = [(900, "The MIT License, mit  LICENSE.\nCC-BY cc by"), (901, "GNU General\nPublic License apache licensed Apache-License"), (902, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0"),
            (903, "// SPDX-License-Identifier: GPL-3.0-or-later OR"), (904, "spdx license identifier: LGPL-2.1 */ and more")]
    out = licenses.scan(frame(spark, rows + more, CLASHING))
    want = Counter()
    for i, t in rows + more:
        w = ALNUM.findall(low(t))
        at = sorted(k for p in PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
        base = sorted({label for p, label in PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()})
        want[i, len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(base)] += 1
    assert got(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    labels = {r.doc_id: (set(r.labels.split(",")), r.score, set(r.base_labels.split(",")) - {""}) for r in out.where("doc_id >= 900").collect()}
    assert all(base <= got_ for got_, _, base in labels.values()) and all(0 < s <= 1 for _, s, _ in labels.values())
    assert labels[902][0] >= {"mit", "apache", "gpl", "expr-copyleft"} and "expr-copyleft" in labels[903][0] and "expr-weak-copyleft" in labels[904][0]


def test_licence_expressions():
    assert licenses.expression("MIT OR GPL-3.0") == ({"mit", "gpl"}, "expr-permissive")
    assert licenses.expression("MIT AND GPL-3.0 OR CC0-1.0") == ({"mit", "gpl", "cc0"}, "expr-public")
    assert licenses.expression("(MIT") == ({"mit"}, "expr-unknown")
    assert licenses.parse(["a", "or", "b", "and", "c"]) == ["a", "b", "c", "and", "or"]
    assert licenses.parse(["a", "b"]) is None and licenses.parse([")"]) is None


def test_bpe(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    import numpy as np

    tk = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    more = [(950, "a<|endoftext|>b <|endoftext|>"), (951, "中" * 5000 + " tail"), (952, "".join(chr(97 + k * k % 26) for k in range(20000))), (953, " " * 9000 + "x")]
    docs = frame(spark, rows + more, CLASHING)
    want = Counter()
    for i, t in rows + more:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tk.decode(ids, skip_special_tokens=False))] += 1
    assert got(bpe.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = bpe.decode(bpe.encode(docs))
    assert got(back, "doc_id", "decoded") == Counter((i, t or "") for i, t in rows + more)


def test_bpe_joins_agree_with_plain_merging():
    import random

    coder = bpe.Coder(*bpe.read_vocabulary(bpe.default_vocabulary()))
    rng = random.Random(2)
    for alphabet in (b"ab", b"aaab", b"etaoinshr", bytes(range(256))):
        for n in (2, 7, 40, 700, 1500):
            raw = bytes(rng.choice(alphabet) for _ in range(n))
            k = rng.randrange(1, n)
            assert coder.join(coder.merge(raw[:k]), coder.merge(raw[k:])) == coder.merge(raw) == coder.piece(raw)


def test_empty_tables(spark):
    none = frame(spark, [], CLASHING)
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert lines.dedup(none).count() == jaccard.link_components(none).count() == jaccard.one_of_each(none).count() == 0
    assert repeats.remove_repeats(none).count() == sharding.assign(none).count() == licenses.scan(none).count() == bpe.digests(none).count() == 0
    assert decontaminate.rate(none.drop("n_words"), bench).count() == 0
    one = frame(spark, [(1, prose(__import__("random").Random(1), 20))])
    assert decontaminate.rate(one, bench).collect()[0].contaminated is False
    assert jaccard.link_components(one).collect()[0].component_id == 1


def test_hot_groups(spark):
    """A third of all rows are near copies, and one line is in all documents."""
    import random

    rng = random.Random(8)
    text = prose(rng, 120)
    rows = [(k, text.replace(" ", f" w{k} ", 1)) for k in range(300)] + [(1000 + k, prose(rng, 40) + "\nthe one line that all of them have") for k in range(600)]
    docs = frame(spark, rows).withColumn("x", F.lit(1))
    out = {r.doc_id: r.component_id for r in jaccard.link_components(docs).collect()}
    assert all(out[k] == 0 for k in range(300)) and all(out[k] == k for k in range(1000, 1600))
    assert lines.dedup(docs).agg(F.sum("n_dropped")).first()[0] == 599
