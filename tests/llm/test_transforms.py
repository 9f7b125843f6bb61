"""Fill-in-middle, chat formatting and the Merkle manifest against brute force, with exact round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus import CLASHING, SCHEMA, corpus, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.llm import chat, fim, merkle
from basketry.llm.wavelet import WaveletMatrix

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def got(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# fill-in-middle


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 7), max_size=300), st.frozensets(st.integers(0, 7)))
def test_wavelet_counts(classes, wanted):
    a = np.array(classes, np.uint8)
    want = np.concatenate([[0], np.cumsum(np.isin(a, list(wanted)))])
    assert (WaveletMatrix(a, 3).count(np.arange(len(a) + 1), wanted) == want).all()


def fim_rows(rows, units):
    out = Counter()
    for i, t in rows:
        t = t or ""
        parts = units(t)
        n = len(parts)
        h = sha(f"1:{'' if i is None else i}")
        h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
        a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(parts[:a]), "".join(parts[a:z]), "".join(parts[z:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            out[i, n, "plain", None, None, t, t] += 1
        elif h4 % 100 < 20:
            out[i, n, "spm", a, z - a, f"<S>{s}<P>{p}<M>{m}", t] += 1
        else:
            out[i, n, "psm", a, z - a, f"<P>{p}<S>{s}<M>{m}", t] += 1
    return out


def fim_corpus():
    rng = random.Random(3)
    more = ["<P>", "a<S>b", "x<M", "<P<S<M", "<" * 40, ">" * 40, "<S" * 30 + "🙂", "\n\n\n", "one\ntwo\n", "one\n\ntwo", "中\n文🙂\né" * 50, "\x00\x7f\r\n\t"]
    return corpus() + [(1000 + k, t) for k, t in enumerate(more * 6)] + [(3000 + k, prose(rng, 9)) for k in range(80)]


@pytest.mark.parametrize("unit", ["char", "line"])
def test_fill_in_middle(spark, unit):
    rows = fim_corpus()
    out = fim.transform(frame(spark, rows, CLASHING), unit=unit)
    out = out.withColumn("restored", fim.restored(F.col("output"), F.col("form")))
    split = list if unit == "char" else lambda t: t.split("\n")[:-1] and [x + "\n" for x in t.split("\n")[:-1]] + ([t.split("\n")[-1]] if t.split("\n")[-1] else []) or ([t] if t else [])
    want = fim_rows(rows, split)
    assert got(out, "doc_id", "n_units", "form", "prefix_units", "middle_units", "output", "restored") == want
    assert {k[2] for k in want} == {"plain", "psm", "spm"}


def test_fill_in_middle_long_text_and_empty_table(spark):
    rows = [(k, "é🙂a" * 1_200_000) for k in (5, 8)] + [(9, "short")]
    out = fim.transform(frame(spark, rows))
    assert got(out, "doc_id", "n_units", "form", "prefix_units", "middle_units", "output") == Counter({k[:-1]: v for k, v in fim_rows(rows, list).items()})
    assert fim.transform(spark.createDataFrame([], SCHEMA)).count() == 0


# chat


CONTROLS = chat.Template().controls()
PIECES = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "]", " ", "s>", "/INST]", "<\\/s>", "[\\\\INST]", "é🙂", "ok", "\n"]), max_size=8).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "tool", "", "[INST] x", "a [TEXT] b"])


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(ROLES, PIECES), max_size=6))
def test_chat_round_trip(turns):
    codec = chat.Codec(chat.Template())
    segments = [s for k, (r, t) in enumerate(turns) for s in codec.segments(r, t, k == 0)]
    assert codec.parse("".join(t for t, _ in segments)) == turns
    assert [codec.unescape(t) for t, loss in segments if loss] == [t for r, t in turns if r == "assistant"]


def test_chat_templates_that_cannot_be_read_back():
    for mark in ("<a<b>", "x", "<a b>", "<\\a>"):
        with pytest.raises(ValueError):
            chat.Template(turns={"user": chat.Turn(mark, "</s>")})


def test_chat_machine_and_digests(spark):
    probe = "</s>[INST] ok [/INST]"
    talks = {
        1: [("user", "hi"), ("assistant", "Hello [/INST] <\\/s>"), ("user", None), ("assistant", "")],
        2: [("system", "s"), ("user", probe), ("assistant", probe)],
        3: [("assistant", "first"), ("assistant", "second")],
        4: [("user", "a"), ("user", "b"), ("tool", "c"), ("assistant", "é🙂")],
        5: [("user", "long " * 50_000), ("assistant", "x" * 200_000)],
        6: [(["user", "assistant"][k % 2], f"turn {k}") for k in range(5_001)],
        None: [("user", "nobody"), (None, None)],
    }
    rows = [(c, k, r, t, "kept", 0) for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, segments string, pos int").repartition(3)
    out = chat.format_turns(df)
    errors = defaultdict(list)
    texts = defaultdict(str)
    flags = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: (r.conv_id or 0, r.pos)):
        errors[r.conv_id].append(r.error)
        texts[r.conv_id] += "".join(s.text for s in r.segments)
        flags[r.conv_id] += [s.text for s in r.segments if s.loss]
    assert errors[1] == [None] * 4 and errors[2] == [None] * 3 and errors[6] == [None] * 5_001
    assert errors[3] == ["assistant after start", "assistant after assistant"]
    assert errors[4] == [None, "user after user", "tool after user", None]
    assert errors[None] == [None, "no role after user"]
    assert texts[3] == "<s>[OUT] first </s>[OUT] second </s>" and flags[3] == ["first", "second"]
    codec = chat.Codec(chat.Template())
    want = Counter()
    for c, turns in talks.items():
        turns = [(r or "", t or "") for r, t in turns]
        assert codec.parse(texts[c]) == turns
        loss = "".join(t for r, t in turns if r == "assistant")
        want[c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(texts[c]), not any(errors[c])] += 1
    assert got(chat.read_back(out), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid") == want


def test_chat_ties_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    assert [r.segments[1].text for r in sorted(chat.format_turns(df).collect(), key=lambda r: r.pos)] == ["s", "a", "a", "b"]
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0


# Merkle manifest


def field(v):
    s = None if v is None else str(v)
    return "-" if s is None else f"{len(s.encode())}:{s}"


def leaf(row, lowered=False):
    i, source, lang, n, text = row
    text = text.translate(LOW) if lowered and text is not None else text
    return sha("".join(map(field, (i, source, lang, n, text))))


def layers_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k:k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def path_of(layers, at):
    out = []
    for layer in layers[:-1]:
        first = at - at % 8
        out.append(("".join(layer[first:at]), "".join(layer[at + 1:first + 8])))
        at //= 8
    return out


def merkle_rows(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    key = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    trees = {g: layers_of([leaf(r) for r in sorted(groups[g], key=key)]) for g in order}
    top = layers_of([trees[g][-1][0] for g in order])
    out, nodes = Counter(), Counter()
    for k, g in enumerate(order):
        nodes.update((g, level, p, h) for level, layer in enumerate(trees[g]) for p, h in enumerate(layer))
        for p, r in enumerate(sorted(groups[g], key=key)):
            path = path_of(trees[g], p) + path_of(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf(r, bad)
            for a, z in path:
                h = sha(a + h + z)
            out[r[0], leaf(r), trees[g][-1][0], top[-1][0], sha("".join(a + z for a, z in path)), h, h == top[-1][0]] += 1
    return out, nodes


MERKLE = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def merkle_table():
    rng = random.Random(9)
    langs = ["en", "de", None, "ü", "zz", "", "B"]
    rows = [(i, rng.choice(["a", None]), rng.choice(langs), None if t is None else len(t), t) for i, t in corpus()]
    rows += [(10_000 + k, "s", "en", k, f"Text {k}") for k in range(9_000)]  # three blocks of the first round
    rows += [(77, "s", "rep", 1, "Same")] * 70 + [(None, "s", "rep", 1, "Same")] * 9 + [(5, None, "alone", None, None)]
    rows += [(30_000 + k, "s", "x8", 0, "abc"[:k % 4].upper()) for k in range(8)] + [(31_000 + k, "s", "x9", 0, "Q") for k in range(9)]
    return rows


def test_merkle_manifest(spark):
    rows = merkle_table()
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(3)
    for c in ["g", "pos", "n", "leaf", "changed", "hash"]:
        df = df.withColumn(c, F.lit("kept"))
    want, nodes = merkle_rows(rows)
    built = merkle.build(merkle.leaves_of(df), "lang", ["doc_id"])
    assert len(built.rounds) == 2
    out = merkle.proofs(built)
    assert out.columns == MERKLE
    assert got(out, *MERKLE) == want
    assert any(k[-1] for k in want) and any(not k[-1] for k in want)
    assert got(merkle.manifest(df), "lang", "level", "pos", "hash") == nodes


def test_merkle_many_groups(spark):
    rows = [(k, "s", f"g{k % 4_500}", k, f"T{k}") for k in range(5_000)]  # more subroots than a block
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(3)
    assert got(merkle.proofs(merkle.build(merkle.leaves_of(df), "lang", ["doc_id"])), *MERKLE) == merkle_rows(rows)[0]


def test_merkle_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert merkle.proofs(merkle.build(merkle.leaves_of(df), "lang", ["doc_id"])).count() == 0


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 100, 600])
def test_versions_share_untouched_nodes(n):
    tree = merkle.Tree([sha(str(k)) for k in range(n)], merkle.levels(n))
    before = [list(layer) for layer in tree.layers]
    for at in {0, n // 2, n - 1}:
        v = merkle.Version(tree, at, sha("new"))
        fresh = merkle.Tree([sha("new") if k == at else sha(str(k)) for k in range(n)], merkle.levels(n))
        assert [[v.node(k, i) for i in range(len(layer))] for k, layer in enumerate(tree.layers)] == fresh.layers
        assert len(v.copies) == len(tree.layers) and v.top == fresh.layers[-1][0]
    assert tree.layers == before
