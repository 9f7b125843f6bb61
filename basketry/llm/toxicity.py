"""Toxicity: a learned weighted lexicon matched by Aho-Corasick on folded text.

Folding: lower case, zero-width characters dropped, homoglyphs (Cyrillic, Greek,
full-width) and digit or sign substitutions mapped to the plain letter,
anything else to one space.  A term is a whole folded word or a word's
beginning, so inflected and compound forms match.  Accents tell words of
many languages apart, so they stay in the terms; a text with accents is matched a
second time without them, against whole words only.

Learning uses labelled rows of ``documents`` only, at most ``max_rows`` of them (by
hash of doc_id; the documented bound).  A term's weight is its smoothed log odds
between toxic and other documents.  A two-word phrase around a term that
is found in harmless documents only is an exception: the term doesn't count there.
A document's matches give four numbers, normalised by its length in
words; a logistic model of them, fitted on the same rows, is the score.
Scoring is one scan with the automaton built once in a worker; no shuffle.

Defined cases: null and empty texts have no match and get the model's base score.
A null doc_id is never held out and never learned from.  Of several labels of one
doc_id the largest counts; null labels are ignored.  With no labelled rows, or
rows of one class only, there is no lexicon and every score is 0.  Repeated rows are scored
each on their own; other columns are carried under ``d_`` names.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS = 20_000
MAX_TERMS = 20_000
_SHORTEST, _LONGEST = 3, 9
_MIN_DOCS, _MIN_WEIGHT = 4, 2.5
_MIN_EVIDENCE = 30.0  # log-likelihood ratio; chance terms among a million candidates stay below it

#: Substitutions folded to plain letters.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
_GLYPHS = {
    "a": "аα", "b": "ьβ", "c": "сϲ", "d": "ԁ", "e": "еєε", "g": "ɡ", "h": "һ", "i": "іιı", "j": "ј", "k": "кκ", "l": "ӏⅼ",
    "m": "мⅿ", "n": "пη", "o": "оοσ", "p": "рρ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υ", "v": "ѵν", "w": "ԝω", "x": "хχ",
    "y": "уγ", "z": "ᴢ",
}
_UNSEEN = "­​‌‍⁠﻿"


def _tables() -> tuple[bytes, dict[int, str]]:
    plain = bytearray(b" " * 256)
    for c in range(ord("a"), ord("z") + 1):
        plain[c] = plain[c - 32] = c
    for c, to in _DIGITS.items():
        plain[ord(c)] = ord(to)
    plain[ord("'")] = ord("'")
    wide = {ord(c): to for to, all_of in _GLYPHS.items() for c in all_of}
    wide |= {0xFF41 + k: chr(ord("a") + k) for k in range(26)}
    wide |= {ord(c): "" for c in _UNSEEN}
    return bytes(plain), wide


_PLAIN, _WIDE = _tables()


class _Fold(dict):
    """Code point -> folded text; unknown letters stay, anything else is a space."""

    def __missing__(self, c: int) -> str:
        out = chr(_PLAIN[c]) if c < 128 else chr(c) if chr(c).isalpha() else " "
        self[c] = out
        return out


_FOLD = _Fold(_WIDE)


def fold(text: str) -> str:
    """Folded words between single spaces, with a space at both ends."""
    if text.isascii():
        folded = text.encode().translate(_PLAIN).decode("ascii")
    else:
        folded = text.lower().translate(_FOLD)
    return f" {' '.join(folded.replace(chr(39), '').split())} "


class _Bare(dict):
    """Letter -> the letter without its accents."""

    def __missing__(self, c: int) -> str:
        out = self[c] = unicodedata.normalize("NFD", chr(c))[0]
        return out


_BARE = _Bare()


def _terms(words: set[str]) -> set[str]:
    """Whole words (`` word ``) and beginnings (`` word``) of every word."""
    out = set()
    for w in words:
        if len(w) >= _SHORTEST:
            out.add(f" {w[:30]} " if len(w) <= 30 else f" {w[:30]}")
            out.update(f" {w[:k]}" for k in range(_SHORTEST, min(len(w), _LONGEST) + 1))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    model: list[float] = field(default_factory=list)

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "model": self.model, "_automaton": None}

    def matches(self, folded: str) -> list[tuple[int, str, float]]:
        """(start, term, weight) of the heaviest term at each word, exceptions left out."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for t, w in self.weights.items():
                self._automaton.add_word(t, (t, w))
            if self.weights:
                self._automaton.make_automaton()
        if not self.weights:
            return []
        best: dict[int, tuple[str, float]] = {}
        for end, (t, w) in self._automaton.iter(folded):
            at = end - len(t) + 1
            if at not in best or w > best[at][1]:
                best[at] = (t, w)
        if not folded.isascii():  # one letter for one: positions stay
            for end, (t, w) in self._automaton.iter(folded.translate(_BARE)):
                if t[-1] == " " and (at := end - len(t) + 1) not in best:
                    best[at] = (t, w)
        return [(at, t, w) for at, (t, w) in sorted(best.items()) if not (self.exceptions and self.exceptions & set(_phrases(folded, at)))]

    def numbers(self, text: str | None) -> list[float]:
        folded = fold(text or "")
        found = [w for _, _, w in self.matches(folded)]
        words = max(1, folded.count(" ") - 1)
        total = sum(found)
        return [1.0, max(found, default=0.0), math.log1p(total), math.log1p(100 * total / words), float(bool(found))]

    def score(self, text: str | None) -> float:
        if not self.model:
            return 0.0
        z = float(np.dot(self.model, self.numbers(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _phrases(folded: str, at: int) -> list[str]:
    """The word at ``at`` with the word before it, and with the word after it."""
    end = folded.find(" ", at + 1)
    before = folded.rfind(" ", 0, at)
    after = folded.find(" ", end + 1)
    return ([folded[before:end + 1]] if before >= 0 else []) + ([folded[at:after + 1]] if after > 0 else [])


def labelled(documents: DataFrame, labels: DataFrame, label: str, fold_of: int, held: int, max_rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled rows out of the learning folds, chosen by hash of doc_id."""
    one = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("y"))
    part = F.pmod(F.crc32(F.col("__id").cast("string").cast("binary")), F.lit(fold_of))
    some = one.where(part != held).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return docs.join(F.broadcast(some), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y")


def held_out(doc_id, fold_of: int, held: int):
    """Whether a row is out of the learning folds; a null doc_id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(fold_of)) == held, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fold_of: int = 5, held: int = 0, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> Lexicon:
    """Terms, exceptions and model from a bounded sample of labelled rows; what comes to the driver is bounded by it too."""
    rows = labelled(documents, labels, label, fold_of, held, max_rows, doc_id, text)

    totals = {r.bad: r.n for r in rows.groupBy((F.col("y") > 0).alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = totals.get(True, 0), totals.get(False, 0)
    if not toxic or not other:
        return Lexicon()

    def count(batches):
        many = Counter(), Counter()

        def counts():
            terms = list(many[0].keys() | many[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([many[y][t] for t in terms], pa.int64()) for y in (1, 0))], ["term", "toxic", "other"])
            many[0].clear()
            many[1].clear()
            return out

        for b in batches:
            for t, y in zip(b.column("text"), b.column("y").to_pylist()):
                many[int(y > 0)].update(_terms(set(fold(t.as_py() or "").split())))
                if len(many[0]) + len(many[1]) > 100_000:  # partial counts: a task holds a bounded number of terms
                    yield counts()
        yield counts()

    counted = rows.mapInArrow(count, "term string, toxic bigint, other bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    weigh = lambda a, b: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1))
    # only terms that pass the tests below are sent (their logarithms may differ in the last digits)
    some = counted.where(F.col("toxic") >= _MIN_DOCS).where(_weight_column(toxic, other) >= _MIN_WEIGHT - 1e-6).where(_evidence_column(toxic, other) >= _MIN_EVIDENCE - 1e-6)
    found = [(r.term, r.toxic, r.other) for r in some.toLocalIterator()]
    found = [x for x in found if _evidence(*x[1:], toxic, other) >= _MIN_EVIDENCE]
    weighed = sorted(((t, weigh(a, b), a) for t, a, b in found), key=lambda x: (-x[1] * math.sqrt(x[2]), x[0]))
    lexicon = Lexicon({t: w for t, w, _ in weighed[:max_terms] if w >= _MIN_WEIGHT})
    lexicon.exceptions = _exceptions(rows, lexicon)
    lexicon.model = _fit(rows, lexicon)
    return lexicon


def _evidence(a: int, b: int, toxic: int, other: int) -> float:
    """Log-likelihood ratio of a term found in ``a`` of the toxic and ``b`` of the other documents."""
    p = (a + b) / (toxic + other)
    cells = ((a, toxic * p), (b, other * p), (toxic - a, toxic * (1 - p)), (other - b, other * (1 - p)))
    return 2 * sum(x * math.log(x / e) for x, e in cells if x > 0 and e > 0)


def _weight_column(toxic: int, other: int):
    """A term's weight from its columns ``toxic`` and ``other``."""
    return F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))


def _evidence_column(toxic: int, other: int):
    """``_evidence`` from the columns ``toxic`` and ``other``."""
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    p = (a + b) / float(toxic + other)
    cells = ((a, toxic * p), (b, other * p), (toxic - a, toxic * (1 - p)), (other - b, other * (1 - p)))
    return 2 * sum((F.when((x > 0) & (e > 0), x * F.log(x / e)).otherwise(0.0) for x, e in cells), F.lit(0.0))


def _exceptions(rows: DataFrame, lexicon: Lexicon) -> set[str]:
    """Two-word phrases around a term found in at least three harmless labelled documents and no toxic one."""

    def count(batches):
        for b in batches:
            out = []
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                folded = fold(t or "")
                for p in {p for at, _, _ in lexicon.matches(folded) for p in _phrases(folded, at)}:
                    out.append((p, int(y > 0)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([y for _, y in out], pa.int64())], ["phrase", "toxic"])

    found = rows.mapInArrow(count, "phrase string, toxic bigint").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    return {r.phrase for r in found.where("toxic = 0 and n >= 3").orderBy(F.desc("n"), "phrase").limit(MAX_TERMS).toLocalIterator()}


def _fit(rows: DataFrame, lexicon: Lexicon) -> list[float]:
    """Logistic regression of the match numbers by Newton's method, lightly regularised."""

    def measure(batches):
        for b in batches:
            xs = [lexicon.numbers(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array([float(y > 0) for y in b.column("y").to_pylist()])], ["x", "y"])

    got = rows.mapInArrow(measure, "x array<double>, y double").groupBy("x").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n")).orderBy("x").collect()
    x = np.array([r.x for r in got])
    hits, n = np.array([r.toxic for r in got]), np.array([r.n for r in got], float)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.1] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge, x.T @ (hits - n * p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def rate(docs: DataFrame, lexicon: Lexicon, text: str = "text", with_text: bool = False) -> DataFrame:
    """Columns of ``docs`` as ``d_<name>`` (without the text unless ``with_text``) and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    base = docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns])
    fields = [f for f in base.schema.fields if with_text or f.name != f"d_{text}"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + (", " if fields else "") + "score double"

    def scan(batches):
        lex = shared.value
        for b in batches:
            for part in (b.slice(k, 500) for k in range(0, len(b), 500)):
                scores = [lex.score(t.as_py()) for t in part.column(f"d_{text}")]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(scores, pa.float64())], [*(f.name for f in fields), "score"])

    return base.mapInArrow(scan, ddl)


def drop_toxic(docs: DataFrame, documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    out = rate(docs, learn(documents, labels), with_text=True).where(F.col("score") < threshold)
    return out.select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = rate(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = out.select(F.col("d_doc_id").alias("doc_id"), "score")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
