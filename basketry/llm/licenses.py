"""License scans: Aho-Corasick over normalised words, and a shunting-yard parser for licence expressions.

A text's words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Joined
by single spaces they form one string, over which one automaton finds the
notice phrases and the identifier tag (``spdx license identifier``) in one pass.
At a tag the expression behind it is read from the text itself, split into
identifiers, AND, OR, WITH and brackets, and parsed by shunting-yard
(WITH binds closer than AND, AND closer than OR).  It is evaluated to the
licence families it names and to an obligation: OR takes the milder side, AND the
stricter one, WITH keeps its licence.  Labels added: the families, and
``expr-<obligation>``.  An expression that doesn't parse adds ``expr-unknown`` and
the families of its identifiers.

The score is the certainty that the text holds licence matter: 1 - product of
(1 - weight) over the distinct labels found, tags weighing more than phrases.

Defined cases: a null or empty text has no words and no labels, score 0.  Repeated rows
and null doc_ids are rated each on their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import text as tx

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "bsd license": "bsd", "isc license": "isc", "eclipse public license": "epl", "creative commons attribution": "cc-by",
    "all rights reserved": "reserved", "licensed under the": "licensed", "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd", "public domain": "public-domain",
}
TAG = "spdx license identifier"
#: Identifier beginnings, their family and their obligation.
FAMILIES = [
    ("agpl", "agpl", 3), ("lgpl", "lgpl", 2), ("gpl", "gpl", 3), ("mpl", "mpl", 2), ("epl", "epl", 2), ("apache", "apache", 1), ("mit", "mit", 1),
    ("bsd", "bsd", 1), ("isc", "isc", 1), ("cc-by-sa", "cc-by-sa", 2), ("cc-by", "cc-by", 1), ("cc0", "cc0", 0), ("unlicense", "unlicense", 0), ("zlib", "zlib", 1),
]
OBLIGATIONS = ["public", "permissive", "weak-copyleft", "copyleft"]
_WEIGHT = {"phrase": 0.6, "notice": 0.5, "tag": 0.9}
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}

_CLASS = bytes(b if tx.ALNUM[b] else 0x20 for b in range(256))


def family(identifier: str) -> tuple[str | None, int | None]:
    low = identifier.lower()
    return next(((name, degree) for start, name, degree in FAMILIES if low.startswith(start)), (None, None))


def parse(tokens: list[str]) -> list[str] | None:
    """Reverse Polish form of an expression by shunting-yard; None if it is malformed."""
    out, ops = [], []
    operand = True  # whether an operand may come next
    for t in tokens:
        low = t.lower()
        if low in _BINDS:
            if operand:
                return None
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif t == "(":
            if not operand:
                return None
            ops.append(t)
        elif t == ")":
            if operand:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(rpn: list[str]) -> tuple[set[str], int | None]:
    """(families, obligation) of a parsed expression."""
    stack: list[tuple[set[str], int | None]] = []
    for t in rpn:
        if t not in _BINDS:
            name, degree = family(t)
            stack.append(({name} if name else set(), degree))
            continue
        b, a = stack.pop(), stack.pop()
        if t == "with":
            stack.append(a)
            continue
        known = [d for d in (a[1], b[1]) if d is not None]
        pick = None if len(known) < 2 and t == "and" or not known else (max if t == "and" else min)(known)
        stack.append((a[0] | b[0], pick))
    return stack[0]


def expression(line: str) -> tuple[set[str], str]:
    """Families and ``expr-`` label of the expression at the start of a line: the longest part of it that parses."""
    tokens: list[str] = []
    end = 0
    for m in _TOKEN.finditer(line):
        if line[end:m.start()].strip():
            break  # something that is no part of an expression
        t, end = m.group(), m.end()
        word = t not in "()" and t.lower() not in _BINDS
        after_operand = bool(tokens) and tokens[-1] != "(" and tokens[-1].lower() not in _BINDS
        if after_operand and (word or t == "("):
            break  # two operands in a row: the expression is over
        tokens.append(t.rstrip(".:") if word else t)
    for size in range(len(tokens), 0, -1):
        rpn = parse(tokens[:size])
        if rpn:
            names, degree = evaluate(rpn)
            return names, f"expr-{OBLIGATIONS[degree]}" if degree is not None else "expr-unknown"
    return {n for n in (family(t)[0] for t in tokens) if n}, "expr-unknown"


class Scanner:
    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        for phrase, label in NOTICES.items():
            self.automaton.add_word(f" {phrase} ", ("notice", label, len(phrase) + 2))
        for phrase, label in BASE.items():
            self.automaton.add_word(f" {phrase} ", ("phrase", label, len(phrase) + 2))
        self.automaton.add_word(f" {TAG} ", ("tag", "", len(TAG) + 2))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score)."""
        raw = (text or "").encode()
        words = raw.translate(tx.LOWER_TABLE).translate(_CLASS).split()
        if not words:
            return 0, 0, None, None, "", "", 0.0
        joined = f" {b' '.join(words).decode('latin-1')} "  # one character for each byte: words stay apart
        base, starts, labels, tags = set(), [], {}, 0
        at = here = 0  # words before the character ``here``
        for end, (kind, label, size) in self.automaton.iter(joined):
            start = end - size + 1
            at += joined.count(" ", here, start) if start >= here else -joined.count(" ", start, here)
            here = start
            if kind == "phrase":
                starts.append(at)
                base.add(label)
            if kind == "tag":
                tags += 1
            else:
                labels[label] = max(labels.get(label, 0.0), _WEIGHT[kind])
        if tags:
            for m in _TAG_LINE.finditer(text):
                names, verdict = expression(m.group(1))
                for n in (*names, verdict):
                    labels[n] = max(labels.get(n, 0.0), _WEIGHT["tag"])
        score = 1.0 - float(np.prod([1 - w for w in labels.values()])) if labels else 0.0
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


#: The tag as the words "spdx license identifier" with what follows on its line.
_TAG_LINE = re.compile(r"(?i)(?<![a-z0-9])spdx[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+license[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+identifier[ \t]*:?[ \t]*([^\r\n]*)")
_OUT = [("n_words", "bigint", pa.int64()), ("n_base", "bigint", pa.int64()), ("first_word", "bigint", pa.int64()), ("last_word", "bigint", pa.int64()), ("base_labels", "string", pa.string()), ("labels", "string", pa.string()), ("score", "double", pa.float64())]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row; one scan, no shuffle."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        scanner = Scanner()
        for b in batches:
            found = [scanner.scan(t.as_py()) for t in b.column("text")]
            cols = list(zip(*found)) or [[]] * len(_OUT)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, kind) for c, (_, _, kind) in zip(cols, _OUT))], ["doc_id", *(n for n, _, _ in _OUT)])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k, _ in _OUT))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
